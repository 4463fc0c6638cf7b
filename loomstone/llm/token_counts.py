"""Token counts: a map-side lookup in two tiers, without any shuffle.

A text is cut where a plain space stands between two non-space characters. The byte-level
pre-tokeniser always starts a new pre-token there (the space belongs to what follows), so the
tokens of a text are those of its pieces, one after another. Pieces are looked up in

1. a broadcast hash table of frequent pieces, built once from a bounded sample of rows, then
2. a cache that each Python worker keeps, bounded in entries; what neither has goes to the
   tokeniser in one batch per Arrow batch.

Both tiers only save work: results equal those of encoding each whole text, in every case.
Texts that contain an added token's own string (the tokeniser matches those before it splits)
are encoded whole.
"""

from __future__ import annotations

import base64
import os
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import like, sampled, ship

#: Rows (at most that many characters each) from which the table of frequent pieces is made, and its entries.
SAMPLE_ROWS, SAMPLE_CHARS, FREQUENT = 512, 20_000, 30_000
#: Entries of a worker's cache, and the longest piece that is kept.
CACHED, LONGEST = 800_000, 64

_cut = re.compile(r"(?<=\S)(?= \S)")
_tokenizers: dict = {}
_encoders: dict = {}


def tokenizer(path: str):
    """The tokeniser of a file, once per process, single-threaded."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _tokenizers[path] = t, tuple(x.content for x in t.get_added_tokens_decoder().values())
    return _tokenizers[path]


class Irregular(Exception):
    """A plain space beside other white space: the text has to be cut with more care."""


def encoder(path: str):
    """ids of a piece. Where the same vocabulary lies beside the file as byte ranks, those serve: same ids, less work for each call."""
    whole, _ = tokenizer(path)
    ranks = Path(path).with_suffix(".tiktoken")
    if not (path.endswith(".json") and ranks.exists()):
        return lambda piece: whole.encode(piece, add_special_tokens=False).ids
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.read_bytes().splitlines())}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
    return _encoders[path]


class Cache(dict):
    """Values of what stands after a plain space: the frequent table, and over it what this worker met.

    What is missing is encoded once and kept, until the bound drops all but the frequent.
    """

    def __init__(self, frequent: dict, encode, value_of):
        super().__init__(frequent)
        self.frequent, self.encode, self.value_of = frequent, encode, value_of

    def __missing__(self, piece: str):
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise Irregular
        value = self.value_of(self.encode(" " + piece))
        if len(piece) <= LONGEST:
            if len(self) >= CACHED:
                self.clear()
                self.update(self.frequent)
            self[piece] = value
        return value


class Lookup:
    """value_of(ids) of the pieces of texts."""

    def __init__(self, path: str, frequent: dict, value_of, caches: dict):
        self.whole, self.special = tokenizer(path)
        self.value_of, self.encode = value_of, encoder(path)
        if path not in caches or caches[path].frequent != frequent:
            caches[path] = Cache(frequent, self.encode, value_of)
        self.get = caches[path].__getitem__

    def values(self, text: str | None) -> list:
        """One value for each piece of a text, in order."""
        if not text:
            return []
        own = lambda piece: self.value_of(self.encode(piece))
        if any(s in text for s in self.special):
            return [self.value_of(self.whole.encode(text, add_special_tokens=False).ids)]
        head, *rest = text.split(" ")
        if not rest:
            return [own(text)]
        last = rest.pop()
        try:
            if not head or head[-1].isspace() or last[:1].isspace():
                raise Irregular
            return [own(head), *map(self.get, rest), own(" " + last)]
        except Irregular:
            return [own(p) for p in _cut.split(text)]


def frequent_pieces(docs: DataFrame, text: str = "text") -> list[str]:
    """The commonest pieces of a bounded sample of rows, taken by a hash from all partitions; of each its first SAMPLE_CHARS.

    Counts do not depend on the sample: it only says which pieces are looked up without being encoded.
    """
    own = like(docs, [text]).where(F.col(f"`{text}`").isNotNull())
    some = own.where(sampled("pieces", text, SAMPLE_ROWS, docs.count()))
    sample = some.select(F.substring(F.col(f"`{text}`"), 1, SAMPLE_CHARS)).limit(4 * SAMPLE_ROWS).collect()
    seen: Counter = Counter()
    for (x,) in sample:
        seen.update(p for p in x.split(" ")[1:] if p and len(p) <= LONGEST and not p[0].isspace() and not p[-1].isspace())
    return [p for p, n in seen.most_common(FREQUENT) if n > 1]


def _slices(batch: pa.RecordBatch, column: int, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most about limit bytes of text, or one row."""
    import pyarrow.compute as pc

    sizes, start, total = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist(), 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


_counts: dict = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of each row; a null text counts as empty (0, 0, false).

    Rows keep their partition, repeated rows and ids each give a row, columns other than id and
    text are ignored, an empty table gives an empty result. Nothing is shuffled.
    """
    ship(docs.sparkSession)
    enc, special = tokenizer(path)
    frequent = [p for p in frequent_pieces(docs, text) if not any(s in p for s in special)]
    lengths = {p: len(e.ids) for p, e in zip(frequent, enc.encode_batch_fast([" " + p for p in frequent], add_special_tokens=False), strict=True)}
    tier1 = docs.sparkSession.sparkContext.broadcast(lengths)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomstone.llm import token_counts as here

        look = here.Lookup(path, tier1.value, len, here._counts)
        for whole in batches:
            for b in here._slices(whole, 1):
                texts = b.column(1).to_pylist()
                n = [sum(look.values(t)) for t in texts]
                size = [len(t.encode()) if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)[id]
    return like(docs, [id, text]).mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("doc_id", id)
