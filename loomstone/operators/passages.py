"""Which texts hold which passages, whatever a passage's length."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most words, and else most bytes, that a key is made of; bits of the filter of keys (a fixed size of 1 MB); pieces of a busy key.
WORDS, BYTES, BITS, SALT = 6, 8, 1 << 23, 16


def _windows(data: bytes, width: int) -> np.ndarray:
    """A key for each run of width bytes."""
    if width == 0:
        return np.zeros(1, np.uint64)
    raw = np.frombuffer(data, np.uint8)
    n = len(raw) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ raw[i : n + i].astype(np.uint64)
    return out ^ (out >> np.uint64(29))


def _runs(words: list[bytes], width: int) -> np.ndarray:
    """A key for each run of width words."""
    import xxhash

    if len(words) < width:
        return np.zeros(0, np.uint64)
    whole, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1]
    hash_of = xxhash.xxh64_intdigest
    return np.array([hash_of(whole[s:e], width) for s, e in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)


def passage_key(text: str) -> tuple[int, int]:
    """Kind and key of a passage. Kind n > 0: its first n inner words; -n: its first n bytes, as it has no inner word.

    A text that holds a passage holds its inner words whole, between white space of whatever kind.
    """
    data = text.encode("utf-8", "replace")
    inner = data.split()[1:-1]
    if inner:
        n = min(WORDS, len(inner))
        return n, int(_runs(inner[:n], n)[0])
    n = min(BYTES, len(data))
    return -n, int(_windows(data[:n], n)[0])


def text_keys(text: str, kinds: Sequence[int]) -> np.ndarray:
    """The distinct keys of these kinds that stand anywhere in a text."""
    data = text.encode("utf-8", "replace")
    words = data.split() if any(k > 0 for k in kinds) else []
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *[_runs(words, k) if k > 0 else _windows(data, -k) for k in kinds]]))


def contained(docs: DataFrame, id: str, text: str, passages: DataFrame, passage: str, keep: Sequence[str] = ()) -> DataFrame:
    """id, text, the kept columns and passage, for each pair of a text and a distinct passage that stands in it letter by letter.

    One pass over the texts: keys of runs of words (of bytes, for passages of one or two words) are looked up in a filter
    of fixed size that is made of the passages' keys, and only a text with a hit goes on, with its hits. Texts and passages
    then meet by key, in SALT pieces, and the text decides. Null texts and passages are in no pair; an empty passage is in
    every text, so its pairs are as many as the texts.
    """
    spark = docs.sparkSession
    own = passages.select(passage).where(F.col(passage).isNotNull()).distinct()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomstone.operators.passages import passage_key

        for b in batches:
            found = [passage_key(t.as_py()) for t in b.column(0)]
            key = np.array([k for _, k in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k for k, _ in found], pa.int32()), pa.array(key)], ["_passage", "_kind", "_key"])

    wanted = own.mapInArrow(keyed, "_passage string, _kind int, _key long")
    at = F.pmod("_key", F.lit(BITS)) + 1
    # at most 15 kinds, and a filter of BITS bits
    kinds = sorted(r[0] for r in wanted.select("_kind").distinct().collect())
    parts = wanted.groupBy(F.bitmap_bucket_number(at).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    held = np.zeros(BITS // 8, np.uint8)
    for r in parts:
        piece = np.frombuffer(bytes(r["bits"]), np.uint8)
        held[(r["n"] - 1) * 4096 : (r["n"] - 1) * 4096 + len(piece)] = piece
    shared = spark.sparkContext.broadcast(held)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomstone.operators.passages import text_keys

        held = shared.value
        for b in batches:
            hits = []
            for t in b.column(1):
                keys = text_keys(t.as_py(), kinds) if t.is_valid else np.zeros(0, np.uint64)
                place = keys % np.uint64(BITS)
                on = (held[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
                hits.append(keys[on == 1].view(np.int64))
            some = np.array([len(h) > 0 for h in hits], bool)
            rows = pa.RecordBatch.from_arrays([*b.columns, pa.array(hits, pa.list_(pa.int64()))], [*b.schema.names, "_keys"])
            yield rows.filter(pa.array(some))

    columns = [id, text, *keep]
    types = dict(docs.dtypes)
    near = docs.select(*columns).mapInArrow(look, ", ".join(f"`{c}` {types[c]}" for c in columns) + ", _keys array<long>")
    near = near.withColumn("_key", F.explode("_keys")).drop("_keys").withColumn("_salt", F.pmod(F.xxhash64(id), F.lit(SALT)))
    wanted = wanted.select("_passage", "_key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))).alias("_salt"))
    pairs = near.join(wanted, ["_key", "_salt"]).where(F.contains(text, "_passage"))
    return pairs.select(*columns, F.col("_passage").alias(passage))
