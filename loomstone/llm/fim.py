"""Fill-in-the-middle transformation: a text is cut in three and put together in another order, with marks between.

Cuts are drawn in units (tokens: a word with the white space before it; or code points) and applied to UTF-8 bytes. What
turns one kind of place into the other is a sparse index of exceptions: only characters of more than one byte are recorded,
by their place and their excess bytes so far. A place is found among them by bisection, and the rest is arithmetic, so
plain ASCII costs nothing and a text is never decoded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import like, ship

#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class Exceptions:
    """The characters of more than one byte of a text in UTF-8: their places, and the excess bytes before each."""

    def __init__(self, data: np.ndarray):
        self.at_byte = np.flatnonzero(data >= 0xC0)
        lead = data[self.at_byte]
        #: excess[i]: bytes beyond one of the first i of them
        self.excess = np.concatenate(([0], np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0), dtype=np.int64)))
        self.at_char = self.at_byte - self.excess[:-1]
        self.chars = len(data) - int(self.excess[-1])

    def char_of(self, byte: int) -> int:
        """Code points before a byte that begins one (or the end)."""
        return byte - int(self.excess[np.searchsorted(self.at_byte, byte)])

    def byte_of(self, char: int) -> int:
        """Bytes before a code point (or the end)."""
        return char + int(self.excess[np.searchsorted(self.at_char, char)])


def token_ends(data: np.ndarray) -> np.ndarray:
    """The byte after each token: a word with the white space before it; white space at the end is one more."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    after = np.append(space[1:], True)
    ends = np.flatnonzero(~space & after) + 1
    if len(data) and space[-1]:
        ends = np.append(ends, len(data))
    return ends


def draws(seed: int, id: object) -> list[int]:
    """Four numbers of 32 bits, from the SHA-256 of the seed, a colon and the id (nothing, if it is null)."""
    h = hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in range(0, 32, 8)]


def transformed(data: bytes, id: object, seed: int, rate: int, spm: int, unit: str, marks: tuple[bytes, bytes, bytes]) -> tuple:
    """n (units), form, prefix and middle in code points (None if plain), and the new text's bytes."""
    x = np.frombuffer(data, np.uint8)
    h = draws(seed, id)
    if unit == "token":
        ends = token_ends(x)
        n = len(ends)
    else:
        index = Exceptions(x)
        n = index.chars
    if not data or any(m in data for m in marks) or h[2] % 100 >= rate:
        return n, "plain", None, None, data
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if unit == "token":
        a, b = (int(ends[k - 1]) if k else 0 for k in (a, b))
        index = Exceptions(x)
        chars = index.char_of(a), index.char_of(b)
    else:
        chars = a, b
        a, b = index.byte_of(a), index.byte_of(b)
    p, s, m = marks
    if h[3] % 100 < spm:
        return n, "spm", chars[0], chars[1] - chars[0], b"".join((s, data[b:], p, data[:a], m, data[a:b]))
    return n, "psm", chars[0], chars[1] - chars[0], b"".join((p, data[:a], s, data[b:], m, data[a:b]))


def transform(
    docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, unit: str = "token", id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """id, n (units of the text), form (plain, psm or spm), prefix_chars, middle_chars (code points), output, a row per row.

    rate of 100 texts are cut, spm of 100 of these have the suffix first. unit: token or char. The draws depend on seed and
    id alone, so a run can be repeated and rows that repeat an id are cut alike (if their texts are); null ids draw as an
    empty one. Null and empty texts, and those that hold a mark already, are plain. Cuts may meet, so each of the
    parts may be empty. Texts may be of any length; each is held whole by one task, in bytes. Nothing is shuffled. Columns
    other than id and text are ignored; an empty table gives none.
    """
    if unit not in ("token", "char"):
        raise ValueError("unit must be token or char")
    marks = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomstone.llm.fim import transformed

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                ids, texts = b.column(0).to_pylist(), b.column(1).cast(pa.binary())
                rows = [transformed(t.as_py() or b"", i, seed, rate, spm, unit, marks) for i, t in zip(ids, texts, strict=True)]
                n, form, prefix, middle, out = zip(*rows, strict=True)
                columns = [pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    ship(docs.sparkSession)
    schema = f"doc_id {dict(docs.dtypes)[id]}, n long, form string, prefix_chars long, middle_chars long, output string"
    return like(docs, [id, text]).mapInArrow(run, schema).withColumnRenamed("doc_id", id)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of; no mark stands in it, and marks cannot overlap, so they are where they were set."""

    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        head, rest = F.split_part(output, F.lit(first), F.lit(1)), F.split_part(output, F.lit(first), F.lit(2))
        return F.substr(head, F.lit(len(PREFIX) + 1)), F.split_part(rest, F.lit(second), F.lit(1)), F.split_part(rest, F.lit(second), F.lit(2))

    p, s, m = between(SUFFIX, MIDDLE)
    psm = F.concat(p, m, s)
    s, p, m = between(PREFIX, MIDDLE)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(p, m, s)).otherwise(output)


def sha256(text: Column) -> Column:
    """Lowercase hex, of the UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)
