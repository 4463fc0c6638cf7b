"""Language identification with a bit-sliced Bloom filter of byte n-grams.

Training counts n-grams of the texts of each language. An n-gram belongs to every language in which
it is at least RATIO times as frequent as in the language that has it most. The filter is one array of
bit masks, a bit per language: an n-gram's mask is ORed in at HASHES places, and a lookup ANDs the
masks there, which gives all languages that contain it at once. A text's hits are counted per
language, corrected for the filter's false positives, and the largest count decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import like, sampled, ship

#: Lengths of the n-grams in bytes; hash places of each; the share of places filled in per language, at most about.
LENGTHS, HASHES, FILL = (3, 4, 5), 3, 0.15
#: Labelled rows to learn from, at most about (a hash of the id picks them); n-grams kept of each language.
TRAIN_ROWS, GRAMS = 20_000, 60_000
RATIO = 0.5

# bytes below 128 other than letters are spaces, A-Z are lower-cased already
_table = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def grams(text: str, n: int) -> np.ndarray:
    """The n-grams of a text as numbers, those with two spaces in a row left out."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_table) + b" ", np.uint8)
    if len(raw) < n:
        return np.zeros(0, np.uint64)
    space = raw == 32
    double = np.concatenate(([0], np.cumsum(space[1:] & space[:-1])))
    code = np.zeros(len(raw) - n + 1, np.uint64)
    for k in range(n):
        code |= raw[k : len(raw) - n + 1 + k].astype(np.uint64) << np.uint64(8 * k)
    return code[double[n - 1 :] == double[: len(raw) - n + 1]] | (np.uint64(n) << np.uint64(56))


def _places(code: np.ndarray, bits: int) -> list[np.ndarray]:
    h = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    step = (h * np.uint64(0x94D049BB133111EB)) | np.uint64(1)
    return [((h + np.uint64(k) * step) >> np.uint64(64 - bits)).astype(np.int64) for k in range(HASHES)]


class Model:
    """The filter: languages, their masks by place (64 languages to a plane), false-positive rates."""

    def __init__(self, langs: list[str], members: dict[str, np.ndarray], common: str):
        self.langs, self.common = langs, common
        most = max([len(v) for v in members.values()] + [1])
        self.bits = max(10, int(np.ceil(np.log2(most * HASHES / FILL))))
        kind = next(k for k, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(langs) <= n or n == 64)
        self.planes = np.zeros((-(-len(langs) // 64) or 1, 1 << self.bits), kind)
        for i, lang in enumerate(langs):
            for at in _places(members[lang], self.bits):
                self.planes[i // 64][at] |= kind(1 << i % 64)
        self.false = np.array([np.mean((self.planes[i // 64] >> kind(i % 64)) & kind(1)) ** HASHES for i in range(len(langs))])

    def counts(self, text: str) -> np.ndarray:
        """Per language, the n-grams of the text that are in its filter, less what chance gives."""
        hits, total = np.zeros(len(self.langs)), 0
        for n in LENGTHS:
            code = grams(text, n)
            total += len(code)
            at = _places(code, self.bits)
            for p, plane in enumerate(self.planes):
                mask = plane[at[0]]
                for x in at[1:]:
                    mask = mask & plane[x]
                for i in range(64 * p, min(len(self.langs), 64 * p + 64)):
                    hits[i] += np.count_nonzero(mask & plane.dtype.type(1 << i % 64))
        return np.maximum(0, (hits - total * self.false) / (1 - self.false))

    def predict(self, text: str) -> tuple[str, float]:
        c = self.counts(text)
        if not c.any():
            return self.common, 0.0
        best = int(c.argmax())
        return self.langs[best], float(c[best] / c.sum())


def train(docs: DataFrame, use: Column, rows: int = TRAIN_ROWS, most_grams: int | None = GRAMS, id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learn from rows where use holds and neither text nor lang is null: about rows of them at most.

    The model keeps the most frequent n-grams of a language, most_grams of them at most (None: all that mark a language).
    Without such rows every text with a letter is "und".
    """
    ship(docs.sparkSession)
    own = docs.where(use).select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    by_lang = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    total = sum(by_lang.values())
    if total > rows:
        own = own.where(sampled("train", "id", rows, total))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from loomstone.llm.langid import LENGTHS, grams

        for b in batches:
            for name, texts in b.groupby("lang")["text"]:
                # parts of a few megabytes, whatever the lengths of the texts
                part = (texts.str.len().cumsum() // 1_000_000).to_numpy()
                for p in np.unique(part):
                    code, n = np.unique(np.concatenate([grams(t, k) for t in texts[part == p] for k in LENGTHS]), return_counts=True)
                    yield pd.DataFrame({"lang": name, "gram": code.astype(np.int64), "n": n})

    counted = own.select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("_all"))
    rate = counted.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("_all"))
    best = rate.groupBy("gram").agg(F.max("rate").alias("_most"))
    from pyspark.sql import Window

    members = rate.join(best, "gram").where(F.col("rate") >= RATIO * F.col("_most")).where("n > 1")
    if most_grams is not None:
        members = members.withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("_k") <= most_grams)
    kept = members.select("lang", "gram").toPandas()  # n-grams of the bounded sample
    langs = sorted(by_lang)
    own_grams = {k: g.to_numpy().view(np.uint64) for k, g in kept.groupby("lang")["gram"]}
    return Model(langs, {k: own_grams.get(k, np.zeros(0, np.uint64)) for k in langs}, max(langs, key=lambda k: by_lang[k], default="und"))


def identify(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, lang_pred, score of each row, from its whole text.

    Null texts and texts without a letter are "und" with score 0; a text none of whose n-grams the
    filter knows gets the commonest language of the training rows with score 0. The score is the
    winner's share of all corrected counts; at equal counts the first language by code point wins.
    Rows keep their partition, repeated ones each give a row, other columns are ignored. Texts may be
    of any length (n-grams of a text are counted whole); an empty table gives none.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            out = [m.predict(t) if t is not None and ok else ("und", 0.0) for t, ok in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = like(docs, [id, text]).withColumn("_letter", F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False)))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id]}, lang_pred string, score double").withColumnRenamed("doc_id", id)
