"""Nearest neighbours by inner product, along shifted Hilbert curves.

Vectors get one more component that makes them all equally long (so the largest inner product is the
smallest distance), are projected to a few dimensions by several random bases, each shifted by an
offset of its own, and ordered along a Hilbert curve in each. Splitters from a bounded sample cut every
curve into blocks of about equal size. A query reads its own block and the same number of blocks on
either side, on every curve; the nearest of each block are merged and ranked by the exact product.

How many blocks that is, is measured: exact neighbours of a bounded sample of queries are found by
reading all rows in blocks, and the window is the narrowest that holds enough of them. On clustered
vectors it is narrow; on vectors without any structure no ordering helps and it nears the whole curve.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.common import cut, sampled, ship

#: Curves, projected dimensions, bits of a coordinate.
CURVES, DIMS, BITS = 3, 6, 8
#: Rows that splitters and offsets are fitted on, rows of a block, and queries that the window is fitted on, at most about.
FIT_ROWS, BLOCK_ROWS, FIT_QUERIES = 20_000, 4096, 96
#: Share of the true neighbours that the window must hold for those.
RECALL = 0.95


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of small unsigned integers, as one number of dims x bits bits.

    The usual transposition of coordinates to the curve's bits: walk from the top bit down and, per
    dimension, either invert or exchange the lower bits of the first one, then Gray-decode.
    """
    x = x.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > one:
        low = q - one
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), one << np.uint64(bits - 1)
    while q > one:
        turn ^= np.where((x[n - 1] & q) != 0, q - one, np.uint64(0))
        q >>= one
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out


class Curves:
    """Bases, offsets, scales and splitters of the curves; fitted on a sample, applied to all rows."""

    def __init__(self, sample: np.ndarray, longest: float, blocks: int, seed: int = 4):
        rng = np.random.default_rng(seed)
        self.longest = max(longest, 1e-300)
        dim = sample.shape[1] + 1
        dims = min(DIMS, dim)
        self.bases = [np.linalg.qr(rng.standard_normal((dim, dims)))[0] for _ in range(CURVES)]
        self.shifts = [rng.random(dims) for _ in range(CURVES)]
        long = self.lengthened(sample, rows=True)
        self.low, self.scale, self.splitters = [], [], []
        for basis in self.bases:
            at = long @ basis
            lo, hi = np.percentile(at, [0.5, 99.5], axis=0)
            self.low.append(lo)
            self.scale.append(np.maximum(hi - lo, 1e-12))
        for c in range(CURVES):
            keys = np.sort(self.keys(long, sample, c))
            self.splitters.append(keys[np.arange(1, blocks) * len(keys) // blocks] if blocks > 1 else keys[:0])

    def lengthened(self, x: np.ndarray, rows: bool) -> np.ndarray:
        """Rows get the component that makes their length the longest one's; queries are scaled to it and get zero."""
        x = x / self.longest
        size = (x * x).sum(axis=1)
        if rows:
            return np.column_stack([x, np.sqrt(np.maximum(0, 1 - size))])
        return np.column_stack([x / np.sqrt(np.maximum(size, 1e-300))[:, None], np.zeros(len(x))])

    def keys(self, long: np.ndarray, x: np.ndarray, c: int) -> np.ndarray:
        """Shifted grid cells (half the grid is room for the shift), then 16 bits of a hash, so that a full cell can be cut, too."""
        unit = np.clip((long @ self.bases[c] - self.low[c]) / self.scale[c], 0, 1)
        cell = hilbert(np.minimum((unit + self.shifts[c]) * (1 << (BITS - 1)), (1 << BITS) - 1), BITS)
        bits = np.ascontiguousarray(x, np.float64).view(np.uint64) * np.arange(1, 2 * x.shape[1], 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (cell << np.uint64(16)) | (np.bitwise_xor.reduce(bits, axis=1) >> np.uint64(48))

    def blocks(self, x: np.ndarray, rows: bool) -> np.ndarray:
        """Per row the number of its block on each curve."""
        long = self.lengthened(x, rows)
        return np.column_stack([np.searchsorted(self.splitters[c], self.keys(long, x, c), side="right") for c in range(CURVES)])


def _matrix(s: pd.Series) -> np.ndarray:
    return np.stack(s.to_numpy()).astype(np.float64) if len(s) else np.zeros((0, 1))


def _best(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query places, row places and products of each query's k best rows (more at equal products)."""
    from_q, from_x, product = [], [], []
    for at in range(0, len(q), 256):
        s = q[at : at + 256] @ x.T
        if s.shape[1] > k:
            floor = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            hit = np.nonzero(s >= (floor - 1e-9 * np.abs(floor))[:, None])
        else:
            hit = np.nonzero(np.ones(s.shape, bool))
        from_q.append(hit[0] + at)
        from_x.append(hit[1])
        # one order of summation whatever the block, so that equal vectors have equal products
        product.append((q[hit[0] + at] * x[hit[1]]).sum(axis=1))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *from_q]), np.concatenate([none, *from_x]), np.concatenate([np.zeros(0), *product])


def clean(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """id and v (array of doubles) of the vectors that take part: no null, no component null or not finite, not zero."""
    v = F.transform(F.col(f"`{vector}`"), lambda e: e.cast("double"))
    rows = vectors.select(F.col(f"`{id}`").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    ok = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    return rows.where(F.coalesce(ok, F.lit(False)))


def search(vectors: DataFrame, every: int = 20, k: int = 20, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by every.

    Vectors that are null, zero or not finite take no part, nor do those of another length than most.
    Equal vectors are one entry of the index, with their k + 1 smallest ids: no more of them can be
    among anyone's k nearest. Rows that repeat an id and a vector count once. An empty table gives none.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = clean(vectors, id, vector)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e))).alias("longest")).orderBy(F.desc("n"), "d").first()
    out = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], out)
    rows = rows.where(F.size("v") == lengths["d"])
    # at most k + 1 ids of a vector pass the shuffle from each task (the window's limit is applied before it, too)
    numbered = rows.distinct().withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_r") <= k + 1)
    entries = cut(numbered.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    n = entries.count()
    blocks = 1 if n <= 16 * k else max(16, -(-n // BLOCK_ROWS))
    sample = entries.where(sampled("fit", "ids", FIT_ROWS, n)).select("v").toPandas()
    curves = spark.sparkContext.broadcast(Curves(_matrix(sample["v"]), float(lengths["longest"]), blocks))

    def numbers(rows_not_queries: bool):
        @F.pandas_udf("array<int>")
        def of(v: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in v:
                yield pd.Series(list(curves.value.blocks(_matrix(s), rows_not_queries).astype(np.int32))) if len(s) else pd.Series([], dtype=object)

        return of(F.col("v"))

    queries = rows.where(F.col("id") % every == 0).distinct().withColumnRenamed("id", "query_id")
    placed = queries.withColumn("at", numbers(False))
    reach = blocks if blocks == 1 else _reach(entries.withColumn("at", numbers(True)), placed, blocks, k)

    windows = F.explode(F.expr("flatten(transform(at, (b, c) -> transform(sequence(greatest(0, b - %d), least(%d, b + %d)), x -> struct(c AS curve, x AS block))))" % (reach, blocks - 1, reach)))
    asked = placed.withColumn("w", windows).select("query_id", F.col("v").alias("q"), "w.curve", "w.block")
    held = entries.select("v", "ids", F.posexplode(numbers(True)).alias("curve", "block"))
    # a block's queries are dealt over as many pieces as leave each with about BLOCK_ROWS; its rows go to every piece
    pieces = max(1, -(-min(blocks, 2 * reach + 1) * placed.count() // (blocks * BLOCK_ROWS)))
    asked = asked.withColumn("piece", F.pmod(F.xxhash64("query_id"), F.lit(pieces)).cast("int"))
    held = held.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))

    def near(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        # one entry more than asked for: the query's own may be among them
        i, j, s = _best(_matrix(q["q"]), _matrix(x["v"]), k + 1)
        ids = x["ids"].to_numpy()
        many = np.array([len(ids[t]) for t in j])
        found = pd.DataFrame({"query_id": np.repeat(q["query_id"].to_numpy()[i], many), "vec_id": np.concatenate([ids[t] for t in j]), "score": np.repeat(s, many)})
        found = found[found.query_id != found.vec_id].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
        return found.groupby("query_id", sort=False).head(k)

    pairs = asked.groupBy("curve", "block", "piece").cogroup(held.groupBy("curve", "block", "piece")).applyInPandas(near, "query_id long, vec_id long, score double")
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _reach(entries: DataFrame, placed: DataFrame, blocks: int, k: int) -> int:
    """Blocks on either side, from a sample of queries and their exact neighbours.

    Every task compares the sampled queries, at most FIT_QUERIES, with its rows and keeps k for each.
    """
    spark = entries.sparkSession
    total = placed.count()
    some = placed.where(sampled("reach", "query_id", FIT_QUERIES, total)).orderBy("query_id").limit(2 * FIT_QUERIES).toPandas()
    if not len(some):  # only if there are no queries, or next to none
        some = placed.orderBy("query_id").limit(FIT_QUERIES).toPandas()
    if not len(some):
        return 0
    shared = spark.sparkContext.broadcast((some["query_id"].to_numpy(), _matrix(some["v"]), np.stack(some["at"].to_numpy())))

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q, at = shared.value
        for b in batches:
            if not len(b):
                continue
            i, j, s = _best(q, _matrix(b["v"]), k + 1)
            near = np.abs(np.stack(b["at"].to_numpy())[j] - at[i]).min(axis=1)
            own = np.array([ids[a] in b["ids"].iloc[c] for a, c in zip(i, j, strict=True)])
            yield pd.DataFrame({"q": i, "score": s, "away": near})[~own]

    found = entries.select("v", "ids", "at").mapInPandas(exact, "q int, score double, away int")
    top = found.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("_r") <= k)
    away = np.array([r["away"] for r in top.select("away").collect()])  # FIT_QUERIES x 2 x k numbers at most
    return int(np.sort(away)[min(len(away) - 1, int(np.ceil(RECALL * len(away))))]) if len(away) else 0
