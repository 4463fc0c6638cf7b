"""Whitening of embeddings by a covariance in which each distinct vector has a weight.

Vectors are put on a grid of integers and equal ones are grouped, with their count. The covariance is fitted on the
distinct vectors, each weighted by its count or by one: sums of whole numbers give the mean exactly, tasks multiply
centred blocks (a weighted product of matrices) and pass on one d x d matrix each, row by row, to be added. Only the sums
of these, d x d numbers, reach the driver, which takes the eigenvectors. Each distinct vector is whitened once and joined
back to the rows that have it, by a narrow key; vectors of many rows are looked up by a broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import Tables, join_hot, ship

#: Eigenvalues below this part of the greatest are noise of rounding and give no component.
LEAST = 1e-11


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _added(parts: DataFrame) -> dict[int, np.ndarray]:
    """The sums of arrays v by i. Each i is added up as a stream, in one task; the result, one array for each i, goes to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None

        def one() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], ["i", "v"])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = v.values.to_numpy()
                if i == last:
                    total = total + v
                    continue
                if last is not None:
                    yield one()
                last, total = i, v
        if last is not None:
            yield one()

    rows = parts.repartition("i").sortWithinPartitions("i", "task").drop("task").mapInArrow(add, "i int, v array<double>").collect()
    return {r["i"]: np.array(r["v"]) for r in rows}


def _products(rows: DataFrame, block: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The sum of X^T diag(w) X over all rows, where block gives X (centred) and w of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for b in batches:
            if b.num_rows:
                x, w = block(b)
                part = (x * w[:, None]).T @ x
                total = part if total is None else total + part
        if total is not None:
            n = len(total)
            columns = [pa.array(range(n), pa.int32()), pa.array([TaskContext.get().partitionId()] * n, pa.int32()), pa.array(list(total), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["i", "task", "v"])

    out = _added(rows.mapInArrow(run, "i int, task int, v array<double>"))
    return np.stack([out[i] for i in range(len(out))])


def gridded(vectors: DataFrame, step: float, offset: int, id: str, vector: str) -> DataFrame:
    """id and x: the components as floor(step * c) + offset, of vectors without null or other than finite components."""
    v = F.col(f"`{vector}`")
    rows = vectors.select(F.col(f"`{id}`").alias(id), v.cast("array<double>").alias("_v")).where("_v IS NOT NULL")
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    rows = rows.where((F.size("_v") > 0) & ~F.coalesce(F.exists("_v", bad), F.lit(True)))
    x = F.transform("_v", lambda c: F.try_add(F.floor(c * F.lit(float(step))), F.lit(offset)))
    return rows.select(id, x.alias("x")).where(~F.exists("x", lambda e: e.isNull()))


def whiten(
    vectors: DataFrame, most: int = 16, step: float = 64.0, offset: int = 1_000_000, by_count: bool = False, id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each row's vector and component.

    x = floor(step * c) + offset for each component c. The fit list is each distinct x once, or as often as it occurs
    (by_count); n is its length, S its sums. Components are unit eigenvectors of the covariance of the fit list (divisor n),
    numbered by falling eigenvalue e. whitened is x - S / n, projected on the component, over the root of e;
    explained is e over the trace; deviation is the sum over dimensions of (n * x - S) ** 2, exact, null where it is beyond a
    long; identity_error is the greatest entry of the covariance of whitened less the identity, over the fit list.

    Rows whose vector is null, empty, or holds null or other than finite components (or such as have no place in the longs of
    the grid) are left out, and so are those of another
    length than most have (of lengths as common as each other, the greatest counts). Components whose eigenvalue is below LEAST of
    the greatest have no direction of their own and are left out: one distinct vector gives no rows. Equal eigenvalues
    are numbered as the solver gives them, the same for all rows; a component's greatest entry is positive. Rows that repeat an
    id are each a row, null ids too. Other columns are ignored; an empty table gives none. A task holds one batch and a d x d
    matrix, the driver two of these.
    """
    spark = vectors.sparkSession
    store = Tables(spark)
    kind = dict(vectors.dtypes)[id]
    schema = f"{id} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = gridded(vectors, step, offset, id, vector)
    longest = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if longest is None:
        return spark.createDataFrame([], schema)
    dim = longest["d"]
    rows = rows.where(F.size("x") == dim)
    keys = [F.xxhash64("x").alias("_k"), F.xxhash64(F.lit("second"), "x").alias("_l")]
    distinct = store.cut(rows.groupBy("x").agg(F.count("*").alias("_n")).select(*keys, "x", "_n"))
    join_on = ["_k", "_l"]
    if not distinct.groupBy(*join_on).count().where("count > 1").isEmpty():
        join_on = ["_k", "_l", "x"]  # two vectors share both hashes: the vectors themselves are the key

    # n and the sums, in whole numbers
    weight = F.col("_n") if by_count else F.lit(1).cast("long")
    held = distinct.select(weight.alias("w"), "x")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for b in batches:
            if b.num_rows:
                w, x = b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, dim)
                top = int(np.abs(x).max(initial=0)) * int(w.sum())
                part = (x * w[:, None]).sum(axis=0).tolist() if top < 1 << 62 else (x.astype(object) * w[:, None]).sum(axis=0).tolist()
                n, total = n + int(w.sum()), [a + p for a, p in zip(total, part, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim), pa.int32()), pa.array([str(v) for v in (n, *total)])], ["i", "v"])

    found = {r["i"]: int(r["v"]) for r in held.mapInArrow(sums, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}
    n, total = found.pop(-1), [found[i] for i in range(dim)]
    # x - S / n = (x - whole) - rest / n without loss, whatever the size of x
    whole, rest = (np.array(c) for c in zip(*[divmod(s, n) for s in total], strict=True))

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - whole).astype(np.float64) - rest / n

    cov = _products(held, lambda b: (centred(_matrix(b.column(1), dim)), b.column(0).to_numpy().astype(np.float64))) / n
    e, vectors_of = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(-e, kind="stable")[: min(most, dim)]
    order = order[e[order] > LEAST * max(e.max(), 0)]
    if not len(order) or e.max() <= 0:
        return spark.createDataFrame([], schema)
    values, base = e[order], vectors_of[:, order]
    base = base * np.where(base[np.abs(base).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    scaled, count = base / np.sqrt(values), len(order)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(0), dim)
            white = centred(x) @ scaled
            # n * x - S = n * (x - whole) - rest
            off = x - whole
            bound = float(n) * (np.abs(off).max() + 1.0)
            if bound < 2**62 and dim * bound * bound < 2**62:
                far = ((off * n - rest) ** 2).sum(axis=1).tolist()
            else:
                far = [int(v) if v < 1 << 63 else None for v in ((off.astype(object) * n - rest) ** 2).sum(axis=1)]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, white.size + 1, count, dtype=np.int32)), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(1, b.num_columns)], pa.array(far, pa.int64()), flat], out)

    key_fields = [("_k", "long"), ("_l", "long"), *([("x2", "array<long>")] if len(join_on) > 2 else [])]
    out = [*[c for c, _ in key_fields], "_n", "deviation", "white"]
    form = ", ".join(f"{c} {k}" for c, k in (*key_fields, ("_n", "long"), ("deviation", "long"), ("white", "array<double>")))
    carried = [F.col("x").alias("x2") if c == "x2" else F.col(c) for c, _ in key_fields]
    white = store.cut(distinct.select("x", *carried, "_n").mapInArrow(project, form))

    # the covariance of what was whitened; its mean is zero but for rounding, and is taken off all the same
    each = white.select("white", weight.cast("double").alias("w"))
    mean = _products(each, lambda b: (np.hstack([np.ones((b.num_rows, 1)), _matrix(b.column(0), count)]), b.column(1).to_numpy()))[0, 1:] / n
    again = _products(each, lambda b: (_matrix(b.column(0), count) - mean, b.column(1).to_numpy())) / n
    error = float(np.abs(again - np.eye(count)).max())

    ship(spark)
    per = white if len(join_on) == 2 else white.withColumnRenamed("x2", "x")
    joined = join_hot(rows.select(id, *keys, *(["x"] if len(join_on) > 2 else [])), per, join_on, "_n")
    share = F.array(*[F.lit(float(v)) for v in values / np.trace(cov)])
    one = joined.select(F.col(id), F.lit(n).cast("long").alias("n"), "deviation", F.posexplode("white").alias("_p", "whitened"))
    return one.select(id, (F.col("_p") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get(share, F.col("_p")).alias("explained"), F.lit(error).alias("identity_error"))
