"""The most similar chunks of a question, exactly, without looking at all of them.

Chunks belong to the nearest of some pivots; of each pivot's chunks the widest angle is known, and so how similar any of them
can be to a question. A question first searches the pivots nearest to it, which gives a score that its last hit has at
least, and then only those whose chunks can still reach that score. Pivots only save work: any would give the same hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.operators.latest import first_per_key
from loomstone.sources.tables import Scratch

#: What a chunk gains for a field that the question mentions, and for the question's own place.
MENTIONED, SAME_PLACE = 0.05, 0.02
#: Pivots at most, and rows that they are fitted on, about; pivots that a question searches first.
PIVOTS, FIT_ROWS, FIRST = 1024, 16_384, 2


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def fitted(sample: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """n unit vectors in the middle of groups of a sample of unit vectors (Lloyd's rounds from an even draw)."""
    at = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(np.int64)]
    for _ in range(rounds):
        own = (sample @ at.T).argmax(axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, sample)
        size = np.sqrt((sums * sums).sum(axis=1))
        at = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], at)
    return at


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """One row for up to most rows of each (pivot, piece): their ids and numbers as arrays. Rows are read as a stream, sorted by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["pivot", "piece", "ids", "boosts", "fields", "places", "flat"]
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            columns = [b.column(k) for k in range(2, 6)] + [b.column(6).flatten()]
            lists = [pa.ListArray.from_arrays([0, len(c)], c) for c in columns]
            held.clear()
            yield pa.RecordBatch.from_arrays([b.column(0).slice(0, 1), b.column(1).slice(0, 1), *lists], names)

        for b in batches:
            key = b.column(0).to_numpy().astype(np.int64) << 32 | b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if held and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) != (b.column(0)[i].as_py(), b.column(1)[i].as_py()):
                    yield from flush()
                while i < j:
                    take = min(j - i, most - sum(h.num_rows for h in held))
                    held.append(b.slice(i, take))
                    i += take
                    if sum(h.num_rows for h in held) == most:
                        yield from flush()
        yield from flush()

    schema = "pivot int, piece int, ids array<long>, boosts array<double>, fields array<double>, places array<double>, flat array<double>"
    rows = rows.select("pivot", "piece", "vec_id", "boost", "field", "place", "e")
    return rows.repartition("pivot", "piece").sortWithinPartitions("pivot", "piece").mapInArrow(run, schema)


def _met(questions: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """q, vec_id, score, read: the k best of each block of chunks for each question that asks it, and how many were compared."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in range(b.num_rows):
                q, _, q_field, q_place, qx, c, boost, field, place, cx = (b.column(m)[n].values.to_numpy(zero_copy_only=False) for m in range(10))
                qx, cx = qx.reshape(len(q), -1), cx.reshape(len(c), -1)
                # nulls are not equal to anything here
                gain = MENTIONED * (q_field[:, None] == field[None]) + SAME_PLACE * (q_place[:, None] == place[None])
                scores = np.round(qx @ cx.T / np.sqrt((qx * qx).sum(axis=1)[:, None] * (cx * cx).sum(axis=1)) + boost + gain, 6)
                scores[q[:, None] == c[None]] = -np.inf
                out = []
                for i in range(len(q)):
                    s, ids = scores[i], c
                    if len(s) > k:
                        # ties with the last one that may stay are kept until ids decide
                        some = s >= np.partition(s, len(s) - k)[len(s) - k]
                        s, ids = s[some], ids[some]
                    order = np.lexsort((ids, -s))[:k]
                    out.append((np.full(len(order), q[i]), ids[order], s[order]))
                one, ids, s = (np.concatenate(x) for x in zip(*out, strict=True))
                fine = np.isfinite(s)
                yield pa.RecordBatch.from_arrays([pa.array(one[fine]), pa.array(ids[fine]), pa.array(s[fine])], ["q", "vec_id", "score"])

    left = questions.toDF("pivot", "piece", "q", "_b", "q_field", "q_place", "qx")
    pairs = left.join(chunks.toDF("pivot", "piece", "c", "boost", "field", "place", "cx"), ["pivot", "piece"]).drop("pivot", "piece")
    return pairs.mapInArrow(meet, "q long, vec_id long, score double")


def nearest_of_all(chunks: DataFrame, every: int = 50, k: int = 10, block: int = 2048) -> DataFrame:
    """q, vec_id, score, read: the k best of all other chunks for each chunk whose id is divisible by every, exactly; read says how many chunks q was compared with.

    chunks: vec_id, boost, e (doubles, equally many in each row), and, if there are, field and place (numbers): a chunk of
    the question's field or place gains MENTIONED or SAME_PLACE. Rows without a vector, or with a zero one, have no cosine
    and are left out; a null boost, field or place gains nothing; ties go to the smaller id.

    A pivot's chunks are dealt in pieces of about block rows, which meet questions by an equi-join, as matrices. Pivots (PIVOTS
    at most, each with its count, widest angle and greatest boost) are all that the driver and each task hold of the chunks.
    """
    spark = chunks.sparkSession
    store = Scratch(spark)
    for c in ("field", "place"):
        chunks = chunks.withColumn(c, F.col(c).cast("double") if c in chunks.columns else F.lit(None).cast("double"))
    chunks = chunks.select("vec_id", F.coalesce(F.col("boost").cast("double"), F.lit(0.0)).alias("boost"), "field", "place", "e")
    chunks = chunks.where("vec_id IS NOT NULL AND e IS NOT NULL AND exists(e, x -> x <> 0)")
    n = chunks.count()
    schema = "q long, vec_id long, score double, read long"
    if not n:
        return spark.createDataFrame([], schema)
    share = max(1, min(1 << 62, (FIT_ROWS << 62) // n))
    drawn = chunks.where(F.pmod(F.xxhash64(F.lit("pivots"), "vec_id"), F.lit(1 << 62)) < F.lit(share)).orderBy("vec_id").select("e").collect()
    sample = np.array([r["e"] for r in drawn] or [chunks.first()["e"]], np.float64)
    at = fitted(_unit(sample), min(PIVOTS, max(1, int(n**0.5 / 2))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _unit(b.column("e").flatten().to_numpy().reshape(b.num_rows, -1))
                near = x @ at.T
                own = near.argmax(axis=1)
                columns = [*b.columns, pa.array(own.astype(np.int32)), pa.array(near[np.arange(len(own)), own])]
                yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "pivot", "near"])

    dealt = store.cut(chunks.mapInArrow(assign, "vec_id long, boost double, field double, place double, e array<double>, pivot int, near double"))
    facts = {r["pivot"]: r for r in dealt.groupBy("pivot").agg(F.count("*").alias("n"), F.min("near").alias("near"), F.max("boost").alias("boost")).collect()}
    known = np.array(sorted(facts), np.int32)
    size = np.array([facts[p]["n"] for p in known.tolist()], np.int64)
    wide = np.arccos(np.clip([facts[p]["near"] for p in known.tolist()], -1, 1))
    most_gain = np.array([facts[p]["boost"] for p in known.tolist()]) + MENTIONED + SAME_PLACE
    pieces = np.maximum(1, -(-size // block))
    middle = at[known]
    number = F.element_at(F.create_map(*[F.lit(int(v)) for pair in zip(known.tolist(), pieces.tolist(), strict=True) for v in pair]), F.col("pivot"))
    right = store.cut(_packed(dealt.withColumn("piece", F.pmod(F.hash("vec_id"), number)), block))
    asked = dealt.where(F.col("vec_id") % every == 0).select("vec_id", "boost", "field", "place", "e")

    def routed(questions: DataFrame, second: bool) -> DataFrame:
        """Questions with each pivot and piece that they search: first the nearest pivots with enough chunks, then all others that can reach their score."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = _unit(b.column("e").flatten().to_numpy().reshape(b.num_rows, -1))
                angle = np.arccos(np.clip(x @ middle.T, -1, 1))
                bound = np.cos(np.clip(angle - wide, 0, np.pi)) + most_gain
                order = np.argsort(angle, axis=1, kind="stable")
                # as many of the nearest pivots as hold more than k chunks together, FIRST at least
                enough = np.maximum(FIRST, 1 + (np.cumsum(size[order], axis=1) <= k).sum(axis=1))
                is_first = np.zeros(angle.shape, bool)
                np.put_along_axis(is_first, order, np.arange(len(size))[None] < enough[:, None], axis=1)
                use = is_first
                if second:
                    least = b.column("least").to_numpy(zero_copy_only=False)
                    use = ~is_first & (bound >= np.where(np.isnan(least), -np.inf, least)[:, None] - 2e-6)
                row, place = np.nonzero(use)
                row, place = np.repeat(row, pieces[place]), np.repeat(place, pieces[place])
                start = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(place) != 0)]) if len(row) else np.zeros(0, np.int64)
                piece = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
                for i in range(0, len(row), 4096):  # a question's vector goes with each of its pieces
                    part = b.select(["vec_id", "boost", "field", "place", "e"]).take(pa.array(row[i : i + 4096]))
                    columns = [pa.array(known[place[i : i + 4096]]), pa.array(piece[i : i + 4096].astype(np.int32)), *part.columns]
                    yield pa.RecordBatch.from_arrays(columns, ["pivot", "piece", *part.schema.names])

        return questions.mapInArrow(run, "pivot int, piece int, vec_id long, boost double, field double, place double, e array<double>")

    def searched(routes: DataFrame) -> tuple[DataFrame, DataFrame]:
        routes = store.cut(routes)
        best = store.cut(first_per_key(_met(_packed(routes, 2 * block), right, k), ["q"], [F.desc("score"), F.col("vec_id")], k))
        count = F.element_at(F.create_map(*[F.lit(int(v)) for pair in zip(known.tolist(), size.tolist(), strict=True) for v in pair]), F.col("pivot"))
        return best, routes.where("piece = 0").groupBy(F.col("vec_id").alias("q")).agg(F.sum(count).alias("read"))

    first, read1 = searched(routed(asked, False))
    least = first.groupBy(F.col("q").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    second, read2 = searched(routed(asked.join(least, "vec_id", "left"), True))
    best = first_per_key(first.unionByName(second), ["q"], [F.desc("score"), F.col("vec_id")], k)
    read = read1.unionByName(read2).groupBy("q").agg(F.sum("read").alias("read"))
    return best.join(read, "q").select("q", "vec_id", "score", "read")
