"""Exact duplicates by a sort of the contents.

Rows are ordered by (first characters of the normalised text, its SHA-256, id). Sampled splitters
range-partition them, each partition is sorted externally, and equal texts stand next to each other.
Splitters hold those short keys only, never whole texts; they include the id, so a group of copies
that is larger than a partition is cut in several. Neighbours are then compared in full. A group that
lies across partitions is the last run of one and the first of the next: those few runs (two per
partition at most) are merged apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.llm.common import SPACES, cut, ship

#: Characters of the normalised text that lead the sort.
LEAD = 32
_spaces = re.compile(r"[\x20\x09-\x0D]+")


def _runs(batches: Iterator[pa.RecordBatch], whole: bool, part: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows with what their run of equal texts has.

    Columns: the given ones, of which the last are text and sha, then keep, size, first, edge, part.
    keep is the run's smallest id, size its rows; first marks a run's first row; edge a partition's
    first and last run. whole: all rows, without the text; else a run's first only, with it (size
    counts all the same).
    """
    flat = lambda t: _spaces.sub(" ", t or "")
    open_rows: list[pa.RecordBatch] = []
    open_size, open_text, open_sha, opened = 0, None, None, 0

    def close(last: bool) -> list[pa.RecordBatch]:
        keep, edge = open_rows[0].column(0)[0].as_py(), opened == 1 or last
        out = []
        for i, b in enumerate(open_rows):
            n = b.num_rows
            out.append(_with(b, [keep] * n, [open_size] * n, [i == 0 and k == 0 for k in range(n)], [edge] * n, part))
        return out

    for b in batches:
        if not b.num_rows:
            continue
        texts, shas = b.column(b.num_columns - 2), b.column(b.num_columns - 1)
        narrow = b.select([*range(b.num_columns - 2), b.num_columns - 1]) if whole else b
        same = [False, *pc.equal(shas[1:], shas[:-1]).to_pylist()] if b.num_rows > 1 else [False]
        same[0] = open_sha is not None and shas[0].as_py() == open_sha
        # neighbours with equal digests are compared in full
        before = open_text
        starts = []
        for i, s in enumerate(same):
            if s:
                own = flat(texts[i].as_py())
                if before is None:
                    before = flat(texts[i - 1].as_py())
                if own != before:
                    starts.append(i)
                before = own
            else:
                starts.append(i)
                before = None
        ends = [*starts[1:], b.num_rows] if starts else []
        if not starts or starts[0] > 0:  # the open run goes on
            n = starts[0] if starts else b.num_rows
            if whole:
                open_rows.append(narrow.slice(0, n))
            open_size += n
        if starts:
            if open_rows:
                yield from close(False)
                if opened == 1:
                    opened = 2
            done, last = list(zip(starts, ends, strict=True))[:-1], starts[-1]
            if done and not opened:  # the partition's first run
                i, j = done.pop(0)
                open_rows, open_size, opened = [narrow.slice(i, j - i if whole else 1)], j - i, 1
                yield from close(False)
                opened = 2
            if done:
                lens = [j - i for i, j in done]
                if whole:
                    keys = narrow.column(0).to_pylist()
                    yield _with(narrow.slice(done[0][0], done[-1][1] - done[0][0]), [keys[i] for (i, _), n in zip(done, lens, strict=True) for _ in range(n)], [n for n in lens for _ in range(n)], [k == 0 for n in lens for k in range(n)], [False] * sum(lens), part)
                else:
                    rows = narrow.take(pa.array([i for i, _ in done]))
                    yield _with(rows, rows.column(0).to_pylist(), lens, [True] * len(lens), [False] * len(lens), part)
            opened = opened or 1
            open_rows, open_size = [narrow.slice(last, b.num_rows - last if whole else 1)], b.num_rows - last
        open_text, open_sha = flat(texts[b.num_rows - 1].as_py()), shas[b.num_rows - 1].as_py()
    if open_rows:
        yield from close(True)


def _with(b: pa.RecordBatch, keep: list, size: list, first: list, edge: list, part: int) -> pa.RecordBatch:
    more = [pa.array(keep, b.schema.field(0).type), pa.array(size, pa.int64()), pa.array(first, pa.bool_()), pa.array(edge, pa.bool_()), pa.array([part] * len(keep), pa.int32())]
    return pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names[:-1], "_sha", "_keep", "_size", "_first", "_edge", "_part"])


def _sorted_runs(docs: DataFrame, id: str, text: str, others: list[str], whole: bool) -> DataFrame:
    ship(docs.sparkSession)
    flat = F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), SPACES, " ")
    rows = docs.select(F.col(f"`{id}`"), *[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").alias("_text"), F.sha2(flat.cast("binary"), 256).alias("_sha"), F.substring(flat, 1, LEAD).alias("_lead"))
    by = ["_lead", "_sha", F.col(f"`{id}`").asc_nulls_last()]
    # written once, so that both readers of the runs see the same edges of partitions
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    fields = {f.name: f.dataType for f in docs.schema.fields}
    out = T.StructType([T.StructField(c, fields[c]) for c in [id, *others]])
    if not whole:
        out = out.add("_text", T.StringType())
    for name, kind in (("_sha", T.StringType()), ("_keep", fields[id]), ("_size", T.LongType()), ("_first", T.BooleanType()), ("_edge", T.BooleanType()), ("_part", T.IntegerType())):
        out = out.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from loomstone.llm.exact_dedup import _runs

        return _runs(batches, whole, TaskContext.get().partitionId())

    return cut(ordered.drop("_lead").select(id, *others, "_text", "_sha").mapInArrow(run, out))


def _settled(runs: DataFrame) -> DataFrame:
    """Runs at the edges of partitions, merged: per digest the first part, the smallest id and all rows.

    Two rows per partition at most are gathered and broadcast, whatever the size of the groups.
    """
    edges = runs.where("_edge AND _first").groupBy("_sha").agg(F.min("_part").alias("_home"), F.min_by("_keep", "_part").alias("_least"), F.sum("_size").alias("_all"))
    return runs.join(F.broadcast(edges.withColumn("_edge", F.lit(True))), ["_sha", "_edge"], "left")


def mark_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256 of each row.

    Null texts count as empty. Of equal texts the smallest id stays (a null one only if there is no
    other); of repeated rows with that id, one. Other columns are ignored; an empty table gives an
    empty result.
    """
    runs = _settled(_sorted_runs(docs, id, text, [], True))
    keep = F.when(F.col("_home").isNull(), F.col("_keep")).otherwise(F.col("_least"))
    return runs.select(id, keep.alias("keep_id"), F.coalesce("_all", "_size").alias("group_size"), (F.col("_first") & (F.coalesce("_home", "_part") == F.col("_part"))).alias("kept"), F.col("_sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that mark_duplicates keeps, whole."""
    # other columns get names of their own on the way
    names = {c: f"_other{i}" for i, c in enumerate(docs.columns) if c not in (id, text)}
    own = docs.select(F.col(f"`{id}`"), F.col(f"`{text}`"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    runs = _settled(_sorted_runs(own, id, text, list(names.values()), False)).where(F.coalesce("_home", "_part") == F.col("_part"))
    return runs.select(*[F.col(names[c]).alias(c) if c in names else F.col("_text").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
