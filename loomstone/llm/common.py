"""What several operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.sources.tables import Scratch as Tables
from loomstone.sources.tables import shared_folder

__all__ = ["Tables", "cut", "fold", "join_hot", "like", "sampled", "shared_folder", "ship", "steps_of", "table"]

#: ASCII white space, and what lies between it, as Java and DuckDB regular expressions.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch: texts may be long, and a batch is held in several copies outside the heap.
BATCH, ARROW = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, where PYTHONPATH doesn't already have it.

    Arrow batches of the session get BATCH rows, unless it has set another number than Spark's own.
    """
    if spark.conf.get(ARROW) == "10000":
        spark.conf.set(ARROW, BATCH)
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _shipped.add(app)
    out = Path(tempfile.mkdtemp(prefix="loomstone-")) / "loomstone_pkg.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in (root / "loomstone").rglob("*.py"):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(out))


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, which stays until the session ends."""
    return Tables(df.sparkSession).cut(df)


#: Keys with this share of all rows, or more, are looked up by a broadcast; there are at most as many of them.
HOT = 4096


def join_hot(rows: DataFrame, per_key: DataFrame, key: list[str], n: str) -> DataFrame:
    """rows joined with per_key, which has one row for each key and in column n how many rows have it.

    The keys with a 4096th of all rows or more, of which there are 4096 at most, go to the rows by a broadcast, so no task
    gets all rows of a hot key; all other keys meet by a shuffle. Keys are not null. rows is read twice.
    """
    total = per_key.agg(F.sum(n).alias("t")).first()["t"] or 0
    hot = per_key.where(F.col(n) >= max(1000, total // HOT))
    names = hot.select(*key).withColumn("_hot", F.lit(True))
    cold = rows.join(F.broadcast(names), key, "left_anti").join(per_key.where(F.col(n) < max(1000, total // HOT)), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def steps_of(rows: int, total: int) -> int:
    """The share rows / total in 2 ** 62 steps, so that it is not rounded to none below that many rows."""
    return max(1, min(1 << 62, (rows << 62) // max(1, total)))


def sampled(seed: str, key: str, rows: int, total: int) -> Column:
    """About rows of total rows, by a hash of key."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 62)) < F.lit(steps_of(rows, total))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids fall into fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(0))


def like(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only these columns, whatever else df has."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
