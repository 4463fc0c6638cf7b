"""Incremental ingest with Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def new_rows(batch: DataFrame, known: DataFrame, keys: Sequence[str], hashed: Sequence[str]) -> DataFrame:
    """Rows of a batch whose key and content hash are not known yet, once each, with content_hash."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in hashed]
    own = batch.withColumn("content_hash", F.sha2(F.concat_ws("\x1f", *text), 256)).dropDuplicates([*keys, "content_hash"])
    return own.join(known.select(*keys, "content_hash"), [*keys, "content_hash"], "left_anti")


def ingest(stream: DataFrame, table: str, keys: Sequence[str], hashed: Sequence[str], checkpoint: str) -> DataStreamWriter:
    """Append what is new to the Parquet folder table, once, whatever is sent again.

    Each batch writes a folder of its own, batch=<id>, anew if the batch is repeated after a failure.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        known = spark.read.parquet(table).where(F.col("batch") < number) if there else batch.limit(0).withColumn("content_hash", F.lit(""))
        new_rows(batch, known, keys, hashed).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def windowed_counts(stream: DataFrame, stamp: str, late: str, width: str, key: str) -> DataFrame:
    """Counts by key and tumbling window, closed when the watermark passes."""
    return stream.withWatermark(stamp, late).groupBy(F.window(stamp, width).alias("w"), key).agg(F.count("*").alias("n")).select("w.start", key, "n")
