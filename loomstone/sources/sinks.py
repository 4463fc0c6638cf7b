"""Sinks: snapshots with a manifest that can be verified, and features as GeoJSON lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def digest(columns: Sequence[str]) -> Column:
    """A number of 32 bits from a row's columns; null and the empty text differ."""
    text = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def manifest(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per group, rows and checksum, the sum of the rows' digests: no order, so no sort and no gathering of keys."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum(digest(columns)), F.lit(0)).alias("checksum"))


def snapshot(df: DataFrame, path: str, columns: Sequence[str], by: Sequence[str] = ()) -> None:
    """Write df, partitioned by the columns by, and then the manifest of what was written; a job that fails before leaves no manifest."""
    df.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/data")
    manifest(df.sparkSession.read.schema(df.schema).parquet(f"{path}/data"), columns, by).write.mode("overwrite").parquet(f"{path}/manifest")


def broken(spark: SparkSession, path: str, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Groups of a snapshot whose rows or checksum aren't what the manifest says, or that only one of them has."""
    said = spark.read.parquet(f"{path}/manifest")
    # names of partition folders would be read as numbers where they look so: the manifest knows their types
    kinds = dict(said.dtypes)
    found = spark.read.parquet(f"{path}/data").dtypes
    there = manifest(spark.read.schema(", ".join(f"`{c}` {kinds[c] if c in by else k}" for c, k in found)).parquet(f"{path}/data"), columns, by)
    return said.exceptAll(there.select(said.columns)).unionByName(there.select(said.columns).exceptAll(said)).select(*by).distinct() if by else said.exceptAll(there)


def features(df: DataFrame, lat: str, lon: str, properties: Sequence[str]) -> DataFrame:
    """feature: a GeoJSON point per row with both coordinates; rows without are left out."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon).cast("double"), F.col(lat).cast("double")).alias("coordinates"))
    whole = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*[F.col(f"`{c}`") for c in properties]).alias("properties"))
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("feature"))


def geojson_lines(df: DataFrame, path: str, lat: str, lon: str, properties: Sequence[str]) -> None:
    features(df, lat, lon, properties).write.mode("overwrite").text(path)
