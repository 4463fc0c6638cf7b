"""Readers that tolerate missing columns and broken rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tiles(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """Network tiles of a Parquet file, in Mbit/s; columns for loaded latency may be missing; keys (quadkey) restrict the scan."""
    raw = spark.read.parquet(path)
    optional = lambda c: F.col(c).cast("double") if c in raw.columns else F.lit(None).cast("double")
    out = raw.select(
        "quadkey", (F.col("avg_d_kbps") / 1000.0).alias("avg_download_mbps"), (F.col("avg_u_kbps") / 1000.0).alias("avg_upload_mbps"), F.col("avg_lat_ms").cast("double").alias("avg_latency_ms"),
        optional("avg_d_lat_ms").alias("avg_loaded_latency_down_ms"), optional("avg_u_lat_ms").alias("avg_loaded_latency_up_ms"), "tests", "devices",
    )
    return out if keys is None else out.join(keys.select("quadkey").distinct(), "quadkey", "left_semi")


def json_rows(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines files, and the lines that don't parse."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    # Spark wants more than the corrupt column read, so both frames keep their columns until the filter
    return rows.where(F.col("_corrupt").isNull()).drop("_corrupt"), rows.where(F.col("_corrupt").isNotNull())


def delimited(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """CSV or TSV with a header and a fixed schema; cells that don't fit are null."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "PERMISSIVE").csv(path)


def place_codes(spark: SparkSession, path: str, schema: str, mark: str, country: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Places of a code list, and its aliases (country, alias, name).

    The column mark says what a line is: X a deletion, which is skipped; = an alias, whose name reads "alias = name".
    """
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").csv(path)
    kind = F.coalesce(F.trim(F.col(mark)), F.lit(""))
    parts = F.split(name, r"\s*=\s*", 2)
    aliases = rows.where(kind == "=").select(country, F.trim(parts[0]).alias("alias"), F.trim(F.get(parts, 1)).alias("name")).where("name IS NOT NULL")
    return rows.where(~kind.isin("X", "=")).drop(mark), aliases


def one_row_per_feature(names: DataFrame, feature: str, kind: str, line: str, name: str, approved: str = "N") -> DataFrame:
    """Of a feature's name rows the first approved one, or else the first, with all its names in the order of lines."""
    from loomstone.operators.latest import first_per_key

    every = names.groupBy(feature).agg(F.sort_array(F.collect_list(F.struct(F.col(line), F.col(name)))).alias("_all"))
    best = first_per_key(names, [feature], [F.coalesce(F.col(kind) != approved, F.lit(True)), F.col(line)])
    return best.join(every.select(feature, F.array_distinct(F.transform("_all", lambda s: s[name])).alias("names")), feature)


def nested_results(spark: SparkSession, path: str, key: str, services: Sequence[str], fields: str, most_m: float = 1000.0) -> DataFrame:
    """key, service and fields of each result of JSON documents {"results": [{key, service: {fields, "distance_m"}, ...}, ...]}.

    A result has a struct for each of services; those that are missing, or farther than most_m, give no row. A document that
    does not parse gives none either.
    """
    inner = ", ".join(f"{s}: struct<{fields}, distance_m: double>" for s in services)
    raw = spark.read.schema(f"results array<struct<{key}: string, {inner}>>").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    rows = raw.select(F.explode("results").alias("r"))
    each = F.array(*[F.struct(F.lit(s).alias("service"), F.col(f"r.{s}").alias("v")) for s in services])
    out = rows.select(F.col(f"r.{key}").alias(key), F.explode(each).alias("s")).where("s.v IS NOT NULL AND s.v.distance_m <= " + repr(float(most_m)))
    return out.select(key, "s.service", "s.v.*")


def manifest_rows(spark: SparkSession, path: str, schema: str, required: Sequence[str], strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON files (arrays or objects) that have all required values, and the rest with what they lack.

    strict raises an error if there is any such rest; a file that does not parse is one row of it.
    """
    raw = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", True).json(path)
    missing = [F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(f"{c} missing")) for c in required]
    rows = raw.withColumn("issues", F.array_compact(F.array(F.when(F.col("_corrupt").isNotNull(), "does not parse"), *missing)))
    bad = rows.where(F.size("issues") > 0)
    if strict and not bad.isEmpty():
        raise ValueError(f"rows of {path} are not valid: {bad.select('issues').first()[0]}")
    return rows.where(F.size("issues") == 0).drop("_corrupt", "issues"), bad


def registry(spark: SparkSession, base: str, overlay: str, schema: str, key: str, values: Sequence[str]) -> DataFrame:
    """Entries of a registry in JSON lines, the overlay's values before the base's; an overlay that is broken or not there is empty."""
    from loomstone.operators.publishing import merged_registry

    good, _ = json_rows(spark, base, schema)
    try:
        over, _ = json_rows(spark, overlay, schema)
        over.limit(0).collect()
    except Exception as e:  # noqa: BLE001  only a missing path is expected
        if "PATH_NOT_FOUND" not in str(e):
            raise
        over = good.limit(0)
    keyed = over.where(F.col(key).isNotNull()).dropDuplicates([key])
    return merged_registry(good.where(F.col(key).isNotNull()).dropDuplicates([key]), keyed, key, values)
