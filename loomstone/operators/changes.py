"""Changes of keyed tables: upserts, scoped replacement, deletes, merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], values: Sequence[str], keep_if_null: Sequence[str] = ()) -> DataFrame:
    """The table after the upsert, and per row its status: kept, inserted, unchanged or updated.

    Both sides have one row per key. Values come from the source where it has the key; those in
    keep_if_null stay if the source's is null.
    """
    t = target.select(*keys, F.struct(*values).alias("_t"))
    s = source.select(*keys, F.struct(*values).alias("_s"))
    both = t.join(s, list(keys), "full_outer")
    new = {v: F.coalesce(F.col(f"_s.{v}"), F.col(f"_t.{v}")) if v in keep_if_null else F.when(F.col("_s").isNotNull(), F.col(f"_s.{v}")).otherwise(F.col(f"_t.{v}")) for v in values}
    same = F.lit(True)
    for v in values:
        same = same & new[v].eqNullSafe(F.col(f"_t.{v}"))
    status = F.when(F.col("_s").isNull(), "kept").when(F.col("_t").isNull(), "inserted").when(same, "unchanged").otherwise("updated")
    return both.select(*keys, *[new[v].alias(v) for v in values], status.alias("status"))


def replace_scope(target: DataFrame, new: DataFrame, scope: Column) -> DataFrame:
    """target without its rows in scope, and the rows of new that are."""
    return target.where(~F.coalesce(scope, F.lit(False))).unionByName(new.where(scope))


def delete_keys(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def exists_flag(df: DataFrame, other: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """df with a column that says whether other has its keys; rows don't multiply."""
    marks = other.select(*keys).distinct().withColumn(name, F.lit(True))
    return df.join(marks, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def union_first(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of frames; of rows with one key the first frame's stays."""
    from loomstone.operators.latest import first_per_key

    rows = [f.withColumn("_from", F.lit(i)) for i, f in enumerate(frames)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return first_per_key(out, keys, [F.col("_from")]).drop("_from")
