"""Publishing parts of tables: scoped replacement with checks, rollback, cascades, merges, and steps that skip what did not change."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.operators.changes import delete_keys, replace_scope
from loomstone.operators.complaints import input_hash
from loomstone.operators.latest import first_per_key
from loomstone.operators.ranks import join_keys


class ScopeError(ValueError):
    """Rows outside the scope would change."""


def scope_counts(before: DataFrame, after: DataFrame, scope: Column) -> DataFrame:
    """One row: rows in and out of scope, before and after."""
    inside = F.coalesce(scope, F.lit(False))
    n = lambda df, name: df.agg(F.count_if(inside).alias(f"in_{name}"), F.count_if(~inside).alias(f"out_{name}"))
    return n(before, "before").crossJoin(n(after, "after"))  # one row each


def publish_scope(target: DataFrame, new: DataFrame, scope: Column) -> DataFrame:
    """replace_scope, after a check that new has no row outside the scope and that as many rows as before lie outside it."""
    if not new.where(~F.coalesce(scope, F.lit(False))).isEmpty():
        raise ScopeError("new rows lie outside the scope")
    out = replace_scope(target, new, scope)
    c = scope_counts(target, out, scope).first()
    if c["out_before"] != c["out_after"]:
        raise ScopeError(f"{c['out_before']} rows outside the scope before, {c['out_after']} after")
    return out


def rollback_scope(target: DataFrame, backup: DataFrame, scope: Column) -> DataFrame:
    """The scope as backup has it, all else as it is now."""
    return replace_scope(target, backup.where(scope), scope)


def cascade_delete(tables: Mapping[str, DataFrame], gone: DataFrame, keys: Sequence[str]) -> dict[str, DataFrame]:
    """Each table without the rows whose keys are gone."""
    return {name: delete_keys(df, gone, keys) for name, df in tables.items()}


def unexpected_counts(actual: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """key, expected, n of each key whose rows are not as many as expected says, missing ones as zero."""
    n = actual.groupBy(key).agg(F.count("*").alias("n"))
    both = expected.join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return both.where(F.col("n") != F.col("expected")).select(key, "expected", "n")


def columns_of(df: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The columns that target has, too; without a key there is an error."""
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ValueError(f"key columns are missing: {missing}")
    return df.select(*[c for c in df.columns if c in target.columns])


def merged_registry(base: DataFrame, overlay: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """One row per key of both: the overlay's value where it has one, else the base's."""
    b = base.select(key, *[F.col(v).alias(f"_b_{v}") for v in values])
    o = overlay.select(key, *[F.col(v).alias(f"_o_{v}") for v in values])
    return b.join(o, key, "full_outer").select(key, *[F.coalesce(f"_o_{v}", f"_b_{v}").alias(v) for v in values])


def merged_evidence(base: DataFrame, overlay: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Evidence of both; of rows with one key the overlay's stays, and of several there the first in order."""
    rows = base.withColumn("_from", F.lit(1)).unionByName(overlay.withColumn("_from", F.lit(0)), allowMissingColumns=True)
    return first_per_key(rows, keys, [F.col("_from"), *order]).drop("_from")


def consolidated(a: DataFrame, b: DataFrame, compatible: Column) -> DataFrame:
    """b, a (or null) and labels of each row of b: joined to the one row of a that shares a label and is compatible.

    a and b have id and labels (an array); compatible speaks of the columns of aliases x (of a) and y (of b) other than id. Labels are
    exploded, so rows meet by an equi-join; rows that match several of a, or none, stay alone. Rows that differ in nothing but their id
    match the same, so they meet as one: of those of a the least and the greatest id say whether there is only one.
    """
    others, asked = [c for c in a.columns if c != "id"], [c for c in b.columns if c != "id"]
    x = a.groupBy(*others).agg(F.min("id").alias("_lo"), F.max("id").alias("_hi")).select(F.struct(*others).alias("x"), "_lo", "_hi", F.explode("labels").alias("_l"))
    y = b.select(*asked).distinct().select(F.struct("*").alias("y"), F.explode("labels").alias("_l"))
    pairs = x.join(y, "_l").where(compatible).groupBy("y").agg(F.min(F.struct(F.col("_lo").alias("a"), F.col("x.labels").alias("la"))).alias("m"), F.max("_hi").alias("_hi"))
    one = pairs.where("m.a = _hi").select("y.*", "m")
    out = join_keys(b, one, asked, "left")
    both = F.array_sort(F.array_union("labels", F.coalesce("m.la", F.array().cast("array<string>"))))
    return out.select(F.col("id").alias("b"), F.col("m.a").alias("a"), both.alias("labels"))


def changed_groups(rows: DataFrame, key: str, columns: Sequence[str], seen: DataFrame) -> DataFrame:
    """key, input_hash, change (new, changed or same) of each group of rows against seen (key, input_hash): what to compute again."""
    now = input_hash(rows, key, columns)
    before = seen.select(key, F.col("input_hash").alias("_before"))
    change = F.when(F.col("_before").isNull(), "new").when(F.col("_before") == F.col("input_hash"), "same").otherwise("changed")
    return now.join(before, key, "left").select(key, "input_hash", change.alias("change"))


def settled(progress: DataFrame, cycle: DataFrame, keys: Sequence[str], empty_cycles: int = 2) -> DataFrame:
    """progress (keys, cycle, empty) after a cycle (keys, accepted, failed, open): the next numbers and the status.

    An open task leaves the row in_progress; a failed one makes it blocked_review; empty_cycles cycles without anything new
    make it exhausted; all else is active. A key without rows in cycle stays as it is, as pending.
    """
    c = cycle.groupBy(*keys).agg(F.sum("accepted").alias("_accepted"), F.count_if("failed").alias("_failed"), F.count_if("open").alias("_open"))
    p = progress.join(c, list(keys), "left")
    ran = F.col("_open").isNotNull() & (F.col("_open") == 0)
    empty = F.when(ran & (F.col("_failed") == 0), F.when(F.col("_accepted") > 0, 0).otherwise(F.col("empty") + 1)).otherwise(F.col("empty"))
    status = (
        F.when(F.col("_open").isNull(), "pending").when(F.col("_open") > 0, "in_progress").when(F.col("_failed") > 0, "blocked_review")
        .when(empty >= empty_cycles, "exhausted").otherwise("active")
    )
    return p.select(*keys, (F.col("cycle") + F.when(ran, 1).otherwise(0)).alias("cycle"), empty.alias("empty"), status.alias("status"))
