"""Ranks and exact percentiles of groups of any size; null keys are a group like any other.

A window over a whole group puts the group into one task. Here a group is first cut into ranges of
its values (splitters come from an approximate percentile, a sketch of bounded size), sums of ranges
are added up, and only a range is ever in one window. A value that fills a range alone is cut again
by the tie column, so many equal values don't meet in one task either. Percentiles need less: a sketch
brackets each wanted rank, and one pass counts what lies below a bracket and orders only what lies in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a group is cut into, and parts of a value that ends a range.
RANGES, PARTS = 64, 64
#: Accuracy of the sketch that brackets a rank; by the number of values of a group, how far a bracket reaches on either side.
ACCURACY, REACH = 10_000, ((10_000, 0.0005), (200, 0.011))


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", same: Sequence[str] = ()) -> DataFrame:
    """left joined with right on keys, where null equals null, and on the columns same, where it does not. Without any, right is one row."""
    on = F.lit(True)
    for c in [*keys, *same]:
        right = right.withColumnRenamed(c, f"_right_{c}")
        there = F.col(f"_right_{c}")
        on = on & (F.col(c).eqNullSafe(there) if c in keys else F.col(c) == there)
    if not keys and not same:
        return left.crossJoin(F.broadcast(right))
    return left.join(right, on, how).drop(*[f"_right_{c}" for c in [*keys, *same]])


def running(df: DataFrame, keys: Sequence[str], value: str, amount: Column, tie: str | None = None, name: str = "running", ranges: int = RANGES) -> DataFrame:
    """df with the sum of amount over the rows of its keys up to and with this one, in order of (value, tie).

    value is a number and not null (rows without one are dropped); tie, a whole number, decides among equal values.
    Rows equal in both get running sums in any order. The splitters only choose ranges: any would give the same sums.
    """
    keys = list(keys)
    at = [i / ranges for i in range(1, ranges)]
    rows = df.where(F.col(value).isNotNull()).withColumn("_amount", amount)
    spread = [F.percentile_approx(value, at, 10_000).alias("_cuts")]
    if tie:
        spread += [F.min(tie).alias("_low"), F.max(tie).alias("_high")]
    cuts = rows.groupBy(*keys).agg(*spread)
    rows = join_keys(rows, cuts, keys)
    v = F.col(value)
    rows = rows.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < v))).withColumn("_ends", F.array_contains("_cuts", v))
    part = F.lit(0)
    if tie:
        width = (F.col("_high") - F.col("_low") + 1) / PARTS
        part = F.when(F.col("_ends"), F.floor((F.col(tie) - F.col("_low")) / width)).otherwise(0)
    rows = rows.withColumn("_part", part.cast("int")).drop("_cuts", "_low", "_high")
    place = ["_range", "_ends", "_part"]
    # one row per range: at most RANGES x (1 + PARTS) of a group
    sums = rows.groupBy(*keys, *place).agg(F.sum("_amount").alias("_sum"))
    ahead = F.sum("_sum").over(Window.partitionBy(*keys).orderBy(*place).rowsBetween(Window.unboundedPreceding, -1))
    before = sums.select(*keys, *place, F.coalesce(ahead, F.lit(0)).alias("_before"))
    order = [v, F.col(tie)] if tie else [v]
    own = Window.partitionBy(*keys, *place).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumn("_within", F.sum("_amount").over(own))
    return join_keys(within, before, [*keys, *place]).withColumn(name, F.col("_before") + F.col("_within")).drop(*place, "_amount", "_before", "_within")


def row_numbers(df: DataFrame, keys: Sequence[str], value: str, tie: str, name: str = "rank") -> DataFrame:
    """df with each row's number, from 1, in order of (value, tie) within its keys."""
    return running(df, keys, value, F.lit(1).cast("long"), tie, name)


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, value, n (rows with this value) and upto (rows not above it); nulls are left out."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return running(counts, keys, value, F.col("n"), name="upto")


def percentiles_of(df: DataFrame, keys: Sequence[str], wanted: dict[str, dict[str, float]]) -> DataFrame:
    """keys and, for each column and name in wanted, the exact percentile of that column, linear between the two rows around it.

    Two passes over df, whatever the number of columns and points: a sketch for each group, which brackets the ranks, then
    counts, where everything below a bracket is one number before any shuffle. A bracket holds a thousandth of a large
    group, or 200 values, at most. Null values don't count; a group without any has nulls; values must not be NaN.
    """
    keys = list(keys)
    points = [(c, name, p) for c, names in wanted.items() for name, p in names.items()]
    sketch = []
    for c in wanted:
        sketch += [F.count(c).alias(f"_n_{c}"), F.min(c).alias(f"_min_{c}"), F.max(c).alias(f"_max_{c}")]
    for k, (c, _, p) in enumerate(points):
        at = [min(1.0, max(0.0, p + sign * reach)) for _, reach in REACH for sign in (-1, 1)]
        sketch.append(F.percentile_approx(c, at, ACCURACY).alias(f"_at_{k}"))
    stats = df.groupBy(*keys).agg(*sketch)

    def edge(k: int, c: str, upper: int) -> Column:
        out = F.col(f"_max_{c}" if upper else f"_min_{c}")
        for i, (least, _) in reversed(list(enumerate(REACH))):
            out = F.when(F.col(f"_n_{c}") >= least, F.col(f"_at_{k}")[2 * i + upper]).otherwise(out)
        return out

    brackets = [F.struct(edge(k, c, 0).alias("low"), edge(k, c, 1).alias("high"), F.col(f"_n_{c}").alias("n")).alias(f"_b_{k}") for k, (c, _, _) in enumerate(points)]
    rows = join_keys(df.select(*keys, *wanted), stats.select(*keys, *brackets), keys)
    each = []
    for k, (c, _, _) in enumerate(points):
        inside = F.when(F.col(c) >= F.col(f"_b_{k}.low"), F.col(c).cast("double"))
        each.append(F.when(F.col(c) <= F.col(f"_b_{k}.high"), F.struct(F.lit(k).alias("k"), inside.alias("v"), F.col(f"_b_{k}.n").alias("n"))))
    # null values are what lies below a bracket: one row for each task, group and point
    counts = rows.select(*keys, F.explode(F.array_compact(F.array(*each))).alias("_e")).groupBy(*keys, "_e.k", "_e.v").agg(F.count("*").alias("_c"), F.first("_e.n").alias("_n"))
    order = Window.partitionBy(*keys, "k").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0)
    upto = (counts.repartition(*keys) if keys else counts.coalesce(1)).withColumn("_upto", F.sum("_c").over(order))
    found = []
    for k, (_, name, p) in enumerate(points):
        own = F.col("k") == k
        at = (F.col("_n") - 1) * F.lit(p)
        low = F.min(F.when(own & (F.col("_upto") > F.floor(at)), F.struct("_upto", "v")))
        high = F.min(F.when(own & (F.col("_upto") > F.ceil(at)), F.struct("_upto", "v")))
        share = F.max(F.when(own, at - F.floor(at)))
        missed = F.max(F.when(own, 1)).isNotNull() & (low["v"].isNull() | high["v"].isNull())
        value = low["v"] + (high["v"] - low["v"]) * share
        found.append(F.when(missed, F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")).otherwise(value).alias(name))
    if not keys:
        return upto.agg(*found)
    # groups without values keep their row
    return join_keys(stats.select(*keys), upto.groupBy(*keys).agg(*found), keys, "left")


def percentiles(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """percentiles_of one column; a group without values has no row."""
    return percentiles_of(df.where(F.col(value).isNotNull()), keys, {value: points})


def share_below(df: DataFrame, keys: Sequence[str], value: str, name: str = "percentile") -> DataFrame:
    """df with (rows not above this one - 1) / (rows - 1); equal values share the highest, a group of one gives 0.5; null values give null."""
    counts = value_counts(df, keys, value)
    total = counts.groupBy(*keys).agg(F.sum("n").alias("_n"))
    share = F.when(F.col("_n") <= 1, 0.5).otherwise((F.col("upto") - 1) / (F.col("_n") - 1))
    places = join_keys(counts, total, keys).select(*keys, value, share.alias(name))
    return join_keys(df, places, keys, "left", [value])


def share_in_order(df: DataFrame, keys: Sequence[str], value: str, tie: str, name: str = "percentile") -> DataFrame:
    """df with (row number - 1) / (rows - 1) in order of (value, tie); a group of one gives 0.5."""
    total = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"))
    rows = join_keys(row_numbers(df, keys, value, tie, "_rank"), total, keys)
    share = F.when(F.col("_n") <= 1, 0.5).otherwise((F.col("_rank") - 1) / (F.col("_n") - 1))
    return rows.withColumn(name, share).drop("_rank", "_n")


def circular_batch(df: DataFrame, keys: Sequence[str], position: str, amount: str, start: int, least: float) -> DataFrame:
    """The items that a turn takes: from the one at start (modulo their number) on, around the end, until their amounts reach least.

    position counts the items of a group from 0 without gaps; amounts are not negative, null ones count as 0. The item that
    reaches least is the last one; one is always taken. Taking while the sum is below least is the same as a running sum and one
    cut, so no loop over items is needed.
    """
    keys = list(keys)
    n = df.groupBy(*keys).agg(F.count("*").alias("_items"))
    turn = F.pmod(F.col(position) - F.lit(start), F.col("_items"))
    rows = join_keys(df, n, keys).withColumn("_turn", turn.cast("double")).withColumn("_a", F.coalesce(F.col(amount), F.lit(0)))
    rows = running(rows, keys, "_turn", F.col("_a"), name="_upto")
    return rows.where((F.col("_upto") - F.col("_a") < least) | (F.col("_turn") == 0)).drop("_items", "_turn", "_a", "_upto")
