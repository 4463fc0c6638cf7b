"""Recommendations by hard metrics: each place's best evidence, ranks in its group, fixed and moving thresholds; and the gate of city assignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.operators.latest import first_per_key
from loomstone.operators.ranks import join_keys, running

GROUP = ("country", "scene")


def best_evidence(evidence: DataFrame) -> DataFrame:
    """The best row of each place: of the metric that comes first, then the best source, the newest, the greatest value, then city and name.

    evidence: place, country, scene, city, name, metric, metric_order, tier (1 is best), dated (a number, greater is newer; null is oldest),
    value. Rows without a value don't count.
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    order = [F.col("metric_order"), F.col("tier"), F.desc_nulls_last("dated"), F.desc("value"), low("city"), low("name"), F.col("metric")]
    return first_per_key(evidence.where("value IS NOT NULL"), ["place"], order)


def recommended(scores: DataFrame, gates: DataFrame | None = None, target: int = 10) -> DataFrame:
    """scores (best_evidence) with rank, threshold_metric, threshold, recommended.

    Ranks go from 1 in each country and scene, by metric_order, falling value, city, name and place. gates: scene, metric, least, of scenes
    with a fixed gate: there a place is recommended if its value is at least that much, whatever its rank; rows of another metric are left out there.
    Elsewhere the threshold is the row at rank target, or the last one: the first target places are recommended, and places
    with the threshold's metric and at least its value. Equal values are counted before they are ordered, so only ties share a window.
    """
    keys = list(GROUP)
    fixed = (gates if gates is not None else scores.limit(0).select("scene", "metric", F.col("value").alias("least"))).select(
        F.col("scene"), F.col("metric").alias("_gm"), F.col("least").cast("double").alias("_least"))
    rows = join_keys(scores, fixed, ["scene"], "left").where(F.col("_gm").isNull() | (F.col("_gm") == F.col("metric")))
    own = rows.groupBy(*keys, "metric_order", "value").agg(F.count("*").alias("_n")).withColumn("_down", -F.col("value"))
    upto = running(own, [*keys, "metric_order"], "_down", F.col("_n"), name="_upto").select(*keys, "metric_order", "value", (F.col("_upto") - F.col("_n")).alias("_better"))
    # metrics of a scene are few: the rows of those that come before
    per = rows.groupBy(*keys, "metric_order").agg(F.count("*").alias("_m"))
    ahead = F.coalesce(F.sum("_m").over(Window.partitionBy(*keys).orderBy("metric_order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = join_keys(join_keys(rows, upto, [*keys, "metric_order", "value"]), per.withColumn("_ahead", ahead).drop("_m"), [*keys, "metric_order"])
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    ties = Window.partitionBy(*keys, "metric_order", "value").orderBy(low("city"), low("name"), "place")
    ranked = ranked.withColumn("rank", F.col("_ahead") + F.col("_better") + F.row_number().over(ties))
    last = ranked.where(F.col("rank") <= target).groupBy(*keys).agg(F.max(F.struct("rank", F.col("metric").alias("m"), F.col("value").alias("v"))).alias("_t"))
    out = join_keys(ranked, last, keys, "left")
    is_fixed = F.col("_gm").isNotNull()
    moving = (F.col("rank") <= target) | ((F.col("metric") == F.col("_t.m")) & (F.col("value") >= F.col("_t.v")))
    return out.select(
        *scores.columns, F.col("rank").cast("long").alias("rank"), F.when(is_fixed, F.col("_gm")).otherwise(F.col("_t.m")).alias("threshold_metric"),
        F.when(is_fixed, F.col("_least")).otherwise(F.col("_t.v")).alias("threshold"), F.when(is_fixed, F.col("value") >= F.col("_least")).otherwise(moving).alias("recommended"),
    )


def assignment_gate(places: DataFrame, assignments: DataFrame, expected: int) -> DataFrame:
    """One row: places, the five numbers that block a release, and passed, if all are zero.

    places: place, country, scene, identity, city, city_id; assignments: place, status, city, city_id. Blockers: count_differs (1 or 0), without_city
    (no or a blank city_id), without_assignment, invalid (not verified, without a city, or of another one), and collisions (identities of more than one place).
    """
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    a = assignments.select("place", F.col("status").alias("_s"), F.col("city").alias("_c"), F.col("city_id").alias("_i"), F.lit(True).alias("_there"))
    rows = places.join(a, "place", "left")
    wrong: Column = (F.col("_s") != "verified") | blank(F.col("_i")) | (F.col("_i") != F.col("city_id")) | (F.col("_c") != F.col("city"))
    per = rows.groupBy("country", "scene", "identity").agg(
        F.count("*").alias("n"), F.count_if(blank(F.col("city_id"))).alias("no_city"), F.count_if(F.col("_there").isNull()).alias("no_row"),
        F.count_if(F.col("_there").isNotNull() & F.coalesce(wrong, F.lit(False))).alias("wrong"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = per.agg(
        total("n").alias("places"), F.when(total("n") != expected, 1).otherwise(0).cast("long").alias("count_differs"), total("no_city").alias("without_city"),
        total("no_row").alias("without_assignment"), total("wrong").alias("invalid"), F.count_if(F.col("n") > 1).alias("collisions"),
    )
    blockers = ("count_differs", "without_city", "without_assignment", "invalid", "collisions")
    return out.withColumn("passed", sum((F.col(b) for b in blockers), F.lit(0)) == 0)
