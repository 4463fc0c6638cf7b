"""The read model: one row per place out of its newest records, summaries from it, pages with full counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.operators.latest import first_per_key
from loomstone.operators.network import map_ready


def candidate_rows(candidates: DataFrame, places: DataFrame, one: Mapping[str, DataFrame], maybe: Mapping[str, DataFrame], evidence: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per newest candidate (pid, run) with its place, its newest rows of each table in one (which it must have)
    and in maybe, and n_evidence (at least 1), n_sources, first_value (of the oldest evidence), n_reviews.

    candidates: pid, run, stamp, id; places: pid and more; tables of one and maybe: pid, run, stamp, id and value columns;
    evidence: pid, run, stamp, id, url, value; reviews: pid, run. Every table is one row per (pid, run) before it is joined,
    so nothing multiplies.
    """
    newest = [F.desc("stamp"), F.desc("id")]
    out = first_per_key(candidates, ["pid"], newest).select("pid", "run").join(places, "pid")
    for tables, how in ((one, "inner"), (maybe, "left")):
        for name, df in tables.items():
            values = [F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in ("pid", "run", "stamp", "id")]
            out = out.join(first_per_key(df, ["pid", "run"], newest).select("pid", "run", *values), ["pid", "run"], how)
    e = evidence.groupBy("pid", "run").agg(
        F.count("*").alias("n_evidence"), F.count_distinct("url").alias("n_sources"), F.min_by("value", F.struct("stamp", "id")).alias("first_value")
    )
    r = reviews.groupBy("pid", "run").agg(F.count("*").alias("n_reviews"))
    out = out.join(e, ["pid", "run"], "left").join(r, ["pid", "run"], "left")
    return out.withColumn("n_evidence", F.greatest(F.lit(1), F.coalesce("n_evidence", F.lit(0)))).fillna(0, ["n_sources", "n_reviews"])


def country_summaries(rows: DataFrame) -> DataFrame:
    """country, n, map_points, coordinate_reviews, reviews, sources, scenes (map of counts) of rows (country, scene, lat, lon, status, n_reviews, n_sources).

    Counted by country and scene first, so the map is made of a few rows of a country.
    """
    ready = map_ready(F.col("lat"), F.col("lon"), F.col("status"))
    part = rows.groupBy("country", "scene").agg(
        F.count("*").alias("n"), F.count_if(ready).alias("map_points"), F.count_if(~ready).alias("coordinate_reviews"),
        F.sum(F.coalesce("n_reviews", F.lit(0))).alias("reviews"), F.sum(F.greatest(F.lit(1), F.coalesce("n_sources", F.lit(0)))).alias("sources"),
    )
    sums = [F.sum(c).alias(c) for c in ("map_points", "coordinate_reviews", "reviews", "sources")]
    scenes = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("scene", F.lit("")), "n"))))
    return part.groupBy("country").agg(F.sum("n").alias("n"), *sums, scenes.alias("scenes"))


def merged_scenes(rows: DataFrame, key: Sequence[str], scenes: str = "scenes") -> DataFrame:
    """key and the sum of maps of counts."""
    part = rows.select(*key, F.explode(scenes).alias("scene", "n")).groupBy(*key, "scene").agg(F.sum("n").alias("n"))
    return part.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("scene", "n")))).alias(scenes))


def regions(summaries: DataFrame, of: DataFrame, other: str = "Other regions") -> DataFrame:
    """region, countries, n, map_points, scenes of country summaries; of: country, region. A country without a region is of other."""
    r = summaries.join(of, "country", "left").withColumn("region", F.coalesce("region", F.lit(other)))
    sums = r.groupBy("region").agg(F.count("*").alias("countries"), F.sum("n").alias("n"), F.sum("map_points").alias("map_points"))
    return sums.join(merged_scenes(r, ["region"]), "region", "left")


def selected_total(summaries: DataFrame, country: str | None) -> DataFrame:
    """One row with the sums of a country, or of all; zeros if there is none."""
    rows = summaries if country is None else summaries.where(F.col("country") == country)
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "map_points", "reviews", "sources")])


def city_markers(features: DataFrame, packets: DataFrame, cached: DataFrame) -> DataFrame:
    """country, city, n, lat, lon, source: a marker per city at the mean of its features, else of ready packets, else of any packets, else where it was found before.

    features: country, city, lat, lon; packets: country, city, lat, lon, status; cached: country, city, lat, lon. Cities without any place have no marker.
    """
    keys = ["country", "city"]
    f = features.where("lat IS NOT NULL AND lon IS NOT NULL").groupBy(*keys).agg(F.avg("lat").alias("f_lat"), F.avg("lon").alias("f_lon"))
    ready = map_ready(F.col("lat"), F.col("lon"), F.col("status"))
    both = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    mean = lambda c, when, name: F.avg(F.when(when, F.col(c))).alias(name)
    p = packets.groupBy(*keys).agg(F.count("*").alias("n"), mean("lat", ready, "r_lat"), mean("lon", ready, "r_lon"), mean("lat", both, "a_lat"), mean("lon", both, "a_lon"))
    g = cached.groupBy(*keys).agg(F.first("lat").alias("g_lat"), F.first("lon").alias("g_lon"))
    out = p.join(f, keys, "left").join(g, keys, "left")
    order = (("f", "features"), ("r", "ready"), ("a", "any"), ("g", "cached"))
    pick = lambda c: F.coalesce(*[F.col(f"{x}_{c}") for x, _ in order])
    source = F.coalesce(*[F.when(F.col(f"{x}_lat").isNotNull(), name) for x, name in order])
    return out.select(*keys, "n", pick("lat").alias("lat"), pick("lon").alias("lon"), source.alias("source")).where("lat IS NOT NULL")


def page(rows: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows, each with the count of all (candidate_count) and of the page (display_count)."""
    total = rows.agg(F.count("*").alias("candidate_count"))
    shown = rows.orderBy(*order).offset(offset).limit(limit)
    both = shown.crossJoin(F.broadcast(total))  # one row
    n = F.greatest(F.lit(0), F.least(F.lit(limit), F.col("candidate_count") - offset))
    return both.withColumn("display_count", n.cast("long"))


def coverage(rows: DataFrame, flags: Mapping[str, Column], amounts: Sequence[str]) -> DataFrame:
    """One row: how many rows there are, whether any and how many have each flag, and sums."""
    any_of = [F.coalesce(F.bool_or(c), F.lit(False)).alias(f"any_{n}") for n, c in flags.items()]
    counts = [F.count_if(c).alias(f"n_{n}") for n, c in flags.items()]
    return rows.agg(F.count("*").alias("n"), *any_of, *counts, *[F.coalesce(F.sum(a), F.lit(0)).alias(a) for a in amounts])


def best_evidence(evidence: DataFrame, key: str, rank: Column, value: Column, tie: Column, names: Sequence[str]) -> DataFrame:
    """key and columns of the evidence with the smallest rank, then the greatest value, then the smallest tie; values that are not finite come last."""
    fine = F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))
    order = F.struct(rank.alias("r"), F.when(fine, -value).otherwise(F.lit(float("inf"))).alias("v"), tie.alias("t"))
    return evidence.groupBy(key).agg(F.min_by(F.struct(*names), order).alias("_m")).select(key, *[F.col(f"_m.{n}").alias(n) for n in names])


def source_documents(cache: DataFrame, evidence: DataFrame, raw: DataFrame, places: DataFrame, country: str | None = None) -> DataFrame:
    """url, text, pid, country, tier of cached sources: with the newest evidence of their address, else the newest raw row, and its place.

    cache: url, text; evidence: url, pid, tier, stamp, id; raw: url, pid, stamp, id; places: pid, country. One row per
    address on each side before the joins. With a country only addresses that evidence there has.
    """
    newest = [F.desc("stamp"), F.desc("id")]
    e = first_per_key(evidence, ["url"], newest).select("url", F.col("pid").alias("_e"), "tier")
    r = first_per_key(raw, ["url"], newest).select("url", F.col("pid").alias("_r"))
    c = cache.dropDuplicates(["url"])
    if country is not None:
        there = evidence.join(places.where(F.col("country") == country), "pid").select("url").distinct()
        c = c.join(there, "url", "left_semi")
    out = c.join(e, "url", "left").join(r, "url", "left").withColumn("pid", F.coalesce("_e", "_r"))
    return out.join(places.select("pid", "country"), "pid", "left").select("url", "text", "pid", "country", "tier")


def mix(rows: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    """keys, kind, n and its share of all rows of the keys."""
    part = rows.groupBy(*keys, kind).agg(F.count("*").alias("n"))
    total = part.groupBy(*keys).agg(F.sum("n").alias("_all"))
    return part.join(total, list(keys)).select(*keys, kind, "n", (F.col("n") / F.col("_all")).alias("share"))
