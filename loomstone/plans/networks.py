"""Measured networks: confidence, scores, tiles near places, priorities."""

from pyspark.sql import functions as F

from loomstone.operators import network
from loomstone.plans.registry import Tables, query

_pick = lambda k, *v: F.element_at(F.array(*map(F.lit, v)), (k % len(v) + 1).cast("int"))


@query("""WITH x AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity::INT AS tests, (l_suppkey % 9)::INT AS devices, l_linenumber % 2 = 0 AS containing, l_partkey * 3.0::DOUBLE AS d, l_extendedprice / 500 AS down, CASE WHEN l_linenumber <> 3 THEN l_quantity * 9 END AS late,
  CASE l_partkey % 4 WHEN 0 THEN 'Poor' WHEN 1 THEN 'moderate' WHEN 2 THEN 'good' END AS class FROM lineitem)
SELECT k, n, CASE WHEN containing AND tests >= 10 AND devices >= 5 THEN 'high' WHEN d <= 1000 AND tests >= 3 AND devices >= 2 THEN 'medium' ELSE 'low' END AS matched, CASE WHEN tests >= 10 AND devices >= 5 THEN 'high' WHEN tests >= 3 AND devices >= 2 THEN 'medium' ELSE 'low' END AS tile,
  round(CASE lower(class) WHEN 'poor' THEN 0.2::DOUBLE WHEN 'moderate' THEN 0.52::DOUBLE WHEN 'good' THEN 0.78::DOUBLE ELSE 0.45::DOUBLE END * 0.45::DOUBLE + least(1.0, down / 120.0::DOUBLE) * 0.4::DOUBLE + CASE WHEN late IS NULL THEN 0.5 ELSE 1.0 - least(1.0, greatest(0.0, (late - 40.0) / 360.0::DOUBLE)) END * 0.15::DOUBLE, 6) AS score FROM x""")
def tile_scores(t: Tables):
    """How far a tile can be trusted, and how good its network is."""
    c = F.col
    tests, devices = c("l_quantity").cast("int"), (c("l_suppkey") % 9).cast("int")
    late = F.when(c("l_linenumber") != 3, c("l_quantity") * 9)
    score = network.mobile_score(c("l_extendedprice") / 500, late, _pick(c("l_partkey"), "Poor", "moderate", "good", None))
    matched = network.tile_confidence(tests, devices, c("l_linenumber") % 2 == 0, c("l_partkey") * 3.0)
    return t.lineitem.select(c("l_orderkey").alias("k"), c("l_linenumber").alias("n"), matched.alias("matched"), network.tile_confidence(tests, devices).alias("tile"), F.round(score, 6).alias("score"))


_KM = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(o.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(o.lat)) * pow(sin(radians(o.lon - p.lon) / 2), 2))))"
_NEAR = f"""p AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 120 - 60)::DOUBLE AS lat, (s_suppkey * 53 % 340 - 170)::DOUBLE AS lon FROM supplier),
o AS (SELECT c_custkey AS observation, c_custkey % 300 AS tile, (c_custkey * 37 % 120 - 60)::DOUBLE + (c_custkey % 7) * 0.01::DOUBLE AS lat, (c_custkey * 53 % 340 - 170)::DOUBLE AS lon, c_custkey % 13 AS tests, c_custkey % 5 AS devices, c_acctbal AS metric FROM customer),
n AS (SELECT id, observation, tile, tests, devices, metric, {_KM} AS d FROM p JOIN o ON abs(o.lat - p.lat) < 1 WHERE d <= 5000)"""


def _points(t: Tables):
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    lat, lon = lambda k: (k * 37 % 120 - 60).cast("double"), lambda k: (k * 53 % 340 - 170).cast("double")
    p = t.supplier.select(s.alias("id"), lat(s).alias("lat"), lon(s).alias("lon"))
    o = t.customer.select(c.alias("observation"), (c % 300).alias("tile"), (lat(c) + (c % 7) * 0.01).alias("lat"), lon(c).alias("lon"), (c % 13).alias("tests"), (c % 5).alias("devices"), F.col("c_acctbal").alias("metric"))
    return p, o


@query(f"WITH {_NEAR} SELECT id, tile, observation, round(d, 3) AS distance_m, tests, devices FROM n QUALIFY row_number() OVER (PARTITION BY id, tile ORDER BY d, tests DESC, devices DESC, observation) = 1")
def best_tiles_near(t: Tables):
    """The best observation of each tile within five kilometres of a place; they meet by cells."""
    return network.best_near(*_points(t), 5000.0).withColumn("distance_m", F.round("distance_m", 3))


@query(f"WITH {_NEAR} SELECT id, observation AS point, round(d, 3) AS distance_m, round(greatest(0.18::DOUBLE, least(1.0, metric / max(metric) OVER (PARTITION BY id))), 6) AS score FROM n WHERE metric > 0")
def footfall_near(t: Tables):
    """Points around a place, scored against the greatest of them."""
    p, o = _points(t)
    f = network.footfall(p, o.withColumnRenamed("observation", "point"), 5000.0)
    return f.select("id", "point", F.round("distance_m", 3).alias("distance_m"), F.round("score", 6).alias("score"))


@query("""SELECT l_partkey, l_returnflag, l_orderkey, l_linenumber, l_quantity AS tests FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_quantity DESC, l_orderkey, l_linenumber) = 1""")
def most_tested_tiles(t: Tables):
    rows = t.lineitem.select("l_partkey", "l_returnflag", "l_orderkey", "l_linenumber", F.col("l_quantity").alias("tests"))
    return network.most_tested(rows, ["l_partkey", "l_returnflag"], [F.col("l_orderkey"), F.col("l_linenumber")])


@query("""WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 9 <> 0 THEN (c_custkey % 200 - 100)::DOUBLE END AS lat, (c_custkey % 390 - 190)::DOUBLE AS lon, (['Verified', 'Geocoded', 'Guessed', ''])[(c_custkey % 4 + 1)::INT] AS st, c_acctbal AS v FROM customer),
s AS (SELECT *, CASE WHEN st = '' THEN 'Verified' ELSE st END AS status FROM c), r AS (SELECT *, CASE WHEN status NOT IN ('Verified', 'Geocoded', 'Cross-Checked') THEN 'status' WHEN NOT coalesce(lat BETWEEN -50 AND 50 AND lon BETWEEN -100 AND 100, false) THEN 'outside the country' END AS reason FROM s)
SELECT k, CASE WHEN reason IS NULL THEN status ELSE 'Review Required' END AS status, reason, round(degrees(acos(greatest(-1.0, least(1.0, sin(radians(lat)) * sin(radians(10.0)) + cos(radians(lat)) * cos(radians(10.0)) * cos(radians(lon - 20.0)))))), 6) AS away,
  round(((lon + 340.0) % 360 + 360) % 360 - 180.0, 6) AS wrapped, CASE WHEN v > 0 THEN round(least(1.0, CASE WHEN v > 1 THEN v / 100.0::DOUBLE ELSE v END), 6) END AS share FROM r""")
def coordinate_checks(t: Tables):
    """The status of a coordinate against its country's box, distances on the sphere, and scores of either scale."""
    k = F.col("c_custkey")
    lat, lon = F.when(k % 9 != 0, (k % 200 - 100).cast("double")), (k % 390 - 190).cast("double")
    box = [F.lit(x) for x in (-50.0, -100.0, 50.0, 100.0)]
    s = network.coordinate_status(F.col("lat"), F.col("lon"), F.col("st"), *box)
    rows = t.customer.select(k.alias("k"), lat.alias("lat"), lon.alias("lon"), _pick(k, "Verified", "Geocoded", "Guessed", "").alias("st"), F.col("c_acctbal").alias("v"))
    away = network.angular_distance(F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(20.0))
    return rows.select("k", s.alias("s"), F.round(away, 6).alias("away"), F.round(network.wrapped(F.col("lon") + 160.0), 6).alias("wrapped"), F.round(network.share_score(F.col("v")), 6).alias("share")).select("k", "s.status", "s.reason", "away", "wrapped", "share")


@query("""WITH c AS (SELECT c_custkey AS k, (['National Flagship', 'City Core', 'Regional Anchor', 'Observation'])[(c_custkey % 4 + 1)::INT] AS v, (['Direct Recommend', 'Survey First', 'Hold', NULL])[(c_custkey // 4 % 4 + 1)::INT] AS a FROM customer)
SELECT k, CASE WHEN v IN ('National Flagship', 'City Core') AND coalesce(a IN ('Direct Recommend', 'Survey First'), false) THEN 'Evidence-backed Priority' WHEN v <> 'Observation' THEN 'High Value / Validate Build Status' ELSE 'Review Needed' END AS band,
  CASE WHEN k % 5 = 0 THEN 50 ELSE k % 5 END * 1000 + CASE WHEN k % 3 = 0 THEN 100 ELSE k % 3 END + k % 7 AS priority FROM c""")
def priorities(t: Tables):
    """Which places come first, and which searches."""
    k = F.col("c_custkey")
    v, a = _pick(k, "National Flagship", "City Core", "Regional Anchor", "Observation"), _pick(F.floor(k / 4), "Direct Recommend", "Survey First", "Hold", None)
    p = network.discovery_priority(F.when(k % 5 != 0, k % 5), F.when(k % 3 != 0, k % 3), k % 7)
    return t.customer.select(k.alias("k"), network.priority_band(v, a).alias("band"), p.alias("priority"))
