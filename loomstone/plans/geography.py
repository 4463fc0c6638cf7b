"""Joins and functions by place; coordinates are formulas of the keys, the same in both engines."""

from pyspark.sql import functions as F

from loomstone.functions import geo
from loomstone.operators import spatial
from loomstone.plans.registry import Tables, query

_C = "SELECT c_custkey AS k, c_nationkey AS nation, (c_custkey * 37 % 1400) / 10.0::DOUBLE - 70 AS la, (c_custkey * 91 % 3600) / 10.0::DOUBLE - 180 AS lo FROM customer"
_S = "SELECT s_suppkey AS s, s_nationkey AS snation, (s_suppkey * 53 % 1400) / 10.0::DOUBLE - 70 AS ra, (s_suppkey * 17 % 3600) / 10.0::DOUBLE - 180 AS ro FROM supplier"
_D = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(ra - la) / 2), 2) + cos(radians(la)) * cos(radians(ra)) * pow(sin(radians(ro - lo) / 2), 2))))"


def _customers(t: Tables):
    return t.customer.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"), ((F.col("c_custkey") * 37 % 1400) / 10.0 - 70).alias("l_lat"), ((F.col("c_custkey") * 91 % 3600) / 10.0 - 180).alias("l_lon"))


def _suppliers(t: Tables):
    return t.supplier.select(F.col("s_suppkey").alias("s"), ((F.col("s_suppkey") * 53 % 1400) / 10.0 - 70).alias("r_lat"), ((F.col("s_suppkey") * 17 % 3600) / 10.0 - 180).alias("r_lon"))


@query(f"SELECT k, s, round({_D}, 1) AS distance_m FROM ({_C}) JOIN ({_S}) ON {_D} <= 300000")
def radius_join(t: Tables):
    return geo.radius_join(_customers(t), _suppliers(t), 300_000).select("k", "s", F.round("distance_m", 1).alias("distance_m"))


@query(f"""WITH n AS (SELECT k, s, {_D} AS d FROM ({_C}) JOIN ({_S}) ON {_D} <= 500000),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, s) AS rn, lead(d) OVER (PARTITION BY k ORDER BY d, s) AS second FROM n)
SELECT k, s, round(d, 1) AS distance_m, CASE WHEN second IS NULL OR (second - d >= 50000 AND second / d >= 1.5) THEN 'matched' ELSE 'review' END AS status FROM r WHERE rn = 1""")
def nearest_with_gap(t: Tables):
    """The nearest within 500 km, for review unless it is clearly nearer than the next."""
    c, p = _customers(t), _suppliers(t)
    two = spatial.nearest(c.select(F.col("k").alias("id"), F.col("l_lat").alias("lat"), F.col("l_lon").alias("lon")), p.select(F.col("s").alias("point"), F.col("r_lat").alias("lat"), F.col("r_lon").alias("lon")), 2, 500_000)
    pick = lambda n, x: F.max(F.when(F.col("position") == n, F.col(x)))
    r = two.groupBy(F.col("id").alias("k")).agg(pick(1, "point").alias("s"), pick(1, "distance_m").alias("first"), pick(2, "distance_m").alias("second"))
    # at no distance at all any other is more than 1.5 times as far; the gap decides alone
    times = F.when(F.col("first") == 0, F.lit(True)).otherwise(F.try_divide("second", "first") >= 1.5)
    clear = F.col("second").isNull() | ((F.col("second") - F.col("first") >= 50_000) & times)
    return r.select("k", "s", F.round("first", 1).alias("distance_m"), F.when(clear, "matched").otherwise("review").alias("status"))


@query(f"""WITH p AS (SELECT k, la, lo, greatest(-85.05112878, least(85.05112878, la)) AS c FROM ({_C})),
x AS (SELECT k, floor((lo + 180.0) / 360.0 * 4096)::BIGINT AS x, floor((0.5 - ln((1 + sin(radians(c))) / (1 - sin(radians(c)))) / (4 * pi())) * 4096)::BIGINT AS y FROM p)
SELECT k, x, y, array_to_string(list_transform(range(11, -1, -1), lambda b: (((x >> b) & 1) + 2 * ((y >> b) & 1))::VARCHAR), '') AS qk FROM x""")
def quadkeys(t: Tables):
    p = _customers(t).select("k", geo.tile_x(F.col("l_lon"), 12).alias("x"), geo.tile_y(F.col("l_lat"), 12).alias("y"))
    return p.withColumn("qk", geo.quadkey(F.col("x"), F.col("y"), 12))


@query(f"""WITH x AS (SELECT k, nation, floor((lo + 180.0) / 360.0 * 16)::BIGINT AS cx, floor((la + 90.0) / 180.0 * 8)::BIGINT AS cy FROM ({_C}))
SELECT cx, cy, count(*) AS n, count(DISTINCT nation) AS nations FROM x GROUP BY 1, 2""")
def grid_cells(t: Tables):
    x = F.floor((F.col("l_lon") + 180.0) / 360.0 * 16).alias("cx")
    y = F.floor((F.col("l_lat") + 90.0) / 180.0 * 8).alias("cy")
    return _customers(t).groupBy(x, y).agg(F.count("*").alias("n"), F.count_distinct("nation").alias("nations"))


@query(f"SELECT k, la BETWEEN -10 AND 40 AND lo BETWEEN -20 AND 60 AS inside, CASE WHEN abs(la) > 66 THEN 'polar' WHEN la BETWEEN -23.5 AND 23.5 THEN 'tropic' ELSE 'temperate' END AS zone FROM ({_C})")
def bounding_box(t: Tables):
    zone = F.when(F.abs("l_lat") > 66, "polar").when(F.col("l_lat").between(-23.5, 23.5), "tropic").otherwise("temperate")
    return _customers(t).select("k", geo.inside(F.col("l_lat"), F.col("l_lon"), -10, -20, 40, 60).alias("inside"), zone.alias("zone"))


#: Of each nation's region: corners of a slanted border and of a hole in it, as offsets of latitude and longitude.
_BORDER, _GAP = ((0, 0), (9, 4), (14, 16), (2, 21)), ((4, 8), (4, 12), (8, 12), (8, 8))
_SIDES = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for ring in (_BORDER, _GAP) for a, b in zip(ring, (*ring[1:], ring[0]), strict=True))


@query(f"""WITH e AS (SELECT n_nationkey AS nation, n_nationkey * 5 - 65 + a AS la, n_nationkey * 29 % 360 - 180 + b AS lo, n_nationkey * 5 - 65 + c AS lb, n_nationkey * 29 % 360 - 180 + d AS lob FROM nation, (VALUES {_SIDES}) v(a, b, c, d)),
m AS (SELECT k, nation, turn, count(*) AS n FROM ({_C.replace(", c_nationkey AS nation", "")}) JOIN e ON la <> lb AND (e.la > p_la) <> (e.lb > p_la) CROSS JOIN (VALUES (0), (360)) t(turn)
  WHERE p_lo + turn < (p_la - e.la) * ((e.lob - e.lo)::DOUBLE / (e.lb - e.la)) + e.lo GROUP BY ALL)
SELECT DISTINCT k, nation FROM m WHERE n % 2 = 1""".replace("AS la, (c_custkey * 91", "AS p_la, (c_custkey * 91").replace("- 180 AS lo FROM customer", "- 180 AS p_lo FROM customer"))
def places_in_regions(t: Tables):
    """Regions with holes are rows, one for each nation, some across the 180th meridian; cells join them to places."""
    k = F.col("n_nationkey")
    at = lambda r: F.array(*[F.struct((k * 5 - 65 + a).cast("double").alias("lat"), (k * 29 % 360 - 180 + b).cast("double").alias("lon")) for a, b in r])
    regions = t.nation.select(k.alias("region"), F.array(at(_BORDER), at(_GAP)).alias("rings"))
    points = _customers(t).select(F.col("k"), F.col("l_lat").alias("lat"), F.col("l_lon").alias("lon"))
    return spatial.within_regions(points, spatial.cover(regions)).select("k", F.col("region").alias("nation"))


_KM = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(ra - la) / 2), 2) + cos(radians(la)) * cos(radians(ra)) * pow(sin(radians(ro - lo) / 2), 2))))"
_TIER = "row_number() OVER (PARTITION BY k ORDER BY d, s) AS rn, lead(d) OVER (PARTITION BY k ORDER BY d, s) AS next"


@query(f"""WITH n AS (SELECT k, s, {_KM} AS d, s % 4 = 0 AS seat FROM ({_C}) CROSS JOIN ({_S})),
a AS (SELECT k, s, d, next FROM (SELECT *, {_TIER} FROM n WHERE seat AND d <= 900) WHERE rn = 1),
c AS (SELECT k, s, d, next FROM (SELECT *, {_TIER} FROM n WHERE d <= 600) WHERE rn = 1),
b AS (SELECT p.k, a.k IS NOT NULL AS seat, CASE WHEN a.k IS NULL THEN c.s ELSE a.s END AS s, CASE WHEN a.k IS NULL THEN c.d ELSE a.d END AS d, CASE WHEN a.k IS NULL THEN c.next ELSE a.next END AS next
  FROM ({_C}) p LEFT JOIN a USING (k) LEFT JOIN c ON c.k = p.k),
r AS (SELECT *, coalesce(next - d < 5 OR next / greatest(d, 0.1) < 1.5, false) AS close FROM b)
SELECT k, CASE WHEN NOT close THEN s END AS city, round(d, 3) AS distance_km, CASE WHEN s IS NULL THEN 'unmapped' WHEN close THEN 'review_required' ELSE 'verified' END AS status,
  CASE WHEN s IS NULL THEN 'none within reach' WHEN close THEN 'the next is as near' WHEN seat THEN 'nearest seat' ELSE 'nearest place' END AS reason FROM r""")
def nearest_cities(t: Tables):
    """The nearest seat within 900 km, else the nearest city within 600, for review where the next is as near."""
    places = _customers(t).select(F.col("k").alias("id"), F.col("l_lat").alias("lat"), F.col("l_lon").alias("lon"))
    cities = _suppliers(t).select(F.col("s").alias("city"), F.col("r_lat").alias("lat"), F.col("r_lon").alias("lon"), (F.col("s") % 4 == 0).alias("admin"))
    out = spatial.nearest_city(places, cities, F.lit(600.0), F.lit(900.0))
    return out.select(F.col("id").alias("k"), "city", F.round("distance_km", 3).alias("distance_km"), "status", "reason")


_DENSE = "SELECT s_suppkey AS code, 'n' || s_nationkey % 3 AS name, (s_suppkey * 53 % 997) / 4000.0::DOUBLE AS la, (s_suppkey * 17 % 1009) / 4000.0::DOUBLE AS lo FROM supplier"
_NEAR = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(x.la - p.la) / 2), 2) + cos(radians(x.la)) * cos(radians(p.la)) * pow(sin(radians(x.lo - p.lo) / 2), 2)))) <= 5"


@query(f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (ORDER BY code) AS n FROM ({_DENSE})),
step(n, kept, code, keeper) AS (
  SELECT 0::BIGINT, []::STRUCT(code BIGINT, name VARCHAR, la DOUBLE, lo DOUBLE)[], NULL::BIGINT, NULL::BIGINT
  UNION ALL
  SELECT p.n, CASE WHEN len(near) = 0 THEN list_append(kept, struct_pack(code := p.code, name := p.name, la := p.la, lo := p.lo)) ELSE kept END, p.code, coalesce(near[1].code, p.code)
  FROM (SELECT s.n + 1 AS m, s.kept, list_filter(s.kept, lambda x: x.name = p.name AND {_NEAR}) AS near FROM step s JOIN p ON p.n = s.n + 1) j JOIN p ON p.n = j.m)
SELECT code, keeper FROM step WHERE code IS NOT NULL""")
def collapsed_places(t: Tables):
    """Places of one name within 5 km fold into the first by code that was kept; SQL goes row by row."""
    k = F.col("s_suppkey")
    rows = t.supplier.select(k.alias("code"), F.concat(F.lit("n"), (F.col("s_nationkey") % 3).cast("string")).alias("name"), ((k * 53 % 997) / 4000.0).alias("lat"), ((k * 17 % 1009) / 4000.0).alias("lon"))
    return spatial.collapse(rows, 5.0)
