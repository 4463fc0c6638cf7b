"""Cities of places and the gazetteer, over customers as places and nations as cities."""

from pyspark.sql import functions as F

from loomstone.functions.names import edit_ratio
from loomstone.operators import gazetteer
from loomstone.operators.ranks import join_keys
from loomstone.plans.registry import Tables, query

_KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({c}.lat - {p}.lat) / 2), 2) + cos(radians({p}.lat)) * cos(radians({c}.lat)) * pow(sin(radians({c}.lon - {p}.lon) / 2), 2))))"
# a city per nation on a grid of two degrees; some share a name, some have a box, some need a point near
_CITY_SQL = """c AS (SELECT n_nationkey::BIGINT AS city, (n_regionkey)::BIGINT AS country, 'city ' || (n_nationkey % 20) AS name, 'town ' || n_nationkey AS locality, n_nationkey % 3 = 0 AS needs, n_nationkey % 2 = 0 AS boxed,
  (n_nationkey * 2)::DOUBLE AS lat, (n_nationkey * 2)::DOUBLE AS lon FROM nation),
p AS (SELECT c_custkey AS id, (c_custkey % 7)::BIGINT AS country, CASE c_custkey % 5 WHEN 0 THEN 'town ' || (c_custkey % 25) WHEN 1 THEN 'nowhere' ELSE 'city ' || (c_custkey % 20) END AS source,
  CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey * 3 % 500) / 10.0::DOUBLE END AS lat, (c_custkey * 3 % 500) / 10.0::DOUBLE + (c_custkey % 3) * 0.2::DOUBLE AS lon FROM customer),
o AS (SELECT c_custkey AS id, (c_custkey % 30)::BIGINT AS city, CASE WHEN c_custkey % 2 = 0 THEN 500.0::DOUBLE END AS reach FROM customer WHERE c_custkey % 17 = 0)"""


def _tables(t: Tables):
    k = F.col("n_nationkey").cast("long")
    at = (k * 2).cast("double")
    bounds = F.when(k % 2 == 0, F.struct((at - 1).alias("south"), (at - 1).alias("west"), (at + 1.5).alias("north"), (at + 1.5).alias("east")))
    country = F.col("n_regionkey").cast("long")
    cities = t.nation.select(k.alias("city"), country.alias("country"), bounds.alias("bounds"), (k % 3 == 0).alias("needs_point"), F.lit(150.0).alias("reach_km"))
    s = lambda a, x: F.concat(F.lit(a), x.cast("string"))
    names = t.nation.select(country.alias("country"), s("city ", k % 20).alias("name"), k.alias("city"), F.lit("canonical").alias("kind"))
    names = names.unionByName(t.nation.select(country.alias("country"), s("town ", k).alias("name"), k.alias("city"), F.lit("locality").alias("kind")))
    points = t.nation.select(k.alias("city"), at.alias("lat"), at.alias("lon"))
    c = F.col("c_custkey")
    x = (c * 3 % 500) / 10.0
    source = F.when(c % 5 == 0, s("town ", c % 25)).when(c % 5 == 1, "nowhere").otherwise(s("city ", c % 20))
    places = t.customer.select(c.alias("id"), (c % 7).alias("country"), source.alias("source"), F.when(c % 11 != 0, x).alias("lat"), (x + (c % 3) * 0.2).alias("lon"))
    overrides = t.customer.where(c % 17 == 0).select(c.alias("id"), (c % 30).alias("city"), F.when(c % 2 == 0, 500.0).alias("reach_km"))
    return places, cities, names, points, overrides


_ASSIGN = f"""{_CITY_SQL},
f AS (SELECT o.id, o.city, c.city IS NOT NULL AS there, o.reach IS NULL OR coalesce({_KM.format(c="c", p="p")} <= o.reach, false) AS fits FROM o JOIN p USING (id) LEFT JOIN c ON c.city = o.city AND c.country = p.country),
m AS (SELECT p.id, c.city, p.source = c.name AS canonical, needs, NOT needs OR coalesce({_KM.format(c="c", p="p")} <= 150.0, false) AS ok FROM p JOIN c ON p.country = c.country AND (p.source = c.name OR p.source = c.locality)),
n AS (SELECT id, count(*) AS n_all, count(*) FILTER (ok) AS nn, arg_min(city, city) FILTER (ok) AS city, arg_min(canonical, city) FILTER (ok) AS canonical, arg_min(needs, city) FILTER (ok) AS needs FROM m GROUP BY 1),
b AS (SELECT p.id, count(*) AS nb, min(c.city) AS box FROM p JOIN c ON p.country = c.country AND boxed AND p.lat BETWEEN c.lat - 1 AND c.lat + 1.5 AND p.lon BETWEEN c.lon - 1 AND c.lon + 1.5 GROUP BY 1),
r AS (SELECT p.id, f.city AS fc, n.city, box, CASE WHEN p.country NOT IN (SELECT country FROM c) THEN 'no_official_match' WHEN f.id IS NOT NULL THEN CASE WHEN NOT there THEN 'property_override_city_missing' WHEN fits THEN 'property_override' ELSE 'property_override_coordinate_conflict' END
  WHEN coalesce(n_all, 0) > 0 AND nn = 0 THEN 'official_name_coordinate_conflict' WHEN nn = 1 AND nb = 1 AND n.city <> box THEN 'coordinate_name_conflict' WHEN nn > 1 OR nb > 1 THEN 'ambiguous_official_mapping'
  WHEN coalesce(nn, 0) <> 1 AND coalesce(nb, 0) <> 1 THEN 'no_official_match' WHEN nn = 1 AND needs THEN CASE WHEN canonical THEN 'reference_exact_coordinate' ELSE 'reference_alias_coordinate' END
  WHEN coalesce(nn, 0) <> 1 THEN 'coordinate_boundary' WHEN canonical THEN 'canonical_exact' ELSE 'official_crosswalk' END AS method FROM p LEFT JOIN f USING (id) LEFT JOIN n USING (id) LEFT JOIN b USING (id)),
a AS (SELECT id, CASE method WHEN 'property_override' THEN fc WHEN 'coordinate_boundary' THEN box WHEN 'canonical_exact' THEN coalesce(box, city) WHEN 'official_crosswalk' THEN coalesce(box, city) WHEN 'reference_exact_coordinate' THEN coalesce(box, city) WHEN 'reference_alias_coordinate' THEN coalesce(box, city) END AS city,
  CASE WHEN method IN ('property_override', 'coordinate_boundary', 'canonical_exact', 'official_crosswalk', 'reference_exact_coordinate', 'reference_alias_coordinate') THEN 'verified' WHEN method = 'no_official_match' THEN 'unmapped' ELSE 'review_required' END AS status, method FROM r)"""


@query(f"WITH {_ASSIGN} SELECT id, city, status, method FROM a")
def city_assignment(t: Tables):
    """Overrides, names, localities, boxes and reference points, with the rules for what contradicts."""
    return gazetteer.assign_cities(*_tables(t))


@query(f"WITH {_ASSIGN} SELECT 'C' || (id % 5) AS before, city AS after, status, count(*) AS n FROM a GROUP BY ALL")
def city_plan(t: Tables):
    """How many places change from one city to another, by status."""
    rows = gazetteer.assign_cities(*_tables(t)).select("id", F.concat(F.lit("C"), (F.col("id") % 5).cast("string")).alias("before"), F.col("city").alias("after"), "status")
    return gazetteer.assignment_plan(rows, [F.col("after").cast("string")])[0]


@query(f"WITH {_ASSIGN} SELECT (id % 40) || '|' || city AS identity, count(*) AS n, min(id) AS first FROM a WHERE city IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def identity_clashes(t: Tables):
    """Places that would have one identity after the change."""
    rows = gazetteer.assign_cities(*_tables(t)).select("id", F.lit("").alias("before"), F.col("city").alias("after"), "status")
    return gazetteer.assignment_plan(rows, [(F.col("id") % 40).cast("string"), F.col("after").cast("string")])[1]


_LOCATIONS = """g AS (SELECT s_suppkey AS code, (s_suppkey % 4)::BIGINT AS country, 'n' || (s_suppkey % 6) AS name, (s_suppkey * 7 % 400) / 10.0::DOUBLE AS lat, (s_suppkey * 7 % 400) / 10.0::DOUBLE AS lon FROM supplier),
q AS (SELECT c_custkey AS id, (c_custkey % 4)::BIGINT AS country, 'n' || (c_custkey % 6) AS name, (c_custkey * 3 % 400) / 10.0::DOUBLE AS lat, (c_custkey * 3 % 400) / 10.0::DOUBLE AS lon FROM customer)"""
_MATCH = f"""d AS (SELECT q.id, code, {_KM.format(c="g", p="q")} AS km FROM q JOIN g USING (country, name) WHERE km <= 75),
k AS (SELECT id, code, km, lead(km) OVER w - km AS gap, row_number() OVER w AS rn FROM d WINDOW w AS (PARTITION BY id ORDER BY km, code))"""


def _located(t: Tables):
    s = lambda a, x: F.concat(F.lit(a), x.cast("string"))
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    g = t.supplier.select(k.alias("code"), (k % 4).alias("country"), s("n", k % 6).alias("name"), ((k * 7 % 400) / 10.0).alias("lat"), ((k * 7 % 400) / 10.0).alias("lon"))
    q = t.customer.select(c.alias("id"), (c % 4).alias("country"), s("n", c % 6).alias("name"), ((c * 3 % 400) / 10.0).alias("lat"), ((c * 3 % 400) / 10.0).alias("lon"))
    return q, g


@query(f"""WITH {_LOCATIONS}, {_MATCH} SELECT q.id, code, round(km, 3) AS distance_km, CASE WHEN gap < 1 THEN 'ambiguous' WHEN code IS NOT NULL THEN 'matched' ELSE 'none' END AS verdict FROM q LEFT JOIN (SELECT * FROM k WHERE rn = 1) USING (id)""")
def gazetteer_nearest(t: Tables):
    """The nearest location of a place's name, if no other is about as near."""
    return gazetteer.gazetteer_match(*_located(t)).withColumn("distance_km", F.round("distance_km", 3))


@query(f"""WITH {_LOCATIONS}, {_MATCH}, b AS (SELECT id, code FROM k WHERE rn = 1 AND (gap IS NULL OR gap >= 1)), n AS (SELECT q.id, min(code) AS code FROM q JOIN g USING (country, name) GROUP BY 1)
SELECT q.id, coalesce(b.code, n.code) AS code, CASE WHEN b.code IS NOT NULL THEN 'nearest' WHEN n.code IS NOT NULL THEN 'name' ELSE 'none' END AS source FROM q LEFT JOIN b USING (id) LEFT JOIN n USING (id)""")
def registry_cascade(t: Tables):
    """A near location of the name first, any of the name else."""
    q, g = _located(t)
    near = gazetteer.gazetteer_match(q, g).where("verdict = 'matched'")
    named = q.join(g.groupBy("country", "name").agg(F.min("code").alias("code")), ["country", "name"]).select("id", "code")
    return gazetteer.first_answer(q, [("nearest", near), ("name", named)])


_GROUPS = """p AS (SELECT c_nationkey AS g, c_custkey AS k, 'plaza ' || c_nationkey AS name, c_nationkey * 2 + (c_custkey % 10) * 0.01::DOUBLE AS lat, (c_nationkey * 2)::DOUBLE AS lon FROM customer),
l AS (SELECT s_suppkey AS code, CASE s_suppkey % 3 WHEN 0 THEN 'plaza ' WHEN 1 THEN 'plazas ' ELSE 'piazza ' END || s_nationkey AS name, s_nationkey * 2 + (s_suppkey % 7) * 0.02::DOUBLE AS lat, (s_nationkey * 2)::DOUBLE AS lon FROM supplier)"""


def _groups(t: Tables):
    k, n, s = F.col("c_custkey"), F.col("c_nationkey"), F.col("s_suppkey")
    text = lambda c: c.cast("string")
    p = t.customer.select(n.alias("group"), F.concat(F.lit("plaza "), text(n)).alias("name"), (n * 2 + (k % 10) * 0.01).alias("lat"), (n * 2).cast("double").alias("lon"))
    kind = F.when(s % 3 == 0, "plaza ").when(s % 3 == 1, "plazas ").otherwise("piazza ")
    m = F.col("s_nationkey")
    l = t.supplier.select(s.alias("code"), F.concat(kind, text(m)).alias("name"), (m * 2 + (s % 7) * 0.02).alias("lat"), (m * 2).cast("double").alias("lon"))  # noqa: E741
    return p, l


@query(f"""WITH {_GROUPS}, d AS (SELECT g, code, avg({_KM.format(c="l", p="p")}) AS mean, max({_KM.format(c="l", p="p")}) AS far FROM p JOIN l USING (name) GROUP BY ALL),
r AS (SELECT g, code, mean, lead(mean) OVER w AS next, row_number() OVER w AS rn FROM d WHERE far <= 14 WINDOW w AS (PARTITION BY g ORDER BY mean, code))
SELECT g, code, round(mean, 4) AS mean_km FROM r WHERE rn = 1 AND (next IS NULL OR next - mean >= 1)""")
def preferred_names(t: Tables):
    """The one location of a group's name that is nearest to all of its places."""
    p, l = _groups(t)  # noqa: E741
    return gazetteer.preferred_exact(p, l, 14.0).select(F.col("group").alias("g"), "code", F.round("mean_km", 4).alias("mean_km"))


@query(f"""WITH {_GROUPS}, open AS (SELECT * FROM p WHERE name NOT IN (SELECT name FROM l)), d AS (SELECT g, code, any_value(p.name) AS a, any_value(l.name) AS b, list_sort(list({_KM.format(c="l", p="p")}))[count(*) // 2 + 1] AS mid FROM open p CROSS JOIN l GROUP BY g, code),
s AS (SELECT g, code, mid, 1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE AS sim FROM d WHERE mid <= 12),
r AS (SELECT *, lead(sim) OVER w AS s2, lead(mid) OVER w AS d2, row_number() OVER w AS rn FROM s WHERE sim >= 0.5 WINDOW w AS (PARTITION BY g ORDER BY sim DESC, mid, code))
SELECT g, code, round(sim, 6) AS similarity, round(mid, 4) AS median_km, CASE WHEN sim - s2 < 0.05 AND abs(mid - d2) < 5 THEN 'review_required' ELSE 'verified' END AS status FROM r WHERE rn = 1""")
def preferred_variants(t: Tables):
    """For groups whose name no location has, the location near them with the most similar name."""
    p, l = _groups(t)  # noqa: E741
    v = gazetteer.preferred_variant(p, l, 12.0, edit_ratio)
    return v.select(F.col("group").alias("g"), "code", F.round("similarity", 6).alias("similarity"), F.round("median_km", 4).alias("median_km"), "status")


@query("""WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS a, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey + 1 END AS b, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey + 2 END AS c, CASE WHEN o_orderkey % 7 > 0 THEN o_custkey + 3 END AS d,
  (o_orderkey % 2)::DOUBLE AS off FROM orders),
s AS (SELECT *, CASE WHEN a IS NOT NULL THEN CASE WHEN b IS NULL THEN 'alone' WHEN off = 0 THEN 'agreed' ELSE 'disputed' END END AS checked,
  CASE WHEN a IS NOT NULL THEN 'first' WHEN b IS NOT NULL THEN 'second' WHEN c IS NOT NULL THEN 'hint' WHEN d IS NOT NULL THEN 'nearest' ELSE 'none' END AS step FROM c)
SELECT step, checked, count(*) AS n, sum(CASE WHEN checked = 'disputed' THEN NULL ELSE coalesce(a, b, c, d) END)::BIGINT AS codes FROM s GROUP BY ALL""")
def registry_steps(t: Tables):
    """Five steps to a place's city, the first checked against the second, and the audit of all."""
    k, v = F.col("o_orderkey"), F.col("o_custkey")
    made = lambda m, n: t.orders.select(k.alias("id"), F.when(k % m > 0, v + n).alias("code"), (k % 2 * n).cast("double").alias("lat"), F.lit(0.0).alias("lon"))
    out, audit = gazetteer.registry(t.orders.select(k.alias("id")), made(3, 0), made(4, 1), made(5, 2), made(7, 3))
    codes = out.groupBy("step", "checked").agg(F.sum("code").alias("codes"))
    return join_keys(audit, codes, ["step", "checked"]).select("step", "checked", "n", "codes")
