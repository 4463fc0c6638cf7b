"""Demand and visitor models, search and retrieval."""

from pyspark.sql import functions as F

from loomstone.operators import visits
from loomstone.operators.latest import first_per_key
from loomstone.operators.retrieval import MENTIONED, SAME_PLACE, nearest_of_all
from loomstone.plans.registry import Tables, query


@query("""WITH v AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN 0 ELSE p_retailprice * 1000 END AS annual FROM part)
SELECT k, CASE WHEN annual IS NULL THEN 'no visits' WHEN annual <= 0 THEN 'not positive' END AS reason,
  CASE WHEN annual > 0 THEN round(annual / 365, 4) END AS daily, CASE WHEN annual > 0 THEN round(annual / 365 * 0.3 * 0.6 * 0.12, 4) END AS busy_users,
  CASE WHEN annual > 0 THEN round(annual / 365 * 0.3 * 0.6 * 0.12 * 0.05 * 1024 * 8 / 3600, 6) END AS mbps FROM v""")
def demand_chain(t: Tables):
    annual = F.when(F.col("p_partkey") % 11 == 0, F.lit(None)).when(F.col("p_partkey") % 13 == 0, 0.0).otherwise(F.col("p_retailprice") * 1000)
    v = t.part.select(F.col("p_partkey").alias("k"), annual.alias("annual"))
    d = v.select("k", visits.demand(F.col("annual"), attach=0.3, capture=0.6, busy=0.12, gigabytes=0.05).alias("d"))
    return d.select("k", "d.reason", F.round("d.daily", 4).alias("daily"), F.round("d.users", 4).alias("busy_users"), F.round("d.mbps", 6).alias("mbps"))


@query("""SELECT o_orderkey, CASE WHEN p = floor(p) AND p BETWEEN 1900 AND 2100 THEN NULL ELSE p END AS visits, p = floor(p) AND p BETWEEN 1900 AND 2100 AS year_like FROM (SELECT o_orderkey, floor(o_totalprice / 100) AS p FROM orders)""")
def year_like_guard(t: Tables):
    p = F.floor(F.col("o_totalprice") / 100).cast("double")
    rows = t.orders.select("o_orderkey", p.alias("p"))
    return rows.select("o_orderkey", visits.safe_visits(F.col("p")).alias("visits"), visits.year_like(F.col("p")).alias("year_like"))


@query(f"""WITH v AS (SELECT o_orderkey, floor(o_totalprice / 100) AS est, CASE WHEN o_custkey % 2 = 0 THEN floor(o_totalprice / 100) ELSE floor(o_totalprice / 100) * 10 END AS raw, CASE WHEN o_orderstatus = 'F' THEN 'no unit' END AS reason FROM orders),
y AS (SELECT *, est BETWEEN 1900 AND 2100 AS bad FROM v)
SELECT o_orderkey, CASE WHEN NOT bad THEN est END AS annual_visits_est, CASE WHEN NOT (bad AND raw BETWEEN 1900 AND 2100) THEN raw END AS annual_visits_raw, CASE WHEN NOT bad THEN est / 365 END AS daily_visits,
  CASE WHEN NOT bad THEN est / 50 END AS busy_hour_users, CASE WHEN bad THEN '{visits.BLOCKED}' ELSE reason END AS cannot_calculate_reason FROM y""")
def scrubbed_visits(t: Tables):
    """Payloads without visits that are a year, and without the demand that follows from them."""
    est = F.floor(F.col("o_totalprice") / 100).cast("double")
    rows = t.orders.select(
        "o_orderkey",
        est.alias("annual_visits_est"),
        F.when(F.col("o_custkey") % 2 == 0, est).otherwise(est * 10).alias("annual_visits_raw"),
        (est / 365).alias("daily_visits"),
        (est / 50).alias("busy_hour_users"),
        F.when(F.col("o_orderstatus") == "F", "no unit").alias("cannot_calculate_reason"),
    )
    return visits.scrubbed(rows)


@query("""SELECT l_orderkey, l_linenumber, coalesce(l_quantity BETWEEN lo AND hi, true) AS plausible FROM lineitem LEFT JOIN (VALUES ('A', 5.0, 40.0), ('N', 1.0, 45.0)) b(f, lo, hi) ON l_returnflag = f""")
def plausibility_bounds(t: Tables):
    bounds = t.spark.createDataFrame([("A", 5.0, 40.0), ("N", 1.0, 45.0)], "f string, lo double, hi double")
    rows = t.lineitem.join(bounds, F.col("l_returnflag") == F.col("f"), "left")
    return rows.select("l_orderkey", "l_linenumber", F.coalesce(F.col("l_quantity").between(F.col("lo"), F.col("hi")), F.lit(True)).alias("plausible"))


@query("""WITH m AS (SELECT l_orderkey AS k, l_returnflag AS key, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2), p AS (SELECT k, max(v) FILTER (key = 'A') AS a, max(v) FILTER (key = 'N') AS n, max(v) FILTER (key = 'R') AS r FROM m GROUP BY 1)
SELECT k, CASE WHEN a IS NOT NULL THEN 'direct annual' WHEN n IS NOT NULL THEN 'direct daily' WHEN r IS NOT NULL THEN 'proxy' ELSE 'insufficient' END AS method,
  CASE WHEN a IS NOT NULL THEN a WHEN n IS NOT NULL THEN n * 365 WHEN r IS NOT NULL THEN r * 120 END AS p50, CASE WHEN a IS NULL AND n IS NOT NULL THEN n * 300 WHEN a IS NULL AND r IS NOT NULL THEN r * 60 END AS p10,
  CASE WHEN a IS NULL AND n IS NOT NULL THEN n * 365 * 1.2 WHEN a IS NULL AND r IS NOT NULL THEN r * 200 END AS p90 FROM p""")
def visit_method_cascade(t: Tables):
    """Direct annual numbers first (without a range), then daily ones, then a proxy."""
    p = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.max("l_quantity"))
    a, n, r = F.col("A"), F.col("N"), F.col("R")
    cascade = lambda x, y, z: F.when(a.isNotNull(), x).when(n.isNotNull(), y).when(r.isNotNull(), z)
    none = F.lit(None).cast("double")
    method = cascade(F.lit("direct annual"), F.lit("direct daily"), F.lit("proxy"))
    return p.select("k", F.coalesce(method, F.lit("insufficient")).alias("method"), cascade(a, n * 365, r * 120).alias("p50"), cascade(none, n * 300, r * 60).alias("p10"), cascade(none, n * 365 * 1.2, r * 200).alias("p90"))


@query("""WITH c AS (SELECT l_orderkey AS k, 'rooms' AS grp, l_linenumber AS pos, l_quantity AS v FROM lineitem WHERE l_linenumber <= 3 UNION ALL SELECT l_orderkey, 'events', l_linenumber, l_quantity FROM lineitem WHERE l_linenumber > 3),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY k, grp ORDER BY pos) = 1)
SELECT k, count(*) AS parts, round(sum(v * CASE grp WHEN 'rooms' THEN 30 ELSE 5 END), 2) AS p50 FROM f GROUP BY 1""")
def component_sum(t: Tables):
    """The first component of each group counts, of those in one position the one stored first; groups add up."""
    grp = F.when(F.col("l_linenumber") <= 3, "rooms").otherwise("events")
    c = t.stored("lineitem").select(F.col("l_orderkey").alias("k"), grp.alias("grp"), F.col("l_linenumber").alias("pos"), F.col("l_quantity").alias("v"), "at")
    f = first_per_key(c, ["k", "grp"], [F.col("pos"), F.col("at")])
    return f.groupBy("k").agg(F.count("*").alias("parts"), F.round(F.sum(F.col("v") * F.when(F.col("grp") == "rooms", 30).otherwise(5)), 2).alias("p50"))


@query("""WITH s AS (SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'green' THEN 0 WHEN starts_with(lower(p_name), 'g') THEN 1 WHEN contains(lower(p_name), 'a') THEN 2 ELSE 9 END AS rk FROM part)
SELECT p_partkey, rk FROM s WHERE rk < 9 ORDER BY rk, length(p_name), p_name, p_partkey LIMIT 25""")
def search_ranking(t: Tables):
    name = F.lower("p_name")
    rk = F.when(name == "green", 0).when(name.startswith("g"), 1).when(name.contains("a"), 2).otherwise(9)
    return t.part.select("p_partkey", "p_name", rk.alias("rk")).where("rk < 9").orderBy("rk", F.length("p_name"), "p_name", "p_partkey").limit(25).select("p_partkey", "rk")


@query("""WITH q AS (SELECT vec_id AS q, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0), c AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q, vec_id, round(list_cosine_similarity(q.e, c.e) + CASE WHEN label = 1 THEN 0.08 WHEN label = 2 THEN 0.04 ELSE 0 END, 6) AS score FROM q, c WHERE q <> vec_id)
SELECT q, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) <= 10""")
def chunk_retrieval_all(t: Tables):
    """Cosine and a boost by tier, the ten best chunks for every row whose id is divisible by 50, against all rows."""
    boost = F.when(F.col("label") == 1, 0.08).when(F.col("label") == 2, 0.04).otherwise(0.0)
    return nearest_of_all(t.embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), boost.alias("boost"), F.col("embedding").cast("array<double>").alias("e"))).drop("read")


@query(f"""WITH c AS (SELECT vec_id, label, vec_id % 7 AS field, vec_id % 11 AS place, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT vec_id AS q, field AS f, place AS p, e AS qe FROM c WHERE vec_id % 50 = 0),
s AS (SELECT q, vec_id, round(list_cosine_similarity(qe, e) + CASE WHEN label = 1 THEN 0.08 WHEN label = 2 THEN 0.04 ELSE 0 END + CASE WHEN f = field THEN {MENTIONED} ELSE 0 END + CASE WHEN p = place THEN {SAME_PLACE} ELSE 0 END, 6) AS score FROM q, c WHERE q <> vec_id)
SELECT q, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) <= 10""")
def chunk_retrieval(t: Tables):
    """As chunk_retrieval_all, with what a chunk gains for the question's field and place."""
    boost = F.when(F.col("label") == 1, 0.08).when(F.col("label") == 2, 0.04).otherwise(0.0)
    k = F.col("vec_id").cast("long")
    return nearest_of_all(t.embeddings.select(k.alias("vec_id"), boost.alias("boost"), (k % 7).alias("field"), (k % 11).alias("place"), F.col("embedding").cast("array<double>").alias("e"))).drop("read")
