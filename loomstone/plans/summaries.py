"""Summaries by country, city and key; counts, gates and hashes."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstone.operators import latest
from loomstone.operators.complaints import input_hash
from loomstone.operators.network import map_ready
from loomstone.plans.registry import Tables, query

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("""SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, arg_min(l_linestatus, (l_shipdate, l_linenumber, l_partkey, l_linestatus)) AS main_status,
  array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS flags FROM lineitem GROUP BY l_orderkey""")
def evidence_per_entity(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("suppliers"), F.min_by("l_linestatus", F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_linestatus")).alias("main_status"),
        F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"),
    )


@query("""WITH c AS (SELECT *, (c_custkey % 140) - 70 AS lat, (c_custkey * 7 % 360) - 180 AS lon, (['Verified', 'Geocoded', 'Guessed', 'Cross-Checked', NULL])[(c_custkey % 5 + 1)::INT] IN ('Verified', 'Geocoded', 'Cross-Checked') AS ready FROM customer)
SELECT lower(trim(n_name)) || '::' || lower(trim(c_mktsegment)) AS city_key, count(*) AS n, count(*) FILTER (ready) AS map_points,
  round(coalesce(avg(lat) FILTER (ready), avg(lat)), 6) AS lat, round(coalesce(avg(lon) FILTER (ready), avg(lon)), 6) AS lon,
  CASE WHEN count(*) FILTER (ready) > 0 THEN 'map ready' ELSE 'all' END AS position_source, count(DISTINCT c_custkey % 11) AS localities
FROM c JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def city_summary(t: Tables):
    c = t.customer.withColumn("lat", F.col("c_custkey") % 140 - 70).withColumn("lon", F.col("c_custkey") * 7 % 360 - 180).withColumn("status", F.element_at(F.array(*map(F.lit, ("Verified", "Geocoded", "Guessed", "Cross-Checked", None))), (F.col("c_custkey") % 5 + 1).cast("int")))
    c = c.withColumn("ready", map_ready(F.col("lat"), F.col("lon"), F.col("status")))
    c = c.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.concat(F.lower(F.trim("n_name")), F.lit("::"), F.lower(F.trim("c_mktsegment")))
    centre = lambda x: F.round(F.coalesce(F.avg(F.when(F.col("ready"), F.col(x))), F.avg(x)), 6).alias(x)
    ready = F.count_if("ready")
    return c.groupBy(key.alias("city_key")).agg(F.count("*").alias("n"), ready.alias("map_points"), centre("lat"), centre("lon"), F.when(ready > 0, "map ready").otherwise("all").alias("position_source"), F.count_distinct(F.col("c_custkey") % 11).alias("localities"))


@query("""SELECT n_name, count(*) FILTER (c_mktsegment = 'AUTOMOBILE') AS automobile, count(*) FILTER (c_mktsegment = 'BUILDING') AS building, count(*) FILTER (c_mktsegment = 'FURNITURE') AS furniture,
  count(*) FILTER (c_mktsegment = 'HOUSEHOLD') AS household, count(*) FILTER (c_mktsegment = 'MACHINERY') AS machinery FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def country_segment_pivot(t: Tables):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    out = rows.groupBy("n_name").pivot("c_mktsegment", SEGMENTS).count().fillna(0)
    return out.select("n_name", *[F.col(c).alias(c.lower()) for c in SEGMENTS])


@query("SELECT c_nationkey, c_mktsegment, round(c_acctbal / 1000)::BIGINT AS bal, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1")
def duplicate_identities(t: Tables):
    bal = F.round(F.col("c_acctbal") / 1000)
    return t.customer.groupBy("c_nationkey", "c_mktsegment", bal.cast("long").alias("bal")).agg(F.count("*").alias("n")).where("n > 1")


@query("""SELECT count(*) FILTER (l_quantity <= 0) AS bad_quantity, count(*) FILTER (l_discount > 0.09) AS high_discount, count(*) FILTER (o_orderkey IS NULL) AS orphans,
  count(*) FILTER (l_shipdate < o_orderdate) AS shipped_early, count(*) FILTER (l_tax > 0.07 AND l_returnflag = 'R') AS taxed_returns,
  count(*) FILTER (o_orderkey IS NULL OR l_quantity <= 0) = 0 AS passed FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""")
def integrity_gate(t: Tables):
    rows = t.lineitem.join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    c = F.col
    return rows.agg(
        F.count_if(c("l_quantity") <= 0).alias("bad_quantity"), F.count_if(c("l_discount") > 0.09).alias("high_discount"), F.count_if(c("o_orderkey").isNull()).alias("orphans"),
        F.count_if(c("l_shipdate") < c("o_orderdate")).alias("shipped_early"), F.count_if((c("l_tax") > 0.07) & (c("l_returnflag") == "R")).alias("taxed_returns"),
        (F.count_if(c("o_orderkey").isNull() | (c("l_quantity") <= 0)) == 0).alias("passed"),
    )


@query("""SELECT 'customer' AS tbl, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem
UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents""")
def run_counts(t: Tables):
    out = None
    for name in ("customer", "orders", "lineitem", "events", "documents"):
        one = getattr(t, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT c_nationkey, sha256(count(*) || '|' || sum(('0x' || substr(sha256(c_custkey || '|' || c_name), 1, 15))::BIGINT)::HUGEINT || '|' || sum(('0x' || substr(sha256(c_custkey || '|' || c_name), 16, 15))::BIGINT)::HUGEINT) AS state FROM customer GROUP BY 1""")
def state_hash(t: Tables):
    """Hashes of rows add up, so no group is collected."""
    return input_hash(t.customer, "c_nationkey", ["c_custkey", "c_name"]).withColumnRenamed("input_hash", "state")


@query("""WITH e AS (SELECT p_type AS scene, p_partkey, count(l_orderkey) AS n, count(DISTINCT l_suppkey) AS doms FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT scene, count(*) AS total, count(*) FILTER (n > 0) AS has_evidence, count(*) FILTER (doms >= 2) AS multi_source, sum(n)::BIGINT AS evidence FROM e GROUP BY 1""")
def data_quality_per_scene(t: Tables):
    lines = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("doms"))
    e = t.part.select("p_type", "p_partkey").join(lines, F.col("l_partkey") == F.col("p_partkey"), "left").fillna(0, ["n", "doms"])
    return e.groupBy(F.col("p_type").alias("scene")).agg(F.count("*").alias("total"), F.count_if(F.col("n") > 0).alias("has_evidence"), F.count_if(F.col("doms") >= 2).alias("multi_source"), F.sum("n").alias("evidence"))


@query("""SELECT p_type, l_suppkey, n, rank FROM (SELECT p_type, l_suppkey, count(*) AS n, row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, l_suppkey) AS rank
FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2) WHERE rank <= 5""")
def top_sources_per_scene(t: Tables):
    rows = t.lineitem.select("l_partkey", "l_suppkey").join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    counts = rows.groupBy("p_type", "l_suppkey").agg(F.count("*").alias("n"))
    return latest.ranked(counts, ["p_type"], [F.desc("n"), F.col("l_suppkey")]).where("rank <= 5")


@query("""SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, lower(l_returnflag), l_suppkey % 4 ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC) = 1""")
def evidence_dedup(t: Tables):
    rows = t.lineitem.withColumn("f", F.lower("l_returnflag")).withColumn("i", F.col("l_suppkey") % 4)
    return latest.first_per_key(rows, ["l_orderkey", "f", "i"], [F.desc("l_shipdate"), F.desc("l_linenumber"), F.desc("l_partkey")]).select("l_orderkey", "l_partkey", "l_linenumber")


@query("""SELECT l_orderkey, arg_min(l_linenumber, (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, -l_extendedprice, l_linenumber)) AS main_line FROM lineitem GROUP BY 1""")
def main_evidence(t: Tables):
    tier = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return t.lineitem.groupBy("l_orderkey").agg(F.min_by("l_linenumber", F.struct(tier, -F.col("l_extendedprice"), F.col("l_linenumber"))).alias("main_line"))


@query("""SELECT r_name, count(DISTINCT n_nationkey) AS countries, count(c_custkey) AS candidates, count(*) FILTER (c_acctbal < 0) AS gaps, round(sum(c_acctbal), 2) AS total
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def region_rollup(t: Tables):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name").agg(F.count_distinct("n_nationkey").alias("countries"), F.count("c_custkey").alias("candidates"), F.count_if(F.col("c_acctbal") < 0).alias("gaps"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("""SELECT c_custkey, row_number() OVER (ORDER BY n_name, c_mktsegment, c_custkey) AS sort_order FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def read_model_order(t: Tables):
    """Ordinals of a total order: numbered within (nation, segment), after the counts of those before."""
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "c_mktsegment")
    counts = rows.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("n"))
    before = counts.select("n_name", "c_mktsegment", (F.coalesce(F.sum("n").over(Window.orderBy("n_name", "c_mktsegment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    own = latest.ranked(rows, ["n_name", "c_mktsegment"], [F.col("c_custkey")], "k")
    return own.join(before, ["n_name", "c_mktsegment"]).select("c_custkey", (F.col("before") + F.col("k")).alias("sort_order"))


@query("""SELECT event_type, count(*) AS n, round((count(*) FILTER (value > 50) + 0.5) / (count(*) + 1), 6) AS reliability FROM events GROUP BY 1""")
def source_reliability(t: Tables):
    ok = F.count_if(F.col("value") > 50)
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round((ok + F.lit(0.5)) / (F.count("*") + 1), 6).alias("reliability"))


@query("""WITH p AS (SELECT c_nationkey AS nation, count(*) AS cand, count(DISTINCT c_mktsegment) AS scenes, count(DISTINCT c_custkey % 7) AS src FROM customer GROUP BY 1)
SELECT nation, cand, scenes, src, round(src / cand, 4) AS density, CASE WHEN cand >= 60 AND scenes >= 5 THEN 'mature' WHEN cand >= 40 THEN 'growing' WHEN cand > 0 THEN 'early' ELSE 'none' END AS level FROM p""")
def scan_maturity(t: Tables):
    p = t.customer.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("cand"), F.count_distinct("c_mktsegment").alias("scenes"), F.count_distinct(F.col("c_custkey") % 7).alias("src"))
    level = F.when((F.col("cand") >= 60) & (F.col("scenes") >= 5), "mature").when(F.col("cand") >= 40, "growing").when(F.col("cand") > 0, "early").otherwise("none")
    return p.withColumn("density", F.round(F.col("src") / F.col("cand"), 4)).withColumn("level", level)
