"""Latest rows, filters, set operations and changes."""

from pyspark.sql import functions as F

from loomstone.operators import changes, filters, latest
from loomstone.plans.registry import Tables, query

_LATEST = "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)"


def _newest():
    return [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]


@query(f"""
WITH l AS (SELECT * FROM orders QUALIFY {_LATEST} = 1),
n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT n_name, count(*) AS candidates, sum(greatest(1, coalesce(n, 0)))::BIGINT AS sources,
  count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderstatus = 'F') AS finished
FROM l JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN n ON l_orderkey = o_orderkey
GROUP BY n_name""")
def latest_country_summary(t: Tables):
    rows = latest.latest_per_key(t.orders, ["o_custkey"], _newest())
    counts = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    rows = rows.join(t.customer, rows.o_custkey == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.join(counts, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.groupBy("n_name").agg(
        F.count("*").alias("candidates"), F.sum(F.greatest(F.lit(1), F.coalesce("n", F.lit(0)))).alias("sources"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"),
    ).orderBy(F.desc("candidates"), "n_name")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_event_per_user(t: Tables):
    return latest.latest_per_key(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT o_custkey, o_orderkey FROM orders o WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def latest_with_ties(t: Tables):
    return latest.ties_of_latest(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate").select("o_custkey", "o_orderkey")


@query(f"SELECT o_custkey, o_orderkey FROM (SELECT * FROM orders WHERE o_orderstatus = 'F') QUALIFY {_LATEST} = 1")
def filter_before_latest(t: Tables):
    return latest.latest_per_key(t.orders, ["o_custkey"], _newest(), before=F.col("o_orderstatus") == "F").select("o_custkey", "o_orderkey")


@query(f"SELECT o_custkey, o_orderkey FROM (SELECT * FROM orders QUALIFY {_LATEST} = 1) WHERE o_orderstatus = 'F'")
def filter_after_latest(t: Tables):
    return latest.latest_per_key(t.orders, ["o_custkey"], _newest(), after=F.col("o_orderstatus") == "F").select("o_custkey", "o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment::VARCHAR = 'BUILDING' AND c_nationkey::VARCHAR = '7'")
def equality_filters(t: Tables):
    """Values are compared as strings; empty ones are no filter."""
    return filters.equal(t.customer, {"c_mktsegment": "BUILDING", "c_nationkey": 7, "c_name": "", "c_acctbal": None}).select("c_custkey", "c_name")


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 0 AND o_totalprice > 100000""")
def read_model_filter(t: Tables):
    """Wishes, flags and a surface together."""
    o = t.orders.withColumn("even", F.col("o_orderkey") % 2 == 0).withColumn("map_ready", F.col("o_totalprice") > 100_000).withColumn("urgent", F.lit(None).cast("boolean"))
    return filters.read_model(o, {"o_orderstatus": "O", "o_orderpriority": ""}, {"even": True, "urgent": False}, "map").select("o_orderkey")


@query("""WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'http://localhost/x' WHEN 1 THEN 'ftp://a.org' WHEN 2 THEN 'https://192.168.0.1/a' WHEN 3 THEN NULL ELSE url END AS url, (page_id * 2 % 200 - 100)::DOUBLE AS lat, CASE WHEN page_id % 5 <> 0 THEN (page_id % 400)::DOUBLE END AS lon, (page_id % 7 - 1) AS annual, CASE WHEN page_id % 4 = 0 THEN ' ' ELSE 'x' END AS name FROM pages)
SELECT page_id, concat_ws('; ', CASE WHEN name = ' ' THEN 'name missing' END, CASE WHEN NOT lat BETWEEN -90 AND 90 THEN 'lat out of range' END, CASE WHEN NOT coalesce(lon BETWEEN -180 AND 180, false) THEN 'lon out of range' END, CASE WHEN annual <= 0 THEN 'annual not positive' END, CASE WHEN page_id % 6 < 4 THEN 'url not public' END) AS issues FROM p""")
def row_issues(t: Tables):
    """Strings, degrees, visits and addresses of a row."""
    k = F.col("page_id")
    url = F.when(k % 6 == 0, "http://localhost/x").when(k % 6 == 1, "ftp://a.org").when(k % 6 == 2, "https://192.168.0.1/a").when(k % 6 > 3, F.col("url"))
    rows = t.pages.select(k, url.alias("url"), (k * 2 % 200 - 100).cast("double").alias("lat"), F.when(k % 5 != 0, (k % 400).cast("double")).alias("lon"), (k % 7 - 1).alias("annual"), F.when(k % 4 == 0, " ").otherwise("x").alias("name"))
    return rows.select("page_id", F.array_join(filters.row_issues("lat", "lon", "annual", ["name"], "url"), "; ").alias("issues"))


@query("""SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_acctbal < 0 THEN 'negative balance' END, CASE WHEN c_nationkey IS NULL THEN 'no nation' END,
  CASE WHEN length(c_mktsegment) > 9 THEN 'long segment' END], lambda x: x IS NOT NULL), ';') AS issues FROM customer""")
def quality_issues(t: Tables):
    issue = lambda bad, text: F.when(bad, F.lit(text))
    found = F.array_compact(F.array(issue(F.col("c_acctbal") < 0, "negative balance"), issue(F.col("c_nationkey").isNull(), "no nation"), issue(F.length("c_mktsegment") > 9, "long segment")))
    return t.customer.select("c_custkey", F.array_join(found, ";").alias("issues"))


@query("""SELECT o_orderkey, count(*) FILTER (l_returnflag = 'R') >= 1 OR count(*) FILTER (l_returnflag = 'A') >= 2 AS evidence_gate,
  count(DISTINCT l_suppkey) >= 2 AS sources_gate FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def evidence_gates(t: Tables):
    rows = t.orders.select("o_orderkey").join(t.lineitem.select("l_orderkey", "l_returnflag", "l_suppkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    strong, weak = F.count_if(F.col("l_returnflag") == "R") >= 1, F.count_if(F.col("l_returnflag") == "A") >= 2
    # at least two sources are there where the least is not the greatest, so no task has to hold all of them
    two = F.coalesce(F.min("l_suppkey") != F.max("l_suppkey"), F.lit(False))
    return rows.groupBy("o_orderkey").agg((strong | weak).alias("evidence_gate"), two.alias("sources_gate"))


@query("SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS has_review FROM orders")
def exists_open_review(t: Tables):
    reviews = t.lineitem.where("l_returnflag = 'R'").withColumnRenamed("l_orderkey", "o_orderkey")
    return changes.exists_flag(t.orders.select("o_orderkey"), reviews, ["o_orderkey"], "has_review")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'O')")
def scoped_delete(t: Tables):
    gone = t.orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return changes.delete_keys(t.lineitem.select("l_orderkey", "l_linenumber"), gone, ["l_orderkey"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem l SEMI JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000) o ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'")
def review_rows_of_pairs(t: Tables):
    pairs = t.orders.where("o_totalprice > 100000").select("o_orderkey")
    return t.lineitem.where("l_returnflag = 'R'").join(pairs, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber")


@query("""SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 0
QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 3""")
def quota_of_accepted(t: Tables):
    rows = t.customer.where("c_acctbal > 0")
    return latest.first_per_key(rows, ["c_nationkey", "c_mktsegment"], [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("c_custkey", "c_nationkey", "c_mktsegment")


@query("""SELECT c_custkey, c_nationkey, c_mktsegment, turn FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS turn FROM customer)
WHERE turn <= 4 ORDER BY turn, c_nationkey, c_mktsegment LIMIT 100 OFFSET 20""")
def round_robin_sample(t: Tables):
    rows = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    return latest.round_robin(rows, ["c_nationkey", "c_mktsegment"], [F.col("c_custkey")], per_key=4, limit=100, offset=20)


@query("""WITH s AS (SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS seg FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT c_custkey + 1000000, c_name, c_mktsegment FROM customer WHERE c_custkey % 5 = 0),
t AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'old ' || c_name ELSE c_name END AS name, c_mktsegment AS seg FROM customer)
SELECT coalesce(s.k, t.k) AS k, CASE WHEN s.k IS NOT NULL THEN s.name ELSE t.name END AS name, coalesce(s.seg, t.seg) AS seg,
  CASE WHEN s.k IS NULL THEN 'kept' WHEN t.k IS NULL THEN 'inserted' WHEN s.name IS NOT DISTINCT FROM t.name AND coalesce(s.seg, t.seg) IS NOT DISTINCT FROM t.seg THEN 'unchanged' ELSE 'updated' END AS status
FROM t FULL JOIN s ON s.k = t.k""")
def upsert_by_key(t: Tables):
    c = t.customer
    target = c.select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("old "), "c_name")).otherwise(F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("seg"))
    even = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("seg"))
    new = c.where("c_custkey % 5 = 0").select((F.col("c_custkey") + 1000000).alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"))
    return changes.upsert(target, even.unionByName(new), ["k"], ["name", "seg"], keep_if_null=["seg"])


@query("""SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_nationkey <> 3
UNION ALL SELECT c_custkey, c_nationkey, round(c_acctbal * 2, 2) FROM customer WHERE c_nationkey = 3""")
def replace_one_scope(t: Tables):
    rows = t.customer.select("c_custkey", "c_nationkey", "c_acctbal")
    return changes.replace_scope(rows, rows.withColumn("c_acctbal", F.round(F.col("c_acctbal") * 2, 2)), F.col("c_nationkey") == 3)


@query("""SELECT k, kind FROM (SELECT lower(c_mktsegment) AS k, 'segment' AS kind, 0 AS f FROM customer UNION ALL SELECT lower(o_orderpriority), 'priority', 1 FROM orders
  UNION ALL SELECT lower(n_name), 'nation', 2 FROM nation UNION ALL SELECT lower(r_name), 'region', 3 FROM region) QUALIFY row_number() OVER (PARTITION BY k ORDER BY f) = 1""")
def union_first_wins(t: Tables):
    part = lambda df, c, kind: df.select(F.lower(c).alias("k")).distinct().withColumn("kind", F.lit(kind))
    return changes.union_first([part(t.customer, "c_mktsegment", "segment"), part(t.orders, "o_orderpriority", "priority"), part(t.nation, "n_name", "nation"), part(t.region, "r_name", "region")], ["k"])


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
def keys_without_rows(t: Tables):
    return t.customer.select("c_custkey").subtract(t.orders.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")))


@query("SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'click'")
def keys_in_both(t: Tables):
    of = lambda kind: t.events.where(F.col("event_type") == kind).select("user_id")
    return of("purchase").intersect(of("click"))


@query("""SELECT coalesce(a.p_brand, b.p_brand) AS brand, a.n AS n_small, b.n AS n_large, CASE WHEN a.n IS NULL THEN 'missing left' WHEN b.n IS NULL THEN 'missing right' WHEN a.n <> b.n THEN 'differs' ELSE 'equal' END AS issue
FROM (SELECT p_brand, count(*) AS n FROM part WHERE p_size <= 2 GROUP BY 1) a FULL JOIN (SELECT p_brand, count(*) AS n FROM part WHERE p_size > 48 GROUP BY 1) b ON a.p_brand = b.p_brand""")
def reconcile_outputs(t: Tables):
    a = t.part.where("p_size <= 2").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n_small"))
    b = t.part.where("p_size > 48").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n_large"))
    issue = F.when(F.col("n_small").isNull(), "missing left").when(F.col("n_large").isNull(), "missing right").when(F.col("n_small") != F.col("n_large"), "differs").otherwise("equal")
    return a.join(b, "brand", "full_outer").withColumn("issue", issue)


@query("""SELECT n_name, seg, prio FROM nation, (SELECT DISTINCT c_mktsegment AS seg FROM customer), (SELECT DISTINCT o_orderpriority AS prio FROM orders)
WHERE NOT EXISTS (SELECT 1 FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey AND c_mktsegment = seg AND o_orderpriority = prio AND o_totalprice > 450000)""")
def tasks_not_yet_seeded(t: Tables):
    """Every nation with every segment and priority (three short lists of values), without what is done."""
    done = t.customer.join(t.orders.where("o_totalprice > 450000"), F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    done = done.select("n_name", F.col("c_mktsegment").alias("seg"), F.col("o_orderpriority").alias("prio")).distinct()
    every = t.nation.select("n_name").crossJoin(t.customer.select(F.col("c_mktsegment").alias("seg")).distinct()).crossJoin(t.orders.select(F.col("o_orderpriority").alias("prio")).distinct())
    return every.join(done, ["n_name", "seg", "prio"], "left_anti")
