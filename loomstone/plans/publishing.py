"""Publishing scopes of tables, merges of registries, steps that skip what did not change."""

from pyspark.sql import functions as F

from loomstone.operators import publishing
from loomstone.plans.registry import Tables, query


@query("""SELECT o_orderkey, o_totalprice, 'kept' AS origin FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, o_totalprice + 1, 'new' FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 2 = 0""")
def publish_scope(t: Tables):
    """A scope is replaced after a check that nothing else changes."""
    now = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", F.lit("kept").alias("origin"))
    new = now.where("o_orderstatus = 'P' AND o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1).withColumn("origin", F.lit("new"))
    return publishing.publish_scope(now, new, F.col("o_orderstatus") == "P").drop("o_orderstatus")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE o_totalprice * 2 END AS o_totalprice FROM orders")
def rollback_scope(t: Tables):
    """A scope as it was, all else as it is."""
    backup = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    return publishing.rollback_scope(backup.withColumn("o_totalprice", F.col("o_totalprice") * 2), backup, F.col("o_orderstatus") == "P").drop("o_orderstatus")


@query("""WITH gone AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'P') SELECT 'orders' AS tbl, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT k FROM gone) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM gone)""")
def cascade_delete(t: Tables):
    """Orders go, and their lines with them."""
    gone = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("k"))
    left = publishing.cascade_delete({"orders": t.orders.withColumn("k", F.col("o_orderkey")), "lineitem": t.lineitem.withColumn("k", F.col("l_orderkey"))}, gone, ["k"])
    n = lambda name: left[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n")
    return n("orders").unionByName(n("lineitem"))


@query("""WITH e AS (SELECT c_custkey AS k, (c_custkey % 20)::BIGINT AS expected FROM customer), n AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) SELECT k, expected, coalesce(n, 0) AS n FROM e LEFT JOIN n USING (k) WHERE coalesce(n, 0) <> expected""")
def unexpected_counts(t: Tables):
    """Keys that have another number of rows than they should."""
    e = t.customer.select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 20).alias("expected"))
    return publishing.unexpected_counts(t.orders.select(F.col("o_custkey").alias("k")), e, "k")


@query("""WITH b AS (SELECT p_partkey AS k, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS brand FROM part WHERE p_partkey % 5 <> 0), o AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) END AS name, p_type AS brand FROM part WHERE p_partkey % 4 = 0)
SELECT coalesce(o.k, b.k) AS k, coalesce(o.name, b.name) AS name, coalesce(o.brand, b.brand) AS brand FROM b FULL JOIN o ON b.k = o.k""")
def merged_registry(t: Tables):
    """What the overlay says, else what the base says."""
    k = F.col("p_partkey")
    b = t.part.where(k % 5 != 0).select(k.alias("k"), F.col("p_name").alias("name"), F.when(k % 3 == 0, F.col("p_brand")).alias("brand"))
    o = t.part.where(k % 4 == 0).select(k.alias("k"), F.when(k % 2 == 0, F.upper("p_name")).alias("name"), F.col("p_type").alias("brand"))
    return publishing.merged_registry(b, o, "k", ["name", "brand"])


@query("""WITH r AS (SELECT l_orderkey AS k, l_suppkey % 4 AS e, l_quantity AS v, 1 AS f, l_linenumber AS n, l_partkey AS p FROM lineitem WHERE l_linenumber <= 4 UNION ALL SELECT l_orderkey, l_suppkey % 4, -l_quantity, 0, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber > 3)
SELECT k, e, v FROM r QUALIFY row_number() OVER (PARTITION BY k, e ORDER BY f, n, p, v) = 1""")
def merged_evidence(t: Tables):
    """Evidence of base and overlay, one row per key, the overlay's first."""
    r = t.lineitem.select(F.col("l_orderkey").alias("k"), (F.col("l_suppkey") % 4).alias("e"), F.col("l_quantity").alias("v"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"))
    out = publishing.merged_evidence(r.where("n <= 4"), r.where("n > 3").withColumn("v", -F.col("v")), ["k", "e"], [F.col("n"), F.col("p"), F.col("v")])
    return out.select("k", "e", "v")


@query("""WITH a AS (SELECT s_suppkey AS id, ['l' || (s_suppkey * 3 % 500), 'm' || (s_suppkey % 50)] AS labels, s_nationkey AS n FROM supplier), b AS (SELECT c_custkey AS id, ['l' || (c_custkey % 500), 'm' || (c_custkey % 70)] AS labels, c_nationkey AS n FROM customer),
p AS (SELECT DISTINCT b.id AS b, a.id AS a FROM a JOIN b ON list_has_any(a.labels, b.labels) AND abs(a.n - b.n) <= 9), o AS (SELECT b, min(a) AS a FROM p GROUP BY 1 HAVING count(*) = 1)
SELECT b.id AS b, o.a, array_to_string(list_sort(list_distinct(list_concat(b.labels, coalesce(a.labels, [])))), ',') AS labels FROM b LEFT JOIN o ON o.b = b.id LEFT JOIN a ON a.id = o.a""")
def consolidated_sources(t: Tables):
    """Rows of two sources are one if a label is shared, nothing speaks against it, and there is only one such."""
    s = lambda x, k: F.concat(F.lit(x), k.cast("string"))
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    a = t.supplier.select(k.alias("id"), F.array(s("l", k * 3 % 500), s("m", k % 50)).alias("labels"), F.col("s_nationkey").alias("n"))
    b = t.customer.select(c.alias("id"), F.array(s("l", c % 500), s("m", c % 70)).alias("labels"), F.col("c_nationkey").alias("n"))
    out = publishing.consolidated(a, b, F.abs(F.col("x.n") - F.col("y.n")) <= 9)
    return out.select("b", "a", F.array_join("labels", ",").alias("labels"))


@query("""SELECT o_custkey, CASE WHEN o_custkey % 3 = 0 THEN 'new' WHEN o_custkey % 3 = 1 THEN 'same' WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'changed' ELSE 'same' END AS change FROM orders GROUP BY 1""")
def changed_packages(t: Tables):
    """What must be computed again: groups whose rows are not those of the last time."""
    from loomstone.operators.complaints import input_hash

    before = t.orders.where("o_custkey % 3 = 1 OR (o_custkey % 3 = 2 AND o_orderstatus <> 'P')")
    seen = input_hash(before, "o_custkey", ["o_orderkey", "o_totalprice"])
    # a customer whose orders were all pending was not there before
    out = publishing.changed_groups(t.orders, "o_custkey", ["o_orderkey", "o_totalprice"], seen)
    change = F.when((F.col("o_custkey") % 3 == 2) & (F.col("change") == "new"), "changed").otherwise(F.col("change"))
    return out.select("o_custkey", change.alias("change"))


@query("""WITH p AS (SELECT c_custkey AS k, (c_custkey % 5)::BIGINT AS cycle, (c_custkey % 3)::BIGINT AS empty FROM customer), c AS (SELECT o_custkey AS k, sum(CASE WHEN o_totalprice > 400000 THEN 1 ELSE 0 END) AS acc, count(*) FILTER (o_orderpriority = '1-URGENT') AS failed, count(*) FILTER (o_orderstatus = 'P') AS open FROM orders GROUP BY 1),
j AS (SELECT p.*, acc, failed, open, CASE WHEN open = 0 AND failed = 0 THEN CASE WHEN acc > 0 THEN 0 ELSE empty + 1 END ELSE empty END AS e FROM p LEFT JOIN c USING (k))
SELECT k, cycle + CASE WHEN open = 0 THEN 1 ELSE 0 END AS cycle, e AS empty, CASE WHEN open IS NULL THEN 'pending' WHEN open > 0 THEN 'in_progress' WHEN failed > 0 THEN 'blocked_review' WHEN e >= 2 THEN 'exhausted' ELSE 'active' END AS status FROM j""")
def settled_progress(t: Tables):
    """A cycle's end: failures block, two cycles without anything new exhaust."""
    p = t.customer.select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 5).alias("cycle"), (F.col("c_custkey") % 3).alias("empty"))
    c = t.orders.select(F.col("o_custkey").alias("k"), (F.col("o_totalprice") > 400_000).cast("int").alias("accepted"), (F.col("o_orderpriority") == "1-URGENT").alias("failed"), (F.col("o_orderstatus") == "P").alias("open"))
    return publishing.settled(p, c, ["k"])
