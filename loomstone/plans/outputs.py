"""Windows over events, expansions, manifests and what screens show: orders, markers, gaps."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstone.plans.registry import Tables, query
from loomstone.sources import versions
from loomstone.sources.tables import Scratch
from loomstone.sources.sinks import manifest


@query("""WITH m AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, epoch_us(min(ts)) AS opened, epoch_us(max(ts)) + 43200000000 AS closed, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM s GROUP BY user_id, k""")
def session_windows(t: Tables):
    """Sessions of a user: events less than 12 hours apart; the same call runs on streams with a watermark."""
    out = t.events.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "12 hours").alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return out.select("user_id", F.unix_micros("w.start").alias("opened"), F.unix_micros("w.end").alias("closed"), "n", "errors")


@query("""WITH e AS (SELECT event_type, value, epoch_us(ts) // 86400000000 AS day FROM events)
SELECT event_type, (day - d) * 86400000000 AS opened, count(*) AS n, round(max(value), 4) AS top FROM e, (VALUES (0), (1), (2)) AS o(d) GROUP BY ALL""")
def sliding_windows(t: Tables):
    """Windows of three days, one opening each day."""
    w = t.events.groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "3 days", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.max("value"), 4).alias("top"))
    return w.select("event_type", F.unix_micros("w.start").alias("opened"), "n", "top")


@query("""SELECT o_orderstatus, year(o_orderdate)::INT AS y, count(*) AS n,
  sum(('0x' || substr(md5('=' || o_orderkey || '|=' || o_custkey || '|=' || o_orderpriority), 1, 8))::BIGINT)::BIGINT AS checksum FROM orders GROUP BY ALL""")
def snapshot_manifest(t: Tables):
    """Rows and an order-free checksum for each partition of a snapshot."""
    return manifest(t.orders.withColumn("y", F.year("o_orderdate")), ["o_orderkey", "o_custkey", "o_orderpriority"], ["o_orderstatus", "y"])


_PHRASES = ("%s suppliers in %s", "%s %s", "%S suppliers in %s")


@query("""WITH d AS (SELECT DISTINCT n_nationkey, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey),
x AS (SELECT n_nationkey, i, CASE i WHEN 0 THEN lower(c_mktsegment) || ' suppliers in ' || n_name WHEN 1 THEN lower(c_mktsegment) || ' ' || n_name ELSE upper(c_mktsegment) || ' suppliers in ' || n_name END AS phrase FROM d, (VALUES (0), (1), (2)) AS v(i))
SELECT n_nationkey, i AS template, phrase FROM x QUALIFY row_number() OVER (PARTITION BY n_nationkey, lower(phrase) ORDER BY i) = 1""")
def phrase_expansion(t: Tables):
    """Search phrases from templates and the pairs that occur; of phrases alike but for case the first template's stays."""
    pairs = t.customer.select("c_nationkey", "c_mktsegment").distinct().join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    lower = F.lower("c_mktsegment")
    rows = pairs.select("n_nationkey", F.posexplode(F.array(*[F.format_string(p, lower, "n_name") for p in _PHRASES])).alias("template", "phrase"))
    return rows.groupBy("n_nationkey", F.lower("phrase").alias("_low")).agg(F.min(F.struct("template", "phrase")).alias("_first")).select("n_nationkey", "_first.template", "_first.phrase")


@query("""SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal > 5000 DESC, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_acctbal END DESC NULLS LAST, s_name, s_suppkey)::INT AS place FROM supplier""")
def panel_order(t: Tables):
    """The order of a panel: marked rows first, then the metric, rows without one last, then the name."""
    metric = F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal"))
    w = Window.partitionBy("s_nationkey").orderBy(F.desc(F.col("s_acctbal") > 5000), metric.desc_nulls_last(), "s_name", "s_suppkey")
    return t.supplier.select("s_nationkey", "s_suppkey", F.row_number().over(w).alias("place"))


@query("""WITH p AS (SELECT s_nationkey, s_suppkey % 180 - 90 AS lat, s_suppkey % 360 - 180 AS lon, s_suppkey % 9 AS city FROM supplier WHERE s_acctbal > 3000)
SELECT n_nationkey, coalesce(round(avg(lat), 6), 0.0)::DOUBLE AS lat, coalesce(round(avg(lon), 6), 0.0)::DOUBLE AS lon, count(DISTINCT city) AS cities, count(lat) AS mapped
FROM nation LEFT JOIN p ON s_nationkey = n_nationkey GROUP BY 1""")
def markers(t: Tables):
    """A marker per nation at the mean of its mapped points, or a fallback; nations without points stay."""
    k = F.col("s_suppkey")
    points = t.supplier.where("s_acctbal > 3000").select("s_nationkey", (k % 180 - 90).alias("lat"), (k % 360 - 180).alias("lon"), (k % 9).alias("city"))
    mean = lambda c: F.coalesce(F.round(F.avg(c), 6), F.lit(0.0)).alias(c)
    return t.nation.join(points, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey").agg(mean("lat"), mean("lon"), F.count_distinct("city").alias("cities"), F.count("lat").alias("mapped"))


@query("""SELECT source, count(*) FILTER (lang IS NULL) AS no_language, count(*) FILTER (coalesce(text, '') = '') AS no_text, count(*) FILTER (n_chars < 200) AS short,
  count(*) FILTER (quality IS NULL) AS unlabelled, count(*) FILTER (toxic = 1) AS toxic, count(*) AS n
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def gap_counters(t: Tables):
    d = t.documents.join(t.labels, "doc_id", "left")
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    return d.groupBy("source").agg(
        n(F.col("lang").isNull(), "no_language"), n(F.coalesce("text", F.lit("")) == "", "no_text"), n(F.col("n_chars") < 200, "short"),
        n(F.col("quality").isNull(), "unlabelled"), n(F.col("toxic") == 1, "toxic"), F.count("*").alias("n"),
    )


@query("""WITH v AS (SELECT c_nationkey AS nation, c_custkey AS k, round(c_acctbal * 100)::BIGINT AS cents FROM customer),
n AS (SELECT nation, k, CASE WHEN nation % 4 = 1 THEN cents + 1 ELSE cents END AS cents FROM v)
SELECT 'pinned' AS reader, nation, count(*) AS n, sum(cents)::BIGINT AS cents FROM v GROUP BY 2 UNION ALL SELECT 'current', nation, count(*), sum(cents)::BIGINT FROM n GROUP BY 2
UNION ALL SELECT 'back', nation, count(*), sum(cents)::BIGINT FROM v GROUP BY 2""")
def versioned_publish(t: Tables):
    """A scoped publish and its rollback: who pinned a version keeps it, who asks later sees the new one, then the old one again."""
    root = f"{Scratch(t.spark).folder}/versions"
    v = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("k"), F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"))
    scope = F.col("nation") % 4 == 1
    versions.publish(v, root, ["nation"])
    pinned = versions.read(t.spark, root)
    versions.publish_scope(root, v.where(scope).withColumn("cents", F.col("cents") + 1), scope, ["nation"])
    now = versions.read(t.spark, root)
    versions.rollback(t.spark, root, by=["nation"])
    rows = None
    for name, df in (("pinned", pinned), ("current", now), ("back", versions.read(t.spark, root))):
        own = df.groupBy("nation").agg(F.count("*").alias("n"), F.sum("cents").alias("cents")).select(F.lit(name).alias("reader"), "nation", "n", "cents")
        rows = own if rows is None else rows.unionByName(own)
    return rows
