"""Percentiles, trends, rollups with freshness, calibration, recommendations, queues."""

from pyspark.sql import functions as F

from loomstone.operators import recommend, visits
from loomstone.operators.network import network_class
from loomstone.operators.latest import ranked
from loomstone.operators.ranks import circular_batch, join_keys, percentiles_of, row_numbers, share_below
from loomstone.plans.registry import Tables, query
from loomstone.streaming import queue

_QUARTER = "year(l_shipdate) * 4 + quarter(l_shipdate) - 1"
_PANEL = f"""SELECT s_nationkey AS nation, {_QUARTER} AS q, s_suppkey AS supp, sum(round(l_extendedprice * 100)::BIGINT) / count(*) AS speed, sum(l_quantity::BIGINT) / count(*) AS latency
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL"""


def _panel(t: Tables):
    rows = t.lineitem.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    q = F.year("l_shipdate") * 4 + F.quarter("l_shipdate") - 1
    return rows.groupBy(F.col("s_nationkey").alias("nation"), q.cast("long").alias("q"), F.col("s_suppkey").alias("supp")).agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / F.count("*")).alias("speed"), (F.sum(F.col("l_quantity").cast("long")) / F.count("*")).alias("latency"))


@query(f"""WITH p AS ({_PANEL}), c AS (SELECT nation, q, quantile_cont(speed, 0.2) AS s20, quantile_cont(speed, 0.4) AS s40, quantile_cont(latency, 0.6) AS l60, quantile_cont(latency, 0.8) AS l80 FROM p GROUP BY 1, 2)
SELECT supp, q, CASE WHEN speed <= s20 OR latency >= l80 THEN 'poor' WHEN speed <= s40 OR latency >= l60 THEN 'moderate' ELSE 'good' END AS class FROM p JOIN c USING (nation, q)""")
def performance_class(t: Tables):
    """Both measures' percentiles of each nation and quarter come from one sketch and one exact pass."""
    p = _panel(t)
    c = percentiles_of(p, ["nation", "q"], {"speed": {"p20": 0.2, "p40": 0.4}, "latency": {"p60": 0.6, "p80": 0.8}})
    kind = network_class(F.col("speed"), F.col("latency"), F.col("p20"), F.col("p40"), F.col("p60"), F.col("p80"))
    return join_keys(p, c, ["nation", "q"]).select("supp", F.col("q").cast("long"), kind.alias("class"))


@query("""SELECT p_partkey, round(CASE WHEN n <= 1 THEN 0.5 ELSE (r - 1) / (n - 1) END, 6) AS pct FROM (SELECT p_partkey, count(*) OVER (PARTITION BY p_brand) AS n,
  (count(*) OVER (PARTITION BY p_brand ORDER BY p_size))::DOUBLE AS r FROM part)""")
def rank_percentile_with_ties(t: Tables):
    return share_below(t.part.select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_size", "pct").select("p_partkey", F.round("pct", 6).alias("pct"))


@query(f"""WITH p AS (SELECT supp, q, speed FROM ({_PANEL}))
SELECT a.supp, a.q, round(a.speed, 4) AS speed, round(b.speed, 4) AS previous, round((a.speed - b.speed) / b.speed, 6) AS trend FROM p a LEFT JOIN p b ON a.supp = b.supp AND b.q = a.q - 1""")
def previous_quarter_trend(t: Tables):
    """Each row goes to its own quarter and, as what was before, to the next: one shuffle of one panel, no join with itself.

    A missing quarter gives null, which lag() would not.
    """
    p = _panel(t).select("supp", "q", "speed")
    sides = F.array(F.struct(F.col("q"), F.col("speed").alias("now"), F.lit(None).cast("double").alias("before")), F.struct((F.col("q") + 1).alias("q"), F.lit(None).cast("double").alias("now"), F.col("speed").alias("before")))
    rows = p.select("supp", F.explode(sides).alias("s")).groupBy("supp", "s.q").agg(F.max("s.now").alias("speed"), F.max("s.before").alias("before")).where("speed IS NOT NULL")
    trend = (F.col("speed") - F.col("before")) / F.col("before")
    return rows.select("supp", "q", F.round("speed", 4).alias("speed"), F.round("before", 4).alias("previous"), F.round(trend, 6).alias("trend"))


@query("""WITH s AS (SELECT p_type AS scene, p_retailprice AS actual, p_retailprice * (1 + (p_partkey % 7 - 3) / 20.0::DOUBLE) AS v1, p_retailprice * (1 + (p_partkey % 5 - 2) / 50.0::DOUBLE) AS v2 FROM part),
a AS (SELECT scene, count(*) AS n, avg(abs(v1 - actual) / actual) AS mape1, avg(abs(v2 - actual) / actual) AS mape2, median(abs(v2 - actual) / actual) AS mdape FROM s GROUP BY 1)
SELECT scene, n, round(mape1, 6) AS mape1, round(mape2, 6) AS mape2, round(mdape, 6) AS mdape, round((mape1 - mape2) / mape1, 6) AS gain, n >= 30 AND (mape1 - mape2) / mape1 >= 0.2 AS passed FROM a""")
def calibration(t: Tables):
    k, x = F.col("p_partkey"), F.col("p_retailprice")
    s = t.part.select(F.col("p_type").alias("scene"), x.alias("actual"), (x * (1 + (k % 7 - 3) / 20.0)).alias("v1"), (x * (1 + (k % 5 - 2) / 50.0)).alias("v2"))
    a = visits.calibration(s, "scene", least=30, gain=0.2)
    errors = [F.round(c, 6).alias(c) for c in ("mape1", "mape2", "mdape", "gain")]
    return a.select("scene", "n", *errors, (F.col("status") == "passed").alias("passed"))


@query("""WITH r AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rk,
  count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer),
g AS (SELECT *, max(CASE WHEN rk = least(10, n) THEN c_acctbal END) OVER (PARTITION BY c_nationkey, c_mktsegment) AS gate FROM r)
SELECT c_custkey, rk, gate, c_acctbal >= gate AS recommended FROM g""")
def recommendation_threshold(t: Tables):
    """The gate is the value at rank ten, or at the last one; ties with it are in."""
    keys = ["c_nationkey", "c_mktsegment"]
    rows = t.customer.select("c_custkey", *keys, "c_acctbal", (-F.col("c_acctbal")).alias("down"))
    r = row_numbers(rows, keys, "down", "c_custkey", "rk")
    gates = r.where("rk <= 10").groupBy(*keys).agg(F.min("c_acctbal").alias("gate"))
    return r.join(gates, keys).select("c_custkey", "rk", "gate", (F.col("c_acctbal") >= F.col("gate")).alias("recommended"))


@query("""WITH q AS (SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END AS prio, o_orderdate AS ts, o_orderstatus AS status, o_orderkey % 3 AS tries FROM orders),
c AS (SELECT id, prio, tries + 1 AS attempts FROM q WHERE (id % 5 > 0 OR ts <= TIMESTAMP '1996-01-01') AND (status = 'O' OR (status = 'P' AND ts <= TIMESTAMP '1996-01-01') OR (status = 'F' AND ts <= TIMESTAMP '1996-01-01' - INTERVAL 86400 SECOND))
  ORDER BY prio, ts, id LIMIT 50) SELECT id, prio, attempts FROM c WHERE id % 7 <> 0""")
def lease_queue_claim(t: Tables):
    """The fifty tasks whose turn it is: queued, failed, expired or long completed ones; those of worked-off progress are not given out."""
    prio = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(3)
    at, k = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "leased").otherwise("completed")
    tasks = t.orders.select(k.alias("id"), prio.alias("priority"), status.alias("status"), F.lit(None).cast("string").alias("owner"), (k % 3).cast("long").alias("attempts"), at.alias("updated_at"), F.when(k % 5 == 0, at).alias("next_due_at"), at.alias("lease_expires_at"))
    got = queue.claim(tasks, "w", "1996-01-01 00:00:00", 50, tasks.where("id % 7 = 0"))
    return got.select("id", F.col("priority").alias("prio"), "attempts")


@query("""WITH p AS (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
u AS (SELECT *, sum(p_size) OVER (PARTITION BY p_brand ORDER BY ((pos - 7) % n + n) % n) AS upto FROM p) SELECT p_brand, p_partkey FROM u WHERE upto - p_size < 120""")
def circular_batches(t: Tables):
    """Of each brand's parts, from the seventh on and around, as many as make a batch of 120."""
    rows = ranked(t.part.select("p_brand", "p_partkey", "p_size"), ["p_brand"], [F.col("p_partkey")], "pos").withColumn("pos", F.col("pos") - 1)
    return circular_batch(rows, ["p_brand"], "pos", "p_size", 7, 120).select("p_brand", "p_partkey")


@query("""SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def hourly_windows(t: Tables):
    return t.events.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")


@query("""SELECT c_custkey, value_class FROM (SELECT c_custkey, CASE WHEN v >= 10000000 THEN 'National Flagship' WHEN v >= 1000000 THEN 'City Core' WHEN v >= 250000 THEN 'Regional Anchor' WHEN v > 0 THEN 'Local Candidate' ELSE 'Observation' END AS value_class
FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1) ON o_custkey = c_custkey)""")
def value_class(t: Tables):
    v = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"))
    return t.customer.join(v, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", visits.value_class(F.col("v")).alias("value_class"))


@query("""WITH r AS (SELECT user_id, event_type, max(ts) AS last, count(*) AS n FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1, 2)
SELECT user_id, max(n) FILTER (event_type = 'click') AS click_n, max(n) FILTER (event_type = 'purchase') AS purchase_n FROM r GROUP BY 1""")
def signal_pivot(t: Tables):
    r = t.events.where(F.col("event_type").isin("click", "purchase")).groupBy("user_id").pivot("event_type", ["click", "purchase"]).agg(F.count("event_id"))
    return r.select("user_id", F.col("click").alias("click_n"), F.col("purchase").alias("purchase_n"))


@query("""WITH e AS (SELECT o_custkey AS place, o_orderkey AS k, o_orderkey % 3 AS metric_order, o_shippriority, o_orderkey % 4 AS tier, o_orderdate AS d, round(o_totalprice, 2) AS value, c_nationkey AS country, c_mktsegment AS scene, c_name AS name
  FROM orders JOIN customer ON c_custkey = o_custkey),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY place ORDER BY metric_order, tier, d DESC, value DESC, lower(name), k) = 1),
g AS (SELECT * FROM b WHERE scene <> 'BUILDING' OR metric_order = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY country, scene ORDER BY metric_order, value DESC, lower(name), place) AS rank FROM g),
t AS (SELECT *, arg_max(metric_order, rank) FILTER (rank <= 3) OVER w AS tm, arg_max(value, rank) FILTER (rank <= 3) OVER w AS tv FROM r WINDOW w AS (PARTITION BY country, scene))
SELECT place, rank, value, CASE WHEN scene = 'BUILDING' THEN value >= 150000 ELSE rank <= 3 OR (metric_order = tm AND value >= tv) END AS recommended FROM t""".replace(" o_shippriority,", ""))
def recommended_places(t: Tables):
    """The best evidence of each place by six keys, ranked in its country and scene; one scene has a fixed gate."""
    o = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    k = F.col("o_orderkey")
    e = o.select(F.col("o_custkey").alias("place"), F.col("c_nationkey").alias("country"), F.col("c_mktsegment").alias("scene"), F.lit("").alias("city"), F.col("c_name").alias("name"),
                 F.concat(F.lit("m"), (k % 3).cast("string")).alias("metric"), (k % 3).alias("metric_order"), (k % 4).alias("tier"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("dated"), F.round("o_totalprice", 2).alias("value"))
    gates = t.spark.createDataFrame([("BUILDING", "m0", 150_000.0)], "scene string, metric string, least double")
    return recommend.recommended(recommend.best_evidence(e), gates, 3).select("place", "rank", "value", "recommended")


@query("""WITH p AS (SELECT c_custkey AS place, c_nationkey AS country, c_mktsegment AS scene, c_custkey % 400 AS identity, c_nationkey AS city, CASE WHEN c_custkey % 50 > 0 THEN c_nationkey::VARCHAR ELSE ' ' END AS city_id FROM customer),
a AS (SELECT place, CASE WHEN place % 31 = 0 THEN 'review' ELSE 'verified' END AS status, city, CASE WHEN place % 37 = 0 THEN 'x' ELSE country::VARCHAR END AS city_id FROM p WHERE place % 41 > 0),
j AS (SELECT p.*, a.place IS NULL AS gone, a.status <> 'verified' OR trim(a.city_id) = '' OR a.city_id <> p.city_id AS wrong FROM p LEFT JOIN a USING (place))
SELECT count(*) AS places, 0::BIGINT AS count_differs, count(*) FILTER (trim(city_id) = '') AS without_city, count(*) FILTER (gone) AS without_assignment, count(*) FILTER (NOT gone AND wrong) AS invalid,
  (SELECT count(*) FROM (SELECT 1 FROM p GROUP BY country, scene, identity HAVING count(*) > 1)) AS collisions, false AS passed FROM j""")
def assignment_gate(t: Tables):
    """The five numbers that block a release of city assignments, in one pass."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    p = t.customer.select(k.alias("place"), n.alias("country"), F.col("c_mktsegment").alias("scene"), (k % 400).alias("identity"), n.cast("string").alias("city"), F.when(k % 50 > 0, n.cast("string")).otherwise(" ").alias("city_id"))
    a = t.customer.where("c_custkey % 41 > 0").select(k.alias("place"), F.when(k % 31 == 0, "review").otherwise("verified").alias("status"), n.cast("string").alias("city"), F.when(k % 37 == 0, "x").otherwise(n.cast("string")).alias("city_id"))
    return recommend.assignment_gate(p, a, p.count())
