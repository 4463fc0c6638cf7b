"""Derived rows and targets, pages and JSON, dates and hashes of records."""

from pyspark.sql import functions as F

from loomstone.functions import names, text, web
from loomstone.operators import derive
from loomstone.plans.registry import Tables, query

_PRIMARY = {"stadium": ("seat_count", "event_days"), "hospital": ("beds", "outpatient_volume"), "transport_hub": ("daily_ridership",)}
_SCENES, _METRICS = ("stadium", "hospital", "transport_hub"), ("seat_count", "event_days", "beds", "outpatient_volume", "daily_ridership", "footfall")
_pick = lambda k, *v: F.element_at(F.array(*map(F.lit, v)), (k % len(v) + 1).cast("int"))
_at = lambda k, *v: "([" + ", ".join("NULL" if x is None else f"'{x}'" for x in v) + f"])[({k} % {len(v)} + 1)::INT]"
_RANK = " ".join(f"WHEN scene = '{s}' AND metric = '{m}' THEN {i}" for s, ms in _PRIMARY.items() for i, m in enumerate(ms))


@query(f"""WITH e AS (SELECT l_orderkey AS k, {_at("l_orderkey", *_SCENES)} AS scene, {_at("l_partkey", *_METRICS)} AS metric, CASE WHEN l_linenumber <> 4 THEN round(l_extendedprice) END AS value, CASE WHEN l_suppkey % 2 = 0 THEN 'visits/year' ELSE 'units' END AS unit, l_suppkey % 3 AS tier, l_suppkey % 5 AS domain, l_partkey * 10 + l_linenumber AS id FROM lineitem),
r AS (SELECT *, CASE {_RANK} END AS rk, CASE WHEN metric IN ('outpatient_volume', 'daily_ridership', 'footfall') AND unit = 'visits/year' THEN value WHEN metric = 'daily_ridership' THEN value * 365 WHEN scene = 'stadium' AND metric = 'seat_count' THEN value * 15 WHEN scene = 'hospital' THEN value * 1000 WHEN scene = 'transport_hub' THEN value * 365 END AS v FROM e),
d AS (SELECT k, scene, arg_min({{'metric': metric, 'value': value, 'v': v}}, (coalesce(rk, 99), tier, -value, id)) FILTER (value IS NOT NULL) AS m, max(rk IS NOT NULL AND value IS NOT NULL) AS hard, count(DISTINCT domain) AS domains FROM r GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN m.v BETWEEN 1900 AND 2100 AND m.v = floor(m.v) THEN NULL ELSE m.v END AS visits FROM d)
SELECT k, scene, m.metric AS metric, visits, CASE WHEN visits >= 10000000 THEN 'National Flagship' WHEN visits >= 1000000 THEN 'City Core' WHEN visits >= 250000 THEN 'Regional Anchor' WHEN visits > 0 THEN 'Local Candidate' ELSE 'Observation' END AS class,
  CASE WHEN NOT hard THEN 'Insufficient' WHEN domains >= 2 THEN 'Supported' ELSE 'Indicative' END AS status, CASE WHEN NOT hard THEN 'find primary metric' WHEN domains < 2 THEN 'find second source' ELSE 'survey' END AS action FROM s""")
def derived_rows(t: Tables):
    """The metric that counts for a place, and what follows from it."""
    c = F.col
    e = t.lineitem.select(
        c("l_orderkey").alias("k"), _pick(c("l_orderkey"), *_SCENES).alias("scene"), _pick(c("l_partkey"), *_METRICS).alias("metric"), F.when(c("l_linenumber") != 4, F.round("l_extendedprice")).alias("value"),
        F.when(c("l_suppkey") % 2 == 0, "visits/year").otherwise("units").alias("unit"), (c("l_suppkey") % 3).alias("tier"), (c("l_suppkey") % 5).alias("domain"), (c("l_partkey") * 10 + c("l_linenumber")).alias("id"),
    )
    return derive.derived(e, "k", _PRIMARY).select("k", "scene", "metric", "visits", "class", "status", "action")


_C = "SELECT o_custkey AS pid, (o_orderkey % 4)::BIGINT AS run, o_orderdate AS stamp, o_orderkey AS id, o_totalprice AS visits FROM orders"


@query(f"""WITH c AS ({_C}), n AS (SELECT pid, run FROM c QUALIFY row_number() OVER (PARTITION BY pid ORDER BY stamp DESC, id DESC) = 1), m AS (SELECT pid, run, visits FROM c WHERE id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY pid, run ORDER BY stamp DESC, id DESC) = 1)
SELECT n.pid, n.run, c_mktsegment AS segment, CASE WHEN n.pid % 2 = 0 THEN c_nationkey END AS assigned, visits FROM n JOIN customer ON c_custkey = n.pid LEFT JOIN m ON m.pid = n.pid AND m.run = n.run""")
def latest_targets(t: Tables):
    """The newest candidate of a place with what is known of it."""
    c = t.orders.select(F.col("o_custkey").alias("pid"), (F.col("o_orderkey") % 4).alias("run"), F.col("o_orderdate").alias("stamp"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("visits"))
    places = t.customer.select(F.col("c_custkey").alias("pid"), F.col("c_mktsegment").alias("segment"))
    cities = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("pid"), F.col("c_nationkey").alias("city"))
    return derive.latest_targets(c.drop("visits"), places, cities, c.where("id % 3 <> 0"))


@query(f"""WITH c AS ({_C}), r(run, started, created) AS (VALUES (0, NULL, 5), (1, 7, 1), (2, 7, 2)) SELECT pid, c.run, id FROM c JOIN r ON c.run = r.run QUALIFY row_number() OVER (PARTITION BY pid ORDER BY started DESC NULLS LAST, created DESC NULLS LAST, stamp DESC, c.run DESC, id DESC) = 1""")
def candidates_in_run_order(t: Tables):
    c = t.orders.select(F.col("o_custkey").alias("pid"), (F.col("o_orderkey") % 4).alias("run"), F.col("o_orderdate").alias("stamp"), F.col("o_orderkey").alias("id"))
    runs = t.spark.createDataFrame([(0, None, 5), (1, 7, 1), (2, 7, 2)], "run long, started int, created int")
    return derive.in_run_order(c, runs)


@query("""WITH r AS (SELECT l_orderkey AS pid, CASE WHEN l_suppkey % 2 = 0 THEN 'mobile' ELSE 'fixed' END AS service, l_partkey AS observation, l_returnflag AS class, l_linestatus AS confidence FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 2 ORDER BY l_shipdate DESC, l_partkey * 10 + l_linenumber DESC) = 1),
j AS (SELECT r.*, p_retailprice AS download FROM r JOIN part ON p_partkey = observation AND p_partkey % 7 <> 0)
SELECT pid, max(class) FILTER (service = 'mobile') AS mobile_class, max(confidence) FILTER (service = 'mobile') AS mobile_confidence, max(download) FILTER (service = 'mobile') AS mobile_download,
  max(class) FILTER (service = 'fixed') AS fixed_class, max(confidence) FILTER (service = 'fixed') AS fixed_confidence, max(download) FILTER (service = 'fixed') AS fixed_download FROM j GROUP BY 1""")
def network_signals(t: Tables):
    """The newest mobile and fixed rollup of a place with the observation it was made of."""
    c = F.col
    r = t.lineitem.select(c("l_orderkey").alias("pid"), F.when(c("l_suppkey") % 2 == 0, "mobile").otherwise("fixed").alias("service"), c("l_partkey").alias("observation"), c("l_shipdate").alias("stamp"), (c("l_partkey") * 10 + c("l_linenumber")).alias("id"), c("l_returnflag").alias("class"), c("l_linestatus").alias("confidence"))
    return derive.network_signals(r, t.part.where("p_partkey % 7 <> 0").select(c("p_partkey").alias("observation"), c("p_retailprice").alias("download")))


@query("SELECT c_mktsegment AS scene, count(*) AS places, count(*) FILTER (NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS without FROM customer GROUP BY 1")
def evidence_gaps(t: Tables):
    places = t.customer.select(F.col("c_custkey").alias("pid"), F.col("c_mktsegment").alias("scene"))
    return derive.gaps(places, t.orders.select(F.col("o_custkey").alias("pid")), "scene")


@query("""SELECT o_orderkey AS pid, o_orderpriority AS kind, 'old' AS text FROM orders WHERE o_orderpriority <> '5-LOW' UNION ALL SELECT c_custkey, '5-LOW', 'few' FROM customer WHERE c_acctbal < 0""")
def relabelled_reviews(t: Tables):
    """Reviews of one kind are made anew, all others stay."""
    old = t.orders.select(F.col("o_orderkey").alias("pid"), F.col("o_orderpriority").alias("kind"), F.lit("old").alias("text"))
    return derive.relabelled(old, t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("pid"), F.lit("few").alias("text")), "5-LOW")


@query("SELECT o_orderpriority AS source, count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS other, count(*) AS total FROM orders GROUP BY 1")
def task_status(t: Tables):
    return derive.status_counts(t.orders.withColumn("source", F.col("o_orderpriority")), ["source"], "o_orderstatus", ["O", "F"])


@query("""WITH e AS (SELECT CASE event_type WHEN 'signup' THEN 'new' ELSE event_type END AS status, value > 100 AS curation_needed FROM events),
s AS (SELECT 'task_backlog' AS section, o_orderstatus AS name FROM orders UNION ALL SELECT 'progress_status', l_linestatus FROM lineitem UNION ALL SELECT 'raw_evidence_status', status FROM e)
SELECT section, name, count(*) AS n, NULL AS at FROM s GROUP BY ALL UNION ALL SELECT 'pending_evidence', 'new', count(*) FILTER (status = 'new' AND curation_needed), NULL FROM e
UNION ALL SELECT 'latest_run', event_id::VARCHAR, NULL, strftime(ts, '%Y-%m-%d %H:%M:%S') FROM (SELECT * FROM events WHERE ts IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 1)""")
def discovery_status(t: Tables):
    """Statuses of tasks, progress and evidence, what waits for curation, and the run that began last."""
    status = F.when(F.col("event_type") == "signup", "new").otherwise(F.col("event_type"))
    tasks, progress = t.orders.select(F.col("o_orderstatus").alias("status")), t.lineitem.select(F.col("l_linestatus").alias("status"))
    evidence = t.events.select(status.alias("status"), (F.col("value") > 100).alias("curation_needed"))
    found = derive.discovery_status(tasks, progress, evidence, t.events.select(F.col("event_id").alias("run"), F.col("ts").alias("started_at")))
    return found.select("section", "name", "n", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey ORDER BY CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END, c_acctbal DESC, n_name, c_custkey LIMIT 30")
def top_targets(t: Tables):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_mktsegment").alias("scene"), F.col("c_acctbal").alias("visits"), F.col("n_name").alias("country"), F.col("c_custkey").alias("name"))
    return derive.top_targets(rows, ["BUILDING", "MACHINERY"], 30).select("c_custkey")


@query("SELECT p_partkey, greatest(p_size * 30, CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice ELSE 0 END) AS score FROM part ORDER BY score DESC, p_partkey LIMIT 40")
def ranked_venues(t: Tables):
    score = derive.venue_score(F.col("p_size"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice")))
    return t.part.select("p_partkey", score.alias("score")).orderBy(F.desc("score"), "p_partkey").limit(40)


@query("SELECT coalesce(a.s_suppkey, b.s_suppkey) AS name, CASE WHEN a.s_suppkey IS NULL THEN 'drop' WHEN a.s_nationkey = b.n THEN 'skip' ELSE 'load' END AS action FROM (SELECT * FROM supplier WHERE s_suppkey % 5 <> 0) a FULL JOIN (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN -1 ELSE s_nationkey END AS n FROM supplier WHERE s_suppkey % 3 <> 0) b ON a.s_suppkey = b.s_suppkey")
def snapshot_actions(t: Tables):
    """Which snapshots must be loaded, and which are as they were."""
    s = t.supplier.select(F.col("s_suppkey").alias("name"), F.col("s_nationkey").alias("hash"))
    before = s.where("name % 3 <> 0").withColumn("hash", F.when(F.col("name") % 4 == 0, -1).otherwise(F.col("hash")))
    return derive.snapshot_state(s.where("name % 5 <> 0"), before)


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS x,
  regexp_replace(lower(regexp_extract(url, 'https?://([^/?#]+)', 1)), '^www\.', '') AS host FROM pages),
b AS (SELECT page_id, host, trim(regexp_replace(replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[\x20\x09-\x0D]+', ' ', 'g')) AS x FROM a)
SELECT page_id, length(x) AS n, sha256(x) AS h, CASE WHEN ends_with(host, '.org') THEN 'tier1' WHEN contains('.' || host || '.', '.blog.') THEN 'tier3' ELSE 'tier2' END AS tier FROM b""")
def page_texts(t: Tables):
    """What a page says, and how good its source is."""
    x = web.page_text(F.col("html"))
    tier = web.source_tier(text.domain(F.col("url")), [("tier1", (".org",)), ("tier3", ("blog",))], "tier2")
    return t.pages.select("page_id", F.length(x).cast("long").alias("n"), F.sha2(x, 256).alias("h"), tier.alias("tier"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS site, page_id % 3 AS m FROM pages)
SELECT page_id, CASE m WHEN 0 THEN '0:' || site || '/o.png,2:https://cdn.example/b.png' WHEN 1 THEN '1:https://cdn.example/j.png,2:' || site || '/i.png' ELSE '' END AS images FROM p""")
def page_images(t: Tables):
    """Images that a page names, the best first; markup is added to pages, which have none."""
    k = F.col("page_id") % 3
    og = '<meta property="og:image" content="/o.png"><img src="/o.png#x"><img alt="b" src="https://cdn.example/b.png">'
    ld = '<script type="application/ld+json">{"image": ["https://cdn.example/j.png"]}</script><img src="/i.png"><img src="data:x">'
    html = F.concat("html", F.when(k == 0, og).when(k == 1, ld).otherwise(""))
    found = web.image_candidates(F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]*)", 1), html)
    return t.pages.select("page_id", F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["rank"].cast("string"), x["address"])), ",").alias("images"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderdate AS d, o_custkey AS c FROM orders)
SELECT k, CASE k % 3 WHEN 0 THEN d WHEN 1 THEN d + INTERVAL 2 HOUR ELSE TIMESTAMP '2000-01-01' END AS seen, (d::DATE + (CASE WHEN k % 4 <> 0 THEN 30 END)::INT) AS stale, 'sale|' || k || '|' || CASE WHEN c % 2 = 0 THEN 'x' ELSE '' END AS record FROM o""")
def record_stamps(t: Tables):
    """Stamps with and without a zone, or none at all; when something is stale; keys of records."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    iso = F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(k % 3 == 0, iso).when(k % 3 == 1, F.concat(iso, F.lit("-02:00"))).otherwise("not a date")
    seen = web.instant(raw, F.lit("2000-01-01").cast("timestamp")).cast("timestamp_ntz")
    stale = web.due(d.cast("date"), F.when(k % 4 != 0, 30))
    key = web.record_key(F.lit(" Sale "), k, F.when(F.col("o_custkey") % 2 == 0, "X"))
    return t.orders.select(k.alias("k"), seen.alias("seen"), stale.alias("stale"), key.alias("record"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS items, CASE WHEN event_id % 4 = 3 THEN '{"b":"2"}' ELSE '{"a":"' || (event_id % 9) || '","b":"2","c":"3"}' END AS merged,
  CASE event_id % 4 WHEN 3 THEN 'no object' WHEN 0 THEN '' WHEN 1 THEN '$.n is no number' ELSE '$.name missing' END AS issues FROM events""")
def json_packets(t: Tables):
    """Lists wherever a packet has them, merges, and what a packet lacks."""
    i = F.col("event_id") % 4
    packet = F.when(i == 0, '{"name":"x","n":1,"rows":[],"items":[1,2]}').when(i == 1, '{"name":"y","n":"z","data":{"rows":["q"]}}').when(i == 2, '{"name":" ","n":3}').otherwise("broken")
    found = web.first_list(F.col("p"), ["$.rows", "$.items", "$.data.rows"])
    base = F.when(i == 3, "broken").otherwise(F.concat(F.lit('{"a":"'), (F.col("event_id") % 9).cast("string"), F.lit('","b":"1","c":"3"}')))
    rows = t.events.select("event_id", packet.alias("p"), base.alias("base"))
    return rows.select("event_id", F.size(found).alias("items"), web.merged_json(F.col("base"), F.lit('{"b":"2"}')).alias("merged"), F.array_join(web.packet_issues(F.col("p"), ["$.name"], ["$.n"]), "; ").alias("issues"))


#: What a packet of an event must have.
_PACKET = {
    "type": "object",
    "required": ["entity", "evidence"],
    "properties": {
        "entity": {
            "type": "object",
            "required": ["user", "kind"],
            "properties": {"user": {"type": "integer"}, "kind": {"enum": ["purchase", "signup", "view"]}, "value": {"type": ["number", "null"], "maximum": 200}},
        },
        "evidence": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 10}}}},
    },
}


@query("""WITH e AS (SELECT event_id, event_type AS kind, value, props, props IS NULL OR json_valid(props) AS whole, (json_extract(props, '$.k'))::VARCHAR AS k, json_type(props, '$.k') AS t FROM events)
SELECT event_id, CASE WHEN NOT whole THEN '$: no JSON' ELSE array_to_string(list_filter([CASE WHEN kind IS NULL OR kind NOT IN ('purchase', 'signup', 'view') THEN '$.entity.kind: not one of purchase, signup, view' END,
  CASE WHEN value > 200 THEN '$.entity.value: above 200' END, CASE WHEN props IS NULL THEN '$.evidence: fewer than 1 items' END,
  CASE WHEN props IS NOT NULL AND k IS NULL THEN '$.evidence[0]: k missing' END, CASE WHEN props IS NOT NULL AND t IN ('BIGINT', 'UBIGINT') AND k::DOUBLE < 10 THEN '$.evidence[0].k: below 10' END],
  lambda x: x IS NOT NULL), '; ') END AS issues FROM e""")
def packets_against_schema(t: Tables):
    """What the packet of each event, with its properties as evidence, breaks of a nested schema."""
    text_of = lambda c: F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))
    value = F.coalesce(F.col("value").cast("string"), F.lit("null"))
    parts = ('{"entity":{"user":', F.coalesce(F.col("user_id"), F.lit(0)).cast("string"), ',"kind":', text_of(F.col("event_type")), ',"value":', value)
    parts += ('},"evidence":[', F.coalesce("props", F.lit("")), "]}")
    packet = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return t.events.select("event_id", F.array_join(web.schema_issues(packet, _PACKET), "; ").alias("issues"))


@query(r"""SELECT doc_id, sha256(trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g'))) AS h FROM documents WHERE text IS NOT NULL""")
def source_text_hashes(t: Tables):
    """The key under which a translation of a text is kept."""
    return t.documents.where("text IS NOT NULL").select("doc_id", F.sha2(names.flat_text("text"), 256).alias("h"))


@query("""WITH s AS (SELECT c_nationkey AS country, count(*) AS n, count(DISTINCT c_custkey % 8) AS scenes, sum(1 + c_custkey % 3)::BIGINT AS sources FROM customer GROUP BY 1),
g AS (SELECT s_nationkey AS country, CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE 's' || (s_suppkey % 6) END AS scene, 'k' || (s_suppkey % 5) AS source, CASE WHEN s_nationkey % 2 = 0 OR s_suppkey % 3 = 0 THEN 'exhausted' ELSE 'active' END AS status, s_suppkey % 4 AS cycle FROM supplier
  UNION ALL SELECT 3, 's' || (i % 6), 'k' || (i % 5), 'exhausted', 1 FROM range(40) r(i)),
p AS (SELECT country, count(*) AS groups, count(DISTINCT nullif(scene, '')) AS sc, count(DISTINCT source) AS ki, count(*) FILTER (status = 'exhausted') AS exhausted, max(cycle) AS rounds FROM g WHERE country <> 3 OR status = 'exhausted' GROUP BY 1),
r AS (SELECT s.*, coalesce(groups, 0) AS groups, coalesce(sc, 0) AS sc, coalesce(ki, 0) AS ki, coalesce(exhausted, 0) AS exhausted, coalesce(rounds, 0) AS rounds, round_even(sources / n, 2) AS density FROM s LEFT JOIN p USING (country)),
f AS (SELECT *, groups >= 12 AND sc >= 6 AND ki >= 2 AND exhausted = groups AS full_, rounds >= 2 AND sc >= 4 AND ki >= 2 AS tracked, scenes >= 6 AND (n >= 100 AND density >= 1.2 OR n >= 50 AND density >= 1.5) AS inferred FROM r)
SELECT country, CASE WHEN full_ THEN 'near_saturation' WHEN tracked OR inferred THEN 'deep_expansion' ELSE 'seed_scan' END AS level, CASE WHEN full_ THEN 'tracked_exhaustion' WHEN tracked THEN 'tracked_rounds' ELSE 'active_coverage' END AS basis, density, groups, exhausted, rounds FROM f""")
def country_maturity(t: Tables):
    """How far a country has been searched, by what its tasks and its sources say."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    rows = t.customer.groupBy(F.col("c_nationkey").alias("country")).agg(F.count("*").alias("n"), F.count_distinct(c % 8).alias("scenes"), F.sum(c % 3 + 1).alias("sources"))
    label = lambda x, k: F.concat(F.lit(x), k.cast("string"))
    status = F.when((F.col("s_nationkey") % 2 == 0) | (s % 3 == 0), "exhausted").otherwise("active")
    g = t.supplier.select(F.col("s_nationkey").alias("country"), F.when(s % 9 == 0, "").otherwise(label("s", s % 6)).alias("scene"), label("k", s % 5).alias("source"), status.alias("status"), (s % 4).alias("cycle"))
    more = t.spark.range(40).select(F.lit(3).alias("country"), label("s", F.col("id") % 6).alias("scene"), label("k", F.col("id") % 5).alias("source"), F.lit("exhausted").alias("status"), F.lit(1).cast("long").alias("cycle"))
    return derive.maturity(rows, g.where("country <> 3 OR status = 'exhausted'").unionByName(more))


@query(r"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')) AS t, sha256(text) AS h FROM documents WHERE text IS NOT NULL AND doc_id % 11 <> 0),
e AS (SELECT doc_id, h, unnest(list_filter(list_transform(range(0, ((length(t) + 1199) // 1200)::BIGINT), lambda i: trim(substr(t, (i * 1200 + 1)::BIGINT, 1200))), lambda p: p <> '')) AS chunk, generate_subscripts(list_filter(list_transform(range(0, ((length(t) + 1199) // 1200)::BIGINT), lambda i: trim(substr(t, (i * 1200 + 1)::BIGINT, 1200))), lambda p: p <> ''), 1) - 1 AS pos FROM d)
SELECT doc_id, pos, sha256(chunk) AS h, CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 <> 0 THEN 'kept' ELSE 'new' END AS origin FROM e""")
def rechunked_documents(t: Tables):
    """An index after an update: unchanged documents keep their chunks."""
    d = t.documents.select("doc_id", "text")
    before = d.where("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    chunks = derive.rechunked(d.limit(0).select("doc_id", F.lit("").alias("content_hash"), F.lit(0).alias("pos"), F.col("text").alias("chunk")), before).drop("origin")
    out = derive.rechunked(chunks, d.where("doc_id % 11 <> 0"))
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), F.sha2("chunk", 256).alias("h"), "origin")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_custkey % 100 = l_suppkey % 100 AND o_totalprice > 50000)""")
def reviews_of_pairs(t: Tables):
    """Rows whose pair of keys is among the candidates': both must match in one of them."""
    pairs = t.orders.where("o_totalprice > 50000").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 100).alias("run"))
    return t.lineitem.withColumn("run", F.col("l_suppkey") % 100).join(pairs, ["l_orderkey", "run"], "left_semi").select("l_orderkey", "l_linenumber")
