"""Quality of candidates, gates, routing, integrity, and what texts say in numbers."""

from pyspark.sql import functions as F

from loomstone.functions import quantities
from loomstone.operators import quality
from loomstone.plans.registry import Tables, query

_pick = lambda k, *v: F.element_at(F.array(*map(F.lit, v)), (k % len(v) + 1).cast("int"))
_at = lambda k, *v: "([" + ", ".join("NULL" if x is None else f"'{x}'" for x in v) + f"])[({k} % {len(v)} + 1)::INT]"

_N = (*["Grand Hall"] * 7, "MVP fake hotel", "Oran", "Airlines", "", "Oran Airport", "Fixture Arena", "Springfield")
_CI = (*["Algiers"] * 9, "Springfield", "unknown", "Oran Province", "Algeria", "", "São Paulo", "Q1234")
_P = (*["rooftop"] * 6, "city centroid", "fixture point", "", "terminal point", "default")
_R = quality.Rules(
    places=("oran", "springfield"), restricted={"sao paulo": ("brazil",)}, regions={"algeria": ("oran province",)}, scene_words={"airport_terminal": ("airport", "terminal")},
    indicators={"airport_terminal": ("annual visits", "passengers"), "stadium": ("seat count",)}, precise={"airport_terminal": ("terminal", "rooftop")},
)
_LEVELS = "(^| )(" + "|".join(_R.levels) + ")( |$)"
_V = ("5000 per year", "6000 per annum", "estimate 900", "Q1: 300", "")
_QUALITY = f"""c AS (SELECT c_custkey AS k, {_at("c_custkey", *_N)} AS name, {_at("c_custkey // 3", *_CI)} AS city, {_at("c_custkey // 5", *_P)} AS precision, {_at("c_custkey // 7", "airport_terminal", "stadium", "other")} AS scene,
  {_at("c_custkey // 2", "verified", None, "verified", "guessed")} AS assignment, {_at("c_custkey // 11", "annual visits", "seat count", "other")} AS field, {_at("c_custkey // 13", "official", "proxy")} AS kind, {_at("c_custkey // 17", *_V)} AS value,
  {_at("c_custkey // 19", "https://en.wikipedia.org/wiki/Oran", "https://x.example/a", "https://x.example/b", "https://x.example/c", "https://en.wikipedia.org/wiki/Springfield")} AS url, {_at("c_custkey // 23", "Nominatim", "Press", "Journal", "Owner")} AS source FROM customer),
f AS (SELECT *, trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9 .-]+', ' ', 'g')) AS n, trim(lower(strip_accents(city))) AS ci, lower(precision) AS p, lower(regexp_extract(url, 'wiki/(.*)$', 1)) AS slug FROM c),
j AS (SELECT *, CASE WHEN scene = 'other' THEN NULL WHEN NOT (scene = 'airport_terminal' AND field = 'annual visits' OR scene = 'stadium' AND field = 'seat count') THEN 'objective metric missing'
  WHEN kind = 'proxy' OR contains(value, 'estimate') THEN 'objective metric missing or defaulted' WHEN scene = 'airport_terminal' AND starts_with(value, 'Q1') THEN 'non-annual period' END AS objective FROM f),
i AS (SELECT k, list_filter([CASE WHEN n = '' THEN 'name missing' END, CASE WHEN contains(n, 'mvp fake') OR contains(n, 'fixture') THEN 'name is a placeholder' END, CASE WHEN n <> '' AND (n = ci OR n = 'algeria') THEN 'name is only a city or country' END,
  CASE WHEN n = 'airlines' THEN 'name is a topic' END, CASE WHEN n IN ('oran', 'springfield') THEN 'name is a place''s' END, CASE WHEN ci = '' THEN 'city missing' END, CASE WHEN ci = 'algeria' THEN 'city is the country' END,
  CASE WHEN ci = 'unknown' THEN 'city is a default' END, CASE WHEN regexp_matches(ci, '^q[0-9]+$') THEN 'city is an entity''s id' WHEN ci = 'oran province' THEN 'city is a region' WHEN regexp_matches(ci, '{_LEVELS}') THEN 'city is an administrative level' END,
  CASE WHEN contains(p, 'fixture') OR contains(p, 'default') THEN 'precision is a default' END, CASE WHEN ci = 'sao paulo' THEN 'city is in another country' END,
  CASE WHEN slug IN ('oran', 'springfield') AND slug = n THEN 'source is a page about a place or topic' END, CASE WHEN slug IN ('oran', 'springfield') AND slug <> n THEN 'source does not identify the candidate' END,
  CASE WHEN source = 'Nominatim' THEN 'a geocoder is no evidence' END,
  CASE WHEN p = '' THEN 'precision missing' WHEN contains(p, 'fixture') THEN 'precision is a placeholder' WHEN regexp_matches(p, '(^| )(city|country|region|centroid)( |$)') THEN 'precision is too coarse'
    WHEN scene = 'airport_terminal' AND NOT (contains(p, 'terminal') OR contains(p, 'rooftop')) THEN 'precision is of another kind of place' END,
  CASE WHEN assignment <> 'verified' THEN 'city is not verified' END, objective], lambda x: x IS NOT NULL) AS issues FROM j)"""


def _judged(t: Tables):
    k = F.col("c_custkey")
    at = lambda d, *v: _pick(F.floor(k / d), *v)
    e = F.array(F.struct(at(11, "annual visits", "seat count", "other").alias("field"), F.lit("").alias("indicator"), at(13, "official", "proxy").alias("kind"), at(17, *_V).alias("value"), F.lit(None).cast("string").alias("note")))
    urls = F.array(at(19, "https://en.wikipedia.org/wiki/Oran", "https://x.example/a", "https://x.example/b", "https://x.example/c", "https://en.wikipedia.org/wiki/Springfield"))
    rows = t.customer.select(
        k.alias("k"), F.lit("Algeria").alias("country"), at(3, *_CI).alias("city"), _pick(k, *_N).alias("name"), at(7, "airport_terminal", "stadium", "other").alias("scene"), at(5, *_P).alias("precision"),
        urls.alias("urls"), F.array(at(23, "Nominatim", "Press", "Journal", "Owner")).alias("sources"), e.alias("evidence"), F.lit(None).cast("string").alias("note"), at(2, "verified", None, "verified", "guessed").alias("assignment"),
    )
    return quality.issues(rows, _R)


@query(f"WITH {_QUALITY} SELECT k, array_to_string(issues, '; ') AS issues FROM i")
def candidate_issues(t: Tables):
    """All that is wrong with a candidate, in a fixed order."""
    return _judged(t).select("k", F.array_join("issues", "; ").alias("issues"))


@query(f"""WITH {_QUALITY}, v AS (SELECT k, len(issues) AS n, len(list_filter(issues, lambda x: NOT starts_with(x, 'objective metric missing'))) AS other FROM i)
SELECT k, CASE WHEN n = 0 THEN 'ready' WHEN other = 0 AND k % 2 = 0 THEN 'review_required' ELSE 'blocked_quality' END AS status, n > 0 AS review FROM v WHERE n = 0 OR other = 0 AND k % 2 = 0""")
def shown_on_map(t: Tables):
    """Candidates that a map may show: nothing wrong, or a named lead that only lacks its metric."""
    rows = _judged(t).select("k", quality.visibility(F.col("issues"), F.col("k") % 2 == 0).alias("v")).select("k", "v.*")
    return quality.on_surface(rows, "map").select("k", "status", F.col("review_required").alias("review"))


@query("""WITH o AS (SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R' AND l_linenumber < 3) AS t12, count(*) FILTER (l_returnflag = 'R') AS t3, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_orderpriority <> '5-LOW' AND o_orderstatus <> 'P' AS entity, coalesce(t12 >= 1 OR t3 >= 2, false) AS evidence, o_orderkey % 4 <> 0 AS quality,
  (CASE WHEN coalesce(t12, 0) < 1 AND coalesce(t3, 0) < 2 THEN 1 ELSE 0 END + CASE WHEN n IS NULL THEN 1 ELSE 0 END)::INT AS sources_missing FROM orders LEFT JOIN o ON l_orderkey = o_orderkey""")
def candidate_gates(t: Tables):
    """Fields present, one good source or two others, and no blocked quality."""
    c = F.col
    e = t.lineitem.groupBy("l_orderkey").agg(F.count_if((c("l_returnflag") != "R") & (c("l_linenumber") < 3)).alias("t12"), F.count_if(c("l_returnflag") == "R").alias("t3"), F.count("*").alias("n"))
    rows = t.orders.join(e, c("o_orderkey") == c("l_orderkey"), "left").fillna(0, ["t12", "t3", "n"])
    rows = rows.withColumn("city", F.when(c("o_orderpriority") != "5-LOW", c("o_orderpriority"))).withColumn("name", F.when(c("o_orderstatus") != "P", c("o_orderstatus")).otherwise(" "))
    g = quality.gates(["city", "name"], ["o_orderstatus"], c("t12"), c("t3"), c("n"), c("o_orderkey") % 4 == 0)
    return rows.select("o_orderkey", g.alias("g")).select("o_orderkey", c("g")[0]["passed"].alias("entity"), c("g")[1]["passed"].alias("evidence"), c("g")[3]["passed"].alias("quality"), F.size(c("g")[1]["issues"]).alias("sources_missing"))


@query("""WITH r AS (SELECT o_orderkey AS id, o_custkey % 400 AS key, o_orderstatus <> 'F' AS valid, o_orderpriority = '1-URGENT' AS probable FROM orders), known AS (SELECT s_suppkey AS key FROM supplier),
a AS (SELECT key, min(id) AS first FROM r WHERE valid AND NOT probable AND key NOT IN (SELECT key FROM known) GROUP BY 1)
SELECT id, CASE WHEN r.key IN (SELECT key FROM known) OR id > first THEN 'duplicate' WHEN probable THEN 'possible_duplicate' WHEN NOT valid THEN 'draft' ELSE 'accepted' END AS route FROM r LEFT JOIN a ON r.key = a.key""")
def batch_routes(t: Tables):
    """Accepted, draft or duplicate, where an accepted row makes its key known to later ones."""
    r = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 400).alias("key"), (F.col("o_orderstatus") != "F").alias("valid"), (F.col("o_orderpriority") == "1-URGENT").alias("probable"))
    known = t.supplier.select(F.col("s_suppkey").alias("key"))
    return quality.routed(r, "key", [F.col("id")], known, F.col("valid"), F.col("probable")).select("id", "route")


_CHECKS = {"bad_quantity": "l_quantity <= 0", "high_discount": "l_discount > 0.09", "taxed_returns": "l_tax > 0.07 AND l_returnflag = 'R'", "late_lines": "l_linenumber > 6", "cheap": "l_extendedprice < 1500", "odd_status": "l_linestatus NOT IN ('O', 'F')"}


@query("WITH " + ", ".join(f"c{i} AS (SELECT '{n}' AS \"check\", l_orderkey * 10 + l_linenumber AS k FROM lineitem WHERE {q})" for i, (n, q) in enumerate(_CHECKS.items()))
       + " , h AS (" + " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(len(_CHECKS))) + "), s AS (SELECT \"check\", count(*) AS n, array_to_string(list_sort(list(k))[1:5], ',') AS samples FROM h GROUP BY 1)"
       + " SELECT e.\"check\", coalesce(n, 0) AS n, coalesce(samples, '') AS samples, n IS NULL AS passed FROM (VALUES " + ", ".join(f"('{n}')" for n in _CHECKS) + ") e(\"check\") LEFT JOIN s USING (\"check\")")
def integrity_counters(t: Tables):
    """How many rows break each check, and the first five of them."""
    rows = t.lineitem.withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    out = quality.counters(rows, "k", {n: F.expr(q) for n, q in _CHECKS.items()})
    return out.select("check", "n", F.coalesce(F.array_join("samples", ","), F.lit("")).alias("samples"), "passed")


@query("""SELECT page_id, regexp_matches(coalesce(url, ''), '^https?://[^/]+') AND NOT (regexp_replace(lower(regexp_extract(url, 'https?://([^/?#]+)', 1)), '^www\\.', '') = 'example.org' OR ends_with(lower(regexp_extract(url, 'https?://([^/?#]+)', 1)), '.example.org')) AND page_id % 6 <> 0 AS usable FROM pages""")
def usable_results(t: Tables):
    ok = quality.usable_result(F.when(F.col("page_id") % 3 == 0, " "), F.col("url"), F.when(F.col("page_id") % 6 != 0, "text"), ("example.org",))
    return t.pages.select("page_id", ok.alias("usable"))


#: field, text before and after a number n, how the number is written, what is read, its unit.
_SAYS = (
    ("seat_count", "Capacity of ", " (opened 2019)", "comma", "n", "seats"),
    ("seat_count", "cost US$ 5 million, capacity of ", "", "comma", "NULL", None),
    ("annual_visits", "About ", " visitors a year; 20 shops", "dot", "n", "visits/year"),
    ("annual_visits", "welcomed ", " million visitors per year", "tenth", "n / 10.0 * 1000000", "visits/year"),
    ("annual_visits", "renovation cost 3 million. Footfall: ", " people", "comma", "n", "visits/year"),
    ("daily_ridership", "average weekday ridership of ", "; peak 999,999 per day", "comma", "n", "visits/day"),
    ("daily_ridership", "", " passengers per day", "plain", "n", "visits/day"),
    ("gla", "GLA ", " sqm and 1 sq ft", "comma", "n", "sqm"),
    ("gla", "retail of ", " square feet", "comma", "n * 0.092903", "sqm"),
    ("exhibition_area", "site area of ", " sqm", "comma", "NULL", None),
    ("beds", "each hospital has ", " beds, 90,000 beds in all", "comma", "n", "beds"),
    ("keys", "offers 350 guest rooms and ", " meeting rooms", "plain", "350", "rooms"),
    ("staff_count", "in 2001 it had ", " employees", "comma", "n", "people"),
    ("tower_height", "a ", " m tall tower", "hundred", "100 + n % 100", "meters"),
    ("line_count", "served by ", " metro lines", "ten", "1 + n % 10", "lines"),
    ("outpatient_volume", "some ", " outpatients annually", "comma", "n", "visits/year"),
    ("international_share", "", " % of all", "ten", "1 + n % 10", "percent"),
    ("peak_event_capacity", "up to ", " guests", "comma", "n", "people"),
)


@query("WITH p AS (SELECT l_orderkey AS k, l_linenumber AS line, 3000 + l_partkey % 6000 AS n, (l_orderkey + l_linenumber) % " + str(len(_SAYS)) + " AS s FROM lineitem) SELECT k, line, CASE s "
       + " ".join(f"WHEN {i} THEN round(({x[4]})::DOUBLE, 4)" for i, x in enumerate(_SAYS)) + " END AS value, CASE s " + " ".join(f"WHEN {i} THEN '{x[5]}'" for i, x in enumerate(_SAYS) if x[5]) + " END AS unit FROM p")
def text_quantities(t: Tables):
    """What a text says of a field, where the number in it is known; its SQL gives the number itself."""
    n = (F.lit(3000) + F.col("l_partkey") % 6000).cast("long")
    s = (F.col("l_orderkey") + F.col("l_linenumber")) % len(_SAYS)
    rows = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), n.alias("n"), s.alias("s"))
    three = F.lpad((F.col("n") % 1000).cast("string"), 3, "0")
    head = F.floor(F.col("n") / 1000).cast("string")
    written = {
        "comma": F.concat(head, F.lit(","), three), "dot": F.concat(head, F.lit("."), three), "plain": F.col("n").cast("string"),
        "tenth": F.concat(F.floor(F.col("n") / 10).cast("string"), F.lit("."), (F.col("n") % 10).cast("string")),
        "hundred": (F.col("n") % 100 + 100).cast("string"), "ten": (F.col("n") % 10 + 1).cast("string"),
    }
    field, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (f, before, after, how, _, _) in enumerate(_SAYS):
        field = F.when(F.col("s") == i, f).otherwise(field)
        said = F.when(F.col("s") == i, F.concat(F.lit(before), written[how], F.lit(after))).otherwise(said)
    rows = rows.select("k", "line", field.alias("field"), said.alias("said"))
    return rows.select("k", "line", quantities.value_and_unit(F.col("field"), F.col("said")).alias("v")).select("k", "line", F.round("v.value", 4).alias("value"), "v.unit")


_PERIODS = ("Q1 2023: 5000", "sum of Q1+Q2+Q3+Q4, derived", "5000 per year", "5000 (chart)", "March: 700", "x 12 of the monthly mean", "")


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey // 7 % 2 = 0 THEN CASE o_orderkey % 7 WHEN 0 THEN 'non-annual period' WHEN 3 THEN 'read off a chart' WHEN 4 THEN 'non-annual period' END END AS issue FROM orders""")
def period_issues(t: Tables):
    """Whether a yearly field's value is a year's."""
    k = F.col("o_orderkey")
    field = F.when(F.floor(k / 7) % 2 == 0, "Annual visits").otherwise("rooms")
    return t.orders.select("o_orderkey", quantities.period_issue(field, _pick(k, *_PERIODS), F.lit(None).cast("string")).alias("issue"))


_ASKED = ("das_deployment", "terminal_role", "line_count")


def _named(name: str):
    return lambda x: x["name"] == name


_DISTINCT = "len(list_distinct(list_transform(regexp_extract_all(t, '(?i){}'), lambda x: lower(x))))"


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, {_DISTINCT.format("distributed[[:space:]]+antenna[[:space:]]+system|das|small[[:space:]]+cell|prru|hrru")} AS das,
  {_DISTINCT.format("international[[:space:]]+gateway|main[[:space:]]+terminal|hub|terminal")} AS role,
  {_DISTINCT.format("[0-9]+(?:[.,][0-9]+)*[[:space:]]*(?:lines|routes|platforms)")} AS lines FROM d""")
def page_indicators(t: Tables):
    """How many different values each document has of three of the indicators; the pages' own texts, whole."""
    rows = quantities.with_indicators(t.documents.select("doc_id", "text"), "text", F.array(*map(F.lit, _ASKED)), "f")
    n = [F.size(F.filter("f", _named(k))).cast("long") for k in _ASKED]
    return rows.select("doc_id", n[0].alias("das"), n[1].alias("role"), n[2].alias("lines"))


@query(r"""WITH p AS (SELECT p_partkey AS k, CASE p_partkey % 4
  WHEN 0 THEN 'In 2024 international passengers ' || p_partkey * 1000 || ' plus domestic passengers ' || p_size * 7
  WHEN 1 THEN '2023 passengers: ' || p_size || '.5 million, terminal of ' || p_name
  WHEN 2 THEN 'Passengers ' || p_size * 100 || ' thousand in ' || p_brand
  ELSE p_name || ' served ' || p_size || ' million people' END AS said FROM part),
n AS (SELECT k, list_transform(regexp_extract_all(said, '(?:[Pp]assengers:?|served) ([0-9.]+)', 1), lambda x: x::DOUBLE) AS v,
  CASE WHEN contains(said, 'million') THEN 1000000 WHEN contains(said, 'thousand') THEN 1000 ELSE 1 END AS times FROM p)
SELECT k, round(list_sum(v) * times, 2) AS passengers FROM n""")
def workbook_passengers(t: Tables):
    """Passengers as the workbook sorts by them: two flows added up, years skipped, people served counted."""
    k, text = F.col("p_partkey"), lambda c: c.cast("string")
    said = (
        F.when(k % 4 == 0, F.concat(F.lit("In 2024 international passengers "), text(k * 1000), F.lit(" plus domestic passengers "), text(F.col("p_size") * 7)))
        .when(k % 4 == 1, F.concat(F.lit("2023 passengers: "), text(F.col("p_size")), F.lit(".5 million, terminal of "), F.col("p_name")))
        .when(k % 4 == 2, F.concat(F.lit("Passengers "), text(F.col("p_size") * 100), F.lit(" thousand in "), F.col("p_brand")))
        .otherwise(F.concat(F.col("p_name"), F.lit(" served "), text(F.col("p_size")), F.lit(" million people")))
    )
    return t.part.select(k.alias("k"), F.round(quantities.workbook_value(F.lit("annual_passengers"), said), 2).alias("passengers"))


_RAW = ("12,000 seats", "seats", "up to 45,000 seats", "Q1: 900,000", "120 %", "planned")


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'accepted' WHEN 2 THEN 'needs_review' ELSE 'rejected' END AS decision, CASE o_orderkey % 6 WHEN 1 THEN 'no number' WHEN 2 THEN 'doubtful' WHEN 3 THEN 'non-annual period' WHEN 4 THEN 'share beyond 100' WHEN 5 THEN 'no number' END AS reason,
  CASE o_orderkey % 6 WHEN 0 THEN 12000::DOUBLE WHEN 2 THEN 45000::DOUBLE WHEN 4 THEN 120::DOUBLE END AS value FROM orders""")
def cleaned_metrics(t: Tables):
    """What the rules make of a raw metric."""
    k = F.col("o_orderkey") % 6
    field = F.when(k == 3, "annual_visits").when(k == 4, "international_share").otherwise("seat_count")
    rows = t.orders.select("o_orderkey", field.alias("field"), _pick(F.col("o_orderkey"), *_RAW).alias("raw"), F.lit(None).cast("string").alias("context"))
    # of a quarter's value the parser may still read a number
    return quantities.cleaned(rows, "field", "raw", "context").select("o_orderkey", "decision", "reason", F.when(k != 3, F.col("value")).alias("value"))


@query("""SELECT p_partkey AS k, 'annual_passenger_throughput:' || (p_partkey * 1000) || ',runways:' || (p_size % 4 + 1) || CASE WHEN p_partkey % 2 = 0 THEN ',elevation:' || p_size ELSE '' END AS metrics FROM part""")
def infobox_metrics(t: Tables):
    """Numbers out of an infobox; the text around them is made of the part's columns."""
    k, s = F.col("p_partkey"), lambda x: x.cast("string")
    grouped = F.concat(s(k), F.lit(",000"))
    box = F.concat(
        F.lit("{{Infobox airport\n| name = A 1\n| Stat-year = x\n| passengers = "), grouped, F.lit("<ref>2019</ref>\n|runways={{nowrap|2020}} "), s(F.col("p_size") % 4 + 1),
        F.when(k % 2 == 0, F.concat(F.lit("\n | elevation = [["), s(F.col("p_size")), F.lit("]] m"))).otherwise("\n| elevation = high"), F.lit("\n}}"),
    )
    found = quantities.infobox(box, {"passengers": "annual_passenger_throughput", "runways": "runways", "elevation": "elevation"})
    return t.part.select(k.alias("k"), F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["metric"], x["value"].cast("long").cast("string"))), ",").alias("metrics"))
