"""Complaints about a network, made of the events: what they are, whose, and what they add up to."""

from pyspark.sql import functions as F

from loomstone.functions import text
from loomstone.functions.names import plain_text
from loomstone.operators import complaints
from loomstone.plans.registry import Tables, query

#: What the events say, by event_id modulo their number.
SAYS = (
    "Sem sinal no hotel", "the network outage lasted hours", "Dropped call again and again", "weak signal in the hall",
    "Internet lenta demais", "wifi is slow internet", "wifi and 5g: no signal", "billing: no signal, charged twice",
    "nice view", "Rede caiu; dados lentos", "", "poor signal",
)
_SAYS_SQL = "[" + ", ".join(f"'{s}'" for s in SAYS) + "]"
_PLAIN = "trim(regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', ' ', 'g'))"


def _has(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(p, '{w}')" for w in words) + ")"


_KIND = " ".join(f"WHEN {_has(words)} THEN '{name}'" for name, _, words in complaints.KINDS)
_WEIGHT = " ".join(f"WHEN '{name}' THEN {weight}::DOUBLE" for name, weight, _ in complaints.KINDS)
_ABOUT = f"p <> '' AND NOT {_has(complaints.EXCLUDED)} AND (NOT {_has(complaints.WIRELESS)} OR {_has(complaints.MOBILE)})"


def _says(t: Tables):
    return F.element_at(F.array(*[F.lit(s) for s in SAYS]), (F.col("event_id") % len(SAYS) + 1).cast("int"))


@query(f"""WITH e AS (SELECT event_id, {_PLAIN.format(f"({_SAYS_SQL})[(event_id % {len(SAYS)} + 1)::INT]")} AS p FROM events),
k AS (SELECT event_id, CASE WHEN {_ABOUT} THEN CASE {_KIND} END END AS kind FROM e)
SELECT event_id, kind, CASE kind {_WEIGHT} END AS weight FROM k""")
def complaint_kinds(t: Tables):
    k = complaints.kind(F.col("p"))
    rows = t.events.select("event_id", plain_text(_says(t)).alias("p"))
    return rows.select("event_id", k.alias("k")).select("event_id", "k.kind", "k.weight")


_OBSERVED = """o AS (SELECT user_id, (['no_signal', 'network_outage', 'dropped_call', 'weak_signal', 'slow_data'])[(event_id % 5 + 1)::INT] AS kind,
  ([1.0::DOUBLE, 1.0::DOUBLE, 0.8::DOUBLE, 0.8::DOUBLE, 0.6::DOUBLE])[(event_id % 5 + 1)::INT] AS weight,
  ts - to_days((event_id % 400)::INT) AS seen, 'H' || (event_id % 3) AS host, event_id % 97 AS digest, event_id FROM events)"""
_ROLLUP = f"""n AS (SELECT max(ts) AS now FROM events), {_OBSERVED},
f AS (SELECT *, greatest(0, (epoch_us(now) - epoch_us(seen)) // 86400000000) AS age FROM o, n),
d AS (SELECT * FROM f WHERE age <= 365 QUALIFY row_number() OVER (PARTITION BY user_id, digest ORDER BY seen DESC, event_id) = 1),
s AS (SELECT user_id, count(*) AS n, round(sum(weight * CASE WHEN age <= 90 THEN 1.0 WHEN age <= 180 THEN 0.6 ELSE 0.3 END::DOUBLE), 4) AS weighted,
  count(DISTINCT host) AS hosts FROM d GROUP BY 1),
c AS (SELECT user_id, string_agg(kind || ':' || n, ',' ORDER BY kind) AS kinds FROM (SELECT user_id, kind, count(*) AS n FROM d GROUP BY 1, 2) GROUP BY 1),
r AS (SELECT a.user_id, coalesce(n, 0) AS n, coalesce(weighted, 0.0) AS weighted, coalesce(hosts, 0) AS hosts, coalesce(kinds, '') AS kinds, latest
  FROM (SELECT user_id, max(seen) AS latest FROM o GROUP BY 1) a LEFT JOIN s USING (user_id) LEFT JOIN c USING (user_id)),
p AS (SELECT *, CASE WHEN n < 3 THEN 'insufficient' WHEN n >= 5 AND weighted >= 4 THEN 'high' WHEN weighted >= 2 THEN 'medium' ELSE 'low' END AS pressure FROM r)"""


def _rollup(t: Tables):
    k = (F.col("event_id") % 5 + 1).cast("int")
    kinds = [name for name, _, _ in complaints.KINDS]
    weights = [weight for _, weight, _ in complaints.KINDS]
    at = F.col("ts") - F.make_dt_interval((F.col("event_id") % 400).cast("int"))
    o = t.events.select(
        "user_id", F.element_at(F.array(*map(F.lit, kinds)), k).alias("kind"), F.element_at(F.array(*map(F.lit, weights)), k).alias("weight"),
        at.alias("at"), F.concat(F.lit("https://H"), (F.col("event_id") % 3).cast("string"), F.lit("/x?y=1")).alias("url"),
        (F.col("event_id") % 97).alias("digest"), "event_id",
    )
    now = t.events.agg(F.max("ts").alias("now"))  # one row
    return complaints.rollup(o.crossJoin(now), "user_id", F.col("now"), [F.col("event_id")])


@query(f"""WITH {_ROLLUP} SELECT user_id, n, weighted, hosts, kinds, pressure, CASE WHEN pressure = 'high' AND hosts < 2 THEN 'medium' ELSE pressure END AS confidence, latest FROM p""")
def complaint_rollup(t: Tables):
    """Observations weighed by severity and freshness, one per content hash, ages in whole days of 24 hours."""
    kinds = F.array_join(F.transform(F.map_entries("kinds"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return _rollup(t).withColumn("kinds", kinds)


@query(f"""WITH {_ROLLUP}, g AS (SELECT *, user_id % 7 AS grp FROM p WHERE n >= 3),
q AS (SELECT user_id, grp, CASE WHEN count(*) OVER w = 1 THEN 0.5 ELSE (row_number() OVER (PARTITION BY grp ORDER BY weighted, user_id) - 1)::DOUBLE / (count(*) OVER w - 1) END AS x FROM g WINDOW w AS (PARTITION BY grp))
SELECT user_id, grp, round(x, 6) AS percentile, CASE WHEN x >= 0.8 THEN 'high' WHEN x >= 0.6 THEN 'medium' ELSE 'low' END AS pressure FROM q""")
def complaint_percentile(t: Tables):
    """The pressure that a rollup has within its group; groups are cut into ranges, so none is in one task."""
    rows = complaints.by_percentile(_rollup(t).withColumn("grp", F.col("user_id") % 7), ["grp"], "user_id")
    return rows.select("user_id", "grp", F.round("percentile", 6).alias("percentile"), "pressure")


@query("""WITH o AS (SELECT user_id, event_id, event_type, value FROM events) SELECT user_id,
  sha256(count(*) || '|' || sum(('0x' || substr(sha256(event_id || '|' || event_type), 1, 15))::BIGINT)::HUGEINT || '|' || sum(('0x' || substr(sha256(event_id || '|' || event_type), 16, 15))::BIGINT)::HUGEINT) AS input_hash FROM o GROUP BY 1""")
def rollup_input_hash(t: Tables):
    """Whether a user's rows have changed, whatever their order."""
    return complaints.input_hash(t.events, "user_id", ["event_id", "event_type"])


_POLICIES = ((1, "example.net", True), (2, "blog.example.com", False), (3, "example.com", True), (4, "com", False))


@query(f"""WITH d AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS h, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s,
  page_id % 5 <> 0 AS robots, CASE WHEN page_id % 7 <> 0 THEN page_id % 11 <> 0 END AS terms FROM pages),
p(place, dom, ok) AS (VALUES {", ".join(map(str, _POLICIES))})
SELECT page_id, s IN ('http', 'https') AND h <> '' AND coalesce(arg_min(ok, place), false) AND robots AND coalesce(terms, false) AND NOT contains(lower(url), '/fr/') AS allowed
FROM d LEFT JOIN p ON h = dom OR ends_with(h, '.' || dom) GROUP BY page_id, url, h, s, robots, terms""")
def complaint_sources(t: Tables):
    """Which pages may be used: denied patterns, then the first policy above the host, then what the record says."""
    policies = t.spark.createDataFrame(list(_POLICIES), "place int, domain string, approved boolean")
    rows = t.pages.select("page_id", "url", (F.col("page_id") % 5 != 0).alias("robots"), F.when(F.col("page_id") % 7 != 0, F.col("page_id") % 11 != 0).alias("terms"))
    return complaints.allowed_source(rows, "url", policies, ["/fr/"], ["robots", "terms"]).select("page_id", "allowed")


_PLACES = """places AS (SELECT n_nationkey AS place, lower(n_name) AS name, 'nation of ' || lower(n_name) AS other, lower(r_name) AS city, 'region' AS country FROM nation JOIN region ON n_regionkey = r_regionkey)"""


@query(f"""WITH {_PLACES}, names AS (SELECT place, city, country, unnest([name, other]) AS name FROM places),
texts AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'poor signal in ' || lower(n_name) || ' of ' || lower(r_name) WHEN 1 THEN 'no signal near ' || lower(n_name) WHEN 2 THEN 'in region ' || lower(n_name) || ' and ' || (SELECT lower(m.n_name) FROM nation m WHERE m.n_nationkey = (c_custkey % 25)) ELSE 'all fine' END AS text,
  CASE WHEN c_custkey % 6 = 2 THEN c_nationkey WHEN c_custkey % 6 = 4 THEN 99 END AS given FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
known AS (SELECT id, text, CASE WHEN given IN (SELECT place FROM places) THEN given END AS given FROM texts),
m AS (SELECT id, count(DISTINCT place) AS n, min(place) AS place FROM known JOIN names ON length(name) >= 4 AND contains(text, name) AND (given IS NULL OR given = place) AND (contains(text, city) OR contains(text, country)) GROUP BY 1)
SELECT id, CASE WHEN n = 1 THEN place END AS place, CASE WHEN n = 1 THEN 'exact' WHEN n > 1 THEN 'possible_duplicate' ELSE 'unmatched' END AS verdict FROM texts LEFT JOIN m USING (id)""")
def complaint_places(t: Tables):
    """The one place whose name, and whose city or country, stands in a text."""
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.lower("n_name").alias("nation"), F.lower("r_name").alias("region"))
    places = n.select(F.col("n_nationkey").alias("place"), F.array("nation", F.concat(F.lit("nation of "), "nation")).alias("names"), F.col("region").alias("city"), F.lit("region").alias("country"))
    other = n.select((F.col("n_nationkey")).alias("_other"), F.col("nation").alias("other"))
    rows = t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(other, F.col("c_custkey") % 25 == F.col("_other"))
    k = F.col("c_custkey")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("poor signal in "), "nation", F.lit(" of "), "region"))
        .when(k % 4 == 1, F.concat(F.lit("no signal near "), "nation"))
        .when(k % 4 == 2, F.concat(F.lit("in region "), "nation", F.lit(" and "), "other"))
        .otherwise("all fine")
    )
    given = F.when(k % 6 == 2, F.col("c_nationkey")).when(k % 6 == 4, 99)
    texts = rows.select(k.alias("id"), text.alias("text"), given.alias("given"))
    return complaints.named(texts, "id", "text", places)


@query("""WITH c AS (SELECT c_custkey AS k, (['National Flagship', 'City Core', 'Regional Anchor'])[(c_custkey % 3 + 1)::INT] AS v, (['high', 'medium', NULL])[(c_custkey % 7 % 3 + 1)::INT] AS p,
  (['poor', 'good'])[(c_custkey % 2 + 1)::INT] AS mc, (['high', 'low', 'medium'])[(c_custkey % 5 % 3 + 1)::INT] AS mf, (['poor', 'moderate', NULL])[(c_custkey % 11 % 3 + 1)::INT] AS fc, 'medium' AS ff FROM customer),
r AS (SELECT k, v, coalesce(p = 'high', false) AS a, mc = 'poor' AND mf IN ('high', 'medium') AS b, coalesce(fc = 'poor', false) AS d FROM c)
SELECT k, CASE WHEN NOT (a OR b OR d) THEN 'Normal' WHEN v IN ('National Flagship', 'City Core') THEN 'High' ELSE 'Medium' END AS priority, a::INT + b::INT + d::INT AS reasons FROM r""")
def network_validation(t: Tables):
    """How urgent it is to look at a place's network, and for how many reasons."""
    k = F.col("c_custkey")
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (n + 1).cast("int"))
    out = complaints.validation(
        pick(k % 3, "National Flagship", "City Core", "Regional Anchor"), pick(k % 7 % 3, "high", "medium", None),
        (pick(k % 2, "poor", "good"), pick(k % 5 % 3, "high", "low", "medium")), (pick(k % 11 % 3, "poor", "moderate", None), F.lit("medium")),
    )
    return t.customer.select(k.alias("k"), out.alias("o")).select("k", "o.priority", F.size("o.reasons").alias("reasons"))


@query("""WITH e AS (SELECT event_id AS k FROM events) SELECT k, CASE k % 5 WHEN 0 THEN '[redacted-handle] no signal ' || k || ' mail [redacted-email] now' WHEN 1 THEN 'call [redacted-phone] or [redacted-phone]' WHEN 2 THEN 'a@b and [redacted-handle]' WHEN 3 THEN 'Maria says x' ELSE '' END AS clean FROM e""")
def sanitized_complaints(t: Tables):
    """Complaints without who wrote them; SQL gives what is left of each."""
    k = F.col("event_id")
    raw = (
        F.when(k % 5 == 0, F.concat(F.lit("  Maria @maria_99 no  signal "), k.cast("string"), F.lit(" mail Ma.Ria@Example.org\nnow"))).when(k % 5 == 1, "call +55 (11) 91234-5678 or 011.4567.8901")
        .when(k % 5 == 2, "a@b and @x.y").when(k % 5 == 3, "Maria says x")
    )
    return t.events.select(k.alias("k"), text.sanitize(raw).alias("clean"))


_CITIES = ("Москва", "Санкт-Петербург", "Щёлково", "Ярославль", "Paris", "Южно-Сахалинск")
_LATIN = "lower(x)"
for _a, _b in text.LATIN:
    _LATIN = f"replace({_LATIN}, '{_a}', '{_b}')"


@query(f"""WITH c AS (SELECT c_custkey AS k, ([{", ".join(f"'{x}'" for x in _CITIES)}])[(c_custkey % {len(_CITIES)} + 1)::INT] AS x FROM customer) SELECT k, translate({_LATIN}, '{text.LATIN_FROM}', '{text.LATIN_TO}') AS latin,
  CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END AS mentions FROM c""")
def romanized_names(t: Tables):
    """Names in Latin letters, and how often a text mentions them."""
    k = F.col("c_custkey")
    name = F.element_at(F.array(*map(F.lit, _CITIES)), (k % len(_CITIES) + 1).cast("int"))
    said = F.when(k % 2 == 0, F.concat(F.lit("The Arena is new. "), F.repeat(F.lit("x "), F.lit(90)), F.lit("arena, again"))).otherwise("no arenas")
    return t.customer.select(k.alias("k"), text.latin(name).alias("latin"), F.size(text.mentions(said, "Arena")).alias("mentions"))
