"""Visits of places: the model over line items, its activation and checks, and what a single metric says."""

from pyspark.sql import functions as F

from loomstone.operators import visits
from loomstone.operators.changes import exists_flag  # noqa: F401
from loomstone.plans.registry import Tables, query

_SCENES = list(visits.SCENES)
_KEYS = sorted({*visits.BOUNDS, *visits.ANNUAL_KEYS, *(k for s in visits.SCENES.values() for k in s.proxies)})
_DIRECT = tuple(sorted({*visits.ANNUAL_KEYS, *visits.DAILY_KEYS}))
_lit = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else repr(x) if isinstance(x, str) else f"{float(x)!r}::DOUBLE"
_array = lambda xs: "NULL::DOUBLE[]" if xs is None else "[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in xs) + "]"
_names = lambda xs: "[" + ", ".join(map(repr, xs)) + "]"


def _scene_rows() -> str:
    rows = []
    for name, s in visits.SCENES.items():
        demand = ", ".join(_array(visits.triple(x)) for x in (s.attach, s.indoor, s.busy, s.gigabytes))
        flags = ", ".join(map(_lit, (s.calibrated, s.event_driven, s.covers_total)))
        rows.append(f"({name!r}, {_array(s.active_days)}, {_array(s.peak)}, {flags}, {demand})")
    return ", ".join(rows)


def _metric_rows() -> str:
    rows = []
    for name, s in visits.SCENES.items():
        for key in sorted({*visits.BOUNDS, *s.proxies}):
            low, high = visits.BOUNDS.get(key, (None, None))
            year, peak = s.proxies.get(key, (None, None))
            at = list(s.proxies).index(key) if key in s.proxies else "NULL"
            place = next(((g, list(ks).index(key)) for g, ks in enumerate(s.groups.values()) if key in ks), ("NULL", "NULL"))
            rows.append(f"({name!r}, {key!r}, {_lit(low)}, {_lit(high)}, {at}::INT, {_array(year)}, {_array(peak)}, {place[0]}::INT, {place[1]}::INT)")
    return ", ".join(rows)


def _year(x: str, i: int) -> str:
    return f"CASE WHEN {x}.unit = 'visits/year' THEN {x}.value WHEN {x}.unit = 'visits/day' THEN {x}.value * days[{i}] ELSE {x}.value * coalesce({x}.per_year[{i}], 1.0) END"


def _day(year: list[str], i: int) -> str:
    return f"({year[i - 1]}) / (CASE WHEN event_driven THEN 365.0 ELSE days[{4 - i}] END)"


def _peak(x: str, i: int) -> str:
    typical = f"CASE WHEN {x}.unit = 'visits/day' THEN {x}.value ELSE {_day([_year(x, j) for j in (1, 2, 3)], i)} END"
    return f"CASE WHEN {x}.per_peak IS NOT NULL THEN {x}.value * {x}.per_peak[{i}] ELSE ({typical}) * peak[{i}] END"


_sum = lambda f, i: " + ".join(f"coalesce({f(f'part{g}', i)}, 0.0)" for g in range(3))
_best = lambda cond, order: f"arg_min({{'metric': metric, 'value': value, 'unit': unit, 'per_year': per_year, 'per_peak': per_peak}}, ({order}-value, metric, evidence)) FILTER (fits AND {cond})"
_ESTIMATE = f"""sc(scene, days, peak, calibrated, event_driven, covers, attach, indoor, busy, gig) AS (VALUES {_scene_rows()}),
me(scene, metric, low, high, proxy, per_year, per_peak, grp, pos) AS (VALUES {_metric_rows()}),
m0 AS (SELECT l_orderkey AS k, ({_names(_SCENES)})[(l_orderkey % {len(_SCENES)} + 1)::INT] AS scene, ({_names(_KEYS)})[(l_partkey % {len(_KEYS)} + 1)::INT] AS metric,
  round(l_extendedprice * (CASE l_suppkey % 3 WHEN 0 THEN 0.02 WHEN 1 THEN 1.0 ELSE 9.0 END)::DOUBLE) AS value, l_linenumber AS line, l_linenumber * 1000000 + l_partkey AS evidence FROM lineitem),
m1 AS (SELECT *, CASE WHEN line = 6 THEN NULL WHEN metric IN {_DIRECT} THEN CASE WHEN evidence % 2 = 0 THEN 'visits/year' ELSE 'visits/day' END ELSE 'units' END AS unit FROM m0),
m AS (SELECT m1.*, low, high, proxy, per_year, per_peak, grp, pos, coalesce(value BETWEEN low AND high, true) AS fits FROM m1 LEFT JOIN me USING (scene, metric)
  WHERE value > 0 AND unit IS NOT NULL AND NOT (value BETWEEN 1900 AND 2100)),
b AS (SELECT k, scene, {_best(f"metric IN {_DIRECT} AND unit = 'visits/year'", "")} AS annual, {_best(f"metric IN {_DIRECT} AND unit = 'visits/day'", "")} AS daily,
  {_best("proxy IS NOT NULL", "proxy, ")} AS prox, {", ".join(_best(f"grp = {g}", "pos, ") + f" AS part{g}" for g in range(3))},
  string_agg(DISTINCT metric, ',' ORDER BY metric) FILTER (NOT fits) AS filtered FROM m GROUP BY 1, 2),
p AS (SELECT * FROM (SELECT DISTINCT k, scene FROM m1) LEFT JOIN b USING (k, scene) LEFT JOIN sc USING (scene)),
q AS (SELECT *, CASE WHEN annual IS NOT NULL AND covers THEN 'direct_annual' WHEN daily IS NOT NULL AND covers THEN 'direct_daily' WHEN part0 IS NOT NULL OR part1 IS NOT NULL OR part2 IS NOT NULL THEN 'scene_components'
  WHEN prox IS NOT NULL THEN 'scene_proxy' ELSE 'insufficient' END AS method FROM p),
y AS (SELECT *, {", ".join(f"CASE method WHEN 'direct_annual' THEN {'annual.value' if i == 2 else 'NULL'} WHEN 'direct_daily' THEN daily.value * days[{i}] WHEN 'scene_components' THEN {_sum(_year, i)} WHEN 'scene_proxy' THEN prox.value * coalesce(prox.per_year[{i}], 1.0) END AS y{i}" for i in (1, 2, 3))} FROM q),
d AS (SELECT *, {", ".join(f"CASE WHEN method = 'direct_daily' THEN daily.value WHEN method <> 'insufficient' THEN {_day(['coalesce(y1, y2)', 'y2', 'coalesce(y3, y2)'], i)} END AS d{i}" for i in (1, 2, 3))} FROM y),
x AS (SELECT *, {", ".join(f"CASE WHEN method = 'scene_components' THEN {_sum(_peak, i)} WHEN method <> 'insufficient' THEN CASE WHEN prox.per_peak IS NOT NULL THEN prox.value * prox.per_peak[{i}] ELSE d{i} * peak[{i}] END END AS x{i}" for i in (1, 2, 3))} FROM d),
r AS (SELECT *, {", ".join(f"x{i} * attach[{i}] * indoor[{i}] * busy[{i}] * gig[{i}] * 8192 / 3600 AS mbps{i}" for i in (1, 2, 3))} FROM x)"""


def _metrics(t: Tables):
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))
    k = F.col("l_suppkey") % 3
    value = F.round(F.col("l_extendedprice") * F.when(k == 0, 0.02).when(k == 1, 1.0).otherwise(9.0))
    evidence = F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")
    rows = t.lineitem.select(F.col("l_orderkey").alias("k"), pick(_SCENES, F.col("l_orderkey")).alias("scene"), pick(_KEYS, F.col("l_partkey")).alias("metric"), value.alias("value"), evidence.alias("evidence"), "l_linenumber")
    direct = F.when(F.col("evidence") % 2 == 0, "visits/year").otherwise("visits/day")
    unit = F.when(F.col("l_linenumber") != 6, F.when(F.col("metric").isin(*_DIRECT), direct).otherwise("units"))
    return rows.withColumn("unit", unit)


@query(f"""WITH {_ESTIMATE} SELECT k, scene, method, round(y1, 6) AS low, round(y2, 6) AS mid, round(y3, 6) AS high, round(d1, 6) AS day_low, round(d3, 6) AS day_high, round(x2, 6) AS peak,
  round(mbps1, 6) AS mbps_low, round(mbps3, 6) AS mbps_high, CASE method WHEN 'insufficient' THEN method WHEN 'direct_annual' THEN 'high' WHEN 'direct_daily' THEN 'medium' ELSE CASE WHEN calibrated THEN 'medium' ELSE 'low' END END AS confidence,
  concat_ws(' ', 'implausible_metric_filtered:' || filtered, CASE WHEN method IN ('scene_components', 'scene_proxy') AND NOT calibrated THEN 'uncalibrated_scene' END) AS flags FROM r""")
def visit_estimates(t: Tables):
    """The whole cascade: direct numbers, components, proxies, with ranges down to the busy hour's bandwidth."""
    e = visits.estimate(_metrics(t), "k")
    at = lambda c, i, n=6: F.round(F.col(c)[i], n)
    return e.select(
        "k", "scene", "method", at("annual", 0).alias("low"), at("annual", 1).alias("mid"), at("annual", 2).alias("high"), at("typical_day", 0).alias("day_low"), at("typical_day", 2).alias("day_high"),
        at("peak_day", 1).alias("peak"), at("mbps", 0).alias("mbps_low"), at("mbps", 2).alias("mbps_high"), "confidence", F.array_join("flags", " ").alias("flags"),
    )


@query(f"""WITH {_ESTIMATE}, a(country, scene) AS (VALUES ('Nation 3', 'stadium'), ('*', 'mall_mixed_use')),
s AS (SELECT k, method, scene, 'nation ' || (k % 5) AS country FROM r),
z AS (SELECT k, CASE WHEN method = 'insufficient' THEN 'shadow_insufficient' WHEN method IN ('direct_annual', 'direct_daily') THEN 'activated_direct'
  WHEN EXISTS (SELECT 1 FROM a WHERE a.scene = s.scene AND lower(a.country) IN ('*', s.country)) THEN 'activated_approved_proxy' ELSE 'shadow_unapproved_proxy' END AS status FROM s)
SELECT k, status, starts_with(status, 'activated') AS active FROM z""")
def visit_activation(t: Tables):
    """Whether an estimate replaces the older one: direct ones do, proxies where scene and country are approved."""
    approvals = t.spark.createDataFrame([("Nation 3", "stadium"), ("*", "mall_mixed_use")], "country string, scene string")
    e = visits.estimate(_metrics(t), "k").select("k", "scene", "method", F.concat(F.lit("nation "), (F.col("k") % 5).cast("string")).alias("country"))
    rows = visits.approved_scenes(e, "country", "scene", approvals)
    return rows.select("k", visits.activation(F.col("method"), F.col("scene"), F.col("approved")).alias("a")).select("k", "a.status", "a.active")


@query("""WITH v AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity - 2 END AS a, CASE WHEN l_linenumber = 5 THEN floor(l_extendedprice / 20) ELSE l_quantity + l_partkey % 5 - 2 END AS b, l_quantity + 1 AS c FROM lineitem)
SELECT k, n, concat_ws('; ', CASE WHEN coalesce(a <= 0, false) OR b <= 0 OR c <= 0 THEN 'annual not positive' END, CASE WHEN a IS NOT NULL AND NOT (a <= b AND b <= c) THEN 'annual out of order' END,
  CASE WHEN b = floor(b) AND b BETWEEN 1900 AND 2100 THEN 'annual looks like a year' END) AS faults FROM v""")
def visit_range_faults(t: Tables):
    q = F.col("l_quantity")
    a, b = F.when(F.col("l_linenumber") % 3 != 0, q - 2), F.when(F.col("l_linenumber") == 5, F.floor(F.col("l_extendedprice") / 20).cast("double")).otherwise(q + F.col("l_partkey") % 5 - 2)
    rows = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.array(a, b, q + 1).alias("annual"))
    return rows.select("k", "n", F.array_join(visits.faults(["annual"]), "; ").alias("faults"))


def _in(xs) -> str:
    return "(" + ", ".join(map(repr, xs)) + ")"


_FACTOR = " ".join(
    f"WHEN scene = '{name}'" + (" AND metric <> 'line_count'" if name == "transport_hub" else "" if keys == ("*",) else f" AND metric IN {_in(keys)}") + f" THEN {float(f)}::DOUBLE" for name, keys, f in visits.YEARLY
)
_CAP_ROWS = ", ".join(f"('{k}', {v})" for k, v in visits.CAPS.items())


@query(f"""WITH {_ESTIMATE}, f AS (SELECT k, evidence, scene, metric, value, CASE WHEN unit = 'visits/day' THEN 365.0::DOUBLE WHEN metric IN {_DIRECT} AND unit = 'visits/year' THEN 1.0::DOUBLE WHEN metric IN {_in(visits.DAILY_FIELDS)} THEN 365.0::DOUBLE {_FACTOR} END AS factor FROM m1),
c(scene, cap) AS (VALUES {_CAP_ROWS})
SELECT k, evidence, factor, value * factor AS visits, CASE WHEN value * factor > cap THEN cap END AS exceeds FROM f JOIN c USING (scene)""")
def annual_proxies(t: Tables):
    """A year's visits by what one metric says, and the cap of its scene where they exceed it."""
    m = _metrics(t).withColumn("p", visits.annual_proxy(F.col("scene"), F.col("metric"), F.col("value"), F.col("unit")))
    return m.select("k", "evidence", "p.factor", "p.visits", visits.implausible_visits(F.col("scene"), F.col("p.visits")).cast("long").alias("exceeds"))


_CAPPED = " ".join(f"WHEN scene = '{n}' AND metric IN {_in(ks)} AND value > {m} THEN '{n} {ks[0]} beyond {m}'" for n, ks, m in visits.METRIC_CAPS)
_SCENE_OF = ["stadium", "transport_hub", "office_government", "hospital", "mall_mixed_use", "convention_center"]
_METRIC_OF = ["seat_count", "line_count", "nla", "beds", "gla", "meeting_area", "daily_ridership"]
_UNIT_OF = ["sqm", "people", "", "m2", "visits_year"]


@query(f"""WITH m AS (SELECT l_orderkey AS k, l_linenumber AS n, ({_names(_SCENE_OF)})[(l_partkey % 6 + 1)::INT] AS scene, ({_names(_METRIC_OF)})[(l_suppkey % 7 + 1)::INT] AS metric, ({_names(_UNIT_OF)})[(l_orderkey % 5 + 1)::INT] AS unit,
  l_extendedprice * l_quantity * (CASE WHEN l_linenumber = 1 THEN 0.001 ELSE 3.0 END)::DOUBLE AS value FROM lineitem)
SELECT k, n, CASE {_CAPPED} WHEN scene = 'office_government' AND metric IN ('nla', 'office_gfa', 'office_nla') AND unit <> '' AND unit NOT IN {_in(visits.AREA_UNITS)} THEN 'office area in another unit'
  WHEN scene = 'office_government' AND metric IN ('nla', 'office_gfa', 'office_nla') AND value > 5000000 THEN 'office area beyond 5000000'
  WHEN metric IN ('gla', 'nla', 'exhibition_area', 'meeting_area', 'mosque_area') AND unit IN {_in(visits.PEOPLE_UNITS)} THEN 'area in a unit of people' END AS reason FROM m""")
def implausible_metrics(t: Tables):
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))
    value = F.col("l_extendedprice") * F.col("l_quantity") * F.when(F.col("l_linenumber") == 1, 0.001).otherwise(3.0)
    reason = visits.implausible_metric(pick(_SCENE_OF, F.col("l_partkey")), pick(_METRIC_OF, F.col("l_suppkey")), pick(_UNIT_OF, F.col("l_orderkey")), value)
    return t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), reason.alias("reason"))


@query("""SELECT c_custkey, CASE WHEN hard THEN CASE WHEN d >= 2 THEN 'Supported' ELSE 'Indicative' END ELSE 'Insufficient' END AS status
FROM (SELECT c_custkey, coalesce(max(o_totalprice) > 200000, false) AS hard, count(DISTINCT o_orderpriority) AS d FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)""")
def evidence_statuses(t: Tables):
    o = t.orders.groupBy("o_custkey").agg((F.max("o_totalprice") > 200_000).alias("hard"), F.count_distinct("o_orderpriority").alias("d"))
    rows = t.customer.select("c_custkey").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("c_custkey", visits.evidence_status(F.coalesce("hard", F.lit(False)), F.coalesce("d", F.lit(0))).alias("status"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN l_quantity * 2 ELSE l_quantity END AS shown, l_quantity AS kept FROM lineitem""")
def activated_values(t: Tables):
    """The new value shows where it is active; the old one stays beside it for a rollback."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("shown"), (F.col("l_quantity") * 2).alias("new"), "l_returnflag")
    out = visits.active_values(rows, F.col("l_returnflag") == "A", ["shown"], ["new"])
    return out.select("l_orderkey", "l_linenumber", "shown", F.col("shown_kept").alias("kept"))


_REST = _ESTIMATE.replace("END AS unit FROM m0)", f"END AS unit FROM m0 WHERE metric NOT IN {_DIRECT})")
_OLD = " ".join(f"WHEN scene = '{name}'" + (" AND metric <> 'line_count'" if name == "transport_hub" else "" if keys == ("*",) else f" AND metric IN {_in(keys)}") + f" THEN value * {float(f)}::DOUBLE" for name, keys, f in visits.YEARLY)


@query(f"""WITH {_REST}, full_rows AS (SELECT *, CASE WHEN line = 6 THEN NULL WHEN metric IN {_DIRECT} THEN CASE WHEN evidence % 2 = 0 THEN 'visits/year' ELSE 'visits/day' END ELSE 'units' END AS unit FROM m0),
known AS (SELECT k, f.scene, arg_min(value, (-value, f.metric, evidence)) AS actual FROM full_rows f LEFT JOIN me ON me.scene = f.scene AND me.metric = f.metric JOIN sc ON sc.scene = f.scene
  WHERE f.metric IN {_DIRECT} AND unit = 'visits/year' AND covers AND value > 0 AND NOT value BETWEEN 1900 AND 2100 AND coalesce(value BETWEEN low AND high, true) GROUP BY 1, 2),
old AS (SELECT k, scene, arg_min(p, (-value, metric, evidence)) AS v1 FROM (SELECT *, CASE {_OLD} END AS p FROM m1) WHERE p > 0 GROUP BY 1, 2)
SELECT k, scene, round(actual, 4) AS actual, round(v1, 4) AS v1, round(y2, 4) AS v2 FROM known JOIN old USING (k, scene) JOIN r USING (k, scene) WHERE method <> 'insufficient'""")
def benchmark_samples(t: Tables):
    """Places whose visits are known, with what both models make of their other metrics."""
    b = visits.benchmark(_metrics(t), "k")
    return b.select("k", "scene", F.round("actual", 4).alias("actual"), F.round("v1", 4).alias("v1"), F.round("v2", 4).alias("v2"))
