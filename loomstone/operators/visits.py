"""Visits of a place out of its metrics: the method cascade, demand in the busy hour, activation, checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators.ranks import join_keys, percentiles

Triple = tuple[float, float, float]

#: Metrics that count visits themselves.
ANNUAL_KEYS = (
    "annual_passenger_throughput", "passenger_throughput", "annual_footfall", "footfall", "annual_visitors",
    "annual_visits", "annual_station_entries_exits", "outpatient_volume", "interchange_volume",
)
DAILY_KEYS = ("daily_ridership", "ridership", "daily_visitors", "outpatient_volume", "interchange_volume")
#: What a metric may be, both ends included.
BOUNDS: dict[str, tuple[float, float]] = {
    "annual_passenger_throughput": (1, 300_000_000), "passenger_throughput": (1, 300_000_000),
    "annual_footfall": (100, 1_000_000_000), "footfall": (100, 1_000_000_000),
    "annual_visitors": (100, 1_000_000_000), "annual_visits": (100, 1_000_000_000),
    "daily_ridership": (10, 20_000_000), "ridership": (10, 20_000_000), "daily_visitors": (10, 20_000_000),
    "outpatient_volume": (10, 500_000_000), "interchange_volume": (10, 500_000_000),
    "exhibition_area": (100, 1_000_000), "meeting_area": (50, 1_000_000),
    "peak_event_capacity": (100, 500_000), "plenary_capacity": (100, 500_000), "seat_count": (100, 250_000),
    "keys": (20, 5_000), "rooms": (20, 5_000), "meeting_ballroom_area": (50, 500_000), "ballroom_capacity": (50, 100_000),
    "gla": (1_000, 2_000_000), "retail_gfa": (1_000, 3_000_000), "office_nla": (1_000, 5_000_000), "office_gfa": (1_000, 5_000_000),
    "beds": (20, 10_000), "staff_count": (20, 100_000), "employee_count": (20, 100_000),
    "enrollment": (100, 1_000_000), "students": (100, 1_000_000), "student_count": (100, 1_000_000), "campus_population": (100, 1_000_000),
}


@dataclass(frozen=True)
class Scene:
    """How a kind of place turns metrics into visits; triples are low, middle and high.

    proxies: key to (a year's visits per unit, a peak day's or None), the first key that a place has counts.
    groups: name to keys, of which the first that a place has is the group's component; components add up.
    """

    active_days: Triple
    peak: Triple
    calibrated: bool = False
    event_driven: bool = False
    covers_total: bool = True
    proxies: Mapping[str, tuple[Triple, Triple | None]] = field(default_factory=dict)
    groups: Mapping[str, Sequence[str]] = field(default_factory=dict)
    attach: tuple[float, ...] = (0.7, 0.7, 0.7)
    indoor: tuple[float, ...] = (0.8, 0.8, 0.8)
    busy: tuple[float, ...] = (0.1, 0.1, 0.1)
    gigabytes: tuple[float, ...] = (0.4, 0.4, 0.4)


_EVENT, _ROOMS, _STAFF, _CAMPUS = ((6, 10, 18), (0.65, 0.85, 1.00)), ((650, 900, 1150), (1.20, 1.80, 2.50)), ((230, 250, 270), None), ((140, 180, 220), None)
#: Fixed values of the model.
SCENES: dict[str, Scene] = {
    "airport_terminal": Scene((365, 365, 365), (1.10, 1.25, 1.50), True, attach=(0.75, 0.85), indoor=(0.85, 0.95), busy=(0.08, 0.12), gigabytes=(0.45, 0.65)),
    "convention_center": Scene(
        (35, 70, 120), (1.20, 1.50, 2.00), event_driven=True, attach=(0.70, 0.85), indoor=(0.80, 0.95), busy=(0.10, 0.20), gigabytes=(0.40, 0.70),
        proxies={
            "exhibition_area": ((5, 10, 18), (0.20, 0.35, 0.55)), "meeting_area": ((8, 15, 25), (0.15, 0.30, 0.50)),
            "peak_event_capacity": _EVENT, "plenary_capacity": _EVENT,
        },
    ),
    "stadium": Scene(
        (8, 15, 30), (1.00, 1.00, 1.00), event_driven=True, attach=(0.75, 0.90), indoor=(0.55, 0.80), busy=(0.18, 0.35), gigabytes=(0.50, 0.90),
        proxies={"seat_count": ((8, 15, 30), (0.55, 0.75, 0.95)), "peak_event_capacity": ((8, 15, 30), (0.55, 0.75, 0.95))},
    ),
    "luxury_hotel_mice": Scene(
        (330, 350, 365), (1.05, 1.20, 1.45), attach=(0.60, 0.80), indoor=(0.75, 0.90), busy=(0.06, 0.12), gigabytes=(0.30, 0.55),
        groups={"accommodation": ("keys", "rooms"), "mice": ("meeting_ballroom_area", "ballroom_capacity")},
        proxies={
            "keys": _ROOMS, "rooms": _ROOMS, "meeting_ballroom_area": ((15, 30, 50), (0.20, 0.35, 0.50)),
            "ballroom_capacity": ((80, 120, 180), (0.60, 0.85, 1.00)),
        },
    ),
    "mall_mixed_use": Scene(
        (350, 360, 365), (1.15, 1.35, 1.75), attach=(0.65, 0.85), indoor=(0.80, 0.95), busy=(0.10, 0.18), gigabytes=(0.35, 0.60),
        proxies={"gla": ((12, 20, 32), None), "retail_gfa": ((10, 18, 28), None)},
    ),
    "office_government": Scene(
        (230, 250, 270), (1.00, 1.10, 1.25), attach=(0.65, 0.85), indoor=(0.80, 0.95), busy=(0.10, 0.18), gigabytes=(0.35, 0.60),
        proxies={"office_nla": ((6, 10, 16), None), "office_gfa": ((5, 9, 14), None)},
    ),
    "hospital": Scene(
        (365, 365, 365), (1.05, 1.20, 1.50), covers_total=False, attach=(0.60, 0.80), indoor=(0.80, 0.95), busy=(0.08, 0.15), gigabytes=(0.30, 0.50),
        groups={"outpatient": ("outpatient_volume",), "inpatient_and_visitors": ("beds",), "staff": ("staff_count", "employee_count")},
        proxies={"outpatient_volume": ((1, 1, 1), None), "beds": ((250, 400, 650), None), "staff_count": _STAFF, "employee_count": _STAFF},
    ),
    "university": Scene(
        (160, 180, 210), (1.00, 1.10, 1.30), attach=(0.60, 0.80), indoor=(0.80, 0.95), busy=(0.08, 0.15), gigabytes=(0.30, 0.50),
        proxies={"enrollment": _CAMPUS, "students": _CAMPUS, "student_count": _CAMPUS, "campus_population": _CAMPUS},
    ),
    "transport_hub": Scene((350, 360, 365), (1.05, 1.20, 1.45), True, attach=(0.70, 0.85), indoor=(0.85, 0.95), busy=(0.10, 0.20), gigabytes=(0.35, 0.60)),
    "cruise_port": Scene((120, 220, 365), (1.20, 1.60, 2.20), True, attach=(0.70, 0.85), indoor=(0.80, 0.95), busy=(0.10, 0.20), gigabytes=(0.35, 0.60)),
    "mosque": Scene(
        (300, 350, 365), (1.50, 2.50, 5.00), attach=(0.65, 0.85), indoor=(0.75, 0.92), busy=(0.12, 0.25), gigabytes=(0.30, 0.55),
        proxies={"mosque_area": ((20, 35, 60), None), "gross_floor_area": ((15, 30, 50), None), "prayer_hall_area": ((20, 35, 60), None)},
    ),
}
BUSY_SECONDS = 3600


def triple(values: Sequence[float] | None, default: Triple = (1.0, 1.0, 1.0)) -> Triple:
    """Three values as they are, two with their mean between them, one three times, none as default."""
    v = [float(x) for x in values or ()]
    if not v:
        return default
    return (v[0], v[0], v[0]) if len(v) == 1 else (v[0], (v[0] + v[1]) / 2, v[1]) if len(v) == 2 else (v[0], v[1], v[2])


def year_like(value: Column) -> Column:
    """Whether a number may be a year that was read as a count."""
    return F.coalesce((value == F.floor(value)) & value.between(1900, 2100), F.lit(False))


def safe_visits(value: Column) -> Column:
    return F.when(~year_like(value), value)


#: Columns of demand that follow from a year's visits, and what stands beside them once they are blank.
DEMAND = ("daily_visits", "busy_hour_users", "busy_hour_traffic_gb", "busy_hour_bandwidth_mbps")
BLOCKED = "annual visits look like a year"


def scrubbed(
    rows: DataFrame, annual: str = "annual_visits_est", raw: str | None = "annual_visits_raw", demand: Sequence[str] = DEMAND, reason: str | None = "cannot_calculate_reason"
) -> DataFrame:
    """rows as they may be shown: where annual may be a year, it and all demand are null, and reason says why.

    annual becomes a double, or null if it is no number; raw is blanked if annual is and it looks like a year itself. Columns
    of demand, raw and reason that rows lacks are left out (a map's features have fewer of them). All else stays, and so
    does every row; rows with no annual value keep their demand.
    """
    bad = year_like(F.col(f"`{annual}`").try_cast("double"))
    has = set(rows.columns)
    new = {annual: safe_visits(F.col(f"`{annual}`").try_cast("double"))}
    if raw in has:
        own = F.col(f"`{raw}`")
        new[raw] = F.when(~(bad & year_like(own.try_cast("double"))), own)
    new |= {c: F.when(~bad, F.col(f"`{c}`")) for c in demand if c in has}
    if reason in has:
        new[reason] = F.when(bad, F.lit(BLOCKED)).otherwise(F.col(f"`{reason}`"))
    return rows.withColumns(new)


def value_class(visits: Column) -> Column:
    return (
        F.when(visits >= 10_000_000, "National Flagship").when(visits >= 1_000_000, "City Core")
        .when(visits >= 250_000, "Regional Anchor").when(visits > 0, "Local Candidate").otherwise("Observation")
    )


def evidence_status(hard_metric: Column, domains: Column) -> Column:
    return F.when(~hard_metric, "Insufficient").when(domains >= 2, "Supported").otherwise("Indicative")


def scene_tables(spark: SparkSession, scenes: Mapping[str, Scene], bounds: Mapping[str, tuple[float, float]]) -> tuple[DataFrame, DataFrame]:
    """One row per scene, and one per (scene, metric) with its bounds, proxy and component; as small as the configuration."""
    of_scene, of_metric = [], []
    keys = set(bounds)
    for name, s in scenes.items():
        demand = [list(triple(x)) for x in (s.attach, s.indoor, s.busy, s.gigabytes)]
        of_scene.append((name, list(map(float, s.active_days)), list(map(float, s.peak)), s.calibrated, s.event_driven, s.covers_total, *demand))
        place = {k: (g, i, j) for g, (_, ks) in enumerate(s.groups.items()) for i, (j, k) in enumerate([(list(s.groups)[g], k) for k in ks])}
        for key in sorted(keys | set(s.proxies) | set(place)):
            low, high = bounds.get(key, (None, None))
            year, peak = s.proxies.get(key, (None, None))
            group, pos, _ = place.get(key, (None, None, None))
            at = list(s.proxies).index(key) if key in s.proxies else None
            number = lambda x: None if x is None else float(x)
            of_metric.append((name, key, number(low), number(high), at, [float(x) for x in year] if year else None, [float(x) for x in peak] if peak else None, group, pos))
    triples = "days array<double>, peak array<double>, calibrated boolean, event_driven boolean, covers_total boolean, attach array<double>, indoor array<double>, busy array<double>, gigabytes array<double>"
    a = spark.createDataFrame(of_scene, f"scene string, {triples}")
    b = spark.createDataFrame(of_metric, "scene string, key string, low double, high double, proxy int, per_year array<double>, per_peak array<double>, grp int, pos int")
    return a, b


def _times(value: Column, factors: Column) -> Column:
    return F.transform(factors, lambda f: value * f)


def _typical(year: Column, days: Column) -> Column:
    """A day's visits of a year's: the low end has the most days, the high end the fewest; a missing end is the middle."""
    at = lambda i: F.coalesce(year[i], year[1])
    return F.array(at(0) / days[2], year[1] / days[1], at(2) / days[0])


def estimate(metrics: DataFrame, key: str, scenes: Mapping[str, Scene] = SCENES, bounds: Mapping[str, tuple[float, float]] = BOUNDS) -> DataFrame:
    """One row per key and scene of metrics (key, scene, metric, value, unit, evidence): the method and its ranges.

    Methods in order: direct_annual, direct_daily (both only where they cover the total), scene_components, scene_proxy,
    insufficient. Ranges (annual, typical, peak, users, gigabytes, mbps) are arrays of low, middle and high; the annual one
    of a direct yearly number has no ends. Values that are not positive, have no unit or look like a year are no metrics;
    those out of bounds are named in filtered. Of equal metrics the greatest value counts, then the smallest evidence.
    All picks are made in one aggregation, after a join with the configuration.
    """
    spark = metrics.sparkSession
    of_scene, of_metric = (F.broadcast(x) for x in scene_tables(spark, scenes, bounds))  # as many rows as the configuration has
    rows = metrics.where((F.col("value") > 0) & (F.coalesce("unit", F.lit("")) != "") & ~year_like(F.col("value")))
    m = rows.withColumnRenamed("metric", "_metric").join(of_metric.select(F.col("scene").alias("_scene"), F.col("key").alias("_metric"), "low", "high", "proxy", "per_year", "per_peak", "grp", "pos").withColumnRenamed("_scene", "scene"), ["scene", "_metric"], "left")
    # bounds hold for scenes without a model, too
    fits = F.coalesce(F.col("value").between(F.col("low"), F.col("high")), F.lit(True))
    own = F.struct(F.col("_metric").alias("metric"), "value", "unit", "evidence", "per_year", "per_peak")
    order = F.struct((-F.col("value")).alias("down"), F.col("_metric"), F.col("evidence"))
    best = lambda when, by=order: F.min_by(F.when(when & fits, own), F.when(when & fits, by))
    direct = F.col("_metric").isin(*ANNUAL_KEYS, *DAILY_KEYS)
    groups = max([len(s.groups) for s in scenes.values()], default=0)
    picked = m.groupBy(key, "scene").agg(
        best(direct & (F.col("unit") == "visits/year")).alias("annual"),
        best(direct & (F.col("unit") == "visits/day")).alias("daily"),
        best(F.col("proxy").isNotNull(), F.struct("proxy", order)).alias("proxy"),
        *[best(F.col("grp") == g, F.struct("pos", order)).alias(f"part{g}") for g in range(groups)],
        F.array_sort(F.collect_set(F.when(~fits, F.col("_metric")))).alias("filtered"),  # at most the keys of the bounds
    )
    everyone = metrics.select(key, "scene").distinct()
    p = everyone.join(picked, [key, "scene"], "left").join(of_scene, "scene", "left")
    days, peak = F.col("days"), F.col("peak")
    day_count = F.when(F.col("event_driven"), F.array(*[F.lit(365.0)] * 3)).otherwise(days)
    parts = F.filter(F.array(*[F.col(f"part{g}") for g in range(groups)]), lambda x: x.isNotNull()) if groups else F.array().cast("array<struct<metric:string>>")
    ones = F.array(*[F.lit(1.0)] * 3)
    year_of = lambda x: F.when(x["unit"] == "visits/year", _times(x["value"], ones)).when(x["unit"] == "visits/day", _times(x["value"], days)).otherwise(_times(x["value"], F.coalesce(x["per_year"], ones)))
    day_of = lambda x: F.when(x["unit"] == "visits/day", _times(x["value"], ones)).otherwise(_typical(year_of(x), day_count))
    peak_of = lambda x: F.when(x["per_peak"].isNotNull(), _times(x["value"], x["per_peak"])).otherwise(F.zip_with(day_of(x), peak, lambda a, b: a * b))
    add = lambda f: F.aggregate(F.transform("parts", f), F.array(*[F.lit(0.0)] * 3), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    p = p.withColumn("parts", parts)
    method = (
        F.when(F.col("days").isNull(), "insufficient")
        .when(F.col("annual").isNotNull() & F.col("covers_total"), "direct_annual")
        .when(F.col("daily").isNotNull() & F.col("covers_total"), "direct_daily")
        .when(F.size("parts") > 0, "scene_components")
        .when(F.col("proxy").isNotNull(), "scene_proxy")
        .otherwise("insufficient")
    )
    p = p.withColumn("method", method)
    none = F.lit(None).cast("double")
    by = lambda a, d, c, x: F.when(F.col("method") == "direct_annual", a).when(F.col("method") == "direct_daily", d).when(F.col("method") == "scene_components", c).when(F.col("method") == "scene_proxy", x)
    annual = by(
        F.array(none, F.col("annual.value"), none), _times(F.col("daily.value"), days), add(year_of), _times(F.col("proxy.value"), F.coalesce(F.col("proxy.per_year"), ones))
    )
    p = p.withColumn("annual_visits", annual)
    typical = F.when(F.col("method") == "direct_daily", _times(F.col("daily.value"), ones)).when(F.col("method") != "insufficient", _typical(F.col("annual_visits"), day_count))
    p = p.withColumn("typical_day", typical)
    # a proxy with a peak of its own gives the peak day, whatever gave the year
    of_proxy = F.when(F.col("proxy.per_peak").isNotNull(), _times(F.col("proxy.value"), F.col("proxy.per_peak"))).otherwise(F.zip_with("typical_day", peak, lambda a, b: a * b))
    p = p.withColumn("peak_day", F.when(F.col("method") == "scene_components", add(peak_of)).when(F.col("method") != "insufficient", of_proxy))
    p = p.withColumn("users", F.transform("peak_day", lambda v, i: v * F.col("attach")[i] * F.col("indoor")[i] * F.col("busy")[i]))
    p = p.withColumn("gb", F.transform("users", lambda v, i: v * F.col("gigabytes")[i])).withColumn("mbps", F.transform("gb", lambda v: v * 8192 / BUSY_SECONDS))
    confidence = F.when(F.col("method") == "insufficient", "insufficient").when(F.col("method") == "direct_annual", "high").when((F.col("method") == "direct_daily") | F.col("calibrated"), "medium").otherwise("low")
    flags = F.array_compact(
        F.array(
            F.when(F.size("filtered") > 0, F.concat(F.lit("implausible_metric_filtered:"), F.array_join("filtered", ","))),
            F.when(F.col("method").isin("scene_components", "scene_proxy") & ~F.col("calibrated"), "uncalibrated_scene"),
        )
    )
    chosen = by(F.col("annual.metric"), F.col("daily.metric"), F.array_join(F.transform("parts", lambda x: x["metric"]), "+"), F.col("proxy.metric"))
    reason = F.when(F.col("days").isNull(), F.concat(F.lit("no model for scene "), "scene")).when(F.col("method") == "insufficient", "no direct visit metric or supported scene proxy")
    return p.select(
        key, "scene", "method", chosen.alias("chosen"), F.col("annual_visits").alias("annual"), "typical_day", "peak_day", "users", "gb", "mbps",
        confidence.alias("confidence"), flags.alias("flags"), reason.alias("reason"),
    )


def activation(method: Column, scene: Column, approved: Column, mode: str = "direct_only") -> Column:
    """Struct (status, active): whether an estimate may stand in for the older one. approved: its scene's proxies are, in its country."""
    if mode not in ("direct_only", "shadow", "all"):
        raise ValueError(f"no such mode: {mode}")
    status = F.when(method == "insufficient", "shadow_insufficient")
    if mode == "shadow":
        status = status.otherwise("shadow_forced")
    else:
        status = status.when(method.isin("direct_annual", "direct_daily"), "activated_direct")
        if mode == "all":
            status = status.otherwise("activated_override_all")
        else:
            status = status.when(F.coalesce(approved, F.lit(False)), "activated_approved_proxy").otherwise("shadow_unapproved_proxy")
    return F.struct(status.alias("status"), status.startswith("activated").alias("active"))


def approved_scenes(rows: DataFrame, country: str, scene: str, approvals: DataFrame) -> DataFrame:
    """rows with approved: whether approvals (country or *, scene) has them, whatever the letters' case."""
    own = approvals.select(F.lower(F.trim("country")).alias("_c"), F.trim("scene").alias("_s")).distinct()
    anywhere = own.where("_c = '*'").select("_s", F.lit(True).alias("_any"))
    there = own.select("_c", "_s", F.lit(True).alias("_there"))
    out = rows.withColumn("_c", F.lower(F.trim(country))).withColumn("_s", F.col(scene)).join(there, ["_c", "_s"], "left").join(anywhere, "_s", "left")
    return out.withColumn("approved", F.coalesce("_there", "_any", F.lit(False))).drop("_c", "_s", "_there", "_any")


def faults(ranges: Sequence[str], annual: str = "annual") -> Column:
    """What is wrong with ranges (columns of low, middle, high): not positive, out of order, or a year."""
    out = []
    for r in ranges:
        present = F.filter(r, lambda x: x.isNotNull())
        out.append(F.when(F.exists(present, lambda x: x <= 0), f"{r} not positive"))
        out.append(F.when((F.size(present) == 3) & ~((F.col(r)[0] <= F.col(r)[1]) & (F.col(r)[1] <= F.col(r)[2])), f"{r} out of order"))
    out.append(F.when(year_like(F.col(annual)[1]), f"{annual} looks like a year"))
    return F.array_compact(F.array(*out))


def demand(annual: Column, attach: float, capture: float, busy: float, gigabytes: float) -> Column:
    """Struct (daily, users, gb, mbps, reason) of a year's visits; null or not positive visits give a reason only."""
    ok = annual > 0
    users = annual / 365 * attach * capture * busy
    gb = users * gigabytes
    reason = F.when(annual.isNull(), "no visits").when(~ok, "not positive")
    return F.struct(
        F.when(ok, annual / 365).alias("daily"), F.when(ok, users).alias("users"), F.when(ok, gb).alias("gb"),
        F.when(ok, gb * 1024 * 8 / 3600).alias("mbps"), reason.alias("reason"),
    )


def calibration(samples: DataFrame, scene: str, least: int = 30, gain: float = 0.2) -> DataFrame:
    """Per scene of samples (actual, v1, v2): mean errors of both models, their relative gain, the median error, and the gate.

    Samples with a value that is not positive don't count.
    """
    ok = samples.where((F.col("actual") > 0) & (F.col("v1") > 0) & (F.col("v2") > 0))
    err = lambda v: F.abs(F.col(v) - F.col("actual")) / F.col("actual")
    rows = ok.select(scene, err("v1").alias("_e1"), err("v2").alias("_e2"))
    a = rows.groupBy(scene).agg(F.count("*").alias("n"), F.avg("_e1").alias("mape1"), F.avg("_e2").alias("mape2"))
    a = join_keys(a, percentiles(rows, [scene], "_e2", {"mdape": 0.5}), [scene])
    better = F.when(F.col("mape1") > 0, (F.col("mape1") - F.col("mape2")) / F.col("mape1"))
    status = F.when(F.col("n") < least, "uncalibrated_scene").when(better >= gain, "passed").otherwise("failed_improvement_gate")
    return a.withColumn("gain", better).withColumn("status", status)


def active_values(rows: DataFrame, active: Column, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    """rows where each column of old shows its new value while active holds; the old one stays beside it, so a rollback is a select."""
    out = rows
    for o, n in zip(old, new, strict=True):
        out = out.withColumn(f"{o}_kept", F.col(o)).withColumn(o, F.when(active, F.col(n)).otherwise(F.col(o)))
    return out


def rolled_back(rows: DataFrame, old: Sequence[str]) -> DataFrame:
    """The table as it was before active_values."""
    for o in old:
        rows = rows.withColumn(o, F.col(f"{o}_kept")).drop(f"{o}_kept")
    return rows


#: A year's visits for each unit of a metric, by scene; * is any metric. The first row that fits counts.
AREA = ("exhibition_area", "meeting_area", "meeting_ballroom_area", "gla", "retail_gfa", "office_nla", "office_gfa", "nla", "mosque_area", "gross_floor_area", "prayer_hall_area")
PEOPLE = ("seat_count", "peak_event_capacity", "plenary_capacity", "ballroom_capacity")
ROOM = ("keys", "rooms")
YEARLY: tuple[tuple[str, tuple[str, ...], float], ...] = (
    ("stadium", PEOPLE, 15), ("convention_center", AREA, 10), ("convention_center", PEOPLE, 10),
    ("luxury_hotel_mice", ROOM, 900), ("luxury_hotel_mice", AREA, 30), ("luxury_hotel_mice", PEOPLE, 120),
    ("mall_mixed_use", AREA, 20), ("office_government", AREA, 10), ("hospital", ("*",), 1000), ("university", ("*",), 180),
    ("transport_hub", ("*",), 365), ("cruise_port", ("*",), 1), ("mosque", AREA, 35),
)
DAILY_FIELDS = ("daily_ridership", "ridership", "daily_visitors")


def annual_proxy(scene: Column, metric: Column, value: Column, unit: Column) -> Column:
    """Struct (visits, factor): a year's visits of one metric, by the first rule that fits; null where none does."""
    factor = F.when(unit == "visits/day", 365.0).when(metric.isin(*ANNUAL_KEYS, *DAILY_KEYS) & (unit == "visits/year"), 1.0).when(metric.isin(*DAILY_FIELDS), 365.0)
    for name, keys, times in YEARLY:
        fits = metric != "line_count" if name == "transport_hub" else F.lit(True) if keys == ("*",) else metric.isin(*keys)
        factor = factor.when((scene == name) & fits, float(times))
    return F.when(value.isNotNull() & factor.isNotNull(), F.struct((value * factor).alias("visits"), factor.alias("factor")))


#: The most visits a year that a scene can have.
CAPS = {
    "airport_terminal": 300_000_000, "convention_center": 100_000_000, "stadium": 50_000_000, "luxury_hotel_mice": 250_000_000,
    "mall_mixed_use": 2_000_000_000, "office_government": 1_000_000_000, "hospital": 500_000_000, "university": 500_000_000,
    "transport_hub": 5_000_000_000, "cruise_port": 100_000_000, "mosque": 500_000_000,
}
OTHER_CAP = 1_000_000_000
#: The most that a scene's metric can be.
METRIC_CAPS = (
    ("stadium", ("seat_count",), 250_000), ("airport_terminal", ("annual_passenger_throughput",), 300_000_000),
    ("transport_hub", ("daily_ridership",), 20_000_000), ("transport_hub", ("line_count",), 20), ("luxury_hotel_mice", ("keys",), 5_000),
    ("hospital", ("beds",), 10_000), ("convention_center", ("exhibition_area", "meeting_area"), 1_000_000), ("mall_mixed_use", ("gla",), 1_500_000),
)
AREA_UNITS = ("sqm", "m2", "sq_m", "square_meters", "square_metres")
PEOPLE_UNITS = ("people", "persons", "persons_day", "visits_year", "daily_visits")


def implausible_visits(scene: Column, visits: Column) -> Column:
    """The cap that a year's visits exceed, or null."""
    caps = F.create_map(*[F.lit(x) for kv in CAPS.items() for x in kv])
    cap = F.coalesce(F.try_element_at(caps, scene), F.lit(OTHER_CAP))
    return F.when(visits > cap, cap)


def implausible_metric(scene: Column, metric: Column, unit: Column, value: Column) -> Column:
    """Why a metric cannot be, by the first rule that says so; metric and unit are key texts. Null without a value."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for name, keys, most in METRIC_CAPS:
        out = out.when((scene == name) & metric.isin(*keys) & (value > most), f"{name} {keys[0]} beyond {most}")
    office = (scene == "office_government") & metric.isin("nla", "office_gfa", "office_nla")
    some_unit = F.coalesce(unit, F.lit("")) != ""
    out = out.when(office & some_unit & ~unit.isin(*AREA_UNITS), "office area in another unit").when(office & (value > 5_000_000), "office area beyond 5000000")
    area = metric.isin("gla", "nla", "exhibition_area", "meeting_area", "mosque_area")
    return out.when(area & some_unit & unit.isin(*PEOPLE_UNITS), "area in a unit of people")


def benchmark(metrics: DataFrame, key: str, scenes: Mapping[str, Scene] = SCENES, bounds: Mapping[str, tuple[float, float]] = BOUNDS) -> DataFrame:
    """Samples (key, scene, actual, v1, v2) for calibration: places that have a direct yearly number and other metrics, too.

    actual is the direct number; v1 is what the older rule makes of the greatest other metric it knows; v2 is the model's
    middle estimate without any direct number.
    """
    direct = F.col("metric").isin(*ANNUAL_KEYS, *DAILY_KEYS)
    rest = metrics.where(~direct)
    known = estimate(metrics, key, scenes, bounds).where("method = 'direct_annual'").select(key, "scene", F.col("annual")[1].alias("actual"))
    old = rest.withColumn("_p", annual_proxy(F.col("scene"), F.col("metric"), F.col("value"), F.col("unit"))["visits"]).where("_p > 0")
    v1 = old.groupBy(key, "scene").agg(F.min_by("_p", F.struct(-F.col("value"), F.col("metric"), F.col("evidence"))).alias("v1"))
    v2 = estimate(rest, key, scenes, bounds).where("method <> 'insufficient'").select(key, "scene", F.col("annual")[1].alias("v2"))
    return known.join(v1, [key, "scene"]).join(v2, [key, "scene"])
