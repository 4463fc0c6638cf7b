"""Quality of candidates: what is wrong with each, which gates it passes, where it may be shown."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions import names, quantities, text
from loomstone.operators.latest import first_per_key

SURFACES = {"raw_pool": "raw_pool", "main_table": "main_table_ready", "map": "map_ready", "export": "export_ready", "review": "review_required"}


@dataclass(frozen=True)
class Rules:
    """Words that candidates are judged by, all in the normal form of names.quality. The first four are fixed values."""

    placeholders: Sequence[str] = ("mvp candidate", "mvp fake", "fixture", "fake centroid", "registry seed", "example city", "exampleland")
    defaults: Sequence[str] = ("mvp fake", "fixture", "placeholder", "fake centroid", "fallback", "default", "deterministic proxy", "registry seed", "source_registry", "unknown")
    not_objective: Sequence[str] = (
        "proxy", "estimate", "estimated", "assumption", "assumed", "verify official", "verify before direct", "not direct fact",
        "conservative baseline", "conservative estimate",
    )
    levels: Sequence[str] = (
        "province", "state", "region", "raion", "district", "governorate", "county", "municipality", "municipal", "commune", "prefecture", "department",
        "borough", "zone", "oblast", "vilayet", "wilaya", "metropolitan area", "local municipality", "partido", "atoll",
    )
    topics: Sequence[str] = ("health care", "healthcare", "airline", "airlines")
    places: Sequence[str] = ()
    restricted: Mapping[str, Sequence[str]] = field(default_factory=dict)
    regions: Mapping[str, Sequence[str]] = field(default_factory=dict)
    precise_not: Sequence[str] = ("city", "country", "region", "centroid")
    precise: Mapping[str, Sequence[str]] = field(default_factory=dict)
    scene_words: Mapping[str, Sequence[str]] = field(default_factory=dict)
    indicators: Mapping[str, Sequence[str]] = field(default_factory=dict)


def _contains_any(c: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def _token_any(c: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.has_token(c, w)
    return out


def _by_scene(scene: Column, words: Mapping[str, Sequence[str]], test, otherwise: bool) -> Column:
    out = F.lit(otherwise)
    for s, ws in words.items():
        out = F.when(scene == s, test(ws)).otherwise(out)
    return out


def issues(rows: DataFrame, rules: Rules) -> DataFrame:
    """rows with issues, an array of what is wrong, each once and in a fixed order; empty if nothing is.

    rows: country, city, name, scene, precision, urls and sources (arrays), evidence (an array of structs field, indicator,
    kind, value, note), note (of the model), assignment (of the city, or null). Missing evidence is an empty array.
    """
    full = lambda c: names.quality_text(F.coalesce(F.col(c), F.lit("")))
    r = rows
    for c in ("country", "city", "name", "precision", "note"):
        r = r.withColumn(f"_{c}", full(c))
    empty = F.array().cast("array<string>")
    r = r.withColumn("_slugs", names.quality_list(F.array_compact(F.transform(F.coalesce("urls", empty), text.wiki_slug))))
    r = r.withColumn("_sources", names.quality_list(F.coalesce("sources", empty)))
    r = r.withColumn("_e", F.coalesce("evidence", F.array().cast(rows.schema["evidence"].dataType)))
    name, city, country, precision, scene = (F.col(c) for c in ("_name", "_city", "_country", "_precision", "scene"))
    scene_word = _by_scene(scene, rules.scene_words, lambda ws: _contains_any(name, ws), False)
    place_name = name.isin(*rules.places) if rules.places else F.lit(False)
    pages = [*rules.places, *rules.topics]
    page = lambda s: s.isin(*pages) if pages else F.lit(False)
    wrong_country = F.lit(False)
    for restricted, allowed in rules.restricted.items():
        wrong_country = wrong_country | ((city == restricted) & ~country.isin(*allowed))
    region = F.lit(False)
    for c, values in rules.regions.items():
        region = region | (city.isin(*values) & (F.lit(True) if c == "*" else country == c))
    # only evidence of a field or indicator that the scene accepts is looked at
    accepted = F.lit(None).cast("array<string>")
    for s, ws in rules.indicators.items():
        accepted = F.when(scene == s, F.array(*map(F.lit, ws))).otherwise(accepted)
    key = lambda x: F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^a-z0-9\s.-]+", " "))
    r = r.withColumn("_accepted", accepted)
    own = F.filter("_e", lambda e: F.array_contains("_accepted", key(e["field"])) | F.array_contains("_accepted", key(e["indicator"])))
    judged = F.transform(own, lambda e: F.when(key(e["kind"]) == "proxy", "defaulted").when(_contains_any(F.lower(F.concat_ws(" ", e["value"], e["note"])), rules.not_objective), "defaulted").otherwise(
        F.coalesce(quantities.period_issue(F.coalesce(F.when(F.trim(e["field"]) != "", e["field"]), e["indicator"]), e["value"], e["note"]), F.lit("fine"))))
    r = r.withColumn("_judged", judged)
    period = F.element_at(F.filter("_judged", lambda j: ~j.isin("fine", "defaulted")), -1)
    objective = (
        F.when(F.col("_accepted").isNull() | F.array_contains("_judged", "fine"), F.lit(None).cast("string"))
        .when(F.size("_judged") == 0, "objective metric missing")
        .otherwise(F.coalesce(F.when(F.exists("_judged", lambda j: ~j.isin("fine", "defaulted")), period), F.lit("objective metric missing or defaulted")))
    )
    checks = [
        F.when(name == "", "name missing"),
        F.when(_contains_any(name, rules.placeholders), "name is a placeholder"),
        F.when((name != "") & ((name == city) | (name == country)), "name is only a city or country"),
        F.when(name.isin(*rules.topics), "name is a topic"),
        F.when(place_name & ~scene_word, "name is a place's"),
        F.when(city == "", "city missing"),
        F.when((city != "") & (city == country), "city is the country"),
        F.when(city.isin(*rules.defaults), "city is a default"),
        F.when(city.rlike("^q[0-9]+$"), "city is an entity's id").when(region, "city is a region").when(_token_any(city, rules.levels), "city is an administrative level"),
        F.when((precision != "") & _contains_any(precision, rules.defaults), "precision is a default"),
        F.when(wrong_country, "city is in another country"),
        F.when(F.exists("_slugs", lambda s: page(s) & (s == name)) & ~scene_word, "source is a page about a place or topic"),
        F.when(F.exists("_slugs", lambda s: page(s) & (s != name)), "source does not identify the candidate"),
        F.when(F.exists("_sources", lambda s: s.isin("nominatim", "openstreetmap nominatim")), "a geocoder is no evidence"),
        F.when(precision == "", "precision missing").when(_contains_any(precision, rules.placeholders), "precision is a placeholder")
        .when(_token_any(precision, rules.precise_not), "precision is too coarse").when(~_by_scene(scene, rules.precise, lambda ws: _contains_any(precision, ws), True), "precision is of another kind of place"),
        F.when(F.col("assignment").isNotNull() & (F.col("assignment") != "verified"), "city is not verified"),
        objective,
        F.when(_contains_any(F.col("_note"), rules.defaults), "model is a default"),
    ]
    helpers = ["_country", "_city", "_name", "_precision", "_note", "_slugs", "_sources", "_e", "_accepted", "_judged"]
    return r.withColumn("issues", F.array_distinct(F.array_compact(F.array(*checks)))).drop(*helpers)


def visibility(issue_list: Column, lead: Column) -> Column:
    """Struct (status, raw_pool, review_required, main_table_ready, map_ready, export_ready) of a candidate's issues.

    A lead that somebody named is shown although its objective metric is missing, if that is all that is wrong.
    """
    only_metric = F.forall(issue_list, lambda i: i.startswith("objective metric missing"))
    some = F.size(issue_list) > 0
    lenient = some & only_metric & F.coalesce(lead, F.lit(False))
    status = F.when(~some, "ready").when(lenient, "review_required").otherwise("blocked_quality")
    shown = ~some | lenient
    return F.struct(
        status.alias("status"), F.lit(True).alias("raw_pool"), some.alias("review_required"), shown.alias("main_table_ready"),
        shown.alias("map_ready"), shown.alias("export_ready"),
    )


def on_surface(rows: DataFrame, surface: str, blocked_too: bool = False) -> DataFrame:
    """Rows that may be shown on a surface; an unknown surface is an error."""
    if surface not in SURFACES:
        raise ValueError(f"no such surface: {surface}")
    return rows if blocked_too else rows.where(F.coalesce(F.col(SURFACES[surface]), F.lit(False)))


def gates(entity: Sequence[str], build: Sequence[str], tier12: Column, tier3: Column, evidence: Column, blocked: Column) -> Column:
    """Array of structs (gate, passed, issues): entity and build fields present, enough sources, quality not blocked."""
    missing = lambda cs: F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(f"{c} missing")) for c in cs]))
    sources = F.array_compact(F.array(F.when((tier12 < 1) & (tier3 < 2), "too few sources"), F.when(evidence < 1, "no evidence")))
    quality = F.array_compact(F.array(F.when(blocked, "quality blocked")))
    one = lambda name, found: F.struct(F.lit(name).alias("gate"), (F.size(found) == 0).alias("passed"), found.alias("issues"))
    return F.array(one("entity", missing(entity)), one("evidence", sources), one("build_status", missing(build)), one("quality", quality))


def routed(rows: DataFrame, key: str, order: Sequence[Column], known: DataFrame, valid: Column, probable: Column) -> DataFrame:
    """rows with route: duplicate (its key is known or came before in the batch), possible_duplicate, draft or accepted.

    Only an accepted row makes its key known to later ones.
    """
    marks = known.select(key).distinct().withColumn("_known", F.lit(True))
    r = rows.join(marks, key, "left").withColumn("_ok", F.coalesce(valid, F.lit(False)) & ~F.coalesce(probable, F.lit(False)) & F.col("_known").isNull())
    place = F.struct(*order)
    first = r.where("_ok").groupBy(key).agg(F.min(place).alias("_first"))
    r = r.join(first, key, "left")
    after = F.col("_first").isNotNull() & (place > F.col("_first"))
    route = (
        F.when(F.col("_known").isNotNull() | after, "duplicate").when(F.coalesce(probable, F.lit(False)), "possible_duplicate")
        .when(~F.coalesce(valid, F.lit(False)), "draft").otherwise("accepted")
    )
    return r.withColumn("route", route).drop("_known", "_ok", "_first")


def counters(rows: DataFrame, key: str, checks: Mapping[str, Column], samples: int = 5) -> DataFrame:
    """check, n, samples (the smallest keys) and passed of each check (true means wrong), checks without a hit included.

    The counts are one aggregation; samples keep a few rows of a check before they are shuffled.
    """
    spark = rows.sparkSession
    hits = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))
    bad = rows.select(F.col(key).alias("key"), F.explode(hits).alias("check"))
    counts = bad.groupBy("check").agg(F.count("*").alias("n"))
    few = first_per_key(bad, ["check"], [F.col("key")], samples).groupBy("check").agg(F.array_sort(F.collect_list("key")).alias("samples"))
    every = spark.createDataFrame([(name,) for name in checks], "check string")
    out = every.join(counts, "check", "left").join(few, "check", "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("check", n.alias("n"), "samples", (n == 0).alias("passed"))


def usable_result(title: Column, url: Column, snippet: Column, blocked_hosts: Sequence[str] = ("facebook.com", "instagram.com", "pinterest.com")) -> Column:
    """Whether a search result can be read: a web address of a host that is not blocked, and some text."""
    host = text.domain(url)
    bad = F.lit(False)
    for h in blocked_hosts:
        bad = bad | (host == h) | host.endswith("." + h)
    some = (F.length(F.trim(F.coalesce(title, F.lit("")))) > 0) | (F.length(F.trim(F.coalesce(snippet, F.lit("")))) > 0)
    return F.coalesce(url.rlike("^https?://[^/]+") & ~bad & some, F.lit(False))
