"""Scrubbed payloads, states of a discovery, spellings of romanized words."""

import datetime as dt

from pyspark.sql import functions as F

from loomstone.functions import text
from loomstone.operators import derive, matching, visits


def test_a_year_is_blanked_with_the_demand_that_follows_from_it(spark):
    data = [
        ("year", "2024", "2024", 5.5, 7.0, "x", None),
        ("raw is no year", "1900", "190000", 5.5, 7.0, "x", None),
        ("half", "2024.5", "2024", 5.5, 7.0, "x", "old"),
        ("border", "2101", "2101", 5.5, None, "x", "old"),
        ("no number", "many", "2024", 5.5, 7.0, "x", None),
        ("null", None, None, None, None, None, None),
    ]
    columns = "k string, annual_visits_est string, annual_visits_raw string, daily_visits double, busy_hour_users double, name string, cannot_calculate_reason string"
    df = spark.createDataFrame(data + data[:1], columns)
    got = visits.scrubbed(df)
    assert got.columns == df.columns and got.count() == 7
    by = {r["k"]: tuple(r)[1:] for r in got.collect()}
    assert by == {
        "year": (None, None, None, None, "x", visits.BLOCKED),
        "raw is no year": (None, "190000", None, None, "x", visits.BLOCKED),
        "half": (2024.5, "2024", 5.5, 7.0, "x", "old"),
        "border": (2101.0, "2101", 5.5, None, "x", "old"),
        "no number": (None, "2024", 5.5, 7.0, "x", None),
        "null": (None, None, None, None, None, None),
    }
    feature = spark.createDataFrame([(2000.0, 3.0, 4.0)], "annual_visits_est double, busy_hour_traffic_gb double, daily_visits double")
    assert tuple(visits.scrubbed(feature, demand=("busy_hour_traffic_gb",)).first()) == (None, None, 4.0)
    assert visits.scrubbed(df.limit(0)).count() == 0


def test_states_of_a_discovery(spark):
    day = dt.datetime(2026, 1, 1)
    tasks = spark.createDataFrame([("done",), ("done",), (None,), ("pending",)], "status string")
    evidence = spark.createDataFrame([("new", True), ("new", None), ("new", False), ("used", True), (None, True)], "status string, curation_needed boolean")
    runs = spark.createDataFrame([("a", day), ("c", None), ("b", day), ("d", day - dt.timedelta(days=1))], "run string, started_at timestamp_ntz")
    got = {(r["section"], r["name"]): (r["n"], r["at"]) for r in derive.discovery_status(tasks, tasks.limit(0), evidence, runs).collect()}
    assert got == {
        ("task_backlog", "done"): (2, None), ("task_backlog", None): (1, None), ("task_backlog", "pending"): (1, None),
        ("raw_evidence_status", "new"): (3, None), ("raw_evidence_status", "used"): (1, None), ("raw_evidence_status", None): (1, None),
        ("pending_evidence", "new"): (1, None), ("latest_run", "b"): (None, day),
    }
    none = derive.discovery_status(tasks.limit(0), tasks.limit(0), evidence.limit(0), runs.limit(0)).collect()
    assert [(r["section"], r["n"]) for r in none] == [("pending_evidence", 0)]


def test_spellings_of_romanized_words(spark):
    words = ["tsentralnyy", "dinamo", "yashina", "arena", "moskva", "a", "y", "ts", "stadion", "", None]
    got = {r["w"]: r["s"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", text.spellings(F.col("w")).alias("s")).collect()}
    assert got["tsentralnyy"] == ["tsentralnyy", "central", "tsentralnyiy", "tsentralnyi", "centralnyy"]
    assert got["dinamo"] == ["dinamo", "dynamo"] and got["yashina"] == ["yashina", "yashin"]
    assert got["arena"] == ["arena"] and got["moskva"] == ["moskva", "moskv"] and got["stadion"] == ["stadion"]
    assert got["a"] == ["a"] and got["y"] == ["y", "iy", "i"] and got["ts"] == ["ts", "c"]
    assert got[""] == [] and (got[None] or []) == []


def test_words_spelled_alike_are_found_by_equality(spark):
    words = spark.createDataFrame([(w,) for w in ["dinamo", "dynamo", "dinamo", "ledovyy", "ledovyi", "arena", "tsirk", "cirk", None, ""]], "word string")
    got = sorted(tuple(r) for r in matching.spelled_alike(words).collect())
    assert got == [("dinamo", "dynamo"), ("ledovyy", "ledovyi"), ("tsirk", "cirk")]
    assert matching.spelled_alike(words.limit(0)).count() == 0


def test_words_of_names_and_connectors_are_not_translated(spark):
    cases = {
        "Bank of Oran reports visitors 客流": ["reports", "visitors"],
        "the grand Arena hall 体育场 opened": ["opened"],
        "the grand Arena hall, 体育场": ["the", "grand", "hall"],
        "arena serves Oran 市": ["arena", "serves"],
        "seat_count gla sqm UK iPhone ok": [],
        "new-town Abc-def New new NEW": ["new-town", "abc-def", "new"],
        "abc的 def-的 ghi": ["ghi"],
        "Bank, of Oran of oran": ["oran"],
        "Port of the Sea": ["the"],
        "Été de Nîmes église église": ["église"],
        "a-" * 60 + "b and then": ["and", "then"],
        "long " * 30_000 + "Hall 馆": [],
        "long " * 30_000 + "Hall, 馆": ["long"],
        "": [],
        None: [],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["w"] for r in df.select("t", text.translatable(F.col("t")).alias("w")).collect()}
    assert got == cases
