"""Preferred places of groups, and the cascade of steps."""

from pyspark.sql import functions as F

from loomstone.operators import gazetteer


def test_preferred_exact(spark):
    points = spark.createDataFrame([(1, "a", 0.0, 0.0), (1, "a", 0.0, 0.1), (2, "b", 0.0, 0.0), (3, "c", 0.0, 0.0), (4, "a", None, 0.0)], "group long, name string, lat double, lon double")
    places = spark.createDataFrame([("A1", "a", 0.0, 0.05), ("A2", "a", 0.0, 0.3), ("A1", "other", 0.0, 0.05), ("B1", "b", 0.0, 0.01), ("B2", "b", 0.0, -0.011), ("C1", "c", 9.0, 9.0)], "code string, name string, lat double, lon double")
    assert [(r["group"], r["code"]) for r in gazetteer.preferred_exact(points, places, 50.0).collect()] == [(1, "A1")]
    assert gazetteer.preferred_exact(points.limit(0), places, 50.0).count() == 0


def test_preferred_variant(spark):
    points = spark.createDataFrame([(1, "marytown", 0.0, 0.0), (1, "marytown", 0.0, 0.01), (1, "marytown", 5.0, 5.0), (2, "twinham", 10.0, 10.0), (3, "known", 0.0, 0.0), (4, "unlike", 20.0, 20.0)], "group long, name string, lat double, lon double")
    places = spark.createDataFrame([("M1", "mary town", 0.0, 0.02), ("M2", "merrytown", 0.0, 0.2), ("T1", "twinhams", 10.0, 10.01), ("T2", "twinhamx", 10.0, 10.02), ("K", "known", 0.0, 0.0), ("U", "zzzz", 20.0, 20.0)], "code string, name string, lat double, lon double")
    got = {r["group"]: (r["code"], r["status"]) for r in gazetteer.preferred_variant(points, places, 30.0).collect()}
    assert got == {1: ("M1", "verified"), 2: ("T1", "review_required")}


def test_registry_steps(spark):
    ids = spark.createDataFrame([(k,) for k in range(7)], "id long")
    at = "id long, code string, lat double, lon double"
    first = spark.createDataFrame([(0, "a", 0.0, 0.0), (1, "a", 0.0, 0.0), (2, "a", 0.0, 0.0)], at)
    second = spark.createDataFrame([(0, "b", 0.0, 0.1), (1, "b", 9.0, 9.0), (3, "b", 0.0, 0.0)], at)
    hints = spark.createDataFrame([(3, "c"), (4, "c")], "id long, code string")
    near = spark.createDataFrame([(4, "d"), (5, "d"), (1, "d")], "id long, code string")
    out, audit = gazetteer.registry(ids, first, second, hints, near)
    assert sorted(tuple(r) for r in out.select("id", F.coalesce("code", F.lit("-")), "step", F.coalesce("checked", F.lit("-"))).collect()) == [
        (0, "a", "first", "agreed"), (1, "-", "first", "disputed"), (2, "a", "first", "alone"), (3, "b", "second", "-"), (4, "c", "hint", "-"), (5, "d", "nearest", "-"), (6, "-", "none", "-"),
    ]
    assert sum(r["n"] for r in audit.collect()) == 7
