"""Recommendations with fixed and moving thresholds, and the gate."""

from loomstone.operators import recommend

SCHEMA = "place long, country string, scene string, city string, name string, metric string, metric_order int, tier int, dated long, value double"


def test_best_row_by_six_keys(spark):
    e = lambda place, order, tier, dated, value, city="c", name="n": (place, "A", "hall", city, name, f"m{order}", order, tier, dated, value)
    rows = [e(1, 1, 1, 9, 99.0), e(1, 0, 2, 1, 1.0), e(1, 0, 1, 1, 5.0), e(1, 0, 1, 2, 4.0), e(1, 0, 1, 2, 6.0), e(1, 0, 1, None, 100.0), e(2, 0, 1, 1, None), e(3, 2, 3, None, 1.0)]
    got = {r["place"]: r["value"] for r in recommend.best_evidence(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 6.0, 3: 1.0}


def test_thresholds(spark):
    row = lambda place, order, value, scene="hall", country="A", name=None: (place, country, scene, None, name or f"n{place}", f"m{order}", order, 1, 1, value)
    rows = [row(1, 0, 9.0), row(2, 0, 7.0), row(3, 0, 7.0), row(4, 0, 5.0), row(5, 1, 90.0), row(6, 1, 3.0, country=None), row(10, 0, 50.0, "fix"), row(11, 0, 49.0, "fix"), row(12, 1, 99.0, "fix")]
    gates = spark.createDataFrame([("fix", "m0", 50.0)], "scene string, metric string, least double")
    out = recommend.recommended(spark.createDataFrame(rows, SCHEMA), gates, 2)
    got = {r["place"]: (r["rank"], r["recommended"], r["threshold"]) for r in out.collect()}
    assert got == {1: (1, True, 7.0), 2: (2, True, 7.0), 3: (3, True, 7.0), 4: (4, False, 7.0), 5: (5, False, 7.0), 6: (1, True, 3.0), 10: (1, True, 50.0), 11: (2, False, 50.0)}
    assert recommend.recommended(spark.createDataFrame(rows, SCHEMA), None, 100).where("NOT recommended").count() == 0


def test_assignment_gate(spark):
    places = spark.createDataFrame([(1, "A", "h", "x", "Oz", "7"), (2, "A", "h", "x", "Oz", "7"), (3, "A", "h", "z", "Oz", None), (4, "A", "h", "w", "Oz", "7")], "place long, country string, scene string, identity string, city string, city_id string")
    assigned = spark.createDataFrame([(1, "verified", "Oz", "7"), (2, "review", "Oz", "7"), (4, "verified", "Other", "7")], "place long, status string, city string, city_id string")
    r = recommend.assignment_gate(places, assigned, 5).first()
    assert tuple(r) == (4, 1, 1, 1, 2, 1, False)
    assert tuple(recommend.assignment_gate(places.where("place = 1"), assigned, 1).first()) == (1, 0, 0, 0, 0, 0, True)
    assert tuple(recommend.assignment_gate(places.limit(0), assigned, 0).first())[-1]
