"""Cells, regions, neighbours and collapse against plain loops."""

import math
import random

from pyspark.sql import functions as F

from loomstone.functions import geo, grid
from loomstone.operators import spatial


def metres(a, b, c, d, radius=6_371_008.8):
    p, q = math.radians(a), math.radians(c)
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * radius * math.asin(math.sqrt(min(1, x)))


def greedy(places, reach=5000):
    kept, out = [], {}
    for code, name, lat, lon in sorted(places):
        near = [k for k in kept if k[1] == name and None not in (lat, lon, k[2]) and metres(lat, lon, k[2], k[3], 6_371_000) <= reach]
        out[code] = near[0][0] if near else code
        if not near:
            kept.append((code, name, lat, lon))
    return out


def test_collapse_equals_a_loop(spark):
    rng = random.Random(1)
    rows = [(f"C{k:03}", "chain", 10 + 0.03 * k, 20.0) for k in range(15)]
    rows += [(f"D{rng.randrange(10**6):06}", rng.choice(["a", "b", None]), 50 + rng.random() * 0.3, rng.random() * 0.3) for _ in range(200)]
    rows += [(f"E{k:03}", "edge", 60.0, (179.97 + 0.02 * k + 180) % 360 - 180) for k in range(6)]
    rows += [(f"P{k}", "pole", 89.99, 60.0 * k) for k in range(6)] + [("N1", "none", None, 1.0), ("N2", "none", 1.0, None)]
    rows += [("S1", "same", 5.0, 5.0), ("S2", "same", 5.0, 5.0), ("S3", "other", 5.0, 5.0)]
    rows = list({r[0]: r for r in rows}.values())
    df = spark.createDataFrame(rows, "code string, name string, lat double, lon double")
    assert {r["code"]: r["keeper"] for r in spatial.collapse(df).collect()} == greedy(rows)
    assert spatial.collapse(df.limit(0)).count() == 0


def test_ten_thousand_of_one_name(spark):
    df = spark.range(10_000).select(F.format_string("K%05d", F.col("id")).alias("code"), F.lit("n").alias("name"), (F.lit(1.0) + F.col("id") * 1e-7).alias("lat"), F.lit(2.0).alias("lon"))
    assert spatial.collapse(df, most_rounds=3).groupBy("keeper").count().collect() == [("K00000", 10_000)]
    places = spark.createDataFrame([("a", ["x", "y"]), ("b", ["y", "z"]), ("c", None)], "code string, aliases array<string>")
    keep = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "code string, keeper string")
    assert sorted(tuple(r) for r in spatial.merged(places, keep).collect()) == [("a", ["x", "y", "z"], ["a", "b"]), ("c", [], [])]


RINGS = {
    "L": [[(0, 0), (0, 10), (4, 10), (4, 4), (10, 4), (10, 0)]],
    "hole": [[(20, 20), (20, 40), (40, 40), (40, 20)], [(25, 25), (25, 35), (35, 35), (35, 25)]],
    "dateline": [[(-5, 170), (-5, 190), (5, 190), (5, 170)]],
    "west": [[(-5, -190), (-5, -175), (-1, -175), (-1, -190)]],
    "small": [[(1, 1), (1.001, 1.002), (1.002, 1)]],
    "neighbour": [[(0, 10), (0, 12), (4, 12), (4, 10)]],
    "world": [[(-90, -180), (-90, 180), (90, 180), (90, -180)]],
    "line": [[(1, 1), (2, 2)]],
}


def plainly(lat, lon, rings):
    inside = 0
    for r in rings:
        if len(r) < 3:
            continue
        for (la, lo), (lb, lob) in zip(r, [*r[1:], r[0]]):
            if la != lb and (la > lat) != (lb > lat) and lon < (lat - la) * ((lob - lo) / (lb - la)) + lo:
                inside += 1
    return inside % 2 == 1


def test_points_in_polygons(spark):
    rng = random.Random(2)
    points = [(rng.uniform(-12, 45), rng.uniform(-12, 45)) for _ in range(400)] + [(rng.uniform(-6, 6), rng.choice([1, -1]) * rng.uniform(165, 180)) for _ in range(150)]
    points += [(la, lo) for la in (0, 4, 10, 20, 25, 35, 40, -5, 5) for lo in (0, 4, 10, 12, 20, 25, 35, 40, 170, -170, 180, -180)] + [(1 + rng.random() * 0.003, 1 + rng.random() * 0.003) for _ in range(100)]
    rows = [(k, float(a), float(b)) for k, (a, b) in enumerate(points)] + [(9000, None, 1.0), (9001, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double")
    regions = spark.createDataFrame([(k, [[(float(a), float(b)) for a, b in ring] for ring in r]) for k, r in RINGS.items()] + [("none", None)], "region string, rings array<array<struct<lat:double,lon:double>>>")
    got = sorted((r["id"], r["region"]) for r in spatial.within_regions(df, spatial.cover(regions)).collect())
    turn = lambda lon: (lon + 180) % 360 - 180
    want = sorted((i, k) for i, a, b in rows[:-2] for k, r in RINGS.items() if any(plainly(a, turn(b) + t, r) for t in (0, 360, -360)))
    assert got == want and len({k for _, k in got}) == 7


def test_points_in_boxes(spark):
    boxes = [("a", "x", 0.0, 0.0, 10.0, 10.0), ("b", "x", 10.0, 10.0, 20.0, 20.0), ("c", "y", 0.0, 0.0, 10.0, 10.0), ("d", "x", -5.0, 170.0, 5.0, -170.0), ("e", "x", None, 0.0, 1.0, 1.0), ("f", "x", 3.0, 3.0, 3.0, 3.0)]
    points = [(k, "x", la, lo) for k, (la, lo) in enumerate([(0.0, 0.0), (10.0, 10.0), (10.000001, 10.0), (3.0, 3.0), (0.0, 180.0), (0.0, -180.0), (0.0, -170.0), (0.0, -169.9), (-5.0, 170.0), (90.0, 180.0)])] + [(99, "x", None, 1.0)]
    b = spark.createDataFrame(boxes, "region string, country string, south double, west double, north double, east double")
    p = spark.createDataFrame(points, "id long, country string, lat double, lon double")
    got = sorted((r["id"], r["region"]) for r in spatial.within_boxes(p, b, ["country"]).collect())
    assert got == [(0, "a"), (1, "a"), (1, "b"), (2, "b"), (3, "a"), (3, "f"), (4, "d"), (5, "d"), (6, "d"), (8, "d")]


def test_nearest_of_far_and_dense_points(spark):
    rng = random.Random(3)
    points = [(k, 48 + rng.gauss(0, 0.01), 2 + rng.gauss(0, 0.01)) for k in range(600)] + [(1000 + k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(60)] + [(2000, 48.0, 2.0), (2001, 48.0, 2.0), (2002, None, 1.0)]
    places = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(60)] + [(100 + k, 48 + rng.gauss(0, 0.02), 2 + rng.gauss(0, 0.02)) for k in range(40)] + [(200, 90.0, 0.0), (201, -90.0, 0.0), (202, 0.0, 180.0), (203, 0.0, None), (204, 48.0, 2.0)]
    p = spark.createDataFrame(points, "point long, lat double, lon double")
    q = spark.createDataFrame(places, "id long, lat double, lon double")
    got = {}
    for r in spatial.nearest(q, p, 3).orderBy("id", "position").collect():
        got.setdefault(r["id"], []).append(r["point"])
    for i, la, lo in places:
        want = sorted((round(metres(la, lo, a, b), 6), k) for k, a, b in points if a is not None)[:3] if lo is not None else []
        assert got.get(i, []) == [k for _, k in want], i
    few = spatial.nearest(q, p.where("point >= 2000"), 3)
    assert few.where("id = 204").count() == 2  # fewer than asked: all of them
    assert few.where("id = 0").count() == 2


def test_nearest_city_has_seats_first(spark):
    cities = spark.createDataFrame([("seat", 0.0, 0.3, True), ("town", 0.0, 0.1, False), ("far", 0.0, 5.0, True), ("twin1", 10.0, 10.0, False), ("twin2", 10.0, 10.02, False)], "city string, lat double, lon double, admin boolean")
    places = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 4.4), (3, 10.0, 10.01), (4, 40.0, 40.0), (5, None, 1.0), (6, 10.0, 10.0)], "id long, lat double, lon double")
    got = {r["id"]: (r["city"], r["status"]) for r in spatial.nearest_city(places, cities, F.lit(20.0), F.lit(50.0)).collect()}
    assert got == {1: ("seat", "verified"), 2: (None, "unmapped"), 3: (None, "review_required"), 4: (None, "unmapped"), 5: (None, "unmapped"), 6: (None, "review_required")}


def test_cells_cover_circles(spark):
    rng = random.Random(4)
    rows = [(rng.uniform(-90, 90), rng.uniform(-180, 180), 10 ** rng.uniform(2, 6), rng.uniform(0, 360), rng.random()) for _ in range(500)]
    out = []
    for la, lo, r, turn, part in rows:
        d, t = r * part / 6_371_008.8, math.radians(turn)
        p = math.radians(la)
        q = math.asin(math.sin(p) * math.cos(d) + math.cos(p) * math.sin(d) * math.cos(t))
        m = math.radians(lo) + math.atan2(math.sin(t) * math.sin(d) * math.cos(p), math.cos(d) - math.sin(p) * math.sin(q))
        out.append((la, lo, r, math.degrees(q), (math.degrees(m) + 180) % 360 - 180))
    df = spark.createDataFrame(out, "a double, b double, r double, c double, d double")
    for level in (0, 3, 6):
        held = F.array_contains(grid.around(F.col("a"), F.col("b"), F.col("r"), level), grid.cell(F.col("c"), F.col("d"), level))
        assert df.where(~held).count() == 0
    assert grid.level_of(5000) == 11 and geo.EARTH_M * math.pi / 2 ** grid.inner_level(5000) * math.sqrt(5) <= 5000
