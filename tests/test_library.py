"""Operators on ties, nulls and groups of one; all queries against their SQL."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from loomstone.functions import geo, names, text
from loomstone.operators import changes, latest, matching
from loomstone.plans import catalog
from loomstone.sources import readers, sinks
from loomstone.streaming import ingest

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or v != v:
        return ""
    return f"{v:.5g}" if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    ours = catalog.QUERIES[name](spark, FOLDER)
    theirs = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(columns) == sorted(ours.columns)
    a = sorted(tuple(cell(r[c]) for c in sorted(columns)) for r in ours.collect())
    b = sorted(tuple(cell(v) for _, v in sorted(zip(columns, r, strict=True))) for r in theirs.fetchall())
    assert a == b


def test_rank_percentile(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 3), ("b", 9)], "k string, v int")
    got = sorted((r["k"], r["v"], round(r["p"], 4)) for r in df.withColumn("p", latest.rank_percentile("v", ["k"])).collect())
    assert got == [("a", 1, 0.0), ("a", 2, 0.6667), ("a", 2, 0.6667), ("a", 3, 1.0), ("b", 9, 0.5)]


def test_upsert_status(spark):
    target = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "c", "y")], "k int, v string, w string")
    source = spark.createDataFrame([(2, "b", None), (3, "d", "z"), (4, None, None)], "k int, v string, w string")
    got = {r["k"]: (r["v"], r["w"], r["status"]) for r in changes.upsert(target, source, ["k"], ["v", "w"], keep_if_null=["w"]).collect()}
    assert got == {1: ("a", None, "kept"), 2: ("b", "x", "unchanged"), 3: ("d", "z", "updated"), 4: (None, None, "inserted")}


def test_radius_join_wraps(spark):
    a = spark.createDataFrame([(1, 10.0, 179.99), (2, 89.5, 0.0)], "k int, l_lat double, l_lon double")
    b = spark.createDataFrame([(1, 10.0, -179.99), (2, 89.5, 90.0), (3, 10.5, 179.99)], "s int, r_lat double, r_lon double")
    got = {(r["k"], r["s"]) for r in geo.radius_join(a, b, 100_000).collect()}
    near = a.crossJoin(b).where(geo.haversine(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon")) <= 100_000)
    assert got == {(r["k"], r["s"]) for r in near.collect()} and (1, 1) in got


def test_quadkey_round_trip(spark):
    df = spark.createDataFrame([(51.5, -0.12), (-90.0, -180.0), (90.0, 180.0)], "lat double, lon double")
    df = df.select(geo.tile_x(F.col("lon"), 16).alias("x"), geo.tile_y(F.col("lat"), 16).alias("y")).withColumn("q", geo.quadkey(F.col("x"), F.col("y"), 16))
    for r in df.select("x", "y", geo.quadkey_xy(F.col("q"), 1).alias("a"), geo.quadkey_xy(F.col("q"), 2).alias("b")).collect():
        assert (r["x"], r["y"]) == (r["a"], r["b"])


def test_text(spark):
    df = spark.createDataFrame([("mail a.b@c.org or @me, +44 20 7946 0958 \n ok", "1.234.567"), (None, "12,345.5"), ("", "1.5"), ("x" * 1201, "n/a")], "t string, n string")
    rows = df.select(text.redact(F.col("t")).alias("r"), text.number(F.col("n")).alias("n"), F.size(text.chunks(F.col("t"), 1200)).alias("c")).collect()
    assert rows[0]["r"] == "mail [email] or [handle], [phone] ok"
    assert [r["n"] for r in rows] == [1234567.0, 12345.5, 1.5, None]
    assert [r["c"] for r in rows][2:] == [0, 2]


def test_readers(spark, tmp_path):
    spark.createDataFrame([("0", 1000, 500, 10, 3, 2)], "quadkey string, avg_d_kbps long, avg_u_kbps long, avg_lat_ms long, tests int, devices int").write.parquet(str(tmp_path / "t"))
    r = readers.tiles(spark, str(tmp_path / "t")).first()
    assert (r["avg_download_mbps"], r["avg_loaded_latency_down_ms"]) == (1.0, None)
    (tmp_path / "j.json").write_text('{"a": 1}\nnot json\n')
    good, bad = readers.json_rows(spark, str(tmp_path / "j.json"), "a int")
    assert [r["a"] for r in good.cache().collect()] == [1] and len(bad.cache().collect()) == 1


def test_ingest_is_idempotent(spark, tmp_path):
    src, table = tmp_path / "in", str(tmp_path / "table")
    src.mkdir()

    def send(name, rows):
        (src / name).write_text("\n".join(json.dumps({"k": k, "v": v}) for k, v in rows))
        stream = spark.readStream.schema("k long, v string").json(str(src))
        ingest.ingest(stream, table, ["k"], ["v"], str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["k"], r["v"]) for r in spark.read.parquet(table).collect())

    assert send("1.json", [(1, "a"), (1, "a"), (2, "b")]) == [(1, "a"), (2, "b")]
    assert send("2.json", [(1, "a"), (2, "c")]) == [(1, "a"), (2, "b"), (2, "c")]


def test_names(spark):
    df = spark.createDataFrame([("São  Tomé & Straße", "Sao Tome"), (None, "x"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(names.plain_text("a")).collect()] == ["sao tome strasse", None, ""]
    pairs = spark.createDataFrame([("abcd", "bcde"), (None, "x"), ("", "")], "a string, b string")
    assert [r[0] for r in pairs.select(names.sequence_ratio("a", "b")).collect()] == [0.75, None, 1.0]
    assert [r[0] for r in pairs.select(names.edit_ratio(F.col("a"), F.col("b"))).collect()] == [0.5, None, 1.0]


def test_hash_vector(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), ([],), (None,)], "w array<string>")
    a, b, c = (r[0] for r in df.select(names.hash_vector(F.col("w"), 8)).collect())
    assert abs(sum(x * x for x in a) - 1) < 1e-9 and b == [0.0] * 8 and c == [0.0] * 8


def test_resolve_needs_one_match(spark):
    known = spark.createDataFrame([(1, "x", "north hall"), (2, "x", "north hall"), (3, "x", "south hall"), (4, "y", None)], "k int, c string, n string")
    incoming = spark.createDataFrame([(10, "x", "north hall"), (11, "x", "south halls"), (12, "x", "south hall"), (13, "y", "south hall"), (14, None, None)], "k int, c string, n string")
    got = {r["k"]: (r["match"], r["rule"]) for r in matching.resolve(incoming, known, "k", [["c", "n"]], ["c"], "n", names.edit_ratio, 0.8).collect()}
    assert got == {10: (1, 1), 11: (3, 1), 12: (3, 0), 13: (None, -1), 14: (None, -1)}


def test_circle_and_ring(spark):
    df = spark.createDataFrame([(0.0, 0.0), (50.0, 8.0), (None, 1.0)], "la double, lo double")
    square = [(-1.0, -1.0), (-1.0, 1.0), (1.0, 1.0), (1.0, -1.0)]
    rows = df.select(geo.in_ring(F.col("la"), F.col("lo"), square).alias("i"), geo.circle(F.col("la"), F.col("lo"), 1000.0).alias("c")).collect()
    assert [r["i"] for r in rows] == [True, False, False]
    assert len(rows[0]["c"]) == 25 and rows[0]["c"][0] == rows[0]["c"][24]


def test_snapshot_and_features(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, 1.0), (3, "", 2.0), (3, "", 2.0)], "k int, g string, v double")
    path = str(tmp_path / "s")
    sinks.snapshot(df, path, ["k", "v"], ["g"])
    assert sinks.broken(spark, path, ["k", "v"], ["g"]).count() == 0
    spark.createDataFrame([(9, 9.0)], "k int, v double").write.mode("append").parquet(f"{path}/data/g=a")
    assert [r["g"] for r in sinks.broken(spark, path, ["k", "v"], ["g"]).collect()] == ["a"]
    sinks.snapshot(df.select("k", F.lit("01").alias("g")), path, ["k"], ["g"])
    assert sinks.broken(spark, path, ["k"], ["g"]).count() == 0
    assert sinks.manifest(df.limit(0), ["k"]).collect()[0]["n"] == 0
    points = spark.createDataFrame([(1, 1.5, 2.0), (2, None, 3.0), (None, 0.0, 0.0)], "k int, la double, lo double")
    sinks.geojson_lines(points, str(tmp_path / "g"), "la", "lo", ["k"])
    rows = sorted((json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "g")).collect()), key=str)
    assert [(r["geometry"]["coordinates"], r["properties"]["k"]) for r in rows] == [([0.0, 0.0], None), ([2.0, 1.5], 1)]


def test_code_lists(spark, tmp_path):
    (tmp_path / "c.csv").write_text(",AA,Town,1\nX,AA,Gone,2\n=,AA,Old = Town,\n+,BB,New,3\n=,BB,alone,\n")
    places, aliases = readers.place_codes(spark, str(tmp_path / "c.csv"), "m string, c string, n string, k int", "m", "c", "n")
    assert sorted(r["n"] for r in places.collect()) == ["New", "Town"]
    assert [tuple(r) for r in aliases.collect()] == [("AA", "Old", "Town")]
    names_ = spark.createDataFrame([(1, "V", 1, "b"), (1, "N", 2, "a"), (1, "N", 3, "b"), (2, None, 4, "z")], "f int, nt string, line int, name string")
    got = {r["f"]: (r["name"], r["names"]) for r in readers.one_row_per_feature(names_, "f", "nt", "line", "name").collect()}
    assert got == {1: ("a", ["b", "a"]), 2: ("z", ["z"])}


def test_nested_and_manifests(spark, tmp_path):
    one = {"results": [{"id": "a", "mobile": {"speed": 1.5, "distance_m": 10}, "fixed": {"speed": 2.0, "distance_m": 5000}}, {"id": "b", "fixed": {"speed": 3.0, "distance_m": 1000}}]}
    (tmp_path / "n.json").write_text(json.dumps(one, indent=1))
    got = readers.nested_results(spark, str(tmp_path / "n.json"), "id", ["mobile", "fixed"], "speed: double")
    assert sorted((r["id"], r["service"], r["speed"]) for r in got.collect()) == [("a", "mobile", 1.5), ("b", "fixed", 3.0)]
    folder = tmp_path / "m"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps([{"title": "t", "url": "u"}, {"title": " ", "url": "v"}]))
    (folder / "b.json").write_text("not json")
    good, bad = readers.manifest_rows(spark, str(folder), "title string, url string", ["title", "url"])
    assert [r["url"] for r in good.cache().collect()] == ["u"] and len(bad.cache().collect()) == 2
    with pytest.raises(ValueError):
        readers.manifest_rows(spark, str(folder), "title string, url string", ["title"], strict=True)


def test_registry_overlay(spark, tmp_path):
    (tmp_path / "base.json").write_text('{"k": 1, "v": "a"}\n{"k": 2, "v": "b"}\n')
    (tmp_path / "over.json").write_text('{"k": 2, "v": "c"}\nbroken\n{"k": 3, "v": null}\n')
    read = lambda over: sorted((r["k"], r["v"]) for r in readers.registry(spark, str(tmp_path / "base.json"), str(tmp_path / over), "k int, v string", "k", ["v"]).collect())
    assert read("over.json") == [(1, "a"), (2, "c"), (3, None)]
    assert read("none.json") == [(1, "a"), (2, "b")]
