"""Packets of many tables, with bounds and what goes beyond them."""

from pyspark.sql import functions as F

from loomstone.operators import packets


def test_packets(spark):
    parents = spark.createDataFrame([(1, 1, "A"), (1, 2, "B"), (2, 1, "C"), (3, 1, "D")], "pid long, run long, name string")
    big = spark.range(50).select(F.lit(1).cast("long").alias("pid"), F.lit(1).cast("long").alias("run"), F.col("id").alias("v"), F.lit("x").alias("name"))
    need = spark.createDataFrame([(1, 1, "n"), (1, 2, None), (2, 1, "n"), (9, 9, "stray")], "pid long, run long, s string")
    bare = spark.createDataFrame([(1, 1)], "pid long, run long")
    children = {"big": packets.Child(big, [-F.col("v")], most=3), "need": packets.Child(need, needed=True), "bare": packets.Child(bare), **{f"c{k}": packets.Child(need, ["s"]) for k in range(8)}}
    out = packets.packets(parents, children, ["pid", "run"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(r["pid"], r["run"]): r for r in out.collect()}
    assert sorted(got) == [(1, 1), (1, 2), (2, 1)]
    one = got[1, 1]
    assert one["parent"]["name"] == "A" and [x["v"] for x in one["big"]] == [49, 48, 47] and one["n_big"] == 50 and one["n_bare"] == 1 and one["c7"][0]["s"] == "n"
    assert got[1, 2]["need"][0]["s"] is None and got[2, 1]["big"] == []
    beyond = packets.overflow(parents, children, ["pid", "run"]).collect()
    assert len(beyond) == 47 and {r["child"] for r in beyond} == {"big"} and sorted(r["position"] for r in beyond) == list(range(4, 51))
    assert packets.packets(parents.limit(0), children, ["pid", "run"]).count() == 0


def test_packets_hold_every_row_or_the_first_of_every_value(spark):
    parents = spark.createDataFrame([(1,), (2,)], "pid long")
    rows = spark.range(3000).select(F.lit(1).cast("long").alias("pid"), F.col("id").alias("v"), F.when(F.col("id") < 2990, "a").when(F.col("id") < 2995, "b").alias("s"))
    children = {"all": packets.Child(rows, [F.col("v")]), "values": packets.Child(rows, [F.col("v")], each=["s"]), "first": packets.Child(rows, [-F.col("v")], each=[], needed=True), "other": packets.Child(rows, [-F.col("v")], each=["s"])}
    out = packets.packets(parents, children, ["pid"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    (got,) = out.collect()
    assert [x["v"] for x in got["all"]] == list(range(3000)) and [got[f"n_{n}"] for n in children] == [3000] * 4
    assert [(x["v"], x["s"]) for x in got["values"]] == [(0, "a"), (2990, "b"), (2995, None)]
    assert [x["v"] for x in got["first"]] == [2999] and [(x["v"], x["s"]) for x in got["other"]] == [(2999, None), (2994, "b"), (2989, "a")]
    assert packets.overflow(parents, children, ["pid"]).count() == 0


def test_index_rows(spark):
    parent = "pid long, name string, country string, city string, city_id string, scene string, lat double, lon double, maps string, precision string, map_source string, coordinate_status string"
    parents = spark.createDataFrame([(1, "São  Hall", "P", "c", "7", "hall", 1.0, 2.0, None, "p", "m", "Verified"), (2, "B", "P", "c", None, "hall", None, None, "link", None, None, "Verified")], parent)
    rows = {
        "candidate": ("quality_status string, main_table_ready boolean, map_ready boolean, export_ready boolean, issues array<string>", [(1, "ok", True, None, False, ["i"])]), "assignment": ("status string, method string", []),
        "alias": ("alias string", [(1, "sao hall"), (1, "Other")]), "scene": ("annual_visits double, proxy_level string", [(1, 2019.0, "x"), (2, 5000.5, "y")]), "build": ("presence string, rat string", [(1, "yes", "5G")]),
        "conclusion": ("evidence_status string, value_class string, action string, solution string", [(1, "e", "v", "a", "s")]), "demand": ("busy_hour_gb double", [(1, 3.0), (2, 4.0)]),
        "traffic": ("p10 double, p50 double, p90 double, model string, active boolean", [(1, 1.0, 2.0, 3.0, "m", True), (2, 1.0, 2.0, 3.0, "m", False)]), "complaint": ("pressure string, freshness string", [(1, "high", "fresh")]),
        "network": ("priority string", [(1, "first")]), "evidence": ("url string, value string", [(1, "b", "first"), (1, "a", "next"), (1, "b", None), (1, None, "x")]), "review": ("reason string", [(1, "r")]),
    }
    children = {n: packets.Child(spark.createDataFrame(r, f"pid long, {schema}").coalesce(1)) for n, (schema, r) in rows.items()}
    assert set(packets.NEEDS) == {"parent", *children}
    out = packets.index_rows(packets.packets(parents, children, ["pid"]), ["pid"])
    assert len(out.columns) == 46
    a, b = out.orderBy("pid").collect()
    assert a["annual_visits"] is None and a["busy_hour_gb"] is None and a["annual_visits_p50"] == 2.0 and a["search_text"] == "sao hall\nother"
    assert a["source_count"] == 4 and a["source_urls"] == ["a", "b"] and a["map_coordinate_ready"] and a["main_table_ready"] and not a["export_ready"] and a["maps_link"].startswith("http")
    assert b["annual_visits_p50"] == 5000.5 and b["traffic_model"] is None and b["has_traffic_model"] and b["source_count"] == 1 and b["main_metric"] == "" and b["maps_link"] == "link" and not b["map_coordinate_ready"]
