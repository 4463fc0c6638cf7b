"""Small tables on which queries once failed, differed from their SQL or did more work than their results need."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from loomstone.functions import geo, names, text
from loomstone.operators import gazetteer, network, publishing, search
from loomstone.plans import catalog


@pytest.fixture
def agrees(spark, tmp_path):
    """Writes tables (name: SQL in DuckDB) to a folder and compares a query with its SQL there."""

    def run(name, tables):
        with duckdb.connect() as duck:
            duck.execute("SET TimeZone='UTC'")
            for table, sql in tables.items():
                duck.execute(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
                duck.execute(f"CREATE VIEW {table} AS FROM '{tmp_path}/{table}.parquet'")
            ours = catalog.QUERIES[name](spark, str(tmp_path))
            columns = sorted(ours.columns)
            theirs = duck.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})").fetchall()
        got = [tuple(r[c] for c in columns) for r in ours.collect()]
        assert sorted(got, key=str) == sorted(theirs, key=str)
        return [dict(zip(columns, r, strict=True)) for r in got]

    return run


def test_a_supplier_in_the_same_spot(agrees):
    # customer 1400 * 9 and supplier 0 are both at -70, -180
    tables = {
        "customer": "SELECT unnest([0, 1, 12600, 25200])::BIGINT AS c_custkey, 1 AS c_nationkey",
        "supplier": "SELECT unnest([0, 7, 25200])::BIGINT AS s_suppkey, 1 AS s_nationkey",
    }
    agrees("nearest_with_gap", tables)
    tables["supplier"] = "SELECT unnest([0, 7])::BIGINT AS s_suppkey, 1 AS s_nationkey"
    rows = {r["k"]: r for r in agrees("nearest_with_gap", tables)}
    assert rows[0]["distance_m"] == 0.0 and rows[0]["status"] == "matched"


def test_lines_of_one_number_go_as_they_are_stored(spark, agrees):
    # larger values first, so neither the smallest nor the last one is right by chance
    tables = {
        "lineitem": """SELECT (i % 40)::BIGINT AS l_orderkey, 1 AS l_linenumber, (i * 7 % 11)::BIGINT AS l_suppkey, (i * 37 % 50)::DOUBLE AS l_quantity, 'R' AS l_returnflag,
          TIMESTAMP '1999-01-01' AS l_shipdate FROM range(4000) t(i)""",
        "orders": """SELECT i AS o_orderkey, i AS o_custkey, 'O' AS o_orderstatus, 1.5 AS o_totalprice, TIMESTAMP '1999-01-01' AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(40) t(i)""",
        "customer": "SELECT i AS c_custkey, 'c' AS c_name, 0 AS c_nationkey, 'm' AS c_mktsegment FROM range(40) t(i)", "nation": "SELECT 0 AS n_nationkey, 'n' AS n_name, 0 AS n_regionkey",
    }
    # small splits, so that rows reach a key's task in another order than they are stored
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        agrees("component_sum", tables)
        assert {r["pid"]: r["first_value"] for r in agrees("candidate_rows", tables)} == {i: float(i * 37 % 50) for i in range(40)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_the_smallest_bucket_of_an_identity_counts(agrees):
    # 2 and 4 are one identity in buckets 1,1 and 2,1; the name of 30 is similar, and it is in the second bucket
    part = "SELECT p_partkey::BIGINT AS p_partkey, 'forest plum' AS p_name, 'B' AS p_brand, 'T' AS p_type, p_size FROM (VALUES (2, 1), (4, 7), (30, 7)) v(p_partkey, p_size)"
    rows = agrees("identity_cascade", {"part": part})
    assert [(r["match"], r["confidence"], r["rule"]) for r in rows] == [(2, 0.916667, "similar name")]


def test_a_total_like_a_year_stays(agrees):
    tables = {
        "orders": """SELECT i AS o_orderkey, 5::BIGINT AS o_custkey, 'F' AS o_orderstatus, 2000.0 + i * 0.0::DOUBLE AS o_totalprice, '1-URGENT' AS o_orderpriority FROM range(10) t(i)""",
        "customer": "SELECT 5::BIGINT AS c_custkey, 'Customer#5' AS c_name",
    }
    row = agrees("packet_index", tables)[0]
    assert (row["annual_visits"], row["annual_visits_p50"], row["busy_hour_gb"]) == (2000.0, 2000.0, 2000.0)


def test_a_source_behind_a_thousand_others_counts(agrees):
    # the newest 1190 of 1200 rows of evidence name one source, the oldest ten another
    tables = {
        "orders": """SELECT i AS o_orderkey, 5::BIGINT AS o_custkey, 'F' AS o_orderstatus, i::DOUBLE AS o_totalprice, CASE WHEN i < 100 THEN '2-HIGH' ELSE '5-LOW' END AS o_orderpriority FROM range(12000) t(i)""",
        "customer": "SELECT 5::BIGINT AS c_custkey, 'Customer#5' AS c_name",
    }
    row = agrees("packet_index", tables)[0]
    assert (row["sources"], row["source_count"], row["review_count"]) == ("2-HIGH|5-LOW", 1200, 1200)


#: Rows in one spot on either side: all pairs of them would be 4 * 10 ** 8.
MANY = 20_000


def test_a_crowd_in_one_spot_is_matched_once(spark):
    at = [F.lit("c").alias("country"), F.lit("n").alias("name"), F.lit(10.0).alias("lat"), F.lit(20.0).alias("lon")]
    places, locations = spark.range(MANY).select("id", *at), spark.range(MANY).select(F.col("id").alias("code"), *at)
    far = spark.createDataFrame([(-5, "c", "n", 10.5, 20.0), (-6, "c", "other", 10.0, 20.0)], "code long, country string, name string, lat double, lon double")
    got = gazetteer.gazetteer_match(places, locations.unionByName(far)).groupBy("code", "distance_km", "verdict").count().collect()
    assert [tuple(r) for r in got] == [(0, 0.0, "ambiguous", MANY)]
    # a code with two rows is no rival of itself
    twice = spark.createDataFrame([(7, "c", "n", 10.0, 20.0), (7, "c", "n", 10.001, 20.0), (8, "c", "n", 10.3, 20.0)], far.schema)
    assert gazetteer.gazetteer_match(places, twice).select("code", "verdict").distinct().collect() == [(7, "matched")]


def test_a_crowd_of_equal_groups_is_averaged_once(spark):
    at = [F.lit("n").alias("name"), F.lit(10.0).alias("lat")]
    points = spark.range(MANY).select(F.lit(1).alias("group"), *at, F.when(F.col("id") % 4 == 0, 20.0).otherwise(20.04).alias("lon"))
    locations = spark.range(MANY).select(F.col("id").alias("code"), *at, F.lit(20.08).alias("lon"))
    one = spark.createDataFrame([(-5, "n", 10.0, 20.0)], "code long, name string, lat double, lon double")
    assert gazetteer.preferred_exact(points, locations, 14.0).collect() == []
    (row,) = gazetteer.preferred_exact(points, locations.unionByName(one), 14.0).collect()
    step = 2 * 6371.0 * math.asin(math.cos(math.radians(10)) * math.sin(math.radians(0.02)))
    assert row["code"] == -5 and abs(row["mean_km"] - 0.75 * step) < 1e-3


def test_a_crowd_around_a_spot_is_ranked_once(spark):
    places = spark.range(MANY).select("id", F.lit(10.0).alias("lat"), F.lit(20.0).alias("lon"))
    seen = spark.range(MANY).select(F.col("id").alias("observation"), F.lit(3).alias("tile"), F.lit(10.01).alias("lat"), F.lit(20.0).alias("lon"), (F.col("id") % 5).alias("tests"), (F.col("id") % 7).alias("devices"))
    got = network.best_near(places, seen, 5000.0).groupBy("tile", "observation", "tests", "devices").count().collect()
    assert [tuple(r) for r in got] == [(3, 34, 4, 6, MANY)]
    points = seen.limit(3).select(F.col("observation").alias("point"), "lat", "lon", (F.col("observation") + 1.0).alias("metric"))
    scores = network.footfall(places, points, 5000.0).groupBy("point", F.round("score", 4)).count().collect()
    assert sorted(tuple(r) for r in scores) == [(0, 0.3333, MANY), (1, 0.6667, MANY), (2, 1.0, MANY)]


def test_rows_that_differ_in_their_id_alone_meet_once(spark):
    labels = [F.array(F.lit("l")).alias("labels"), F.lit(1).alias("n")]
    b = spark.range(MANY).select("id", *labels)
    fits = F.abs(F.col("x.n") - F.col("y.n")) <= 9
    got = publishing.consolidated(spark.range(MANY).select("id", *labels), b, fits).groupBy("a", F.size("labels")).count().collect()
    assert [tuple(r) for r in got] == [(None, 1, MANY)]
    one = spark.createDataFrame([(4, ["m", "l"], 1), (5, ["l"], 11), (6, ["m"], 1)], "id long, labels array<string>, n int")
    got = publishing.consolidated(one, b, fits).groupBy("a", F.array_join("labels", ",")).count().collect()
    assert [tuple(r) for r in got] == [(4, "l,m", MANY)]


def test_no_pair_is_made_of_rows_that_are_far(spark):
    """All in one cell, and only one spot of the right side is near: the join of rows makes no more than there are in the result."""
    left = spark.range(MANY).select(F.col("id").alias("k"), F.lit(10.0).alias("l_lat"), F.lit(20.0).alias("l_lon"))
    right = spark.range(MANY).select(F.col("id").alias("s"), F.when(F.col("id") == 0, 10.0).otherwise(11.5).alias("r_lat"), F.lit(20.0).alias("r_lon"))
    got = geo.radius_join(left, right, 100_000.0)
    assert got.columns == ["k", "l_lat", "l_lon", "s", "r_lat", "r_lon", "distance_m"]
    assert got.groupBy("s", "distance_m").count().collect() == [(0, 0.0, MANY)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_long_texts_go_to_python_in_small_batches(spark):
    df = spark.createDataFrame([("Çá  va",), (None,)], "a string")
    for form, want in ((names.plain_text, "ca va"), (names.flat_text, "Çá va")):
        rows = df.select(form("a"))
        assert "ArrowEvalPython" not in plan_of(rows) and [r[0] for r in rows.collect()] == [want, None]


def test_words_are_sifted_without_a_step_for_each(spark):
    """Nothing is evaluated word by word; rows of words alone are looked at, and only in texts with Chinese characters."""
    cases = {
        "the Port of Oran and Bank, hall of Fez 站 the tail": ["the", "tail"],
        "old Ab and Cd and the Ef": ["old", "and", "the"],
        "hall Oran 的 hall serves Fez 的": ["hall", "serves"],
        "hall Oran\n.-’ Fez-fez \u3000馆 gfa ab-C éa": [],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    rows = df.select("t", text.translatable(F.col("t")).alias("w"))
    assert {r["t"]: r["w"] for r in rows.collect()} == cases
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_zip" not in plan and "exists(" not in plan and plan.count("regexp_extract_all") == 2


def test_names_of_one_part_are_dealt_over_tasks(spark):
    n = spark.range(2000).select("id", F.concat(F.lit("hall "), F.col("id").cast("string")).alias("name"))
    places = n.select("*", F.lit("c").alias("country"), F.lit("t").alias("city"))
    queries = spark.createDataFrame([(1, "hall"), (2, "hall 1999")], "query long, asked string")
    found = search.search(places, n.withColumn("canonical", F.lit(True)), queries, 3)
    assert "_share" in plan_of(found)
    assert sorted((r["query"], r["position"], r["id"]) for r in found.collect()) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 1, 1999)]


def test_two_sources_are_told_without_a_set_of_them(spark, agrees, tmp_path):
    tables = {
        "orders": "SELECT i AS o_orderkey FROM range(4) t(i)",
        "lineitem": "SELECT * FROM (VALUES (0::BIGINT, 'R', 1::BIGINT), (0, 'A', 2), (1, 'A', 3), (1, 'A', 3), (2, 'N', NULL)) v(l_orderkey, l_returnflag, l_suppkey)",
    }
    assert {r["o_orderkey"]: r["sources_gate"] for r in agrees("evidence_gates", tables)} == {0: True, 1: False, 2: False, 3: False}
    assert "distinct" not in plan_of(catalog.QUERIES["evidence_gates"](spark, str(tmp_path)))
