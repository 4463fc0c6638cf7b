"""Library operators on the cases that their rules are about: borders, ties, nulls, contradictions."""

import datetime as dt
import random

import math

import pytest
from pyspark.sql import functions as F

from loomstone.functions import names, quantities, text, web
from loomstone.operators import complaints, gazetteer, identity, network, passages, publishing, quality, ranks, readmodel, search, visits

NOW = dt.datetime(2026, 6, 1)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture
def observed(spark):
    def make(items):
        data = [(p, k, w, NOW - dt.timedelta(days=d), u, h) for p, k, w, d, u, h in items]
        return spark.createDataFrame(data, "pid string, kind string, weight double, at timestamp_ntz, url string, digest string")

    return make


def test_freshness_changes_after_90_180_and_365_days(spark, observed):
    ages = [0, 90, 91, 180, 181, 365, 366, -5]
    df = observed([("p", "no_signal", 1.0, d, f"https://H{i % 2}.org/x", f"h{i}") for i, d in enumerate(ages)])
    r = complaints.rollup(df, "pid", F.lit(NOW)).first()
    assert (r["n"], r["weighted"], r["hosts"]) == (7, 1.0 + 1.0 + 0.6 + 0.6 + 0.3 + 0.3 + 1.0, 2)
    assert (r["pressure"], r["confidence"], r["kinds"]) == ("high", "high", {"no_signal": 7})
    assert r["latest"] == NOW + dt.timedelta(days=5)


def test_pressure_needs_three_observations_and_two_hosts(spark, observed):
    few = [("a", "no_signal", 1.0, i, "https://h.org", f"h{i}") for i in range(2)]
    twice = [("b", "weak_signal", 0.8, i, "https://h.org", "same") for i in range(9)]
    one_host = [("c", "no_signal", 1.0, 1, "https://h.org", f"h{i}") for i in range(5)]
    old = [("d", "no_signal", 1.0, 400, "https://h.org", "x")]
    low = [("e", "slow_data", -0.6, 1, None, f"h{i}") for i in range(3)]
    got = complaints.rollup(observed([*few, *twice, *one_host, *old, *low]), "pid", F.lit(NOW))
    want = [("a", 2, "insufficient", "insufficient"), ("b", 1, "insufficient", "insufficient"), ("c", 5, "high", "medium"), ("d", 0, "insufficient", "insufficient"), ("e", 3, "low", "low")]
    assert rows(got, "pid", "n", "pressure", "confidence") == want
    assert complaints.rollup(observed([]), "pid", F.lit(NOW)).count() == 0


def test_kinds_of_complaints(spark):
    cases = {
        "Sem sinal aqui": "no_signal", "a Rede caiu": "network_outage", "queda de ligação": "dropped_call", "Weak signal": "weak_signal", "internet lenta": "slow_data",
        "wifi: slow internet": None, "wi-fi e 4G: slow internet": "slow_data", "no signal, and the invoice is wrong": None, "": None, "lovely": None, "weak signal and no signal": "no_signal",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string")
    for r in df.select("t", "want", complaints.kind(names.plain_text("t")).alias("k")).collect():
        assert (r["k"] and r["k"]["kind"]) == r["want"], r["t"]


def test_a_complaint_belongs_to_exactly_one_place(spark):
    places = spark.createDataFrame([("p1", ["grand hall", "gh"], "lima", "peru"), ("p2", ["grand hall"], "quito", "ecuador"), ("p3", ["arena"], "lima", "peru")], "place string, names array<string>, city string, country string")
    data = [(1, "no signal at grand hall lima", None), (2, "grand hall", None), (3, "grand hall in lima and quito", None), (4, "gh lima", None), (5, "grand hall in lima and quito", "p2"), (6, "arena peru", "unknown"), (7, None, None)]
    got = complaints.named(spark.createDataFrame(data, "id int, t string, given string"), "id", "t", places)
    assert rows(got.where("place IS NOT NULL"), "id", "place") == [(1, "p1"), (5, "p2"), (6, "p3")]
    assert {r["id"]: r["verdict"] for r in got.collect()}[3] == "possible_duplicate"


def test_sources_are_allowed_by_the_first_policy(spark):
    policies = spark.createDataFrame([(1, "blog.x.org", False), (2, "x.org", True)], "place int, domain string, approved boolean")
    data = [("https://x.org/a", True), ("https://www.x.org:8080/a", True), ("https://blog.x.org/a", True), ("ftp://x.org/a", True), ("https://notx.org", True), ("https://x.org/private", True), ("https://x.org/a", None), (None, True)]
    df = spark.createDataFrame(data, "url string, ok boolean")
    got = complaints.allowed_source(df, "url", policies, ["PRIVATE"], ["ok"]).collect()
    assert sorted(r["url"] for r in got if r["allowed"]) == ["https://www.x.org:8080/a", "https://x.org/a"]


def test_ranks_of_large_groups(spark):
    rng = random.Random(3)
    data = [(rng.choice("ab"), float(rng.choice([1, 1, 1, 2, 7, rng.randrange(500)])), i) for i in range(3000)] + [("c", 5.0, 9), ("a", None, 9999)]
    df = spark.createDataFrame(data, "g string, v double, i long").repartition(4)
    order = {}
    for g, v, i in sorted((d for d in data if d[1] is not None), key=lambda d: (d[0], d[1], d[2])):
        order.setdefault(g, []).append((v, i))
    got = {(r["g"], r["i"]): r["rank"] for r in ranks.row_numbers(df, ["g"], "v", "i").collect()}
    assert got == {(g, i): n + 1 for g, vs in order.items() for n, (_, i) in enumerate(vs)}
    p = {r["g"]: (r["m"], r["q"]) for r in ranks.percentiles(df, ["g"], "v", {"m": 0.5, "q": 0.2}).collect()}
    import numpy as np

    for g, vs in order.items():
        want = np.quantile([v for v, _ in vs], [0.5, 0.2])
        assert abs(p[g][0] - want[0]) < 1e-9 and abs(p[g][1] - want[1]) < 1e-9
    share = {(r["g"], r["i"]): r["percentile"] for r in ranks.share_below(df, ["g"], "v").collect()}
    for g, vs in order.items():
        for v, i in vs[:: 1 + len(vs) // 50]:
            n = len(vs)
            assert abs(share[g, i] - (0.5 if n == 1 else (sum(x <= v for x, _ in vs) - 1) / (n - 1))) < 1e-9
    assert share["a", 9999] is None


def test_null_keys_are_a_group(spark):
    rows = spark.createDataFrame([(None, 1.0, 1), (None, 3.0, 2), (None, None, 3), ("a", 5.0, 4), ("a", 9.0, 5), ("b", None, 6)], "g string, v double, t long")
    got = {(r["g"], r["t"]): r["rank"] for r in ranks.row_numbers(rows, ["g"], "v", "t").collect()}
    assert got == {(None, 1): 1, (None, 2): 2, ("a", 4): 1, ("a", 5): 2}
    assert {r["g"]: r["m"] for r in ranks.percentiles(rows, ["g"], "v", {"m": 0.5}).collect()} == {None: 2.0, "a": 7.0}
    assert {(r["g"], r["t"]): r["percentile"] for r in ranks.share_below(rows, ["g"], "v").collect()} == {(None, 1): 0.0, (None, 2): 1.0, (None, 3): None, ("a", 4): 0.0, ("a", 5): 1.0, ("b", 6): None}
    assert len(ranks.share_in_order(rows, ["g"], "v", "t").collect()) == 4


def test_percentiles_of_several_columns(spark):
    import random

    rng = random.Random(3)
    rows = [(None if g == 0 else g, rng.choice([1.0, rng.random(), 2.0 * g]), None if rng.random() < 0.1 else rng.gauss(0, g + 1)) for g, n in ((0, 1), (1, 2), (2, 7), (3, 199), (4, 3000), (5, 12_000)) for _ in range(n)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    points = {"x": {"a": 0.0, "b": 0.2, "c": 0.5}, "y": {"d": 0.37, "e": 0.999, "f": 1.0}}
    got = {r["g"]: r for r in ranks.percentiles_of(df, ["g"], points).collect()}
    everything = ranks.percentiles_of(df, [], points).collect()[0]
    assert len(got) == 6
    for g in (*got, "all"):
        for k, (c, names) in enumerate(points.items()):
            values = sorted(r[k + 1] for r in rows if g in (r[0], "all") and r[k + 1] is not None)
            for name, p in names.items():
                at = (len(values) - 1) * p
                low, high = values[math.floor(at)], values[math.ceil(at)]
                mine = (everything if g == "all" else got[g])[name]
                assert abs(mine - (low + (high - low) * (at - math.floor(at)))) < 1e-9
    assert ranks.percentiles_of(df.limit(0), ["g"], points).count() == 0
    assert ranks.percentiles_of(df.limit(0), [], points).collect()[0]["b"] is None


def test_passages_of_any_length(spark):
    texts = ["one two three four five six seven eight nine ten", "", None, "a  b\tc", "xonex", "one  two three", "é one"]
    wanted = ["two three four", "one", "ne two three four five six seven eig", "", "b\tc", "b c", "é", "one two", "ten", None, "  b", "two three four five six seven"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows(passages.contained(docs, "doc_id", "text", spark.createDataFrame([(w,) for w in wanted], "passage string"), "passage"), "doc_id", "passage")
    assert got == sorted((i, w) for i, t in enumerate(texts) for w in wanted if t is not None and w is not None and w in t)
    assert passages.contained(docs, "doc_id", "text", docs.select(F.lit(None).cast("string").alias("passage")), "passage").count() == 0


def estimate(spark, metrics):
    data = [("p", s, m, float(v), u, i) for i, (s, m, v, u) in enumerate(metrics)]
    return visits.estimate(spark.createDataFrame(data, "p string, scene string, metric string, value double, unit string, evidence int"), "p").first()


def test_direct_numbers_come_first_and_years_are_none(spark):
    r = estimate(spark, [("stadium", "annual_visitors", 800_000, "visits/year"), ("stadium", "seat_count", 40_000, "seats"), ("stadium", "annual_visits", 2020, "visits/year")])
    assert (r["method"], list(r["annual"]), r["confidence"]) == ("direct_annual", [None, 800_000.0, None], "high")
    # an event scene spreads a year over the calendar, and its proxy gives the peak day
    assert r["typical_day"] == [800_000 / 365] * 3 and r["peak_day"] == [40_000 * f for f in (0.55, 0.75, 0.95)]
    r = estimate(spark, [("stadium", "annual_visits", 2020, "visits/year")])
    assert (r["method"], r["annual"], r["confidence"]) == ("insufficient", None, "insufficient")


def test_daily_numbers_and_swapped_ends(spark):
    r = estimate(spark, [("transport_hub", "daily_ridership", 10_000, "visits/day")])
    assert (r["method"], r["annual"], r["typical_day"], r["confidence"]) == ("direct_daily", [3_500_000, 3_600_000, 3_650_000], [10_000] * 3, "medium")
    r = estimate(spark, [("mall_mixed_use", "gla", 10_000, "sqm"), ("mall_mixed_use", "retail_gfa", 90_000, "sqm")])
    assert (r["method"], r["annual"], r["flags"]) == ("scene_proxy", [120_000, 200_000, 320_000], ["uncalibrated_scene"])
    assert r["typical_day"] == [120_000 / 365, 200_000 / 360, 320_000 / 350]
    users = [r["peak_day"][i] * (0.65, 0.75, 0.85)[i] * (0.80, 0.875, 0.95)[i] * (0.10, 0.14, 0.18)[i] for i in range(3)]
    assert all(abs(a - b) < 1e-9 for a, b in zip(r["users"], users, strict=True))
    assert all(abs(m - g * 8192 / 3600) < 1e-9 for m, g in zip(r["mbps"], r["gb"], strict=True))


def test_components_add_up(spark):
    r = estimate(spark, [("luxury_hotel_mice", "rooms", 300, "rooms"), ("luxury_hotel_mice", "keys", 200, "rooms"), ("luxury_hotel_mice", "ballroom_capacity", 1000, "people")])
    assert (r["method"], r["chosen"], r["annual"]) == ("scene_components", "keys+ballroom_capacity", [200 * 650 + 80_000, 200 * 900 + 120_000, 200 * 1150 + 180_000])
    r = estimate(spark, [("hospital", "outpatient_volume", 500_000, "visits/year"), ("hospital", "beds", 800, "beds"), ("hospital", "employee_count", 3000, "people")])
    assert (r["method"], r["annual"][1]) == ("scene_components", 500_000 + 800 * 400 + 3000 * 250)
    r = estimate(spark, [("stadium", "seat_count", 999_999, "seats"), ("stadium", "peak_event_capacity", 5000, "people")])
    assert (r["chosen"], r["flags"]) == ("peak_event_capacity", ["implausible_metric_filtered:seat_count", "uncalibrated_scene"])
    assert estimate(spark, [("castle", "rooms", 5, "rooms")])["method"] == "insufficient"


def test_calibration_needs_thirty_samples_and_a_fifth(spark):
    def sample(scene, n, v2):
        return [(scene, 100.0, 150.0, v2) for _ in range(n)]

    data = [*sample("a", 29, 100.0), *sample("b", 30, 139.0), *sample("c", 30, 141.0), ("c", 0.0, 1.0, 1.0)]
    got = visits.calibration(spark.createDataFrame(data, "scene string, actual double, v1 double, v2 double"), "scene")
    assert rows(got, "scene", "n", "status") == [("a", 29, "uncalibrated_scene"), ("b", 30, "passed"), ("c", 30, "failed_improvement_gate")]


def test_names_and_identities(spark):
    df = spark.createDataFrame([("Marks & Spencer's",), ("Aéroport Intl.",), ("Grand Centre official statistics",), ("Official",), (None,)], "t string")
    got = df.select(names.identity_text("t").alias("i"), names.entity_name("t").alias("e"), names.search_text("t").alias("s")).collect()
    assert [r["i"] for r in got] == ["marks and spencers", "airport international", "grand center official statistics", "official", None]
    assert [r["e"] for r in got] == ["marks and spencers", "airport international", "grand center", "", None]
    other = spark.createDataFrame([("São-Paulo",), ("東京タワー",), ("مَدْرَسَة",)], "t string").select(names.search_text("t").alias("s")).collect()
    assert other[0]["s"] == "sao paulo" and other[1]["s"] == "東京タワー" and other[2]["s"] == "م د ر س ة"
    v = spark.createDataFrame([(["alpha", "beta", "alpha"],)], "w array<string>").select(names.hash_vector(F.col("w"), 64)).first()[0]
    import hashlib
    import math

    want = [0.0] * 64
    for w in ("alpha", "beta", "alpha"):
        d = hashlib.sha256(w.encode()).digest()
        want[int.from_bytes(d[:4], "big") % 64] += 1.0 if d[4] % 2 == 0 else -1.0
    size = math.sqrt(sum(x * x for x in want))
    assert all(abs(a - b / size) < 1e-12 for a, b in zip(v, want, strict=True))


def test_identity_cascade_with_sequence_ratio(spark):
    schema = "id int, country string, city string, name string, scene string, lat double, lon double, maps string"
    known = spark.createDataFrame([(1, "Peru", "Lima", "Jorge Chávez Airport", "airport", -12.021, -77.114, "https://maps/1"), (2, "Peru", "Cusco", "Sun Hall", "hall", None, None, None), (3, "Peru", "Lima", "Moon Hall", "hall", None, None, None)], schema)
    known = known.withColumn("urls", F.when(F.col("id") == 2, F.array(F.lit("https://s.org/p?b=1&a=2"))))
    data = [
        (10, "PERU", "lima", "Jorge Chavez Airport official report", "airport", None, None, None, None), (11, "Peru", "", "Sun Hall", "hall", None, None, None, None),
        (12, "Peru", "Lima", "Jorge Chaves Airport", "airport", -12.0211, -77.1141, None, None), (13, "Peru", "Puno", "Other", "airport", None, None, "https://maps/1/", None),
        (14, "Peru", "Lima", "x", "hall", None, None, None, "HTTPS://S.org/p?a=2&b=1#top"), (15, "Chile", "Lima", "Sun Hall", "hall", None, None, None, None), (16, "Peru", "Arequipa", "Sun Halls", "hall", None, None, None, None),
    ]
    got = identity.match(spark.createDataFrame(data, schema + ", url string"), known)
    want = [(10, "known_property", 1), (11, "known_property", 2), (12, "possible_duplicate", 1), (13, "possible_duplicate", 1), (14, "known_property", None), (15, "new_opportunity", None), (16, "new_opportunity", None)]
    assert sorted((r["id"], r["status"], r["match"]) for r in got.collect()) == want


def test_search_order(spark):
    places = spark.createDataFrame([("1", "Central Hall", "A", "x"), ("2", "Hall", "B", "y"), ("3", "Great Hall of Hall", "A", "z"), ("4", "Museum", "A", "x")], "id string, name string, country string, city string")
    alias = spark.createDataFrame([("4", "Hall", False), ("1", "hall annex", False)], "id string, name string, canonical boolean")
    every = places.select("id", "name", F.lit(True).alias("canonical")).unionByName(alias)
    got = search.search(places, every, spark.createDataFrame([(1, "HALL"), (2, "--")], "query long, asked string"), 3).orderBy("position").collect()
    assert [(r["id"], r["kind"]) for r in got] == [("2", "canonical_exact"), ("4", "alias_exact"), ("1", "alias_prefix")]


QUANTITIES = [
    ("seat_count", "Capacity 45,000 seats (2019)", 45000.0, "seats"), ("seat_count", "78.838 spectators; a budget of $5 million", 78838.0, "seats"), ("annual_visits", "12.5 million visitors a year", 12.5e6, "visits/year"),
    ("annual_visits", "in 2019", None, None), ("daily_ridership", "peak 90,000 per day in one of the summers, and else 31,200 passengers per day", 31200.0, "visits/day"), ("gla", "10,000 square feet", 929.03, "sqm"),
    ("beds", "each hospital has about 120 beds, 4,000 beds in all", 120.0, "beds"), ("rooms", "20 meeting rooms", None, None), ("line_count", "served by 45 metro lines", None, None), ("international_passenger_share", "43.5 %", 43.5, "percent"),
]


def test_quantities(spark):
    df = spark.createDataFrame([(f, t) for f, t, _, _ in QUANTITIES], "f string, t string")
    got = [tuple(r[0]) for r in df.select(quantities.value_and_unit(F.col("f"), F.col("t"))).collect()]
    assert [(v and round(v, 2), u) for v, u in got] == [(v, u) for _, _, v, u in QUANTITIES]


def test_quality_and_surfaces(spark):
    rules = quality.Rules(indicators={"stadium": ("seat count",)})
    kind = "country string, city string, name string, scene string, precision string, urls array<string>, sources array<string>, evidence array<struct<field:string,indicator:string,kind:string,value:string,note:string>>, note string, assignment string"
    good = ("Peru", "Lima", "Grand Arena", "stadium", "rooftop", [], ["Press"], [("seat count", None, "official", "45000", None)], None, "verified")
    lead = (*good[:7], [], None, None)
    bad = ("Peru", "Peru", "", "stadium", None, None, None, None, "a default", None)
    df = quality.issues(spark.createDataFrame([good, lead, bad], kind), rules).withColumn("v", quality.visibility(F.col("issues"), F.lit(True)))
    got = df.collect()
    assert [r["v"]["status"] for r in got] == ["ready", "review_required", "blocked_quality"]
    assert got[2]["issues"] == ["name missing", "city is the country", "precision missing", "objective metric missing", "model is a default"]
    shown = quality.on_surface(df.select("name", "v.*"), "map")
    assert sorted(r["name"] for r in shown.collect()) == ["Grand Arena", "Grand Arena"]
    with pytest.raises(ValueError):
        quality.on_surface(shown, "moon")


def test_only_the_first_accepted_row_makes_its_key_known(spark):
    df = spark.createDataFrame([(1, "a", False, False), (2, "a", True, False), (3, "a", True, False), (4, "b", True, False), (5, "c", True, True), (6, "c", True, False)], "id int, key string, ok boolean, maybe boolean")
    got = quality.routed(df, "key", [F.col("id")], spark.createDataFrame([("b",)], "key string"), F.col("ok"), F.col("maybe"))
    assert rows(got, "id", "route") == [(1, "draft"), (2, "accepted"), (3, "duplicate"), (4, "duplicate"), (5, "possible_duplicate"), (6, "accepted")]


def test_publishing_guards_what_lies_outside(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "k int, c string")
    assert rows(publishing.publish_scope(now, now.where("c = 'b'").withColumn("k", F.lit(9)), F.col("c") == "b"), "k") == [(1,), (9,)]
    with pytest.raises(publishing.ScopeError):
        publishing.publish_scope(now, now, F.col("c") == "b")
    with pytest.raises(ValueError):
        publishing.columns_of(now, now, ["id"])


def test_gazetteer_needs_a_clear_nearest(spark):
    places = spark.createDataFrame([(1, "P", "lima", 0.0, 0.0), (2, "P", "lima", 5.0, 5.0), (3, "P", "cusco", 0.0, 0.0)], "id int, country string, name string, lat double, lon double")
    spots = spark.createDataFrame([("x", "P", "lima", 0.0, 0.1), ("y", "P", "lima", 0.0, -0.1005), ("z", "P", "lima", 5.0, 5.1)], "code string, country string, name string, lat double, lon double")
    assert rows(gazetteer.gazetteer_match(places, spots), "id", "verdict") == [(1, "ambiguous"), (2, "matched"), (3, "none")]


def test_markers_fall_back(spark):
    kind = "country string, city string, lat double, lon double"
    features = spark.createDataFrame([("A", "x", 1.0, 2.0), ("A", "x", 3.0, 4.0)], kind)
    packets = spark.createDataFrame([("A", "x", 9.0, 9.0, "Verified"), ("A", "y", 5.0, 5.0, "Guessed"), ("A", "y", 7.0, 7.0, "Geocoded"), ("A", "z", None, None, None), ("A", "w", None, 1.0, None)], kind + ", status string")
    got = readmodel.city_markers(features, packets, spark.createDataFrame([("A", "z", 0.5, 0.5)], kind))
    assert rows(got, "city", "lat", "lon", "source") == [("x", 2.0, 3.0, "features"), ("y", 7.0, 7.0, "ready"), ("z", 0.5, 0.5, "cached")]


def test_network_classes(spark):
    df = spark.createDataFrame([(10.0, None), (50.0, 300.0), (50.0, 150.0), (50.0, None), (30.0, 10.0)], "d double, l double")
    got = df.select(network.network_class(F.col("d"), F.col("l"), F.lit(20.0), F.lit(40.0), F.lit(100.0), F.lit(200.0))).collect()
    assert [r[0] for r in got] == ["poor", "poor", "moderate", "good", "moderate"]


def test_pages_and_packets(spark):
    html = "<html><script>x<1</script><!-- no --><p>A &amp;lt; B</p><meta property='og:image' content='//c.org/a.png'><img src='a/b.png'></html>"
    df = spark.createDataFrame([("https://s.org/d/p.html?q=1", html), (None, None)], "u string, h string")
    got = df.select(web.page_text(F.col("h")).alias("t"), web.image_candidates(F.col("u"), F.col("h")).alias("i")).collect()
    assert got[0]["t"] == "A &lt; B" and [tuple(x) for x in got[0]["i"]] == [(0, "https://c.org/a.png"), (2, "https://s.org/d/a/b.png")]
    assert (got[1]["t"], got[1]["i"]) == (None, None)
    slug = spark.createDataFrame([("https://en.wikipedia.org/wiki/S%C3%A3o_Paulo?x=1",), ("https://x.org/wiki/A",), (None,)], "u string").select(text.wiki_slug(F.col("u"))).collect()
    assert [r[0] for r in slug] == ["São Paulo", None, None]


def test_filters(spark):
    from loomstone.operators import filters

    df = spark.createDataFrame([(1, "a", True, True), (2, "a", None, True), (3, "b", True, False)], "k int, c string, f boolean, map_ready boolean")
    assert rows(filters.read_model(df, {"c": "a", "k": ""}, {"f": True}, "map"), "k") == [(1,)]
    assert rows(filters.read_model(df, {}, {"f": False}), "k") == [(2,)] and filters.equal(df, {"f": True}).count() == 2
    with pytest.raises(ValueError):
        filters.equal(df, {"nothing": 1})


def test_covers_and_holes(spark):
    import math

    from loomstone.functions import geo

    df = spark.createDataFrame([(0.0, 0.0), (60.2, 24.9), (-84.0, 100.0), (51.5, 179.9)], "la double, lo double")
    got = df.select("la", "lo", geo.radius_cover(F.col("la"), F.col("lo"), 90_000.0, 9).alias("t")).collect()

    def metres(a, b, c, d):
        x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * geo.EARTH_M * math.asin(math.sqrt(x))

    for r in got:
        want = set()
        for x in range(512):
            for y in range(512):
                la, lo = math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * (y + 0.5) / 512)))), (x + 0.5) / 512 * 360 - 180
                if abs(lo - r["lo"]) < 180 and metres(r["la"], r["lo"], la, lo) <= 90_000:
                    want.add((x, y))
        assert {(t["x"], t["y"]) for t in r["t"]} == want
    ring, hole = [(-4.0, -4.0), (-4.0, 4.0), (4.0, 4.0), (4.0, -4.0)], [(-1.0, -1.0), (-1.0, 1.0), (1.0, 1.0), (1.0, -1.0)]
    points = spark.createDataFrame([(0.0, 0.0), (2.0, 2.0), (5.0, 0.0), (None, 0.0)], "la double, lo double")
    assert [r[0] for r in points.select(geo.in_polygon(F.col("la"), F.col("lo"), [ring, hole])).collect()] == [False, True, False, False]


def test_maturity_and_chunks(spark):
    from loomstone.operators import derive

    s = spark.createDataFrame([("A", 200, 6, 300), ("B", 60, 6, 90), ("C", 60, 5, 90), ("D", 0, 0, 0), ("E", 5, 1, 5)], "country string, n int, scenes int, sources int")
    p = spark.createDataFrame([("D", f"s{i % 6}", f"k{i % 2}", "exhausted", 1) for i in range(12)] + [("E", f"s{i}", f"k{i % 2}", "active", 2) for i in range(4)], "country string, scene string, source string, status string, cycle int")
    want = [("A", "deep_expansion", "active_coverage"), ("B", "deep_expansion", "active_coverage"), ("C", "seed_scan", "active_coverage"), ("D", "near_saturation", "tracked_exhaustion"), ("E", "deep_expansion", "tracked_rounds")]
    assert rows(derive.maturity(s, p), "country", "level", "basis") == want
    none = spark.createDataFrame([], "doc_id int, content_hash string, pos int, chunk string")
    first = derive.rechunked(none, spark.createDataFrame([(1, "abcdef"), (2, "xy"), (3, None), (4, "")], "doc_id int, text string"), 4)
    then = derive.rechunked(first.drop("origin"), spark.createDataFrame([(1, "abcdef"), (2, "xyz")], "doc_id int, text string"), 4)
    assert rows(then, "doc_id", "pos", "chunk", "origin") == [(1, 0, "abcd", "kept"), (1, 1, "ef", "kept"), (2, 0, "xyz", "new")]


def test_circular_batches(spark):
    def loop(counts, start, least, most=10**9):
        start, taken, total = start % len(counts), [], 0
        for k in range(len(counts)):
            at = (start + k) % len(counts)
            if total + counts[at] <= most or total < least:
                taken.append(at)
                total += counts[at]
            if total >= least:
                break
        return sorted(taken or [start])

    rng = random.Random(5)
    for counts, start, least in [([12, 14, 16, 20], 0, 30), ([12, 14, 16, 20], 3, 30), ([0, 0, 5], 1, 5), ([3], 7, 100), ([4, 4], 1, 0), *[([rng.randrange(9) for _ in range(40)], rng.randrange(100), rng.randrange(120)) for _ in range(4)]]:
        df = spark.createDataFrame([(None, k, c) for k, c in enumerate(counts)], "g string, pos long, c long")
        assert sorted(r["pos"] for r in ranks.circular_batch(df, ["g"], "pos", "c", start, least).collect()) == loop(counts, start, least)
