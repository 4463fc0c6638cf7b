"""Similarity join of names and search by parts, against all pairs and against plain loops."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from loomstone.functions import names, text
from loomstone.operators import identity, matching, search


def words(rng, n):
    return " ".join("".join(rng.choice("aeiorstnlz") for _ in range(rng.randrange(1, 8))) for _ in range(n))


def edited(rng, s):
    s = list(s)
    for _ in range(rng.randrange(0, 4)):
        k = rng.randrange(len(s) + 1)
        s[k : k + rng.randrange(2)] = rng.choice(["", "x", "ea"])
    return "".join(s).strip()


def test_no_similar_pair_is_missed(spark):
    rng = random.Random(1)
    base = [words(rng, rng.randrange(1, 4)) for _ in range(150)] + ["a", "ab", "abc", "abcd", "abcde", "abcdef", "aaaaaa", "ababab"]
    ours = [(rng.choice("pq"), b) for b in base] + [("p", ""), ("p", None)]
    theirs = [(rng.choice("pq"), edited(rng, b)) for b in base for _ in range(2)] + [("q", "")]
    a, b = spark.createDataFrame(ours, "g string, x string"), spark.createDataFrame(theirs, "g string, y string")
    got = {(r["g"], r["x"], r["y"]) for r in matching.similar_pairs(a, b, ["g"], "x", "y", 0.82).collect()}
    want = {(g, x, y) for g, x in ours for h, y in theirs if g == h and x and y and SequenceMatcher(None, x, y).ratio() >= 0.82}
    assert want <= got and len(want) > 100
    # only what can reach the ratio by its letters
    for _, x, y in got:
        shared = sum(min(x.count(c), y.count(c)) for c in set(x))
        assert 2 * shared / (len(x) + len(y)) >= 0.82 - 1e-6
    assert len(got) < len({g for g in ours}) * len(theirs) / 10
    assert matching.similar_pairs(a.limit(0), b, ["g"], "x", "y", 0.82).count() == 0


def test_every_link_and_bucket_of_a_record_counts(spark):
    schema = "id long, country string, city string, name string, scene string, lat double, lon double, maps string"
    known = spark.createDataFrame([(1, "Peru", "Lima", "Sun Hall", "hall", 1.0, 1.0, "https://m/1"), (2, "Peru", "Lima", "Sun Hall", "hall", 2.0, 2.0, "https://m/2"), (3, "Peru", "Lima", "Grand Museum of Art", "hall", None, None, None)], schema)
    known = known.withColumn("urls", F.array().cast("array<string>"))
    rows = [
        (10, "Peru", "Cusco", "Other", "hall", None, None, "https://m/1", None), (11, "Peru", "Cusco", "Another", "hall", None, None, "https://m/2", None),
        (12, "Peru", "Lima", "Sum Hallx", "hall", 2.0, 2.0, None, None), (13, "Peru", "Lima", "Sum Hallx", "hall", 9.0, 9.0, None, None), (14, "Peru", "Lima", "Grand Museum off Art", "hall", None, None, None, None),
    ]
    got = {r["id"]: (r["status"], r["match"]) for r in identity.match(spark.createDataFrame(rows, schema + ", url string"), known).collect()}
    assert got == {10: ("possible_duplicate", 1), 11: ("possible_duplicate", 1), 12: ("possible_duplicate", 1), 13: ("new_opportunity", None), 14: ("possible_duplicate", 3)}


@pytest.mark.parametrize("kept", [True, False])
def test_search_equals_a_loop(spark, kept):
    rng = random.Random(2)
    places = [(str(k), words(rng, 2), rng.choice("AB"), rng.choice("xy")) for k in range(120)]
    alias = [(str(rng.randrange(120)), words(rng, 2), False) for _ in range(80)] + [("3", "São Tomé", False), ("4", "  ", False)]
    every = [(i, n, True) for i, n, _, _ in places] + alias
    asked = [(k, q) for k, q in enumerate(["a", "ea", "sao tome", "São", "zz", places[5][1], places[7][1][1:5], "", "--", "e", "not there at all"])]
    p = spark.createDataFrame(places, "id string, name string, country string, city string")
    n = spark.createDataFrame(every, "id string, name string, canonical boolean")
    q = spark.createDataFrame(asked, "query long, asked string")
    out = search.search(p, n, q, 7, search.name_index(n) if kept else None)
    plan = out._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    got = {}
    for r in out.orderBy("query", "position").collect():
        got.setdefault(r["query"], []).append(r["id"])
    form = names.search_form
    for k, a in asked:
        best = {}
        for i, name, canonical in every:
            f, w = form(name), form(a)
            if w and f and w in f:
                rank = (0 if f == w else 2 if f.startswith(w) else 4) + (not canonical)
                best[i] = min(best.get(i, (9, 0, "")), (rank, len(name), name))
        of = {i: (form(n), c.lower(), t.lower()) for i, n, c, t in places}
        want = sorted(best, key=lambda i: (best[i][0], len(form(best[i][2])), *of[i], i))[:7]
        assert got.get(k, []) == want, a


def test_search_forms():
    for given, want in (("São  Tomé-1", "sao tome 1"), ("ÅNGSTRÖM", "angstrom"), ("かがく", "かがく"), ("й", "й"), ("ﬁn", "fin"), ("Straße", "strasse"), ("é̂x", "ex"), ("", "")):
        assert names.search_form(given) == want


def test_sanitized(spark):
    rows = [
        ("Ana @x.y no signal", "[redacted-handle] no signal"), ("  Élise-Marie @anna: bad", "Élise-Marie [redacted-handle]: bad"), ("write to Ab.C+d@mail.example.org now", "write to [redacted-email] now"),
        ("call +55 (11) 98765-4321!", "call [redacted-phone]!"), ("a@b and é@c", "a@b and é@c"), ("id x12345678901", "id x12345678901"), ("1234567", "1234567"), (None, ""), ("a\n\tb", "a b"), ("@", "@"),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "k long, t string")
    got = [r["s"] for r in df.select("k", text.sanitize(F.col("t")).alias("s")).orderBy("k").collect()]
    assert got == [w if k != 1 else "[redacted-handle]: bad" for k, (_, w) in enumerate(rows)]


def test_similar_part_names_equal_all_pairs(spark):
    import os

    from loomstone.plans import catalog

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables here")
    import re

    part = spark.read.parquet(f"{folder}/part.parquet").select("p_brand", "p_name").collect()
    ours = {(b, n.lower()) for b, n in part}
    theirs = {(b, (re.sub("(.)e", r"\1", n) + " x").lower()) for b, n in part}
    want = {(b, x, y, round(r, 6)) for b, x in ours for d, y in theirs if b == d and (r := SequenceMatcher(None, x, y).ratio()) >= 0.82}
    assert {tuple(r) for r in catalog.QUERIES["similar_part_names"](spark, folder).collect()} == want
