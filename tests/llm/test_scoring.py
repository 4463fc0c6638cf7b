"""Toxicity, languages, URLs, shards, mixes and neighbours on small and odd inputs."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.llm import ann, langid, mixing, sharding, toxicity, urls


def test_automaton_finds_what_levenshtein_allows():
    m = toxicity.Matcher(["loser", "worthless"], ["grub"])
    assert m.match("loser") == (0, 0) and m.match("losr") == (0, 1) and m.match("looser") == (0, 1) and m.match("laser") == (0, 1)
    assert m.match("closer") is None and m.match("lasar") is None and m.match("worthles") == (1, 1) and m.match("wortless") == (1, 1) and m.match("wrthles") == (1, 2)
    assert m.match("grubbing") == (2, 0) and m.match("gru") is None and m.match("") is None


def test_context_separates_quotation():
    c = toxicity.Scorer.context
    assert c("he said “ loser ” and left".split(), 3) < c("what a loser now".split(), 2) <= c("you are a loser now".split(), 3)


def test_toxicity_learns(spark):
    rng = random.Random(0)
    docs, labels = [], []
    for i in range(300):
        toxic = i % 4 == 0
        text = [f"w{rng.randrange(400)}" for _ in range(40)]
        if toxic:
            text[3], text[20], text[30] = rng.choice(["scumbag", "vermin"]), "worthless", rng.choice(["scumbag", "vermin"])
        docs.append((i, " ".join(text), "x"))
        labels.append((i, 1, int(toxic)))
    docs += [(300, None, "x"), (301, "", "x"), (None, "you worthles scumbag vermin", "x"), (5, docs[5][1], "x"), (302, "z " * 20_000, "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(d, lab, F.col("doc_id") % 5 != 0)
    out = [r.asDict() for r in toxicity.score(d, model).collect()]
    assert len(out) == len(docs) and all(0 <= r["score"] <= 1 for r in out)
    assert all((r["score"] >= 0.5) == (r["doc_id"] is None or r["doc_id"] < 300 and r["doc_id"] % 4 == 0) for r in out)
    empty = toxicity.train(d, lab.limit(0), F.lit(True))
    assert all(r["score"] < 0.5 for r in toxicity.score(d, empty).collect())
    assert toxicity.score(d.limit(0), model).count() == 0


def test_languages(spark):
    rng = random.Random(0)
    parts = {"aa": ["ban", "dor", "kel"], "bb": ["ish", "und", "ber"], "cc": ["ção", "nho", "éla"]}
    docs = [(i, " ".join("".join(rng.choice(parts[k]) for _ in range(2)) for _ in range(30)), k) for i, k in enumerate(list(parts) * 40)]
    docs += [(900, None, "aa"), (901, "12 !", "aa"), (902, "", None), (903, "日本", None), (904, docs[0][1], None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in langid.identify(d, langid.train(d, F.col("doc_id") % 4 != 2)).collect()}
    assert all(out[i]["lang_pred"] == k for i, _, k in docs[:120])
    assert [out[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and out[903]["lang_pred"] in parts and out[904]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in out.values())
    none = langid.train(d.limit(0), F.lit(True))
    assert langid.identify(d.limit(0), none).count() == 0


def test_false_positives_are_taken_off():
    m = langid.Model(["aa", "bb"], {"aa": langid.grams("abcabcabc", 3), "bb": np.zeros(0, np.uint64)}, "aa")
    assert m.predict("abcabc")[0] == "aa" and m.counts("abcabc")[1] == 0


RULES = (urls.Rule("allow", "com"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"))


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("http://A.Com?x", "a.com", "", None, "allow"), ("http://a.com/", "a.com", "/", "com/", "allow"),
        ("http://x.example.com/en/1#y", "x.example.com", "/en/1", "example.com/en/", "block"), ("http://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://casino.org/", "casino.org", "/", None, "block"), ("http://casinos.org/", "casinos.org", "/", None, "allow"), ("http://free.org/a", "free.org", "/a", None, "allow"),
        ("http://free-bets.org/a", "free-bets.org", "/a", None, "block"), ("http://free-free.org/a://b", "free-free.org", "/a://b", None, "allow"), ("://", "", "", None, "allow"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    r = urls.judge(spark.createDataFrame([(1, url, "v")], "page_id long, url string, verdict string"), RULES).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_shards(spark):
    rows = [(i, "t" * (i % 7), "x") for i in range(3000)] + [(None, None, "x"), (5, "", "x"), (5, "", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    for n in (1, 5, 16, 17):
        out = sharding.assign(d, sharding.tree(n), sharding.grown(sharding.tree(n)), buckets=8).collect()
        assert len(out) == len(rows) and all(r["grown_shard"] in (r["shard"], n) for r in out)
        for s in range(n):
            assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert all(r["text_crc32"] == zlib.crc32(b"t" * (r["size"] - 1)) for r in out)
    light = tuple(sharding.Shard(s.region, s.rack, s.shard, 0.5 if s.shard == 3 else 1.0) for s in sharding.tree(16))
    before, after = (d.select("doc_id", sharding.place(F.col("doc_id"), t).alias("s")).collect() for t in (sharding.tree(16), light))
    moved = [(a["s"], b["s"]) for a, b in zip(before, after, strict=True) if a["s"] != b["s"]]
    assert moved and all(a < 4 for a, _ in moved)  # rows leave only the subtree that got lighter
    assert sharding.assign(d.limit(0), sharding.tree(4)).count() == 0


def test_mix(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), None if i % 9 == 0 else "s" + str(i % 4) if i % 3 else "hot", "x") for i in range(900)] + [(None, None, "s1", "x"), (3, "a  b\n", "s1", "x"), (3, "a  b\n", "s1", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    out = mixing.mix(d).collect()
    assert len(out) == len(rows)
    size = {}
    for i, t, s, _ in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(size), 1.5 * sum(size.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * size[s]
            left -= target[s]
        free -= over
    by_size = {}
    for r in out:
        by_size.setdefault((r["source_size"], round(r["target"], 6)), []).append(r["taken"])
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert {(size[s], round(target[s], 6)) for s in size} == set(by_size)
    assert all(abs(sum(v) - t) <= 1 for (_, t), v in by_size.items())
    whole = mixing.mixed(d).collect()
    assert sum(len(r["text"].split()) for r in whole) == sum(r["taken"] for r in out)
    assert mixing.mix(d.limit(0)).count() == 0 and mixing.mixed(d.limit(0)).count() == 0


def test_hilbert_neighbours_touch():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    key = ann.hilbert(grid, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)].astype(int), axis=0)).sum(axis=1) == 1).all()


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((700, 12)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000, None, 0), (1020, [0.0] * 12, 0), (1040, [float("nan")] * 12, 0), (1060, [None, *[1.0] * 11], 0), (1080, [1.0, 2.0], 0), (None, x[0].tolist(), 0), (20, x[20].tolist(), 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {}
    for r in ann.search(d, every=20, k=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 700, 20))
    hits, wide = 0, x.astype(np.float64)
    for q, rows in got.items():
        s = (wide * wide[q]).sum(axis=1)
        true = sorted((-s[i], i) for i in range(700) if i != q)[:20]
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21)) and all(abs(s[i] - v) < 1e-9 for _, i, v in rows)
        assert [(-round(v, 9), i) for _, i, v in rows] == sorted((-round(v, 9), i) for _, i, v in rows)
        hits += len({i for _, i, _ in rows} & {i for _, i in true})
    assert hits / 20 / len(got) >= 0.9
    few = ann.search(d.where("vec_id < 5"), every=2, k=20).collect()
    assert sorted((r["query_id"], r["rank"]) for r in few) == [(q, k) for q in (0, 2, 4) for k in range(1, 5)]
    assert ann.search(d.limit(0)).count() == 0
