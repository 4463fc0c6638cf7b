"""Near copies by sketches against brute force, and the sketch's own laws."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomstone.llm import common, minhash, near

SCHEMA = "doc_id long, text string, n_shingles string, component_id string, _node long, key string"


def sets_of(rows, k=4):
    words = [(i, (t or "").encode().lower().split()) for i, t in rows]
    return [(i, {b" ".join(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()) for i, w in words]


def brute(rows, k=4):
    """n_shingles, component_id of each row, by all pairs that share a shingle."""
    sets, root = sets_of(rows, k), list(range(len(rows)))

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    at = defaultdict(list)
    for a, (_, s) in enumerate(sets):
        shared = Counter()
        for g in s:
            shared.update(at[g])
            at[g].append(a)
        for b, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[b][1]) - n):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    least = {}
    for a, (i, _) in enumerate(sets):
        least.setdefault(top(a), []).append(i)
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in least.items()}
    return [(i, len(s), least[top(a)]) for a, (i, s) in enumerate(sets)]


def same(spark, rows):
    df = spark.createDataFrame([(i, t, "x", "y", 1, "z") for i, t in rows], SCHEMA)
    got = minhash.near_duplicates(df).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == sorted(brute(rows), key=str)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    return got


def test_bins_are_filled_and_agree_as_often_as_sets_do():
    rng = np.random.default_rng(1)
    full = np.iinfo(np.uint64).max
    for n in (1, 2, 7, 100, 5000):
        assert minhash.sketch(rng.integers(0, 2**64, n, dtype=np.uint64)).max() < full
    # order does not matter, and one sweep gives what single rounds give
    x = rng.integers(0, 2**64, 40, dtype=np.uint64)
    assert (minhash.sketch(x) == minhash.sketch(x[::-1].copy())).all()
    for similarity in (0.5, 0.8):
        agree = []
        for _ in range(200):
            n = 300
            one = rng.integers(0, 2**64, n, dtype=np.uint64)
            shared = round(2 * n * similarity / (1 + similarity))
            two = np.concatenate([one[:shared], rng.integers(0, 2**64, n - shared, dtype=np.uint64)])
            agree.append((minhash.sketch(one) == minhash.sketch(two)).mean())
        assert abs(np.mean(agree) - similarity) < 0.01
        assert np.std(agree) < 1.2 * math.sqrt(similarity * (1 - similarity) / minhash.COORDINATES)


def test_small_sets_agree_as_often_as_sets_do():
    rng = np.random.default_rng(2)
    agree = []
    for _ in range(400):
        x = rng.integers(0, 2**64, 6, dtype=np.uint64)
        agree.append((minhash.sketch(x[:5]) == minhash.sketch(x[1:])).mean())  # 4 of 6
    assert abs(np.mean(agree) - 4 / 6) < 0.02


def test_pairs_at_the_limit_are_not_missed():
    assert minhash.missed(0.8) < 2e-6 and minhash.missed(0.9) < 1e-9
    rng = np.random.default_rng(3)
    for _ in range(300):
        x = rng.integers(0, 2**64, 108, dtype=np.uint64)
        a, b = minhash.sketch(x[:96]), minhash.sketch(x[12:])  # 84 of 108 shared, 0.78: below the limit and yet met
        assert (minhash.bands(a) == minhash.bands(b)).any()
        assert np.bitwise_count(minhash.bits(a) ^ minhash.bits(b)).sum() <= minhash.DIFFER


def test_groups_equal_brute_force(spark):
    rng = random.Random(7)
    words = lambda n: [f"u{rng.randrange(9000)}" for _ in range(n)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (5, "ONE  two"), (None, "one two"), (None, "alone here now then"), (6, "a b c d"), (7, "A b\tc d")]
    rows += [(8, "é b c d e"), (9, "É b c d e")]  # only A-Z are lower-cased
    for g in range(30):
        base = words(150)
        rows += [(100 + 10 * g, " ".join(base)), (101 + 10 * g, " ".join(base[: 130 + g] + words(20 - g if g < 20 else 1)))]
    base = words(300)
    rows += [(1000 + k, " ".join(base[: 7 * k] + words(5) + base[7 * k + 5 :])) for k in range(30)]
    chain = words(400)
    rows += [(2000 + k, " ".join(chain[12 * k : 12 * k + 250])) for k in range(12)]
    line = words(30)
    rows += [(3000 + k, " ".join(line + words(40))) for k in range(20)]  # a shared passage links nothing
    rows += [(4000, " ".join(words(60_000))), (4001, "x " * 50_000)]
    got = same(spark, rows)
    assert sum(not r["kept"] for r in got) > 30
    df = spark.createDataFrame([(i, t, "x", "y", 1, "z") for i, t in rows], SCHEMA)
    left = minhash.drop_near(df)
    gone = {r["doc_id"] for r in got if r["doc_id"] is not None and not r["kept"]}
    assert left.columns == df.columns and left.count() == sum(i not in gone for i, _ in rows)


def test_exact_limit(spark):
    # 40 shingles in all, 32 shared: just 0.8; one fewer is below
    x = [f"s{k}" for k in range(100)]
    rows = [(1, " ".join(x[:39])), (2, " ".join(x[:35])), (3, " ".join(x[50:89])), (4, " ".join(x[58:89]))]
    got = {r["doc_id"]: r["component_id"] for r in same(spark, rows)}
    assert got[2] == 1


def test_hot_groups_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(near, "BUSY", 32)
    rng = random.Random(6)
    words = lambda n: [f"b{rng.randrange(9000)}" for _ in range(n)]
    base, rows = words(200), []
    for k in range(250):
        own = list(base)
        for _ in range(rng.randrange(1, 7)):
            own[rng.randrange(200)] = f"e{rng.randrange(9000)}"
        rows.append((k, " ".join(own)))
    rows += [(1000 + k, " ".join(base)) for k in range(2000)]  # exact copies, a hot node
    rows += [(5000 + k, " ".join(words(60))) for k in range(50)]
    same(spark, rows)


@pytest.mark.parametrize("kind", ["string", "long"])
def test_empty_tables_and_kinds_of_ids(spark, kind):
    df = spark.createDataFrame([], f"doc_id {kind}, text string")
    assert minhash.near_duplicates(df).count() == 0
    if kind == "string":
        df = spark.createDataFrame([("b", "x y z w"), ("a", "x y z w"), ("c", None)], "doc_id string, text string")
        assert sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(df).collect()) == [("a", "a"), ("b", "a"), ("c", "c")]


def test_join_hot_is_a_join(spark):
    rows = spark.createDataFrame([(k % 7, k) for k in range(3000)] + [(100 + k, k) for k in range(500)], "k long, v long")
    per = rows.groupBy("k").count().withColumnRenamed("count", "n").withColumn("w", common.F.col("k") * 2)
    got = common.join_hot(rows, per.where("k <> 3"), ["k"], "n")
    assert sorted((r["k"], r["v"], r["w"]) for r in got.collect()) == sorted((r["k"], r["v"], 2 * r["k"]) for r in rows.collect() if r["k"] != 3)


def test_tables_are_removed(spark):
    import glob
    import os

    store = common.Tables(spark)
    a, b = store.cut(spark.range(5).toDF("x")), store.cut(spark.range(7).toDF("x"))
    assert a.count() == 5 and len(glob.glob(f"{store.folder}/*")) == 2
    store.drop(a, None, spark.range(3))
    assert b.count() == 7 and len(os.listdir(store.folder)) == 1
