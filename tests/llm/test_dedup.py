"""Exact and near duplicates against brute force, on odd rows."""

import hashlib
import math
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomstone.llm import exact_dedup, graph, near, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp long, _sha string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, "x", 1, "y") for i, t in rows], SCHEMA)


ROWS = [(5, "a  b"), (3, "a\tb"), (3, "a\tb"), (None, "a b"), (9, None), (8, ""), (7, " "), (6, "\n "), (1, "x" * 50_000), (2, "x" * 50_000), (4, "A b"), (None, None), (10, "é b")]


def flat(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_marks(spark):
    rows = ROWS + [(100 + i, "copy  of one") for i in range(400)]
    out = exact_dedup.mark_duplicates(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(flat(t), []).append(i)
    by = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in groups.items()}
    kept = {}
    for r in out:
        ids = by[r["text_sha256"]]
        assert r["doc_id"] in ids and r["group_size"] == len(ids)
        assert r["keep_id"] == min((i for i in ids if i is not None), default=None)
        kept[r["text_sha256"]] = kept.get(r["text_sha256"], 0) + r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1} and len(kept) == len(by)
    left = exact_dedup.drop_duplicates(frame(spark, rows))
    assert left.columns == frame(spark, []).columns and left.count() == len(by)
    assert exact_dedup.mark_duplicates(frame(spark, [])).count() == 0


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 4)), min_size=1, max_size=12), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_runs_over_batches(groups, size):
    rows = sorted((f"{g}", n, k) for n, (g, c) in enumerate(groups) for k in range(c))
    rows = [(n * 10 + k, f"t{g}", f"h{g}") for g, n, k in rows]
    rows.sort(key=lambda r: (r[2], r[0]))
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows[i : i + size]], pa.int64()), "_text": [r[1] for r in rows[i : i + size]], "_sha": [r[2] for r in rows[i : i + size]]}) for i in range(0, len(rows), size)]
    out = [r for b in exact_dedup._runs(iter(batches), True, 0) for r in b.to_pylist()]
    assert [r["doc_id"] for r in out] == [r[0] for r in rows]
    digests = list(dict.fromkeys(r[2] for r in rows))
    for r in out:
        own = [x[0] for x in rows if x[2] == r["_sha"]]
        assert (r["_keep"], r["_size"], r["_first"]) == (own[0], len(own), r["doc_id"] == own[0])
        assert r["_edge"] == (r["_sha"] in (digests[0], digests[-1]))
    firsts = [r for b in exact_dedup._runs(iter(batches), False, 0) for r in b.to_pylist()]
    assert [(r["_sha"], r["_size"]) for r in firsts] == [(d, sum(x[2] == d for x in rows)) for d in digests]


def brute(rows, shingle):
    fps = [(i, simhash.fingerprint(t, shingle)[0]) for i, t in rows]
    group = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 3:
                group = [group[b] if g == group[a] else g for g in group]
    return fps, group


def test_near_duplicates(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(200)]
    rows = list(ROWS)
    for g in range(12):
        base = [rng.choice(words) for _ in range(300)]
        for k in range(8):
            own = list(base)
            own[rng.randrange(300)] = f"n{g}{k}"
            rows.append((1000 + 10 * g + k, " ".join(own)))
    out = {}
    for r in simhash.near_duplicates(frame(spark, rows).drop("fp"), shingle=3).collect():
        out.setdefault((r["doc_id"], r["fp"] % 2**64), set()).add(r["component_id"])
    fps, group = brute(rows, 3)
    for k, (i, fp) in enumerate(fps):
        assert out[i, fp] == {min((fps[j][0] for j in range(len(fps)) if group[j] == group[k] and fps[j][0] is not None), default=None)}
    assert simhash.near_duplicates(frame(spark, []).drop("fp")).count() == 0


def test_links_in_dense_keys():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 1, dtype=np.uint64)
    x = np.unique(np.concatenate([centre ^ (np.uint64(1) << rng.integers(26, 64, 1).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(26, 64, 1).astype(np.uint64)) for _ in range(600)]))[:, None]
    a, b = simhash._links(np.full(len(x), (0 << 26) | 5), x, 3)
    assert all((int(x[i, 0]) ^ int(x[j, 0])).bit_count() <= 64 for i, j in zip(a, b, strict=True))
    reached = {0}
    for _ in range(5):
        reached |= {int(j) for i, j in zip(a, b, strict=True) if int(i) in reached} | {int(i) for i, j in zip(a, b, strict=True) if int(j) in reached}
    assert len(reached) == len(x) and len(a) < 2 * len(x)


def test_similar_documents_are_found(spark):
    rng = random.Random(2)
    rows = []
    for g in range(30):
        base = [f"v{rng.randrange(5000)}" for _ in range(400)]
        rows.append((10 * g, " ".join(base)))
        for k in range(1, 4):
            own = list(base)
            for _ in range(5):
                own[rng.randrange(400)] = f"edit{g}{k}"
            rows.append((10 * g + k, " ".join(own)))
    left = {r["doc_id"] for r in simhash.drop_similar(frame(spark, [*rows, (900, None), (901, ""), (None, "lone text")])).collect()}
    assert {900, 901, None} <= left and {10 * g for g in range(30)} <= left
    assert len(left) <= 30 + 3 + 4


def similar_brute(rows):
    """The least id of each row's group, by links of sets of five-word shingles at 0.8."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.lower().split()) for i, t in rows)}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    return root


def test_only_similar_documents_go(spark):
    rng = random.Random(5)
    words = lambda n: [f"u{rng.randrange(9000)}" for _ in range(n)]
    rows = []
    # near 0.7, far within the Hamming limit; one line repeated, with other words around it
    for g in range(40):
        base = words(200)
        rows += [(10 * g, " ".join(base)), (10 * g + 1, " ".join(base[:165] + words(35)))]
    line = words(12)
    rows += [(500 + g, " ".join(line * 40 + words(60))) for g in range(6)]
    # a dense group whose smallest member is too far from most, which others connect; and a chain
    base = words(300)
    rows += [(1000, " ".join(words(40) + base[40:]))]
    rows += [(1001 + k, " ".join(base[: 7 * k] + words(5) + base[7 * k + 5 :])) for k in range(30)]
    chain = words(400)
    rows += [(2000 + k, " ".join(chain[15 * k : 15 * k + 250])) for k in range(10)]
    want = similar_brute(rows)
    left = {r["doc_id"] for r in simhash.drop_similar(frame(spark, rows)).collect()}
    assert left == {i for i, r in want.items() if i == r} and 500 in left and 505 in left


def test_pairs_across_labels_are_complete():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2**63, (1, 2), dtype=np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, (60, 2), dtype=np.uint64))
    key, label = np.repeat([1, 2, 3], [40, 15, 5]), rng.integers(0, 4, 60)
    want = {(i, j) for i in range(60) for j in range(i) if key[i] == key[j] and label[i] != label[j] and np.bitwise_count(x[i] ^ x[j]).sum() <= 3}
    a, b, more = near.across(key, x, label, 3, 60)
    assert {(max(p), min(p)) for p in zip(a.tolist(), b.tolist(), strict=True)} == want and not more.any()
    a, b, more = near.across(key, x, label, 3, 1)
    assert {(max(p), min(p)) for p in zip(a.tolist(), b.tolist(), strict=True)} < want and more.any()


def test_similar_pairs_are_rarely_missed():
    p = math.acos(0.8 / 0.9) / math.pi  # share of bits in which equally large sets at 0.8 differ
    above = lambda n, d: sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(d + 1, n + 1))
    for rows in (1, 50_000, 15_000_000, 50_000_000_000):
        width, blocks, words = simhash.table_sizes(rows)
        assert blocks <= words * (64 // width)
        no_block = (1 - (1 - p) ** width) ** blocks
        assert no_block + above(128, simhash.DIFFER) < 0.0067


def test_busy_keys_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUSY", 32)
    monkeypatch.setattr(near, "BUSY", 32)
    rng = random.Random(6)
    rows, words = [], lambda n: [f"b{rng.randrange(9000)}" for _ in range(n)]
    base = words(300)
    for k in range(300):
        own = list(base)
        for _ in range(rng.randrange(1, 9)):
            own[rng.randrange(300)] = f"e{rng.randrange(9000)}"
        rows.append((k, " ".join(own)))
    rows += [(1000 + k, " ".join(words(120))) for k in range(100)]
    want = similar_brute(rows)
    left = {r["doc_id"] for r in simhash.drop_similar(frame(spark, rows)).collect()}
    assert left == {i for i, r in want.items() if i == r}
    out = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frame(spark, rows).drop("fp"), shingle=5).collect()}
    fps, group = brute(rows, 5)
    least = {g: min(i for (i, _), h in zip(fps, group, strict=True) if h == g) for g in set(group)}
    assert out == {i: least[g] for (i, _), g in zip(fps, group, strict=True)}


def test_open_keys_of_many_tables_are_clustered_once(spark, monkeypatch):
    """All nodes are near and none are linked but two, which only the last step compares: what is clustered grows with the nodes, not with nodes times tables."""
    n, tables, counted = 640, 40, []
    real = near.components

    def told(edges, **more):
        counted.append(edges.count())
        return real(edges, **more)

    monkeypatch.setattr(near, "components", told)
    node, twins = F.col("_node"), (301, 477)
    nodes = spark.range(n).select(
        F.col("id").alias("_node"), F.col("id").alias("_least"), F.lit(4).alias("_size"),
        F.when(F.col("id") == twins[0], 7).when(F.col("id") == twins[1], 56).otherwise(F.expr("shiftleft(1L, cast(id % 60 AS int))")).cast("long").alias("w0"), F.lit(0).cast("long").alias("w1"),
    )
    keys = lambda r: F.array(*[F.lit(t << 40) + F.when(node.isin(*twins), 0).otherwise(F.pmod(F.xxhash64(F.lit(t), node), F.lit(16))) for t in r])
    own = F.when(node.isin(*twins), -1).otherwise(node) * 4
    sets_of = lambda some: some.select("_node", F.array(*[own + k for k in range(4)]).alias("_set"))
    labels = near.groups(nodes, keys, tables, 36, sets_of, near.Tables(spark)).collect()
    assert sorted(r["_node"] for r in labels) == [*twins] and len({r["label"] for r in labels}) == 1
    assert n < sum(counted) < (near.FIRST + 1) * n


def test_keys_stay_open_for_pairs_across_clusters_only(spark, monkeypatch):
    """A dense group without links is clustered by the first tables: of the others, its rows are not looked up again."""
    key, x, label = np.zeros(30), np.zeros((30, 2), np.uint64), np.arange(30)
    assert near.across(key, x, label, 3, 2)[2].any()
    assert not near.across(key, x, label, 3, 2, np.full(30, 7))[2].any()
    a, b, more = near.across(key, x, label, 3, 2, np.repeat([7, 8], 15))
    assert more.any() and len(a) == len(b) == len(more)
    n, tables, counted = 640, 40, []
    real = near._clustered

    def told(rows, *others):
        counted.append(rows.count())
        return real(rows, *others)

    monkeypatch.setattr(near, "_clustered", told)
    node = F.col("_node")
    nodes = spark.range(n).select(F.col("id").alias("_node"), F.col("id").alias("_least"), F.lit(4).alias("_size"), F.expr("shiftleft(1L, cast(id % 60 AS int))").alias("w0"), F.lit(0).cast("long").alias("w1"))
    keys = lambda r: F.array(*[F.lit(t << 40) + F.pmod(F.xxhash64(F.lit(t), node), F.lit(16)) for t in r])
    sets_of = lambda some: some.select("_node", F.array(*[F.when(node >= n - 2, -1).otherwise(node) * 4 + k for k in range(4)]).alias("_set"))
    labels = near.groups(nodes, keys, tables, 36, sets_of, near.Tables(spark)).collect()
    assert sorted(r["_node"] for r in labels) == [n - 2, n - 1] and len({r["label"] for r in labels}) == 1
    assert 0 < sum(counted) < 2 * near.FIRST * n


def test_pairs_in_a_run_connect_clusters():
    x, label = np.zeros((6, 2), np.uint64), np.arange(6)
    a, b = near.chained(np.zeros(6), x, label, 3, np.array([7, 7, 8, 8, 8, 9]))
    assert len(a) == 2 and len(near.chained(np.zeros(6), x, label, 3, np.full(6, 7))[0]) == 0
    x[4:] = np.uint64(255)  # 4 and 5 are near each other alone, 4 is of one cluster with 2
    a, b = near.chained(np.zeros(6), x, label, 3, np.array([7, 7, 8, 8, 8, 9]))
    assert {frozenset(p) for p in zip(np.array([7, 7, 8, 8, 8, 9])[a].tolist(), np.array([7, 7, 8, 8, 8, 9])[b].tolist(), strict=True)} == {frozenset((7, 8)), frozenset((8, 9))}


def test_similar_with_string_ids_and_blank_texts(spark):
    base = " ".join(f"q{k}" for k in range(80))
    rows = [("b", base), ("a", base + " tail"), ("c", "\t"), ("d", "\n"), ("e", None), (None, base), ("f", base.upper())]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    left = sorted((r["doc_id"] or "", r["text"]) for r in simhash.drop_similar(df).collect())
    assert [i for i, _ in left] == ["", "a", "c", "d", "e"]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert graph.components(edges.limit(0)).count() == 0
