"""Each stage of the pipeline against brute force on its own input, over the smallest tables."""

import os
import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline as cp
from loomstone.llm import mixing, queries, token_counts, toxicity

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def flat(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def shingles(t):
    w = flat(t).lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What each stage reads, and what the last one gives, with odd rows added to the documents."""
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "x", 0), (9003, "only  one", "en", "x", 9), (9004, "only one", "en", "x", 8), (9005, "long " * 30_000, "en", None, 150_000)], docs.schema)
    out = [docs.unionByName(odd)]
    for name, stage in cp.STAGES:
        stage(spark, out[-1], FOLDER).write.parquet(str(root / name))
        out.append(spark.read.parquet(str(root / name)))
    return out


def test_columns(steps):
    assert [name for name, _ in cp.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    assert all(s.columns == cp.COLUMNS for s in steps[:5])


def test_toxic_documents_go(spark, steps):
    scorer = toxicity.Scorer(toxicity.train(steps[0], spark.read.parquet(f"{FOLDER}/labels.parquet"), F.lit(True)))
    want = sorted(r["doc_id"] for r in steps[0].collect() if scorer.score(r["text"])[0] < 0.5)
    assert sorted(r["doc_id"] for r in steps[1].collect()) == want


def test_one_of_equal_texts_stays(steps):
    least = {}
    for r in steps[1].collect():
        least[flat(r["text"])] = min(r["doc_id"], least.get(flat(r["text"]), r["doc_id"]))
    left = {r["doc_id"]: r for r in steps[2].collect()}
    assert sorted(left) == sorted(least.values()) and len(left) == steps[2].count()
    before = {r["doc_id"]: r for r in steps[1].collect()}
    assert all(before[i] == r for i, r in left.items())


def test_one_of_near_copies_stays(steps):
    rows = sorted((r["doc_id"], r["text"]) for r in steps[2].collect())
    left = {r["doc_id"] for r in steps[3].collect()}
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i, _ in rows}
    pairs = 0
    for n, (i, _) in enumerate(rows):
        for j, _ in rows[:n]:
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
                pairs += 1
    assert pairs and left == {i for i, r in root.items() if i == r}
    assert len(left) == steps[3].count()


def test_budgets_are_met(steps):
    want, size = {}, {}
    for r in mixing.mix(steps[3]).collect():
        want[r["doc_id"]] = r["taken"]
        size[r["doc_id"]] = r["size"]
    got, whole = {}, {r["doc_id"]: r["text"] for r in steps[3].collect()}
    for r in steps[4].collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].split())
        assert whole[r["doc_id"]].startswith(r["text"])
    assert got == {i: n for i, n in want.items() if n} and all(n <= 2 * size[i] for i, n in got.items())


def test_pieces_hold_the_mix(steps):
    enc = token_counts.tokenizer(queries.vocabulary())[0]
    want = {}
    for r in steps[4].collect():
        want.setdefault(r["doc_id"], []).append(len(enc.encode(r["text"], add_special_tokens=False).ids) + 1)
    got, windows = {}, {}
    for r in steps[5].collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == {i: sum(n) for i, n in want.items()}
    for w in windows.values():
        w.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(w, w[1:])) and w[0][0] == 0 and sum(n for _, n in w) <= 2048


def test_empty_documents(spark, steps):
    docs = steps[0].limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0
