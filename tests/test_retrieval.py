"""The search for all queries against brute force."""

import numpy as np

from loomstone.operators import retrieval
from loomstone.plans import catalog


def test_all_queries_are_searched(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 8))
    x[100:140] = x[100]  # ties
    x[200] = 0
    boost = np.where(np.arange(600) % 3 == 1, 0.08, 0.0)
    rows = [(i, float(boost[i]), x[i].tolist()) for i in range(600)] + [(650, 0.0, None)]
    out = retrieval.nearest_of_all(spark.createDataFrame(rows, "vec_id long, boost double, e array<double>"), block=16).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["q"], -r["score"], r["vec_id"])):
        got.setdefault(r["q"], []).append(r["vec_id"])
    unit = x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None]
    want = {}
    for q in range(0, 600, 50):
        if q != 200:
            s = np.round(unit[q] @ unit.T + boost, 6)
            want[q] = [i for i in np.lexsort((np.arange(600), -s)).tolist() if i not in (q, 200)][:10]
    assert got == want


def test_every_fiftieth_row_is_asked(spark):
    folder = "/root/testdata/sf0.001"
    ids = {r[0] for r in spark.read.parquet(f"{folder}/embeddings.parquet").where("vec_id % 50 = 0").select("vec_id").collect()}
    assert {r["q"] for r in catalog.QUERIES["chunk_retrieval_all"](spark, folder).collect()} == ids


def test_far_blocks_are_skipped(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    x = (centres[:, None] + rng.normal(size=(20, 100, 16)) * 0.05).reshape(-1, 16)
    rows = [(i, 0.0, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, boost double, e array<double>")
    out = retrieval.nearest_of_all(df, every=40, k=5, block=64)
    plan = out._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    got, read = {}, {}
    for r in sorted(out.collect(), key=lambda r: (r["q"], -r["score"], r["vec_id"])):
        got.setdefault(r["q"], []).append(r["vec_id"])
        read[r["q"]] = r["read"]
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    for q in range(0, 2000, 40):
        s = np.round(unit[q] @ unit.T, 6)
        assert got[q] == [i for i in np.lexsort((np.arange(2000), -s)).tolist() if i != q][:5]
    assert sum(read.values()) < 0.3 * 2000 * len(read)  # the share that was compared
    assert retrieval.nearest_of_all(df.limit(0)).count() == 0
    assert retrieval.nearest_of_all(df.where("vec_id < 3"), every=2).count() == 4
