"""Whitening against numpy on the fit list."""

import math

import numpy as np
import pytest

from loomstone.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, component int, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", 1, "b") for i, v in rows], SCHEMA)


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


def check(spark, rows, dim, most=16, by_count=False):
    good = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if usable(v) and len(v) == dim]
    fit = [x for _, x in good] if by_count else sorted({tuple(x) for _, x in good})
    X = np.array(fit, dtype=np.int64)
    n, S = len(fit), [sum(int(x[d]) for x in fit) for d in range(dim)]
    xc = X - np.array([s / n for s in S])
    V = xc.T @ xc / n
    e, vectors = np.linalg.eigh(V)
    e, vectors = e[::-1], vectors[:, ::-1]
    k = min(most, dim, int((e > 1e-9 * e[0]).sum()))
    got = whitening.whiten(frame(spark, rows), most=most, by_count=by_count).collect()
    assert len(got) == k * len(good)
    by_id = {}
    for r in got:
        by_id.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r
    for i, x in good:
        far = sum((n * a - s) ** 2 for a, s in zip(x, S, strict=True))
        r = by_id[i, far]
        mine = np.array([r[c + 1]["whitened"] for c in range(k)])
        want = (np.array(x) - np.array([s / n for s in S])) @ vectors[:, :k] / np.sqrt(e[:k])
        assert np.allclose(np.abs(mine), np.abs(want), atol=1e-6)
        assert all(r[c + 1]["n"] == n and abs(r[c + 1]["explained"] / (e[c] / e.sum()) - 1) < 1e-6 for c in range(k))
    errors = {r["identity_error"] for r in got}
    assert len(errors) <= 1 and max(errors, default=0) < 1e-6
    return by_id


def test_equal_to_numpy(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 24)) * np.linspace(0.2, 3, 24)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[7].tolist()) for i in range(1500)]
    rows += [(2000, None), (2001, []), (2002, [None] * 24), (2003, [float("nan")] * 24), (2004, [float("inf")] * 24), (2005, [1.0] * 23), (None, base[3].tolist()), (5, base[5].tolist())]
    out = check(spark, rows, 24)
    # one sign for all rows: whitened values are a linear map of the vectors
    a, b = (np.array([next(v for (i, _), v in out.items() if i == k)[c + 1]["whitened"] for c in range(16)]) for k in (0, 1007))
    assert not np.allclose(a, b)
    check(spark, rows, 24, most=5, by_count=True)


def test_few_dimensions_and_no_spread(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(a), float(b), float(a + b)]) for i, (a, b) in enumerate(rng.integers(-5, 5, (60, 2)))]  # two directions only
    check(spark, rows, 3)
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None)])).count() == 0


def test_wide_values_and_hot_vectors(spark):
    # sums of squares beyond a long are null; the second direction is below what doubles tell from the first
    rows = [(i, [float(2**30 * (i % 7)), float(i)]) for i in range(40)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 40 and any(r["deviation"] is None for r in got) and max(r["identity_error"] for r in got) < 1e-4
    assert whitening.whiten(frame(spark, [(1, [3e38, 1.0]), (2, [1.0, 0.0]), (3, [0.0, 4.0])])).count() in (2, 4)


def test_hashes_in_common_fall_back_to_vectors(spark, monkeypatch):
    one = whitening.F.lit(1).cast("long")
    monkeypatch.setattr(whitening.F, "xxhash64", lambda *a: one)
    rng = np.random.default_rng(3)
    check(spark, [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((30, 4)))], 4)


def test_registered_query(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables here")
    from loomstone.llm import queries

    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    out = queries.op12_whitening(spark, "/root/testdata/sf0.001").collect()
    assert len(out) == 16 * sum(usable(r["embedding"]) for r in rows) and max(r["identity_error"] for r in out) < 1e-4
