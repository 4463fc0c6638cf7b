"""Fill-in-the-middle against a plain version over code points, and round trips."""

import hashlib
import os
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomstone.llm import fim, queries

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
MARKS = tuple(m.encode() for m in (fim.PREFIX, fim.SUFFIX, fim.MIDDLE))
TEXT = st.text(st.sampled_from("ab \t\n<>PSM\x1c é€😀"), max_size=60)


def plainly(text, id, seed=42, rate=50, spm=80, unit="token"):
    text = text or ""
    u = UNIT.findall(text) if unit == "token" else list(text)
    h = hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(u)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=400, deadline=None)
@given(TEXT, st.integers(0, 500), st.sampled_from(["token", "char"]))
def test_as_over_code_points(text, id, unit):
    n, form, p, m, out = fim.transformed(text.encode(), id, 42, 90, 50, unit, MARKS)
    assert (n, form, p, m, out.decode()) == plainly(text, id, 42, 90, 50, unit)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_index_turns_places_both_ways(text):
    index = fim.Exceptions(np.frombuffer(text.encode(), np.uint8))
    assert index.chars == len(text) and len(index.at_byte) == sum(ord(c) > 127 for c in text)
    for k in range(len(text) + 1):
        byte = len(text[:k].encode())
        assert index.char_of(byte) == k and index.byte_of(k) == byte


def test_rows_and_round_trip(spark):
    rows = [(None, "a b c d e f"), (1, None), (2, ""), (3, " \t "), (4, "has <M> in it"), (5, "x"), (5, "x"), (6, "é" * 70_000 + " end"), (7, "w " * 200_000)]
    rows += [(10 + k, f"  word{k} <é{'😀' * (k % 5)}\tthree < P> S>  ") for k in range(300)]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, n int, form string, output string")
    for unit in ("token", "char"):
        out = fim.transform(df, rate=70, unit=unit).withColumn("back", fim.restored(F.col("output"), F.col("form")))
        got = out.collect()
        want = sorted(((i, *plainly(t, i, rate=70, unit=unit), t or "") for i, t in rows), key=str)
        assert sorted((tuple(r) for r in got), key=str) == want
        assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fim.transform(df, unit="line")
    ids = spark.createDataFrame([("k1", "a b c"), ("k2", "d e")], "doc_id string, text string")
    assert sorted(tuple(r)[:2] for r in fim.transform(ids).collect()) == [("k1", 3), ("k2", 2)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
@pytest.mark.parametrize("name", ["op11_minhash", "op13_fill_in_middle"])
def test_query_equals_its_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    ours = queries.QUERIES[name](spark, folder)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    theirs = c.execute(queries.ORACLES[name])
    names = [d[0] for d in theirs.description]
    assert sorted(names) == sorted(ours.columns)
    assert sorted(map(str, theirs.fetchall())) == sorted(str(tuple(r)) for r in ours.select(*names).collect())
