"""Token counts and packing against encoding each whole text."""

import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from hypothesis import given, settings
from hypothesis import strategies as st

from loomstone.llm import packing, queries, token_counts

PATH = queries.vocabulary()
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n b", "a \nb", "a\tb  c\n", "\n", "\n\na b", "it's we'll don't", "x<|endoftext|>y z", "été über 12 3½ ½", "a\x1cb \x85 c", "a b", "日本 語 ", "1 2,3", "!! ?", "word " * 3000, "a" * 5000]


def ids(text):
    return token_counts.tokenizer(PATH)[0].encode(text or "", add_special_tokens=False).ids


@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\ta1.,'é\x1c\x85　s"), st.characters(exclude_categories=["Cs"])), max_size=60))
@settings(max_examples=600, deadline=None)
def test_pieces_give_the_tokens_of_the_whole(text):
    look = token_counts.Lookup(PATH, {}, list, {})
    assert sum(look.values(text), []) == ids(text)


def test_counts(spark):
    texts = [*ODD, None, ODD[5]]
    docs = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    out = {r["doc_id"]: r for r in token_counts.count_tokens(docs, PATH, 3).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        r = out[i if i else None]
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (len(ids(t)), len((t or "").encode()), len(ids(t)) > 3)
    assert token_counts.count_tokens(docs.limit(0), PATH).count() == 0


def test_packing_round_trip(spark):
    texts = [*ODD, None, "one two three " * 900, ODD[3]] * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = packing.pack(docs, PATH, 256, with_ids=True).collect()
    for i, t in enumerate(texts):
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        whole = np.array([*ids(t), 1], "<u4").tobytes()
        assert b"".join(bytes(r["ids"]) for r in own) == whole
        assert all(r["doc_tokens"] == len(whole) // 4 and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in own)
        assert [r["start"] for r in own] == list(np.cumsum([0, *[r["length"] for r in own]])[:-1])
    windows = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for w in windows.values():
        w.sort()
        assert [o for o, _ in w] == list(np.cumsum([0, *[n for _, n in w]])[:-1]) and sum(n for _, n in w) <= 256
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_differencing_is_near_equal():
    rng = np.random.default_rng(0)
    sizes = [*rng.integers(200, 900, 60).tolist(), *[32] * 200]
    dealt = packing.differencing(sizes, 12)
    sums = [sum(sizes[i] for i in w) for w in dealt]
    assert sorted(i for w in dealt for i in w) == list(range(len(sizes)))
    assert max(sums) - min(sums) <= 40
    assert all(sum([1000, 1000, 1000][i] for i in w) <= 1500 for w in packing.windows_of([1000, 1000, 1000], 1500))
