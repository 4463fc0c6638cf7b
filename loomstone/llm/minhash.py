"""Near copies by fast similarity sketching, banding and exact verification.

A sketch of a set has COORDINATES bins. In round i every element of the set falls into a hashed bin with a hashed value;
a bin keeps the least (round, value) that fell into it. Rounds end as soon as no bin is empty; from round COORDINATES
on all elements fall into one bin, the next in turn, so every bin is filled after twice as many rounds at the latest. The
bins of two sets agree with the probability of their Jaccard similarity, concentrated as in plain MinHash, but a set
of n elements costs O(n + t log t), not O(n t): about two passes over the set, once it is larger than the sketch.

Bands of bins are join keys (near.groups); a bit of each bin is the sketch that is compared where texts meet; the
sets themselves decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm import near
from loomstone.llm.common import Tables, join_hot, like, ship
from loomstone.llm.simhash import shingle_set

#: Bins of a sketch, and how many are one band: sets at 0.8 agree on no band with 0.59 ** 32, one in twenty million.
COORDINATES, BAND = 128, 4
#: Bits of the 128 (one for each bin) that may differ: 13 are expected at 0.8, with a deviation of 3.4; unlike sets differ in 64.
DIFFER = 32

_ODD = np.random.default_rng(11).integers(0, 2**63, 2 * COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64((1 << 56) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX
    x ^= x >> np.uint64(29)
    return x


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The bins of a set of 64-bit hashes: the round above bit 56, the value below. The set must not be empty."""
    n, t = len(hashes), COORDINATES
    out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    at = max(1, 1024 // n)  # rounds of one sweep: later ones change no bin that an earlier one filled
    start = 0
    while start < 2 * t and out.max() == np.iinfo(np.uint64).max:
        stop = min(start + at, t if start < t else 2 * t)
        rounds = np.arange(start, stop, dtype=np.uint64)
        x = _mixed(hashes[None, :] * _ODD[start:stop, None])
        value = (rounds[:, None] << np.uint64(56)) | ((x >> np.uint64(8)) & _LOW)
        if start < t:
            np.minimum.at(out, (x % np.uint64(t)).astype(np.int64).ravel(), value.ravel())
        else:
            out[start - t : stop - t] = np.minimum(out[start - t : stop - t], value.min(axis=1))
        start = stop
    return out


def bands(bins: np.ndarray) -> np.ndarray:
    """A key of 64 bits for each band of BAND bins; bands have keys of their own."""
    parts = bins.reshape(-1, BAND)
    key = _ODD[: len(parts)].copy()
    for k in range(BAND):
        key = _mixed((key ^ parts[:, k]) * _ODD[-1 - k])
    return key


def bits(bins: np.ndarray) -> np.ndarray:
    """One bit of each bin, in words of 64."""
    one = (_mixed(bins * _ODD[7]) >> np.uint64(63)).astype(np.uint8)
    return np.packbits(one, bitorder="little").view("<u8")


def sketches(docs: DataFrame, shingle: int = 4, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, _node (a hash of the set), w0, w1 (the bits), bands of each row; null but for id and n_shingles without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomstone.llm import minhash, near

        none = [None] * 4
        for b in batches:
            rows = []
            for t in b.column(1):
                s = minhash.shingle_set(t.as_py(), shingle)
                if not len(s):
                    rows.append((0, *none))
                    continue
                bins = minhash.sketch(s)
                node = np.array([near.node_of(s)], np.uint64).view(np.int64)[0]
                rows.append((len(s), node, *minhash.bits(bins).view(np.int64), minhash.bands(bins).view(np.int64)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "n_shingles", "_node", "w0", "w1", "bands"])

    ship(docs.sparkSession)
    schema = f"doc_id {dict(docs.dtypes)[id]}, n_shingles long, _node long, w0 long, w1 long, bands array<long>"
    return like(docs, [id, text]).mapInArrow(run, schema).withColumnRenamed("doc_id", id)


def missed(similarity: float) -> float:
    """The probability that a pair of this similarity is not compared: it agrees on no band, or on too few bits."""
    off = (1 - similarity) / 2
    far = sum(math.comb(COORDINATES, k) * off**k * (1 - off) ** (COORDINATES - k) for k in range(DIFFER + 1, COORDINATES + 1))
    return (1 - similarity**BAND) ** (COORDINATES // BAND) + far


def near_duplicates(docs: DataFrame, shingle: int = 4, id: str = "doc_id", text: str = "text", differ: int = DIFFER) -> DataFrame:
    """id, n_shingles (size of the set), component_id (the smallest id of the group), kept (id = component_id), a row per row.

    Rows are linked if the Jaccard similarity of their sets of distinct shingles (of lower-cased words, as hashes of 64
    bits) is at near.SIMILAR or above, tested on the whole sets; equal sets are linked. A pair is not compared with a
    probability of missed(): less than one in a million at 0.8.

    Texts with fewer words than a shingle have them all as one. Null texts and texts without words have an empty set and
    are linked with nothing; their component is their own id. Null ids count only if a group has no other, and a row with
    a null id alone in its group has a null component and is kept. Rows that repeat an id are each a row; ties do not
    matter. Texts may be of any length. Other columns are ignored, whatever their names; an empty table gives none.
    """
    store = Tables(docs.sparkSession)
    own = store.cut(sketches(docs, shingle, id, text))
    some = own.where("_node IS NOT NULL")
    per = some.groupBy("_node", F.col("n_shingles").alias("_size"), *near.SKETCH, "bands").agg(F.min(id).alias("_least"), F.count("*").alias("_n"))
    nodes = store.cut(per.where("_least IS NOT NULL"))
    labels = near.groups(
        nodes,
        lambda tables: F.slice("bands", tables.start + 1, len(tables)),
        COORDINATES // BAND,
        differ,
        near.text_sets(docs, lambda t: shingle_set(t, shingle), id, text, store),
        store,
    )
    groups = store.cut(near.least_of(nodes, labels, store).select("_node", "component_id", "_n"))
    rows = some.select(id, "n_shingles", "_node")
    linked = join_hot(rows, groups, ["_node"], "_n").select(id, "n_shingles", "component_id")
    # without words, or only null ids have the set
    lone = own.where("_node IS NULL").select(id, "n_shingles", F.col(id).alias("component_id"))
    nameless = rows.where(F.col(id).isNull()).join(groups.select("_node"), "_node", "left_anti").select(id, "n_shingles", F.col(id).alias("component_id"))
    return linked.unionByName(lone).unionByName(nameless).withColumn("kept", F.col(id).eqNullSafe(F.col("component_id")))


def drop_near(docs: DataFrame, shingle: int = 4, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that near_duplicates does not keep; rows that repeat an id stay or go together, null ids stay."""
    gone = near_duplicates(docs, shingle, id, text).where("NOT kept").where(F.col(id).isNotNull()).select(F.col(id).alias("_gone")).distinct()
    return docs.join(near.small(gone, Tables(docs.sparkSession)), F.col(f"`{id}`") == F.col("_gone"), "left_anti")
