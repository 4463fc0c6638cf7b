"""SimHash near-duplicates by pigeonhole blocks.

Each text gets a 64-bit fingerprint. Distinct fingerprints are split into five blocks of bits;
two that differ in at most three bits agree on at least two blocks, so every pair of blocks is a
join key (ten keys of about 26 bits, which few unrelated fingerprints share). Rows meet on a key
by one shuffle and a sort; within a key, Hamming distances are verified in place and only a
forest of links goes on, never all pairs. Components of the links are the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm import near
from loomstone.llm.common import Tables, cut, join_hot, like, ship
from loomstone.llm.graph import components
from loomstone.llm.near import BUSY, FEW

#: Widths of the blocks, from bit 0; they and the distance fit by the pigeonhole principle.
BLOCKS = (13, 13, 13, 13, 12)
#: Rows of a key that are compared all at once; more are first split on the bits that the key leaves open.
DENSE = 4096


def _hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of each shingle (of all words, if they are fewer), in arrays of bounded size."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return
    buf, hash_of = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, n)
    total = n - width + 1
    for at in range(0, total, 65536):
        to = min(total, at + 65536)
        yield np.array([hash_of(buf[s:e], 42) for s, e in zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist(), strict=True)], "<u8")


def _signs(parts: Iterable[np.ndarray], words64: int) -> list[int]:
    counts, total = np.zeros((words64, 64), np.int64), 0
    for h in parts:
        total += len(h)
        for k in range(words64):
            if k:
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            counts[k] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return [int.from_bytes(np.packbits(c * 2 > total, bitorder="little").tobytes(), "little") for c in counts]


#: An odd factor for each word of a wide fingerprint.
ODD = np.random.default_rng(8).integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def set_fingerprint(hashes: np.ndarray, words64: int) -> list[int]:
    """words64 numbers of 64 bits: the majority, bit by bit, of hashes mixed anew for each word. Each shingle counts once, as in Jaccard similarity."""
    counts, n = np.zeros(64 * words64, np.int64), len(hashes)
    step = max(1, (1 << 20) // (64 * words64))
    for at in range(0, n, step):
        h = hashes[at : at + step, None] * ODD[None, :words64]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        bits = np.unpackbits(h.view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # sums of 255 bits fit a byte, which adds up fastest
            counts += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > n, bitorder="little").view("<u8").tolist()


def fingerprint(text: str | None, shingle: int = 5, words64: int = 1) -> list[int]:
    """words64 unsigned numbers of 64 bits; zero if there are no words.

    The first comes from XXH64 of the shingles, further ones from that hash, mixed with odd constants.
    """
    return _signs(_hashes(text, shingle), words64)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct hashes of the shingles, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_hashes(text, shingle)]))


def fingerprints(docs: DataFrame, shingle: int = 5, words64: int = 1, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id and fp, fp1, ... (the fingerprint as signed longs) of each row; nothing is shuffled."""
    ship(docs.sparkSession)
    names = ["fp", *[f"fp{k}" for k in range(1, words64)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomstone.llm.simhash import fingerprint

        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle, words64) for t in b.column(1)], np.uint64).view(np.int64).reshape(b.num_rows, words64)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(fp[:, k].copy()) for k in range(words64)]], ["doc_id", *names])

    return like(docs, [id, text]).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id]}, " + ", ".join(f"{c} long" for c in names)).withColumnRenamed("doc_id", id)


def _forest(x: np.ndarray, distance: int, direct: bool = False) -> list[tuple[int, int]]:
    """Links (places in x) from the first place of each group to all others that the distance connects to it.

    Breadth first: each place reached is compared with all not reached yet, so a dense group costs
    little more than its size. Few but far values are compared with each other. Stars with the
    smallest place in the middle are much the same for each key, so that few links are left in all.
    With direct, links start at the place that reached the other, so that their ends are within the distance.
    """
    out, left = [], np.arange(len(x))
    while len(left):
        first, queue, left = int(left[0]), [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = near.within(x[left], x[at], distance)
            if hit.any():
                reached = left[hit].tolist()
                out += [(at if direct else first, j) for j in reached]
                queue += reached
                left = left[~hit]
    return out


def _dense(x: np.ndarray, free: list[int], distance: int) -> list[tuple[int, int]]:
    """_forest of many values of one word: split once more on distance + 1 parts of the bits that may differ."""
    parts = [p for p in np.array_split(np.array(free), distance + 1) if len(p)]
    if len(x) <= DENSE or len(parts) <= distance:
        return _forest(x, distance)
    out = []
    for p in parts:
        own_bits = x[:, 0] & np.uint64(sum(1 << int(b) for b in p))
        order = np.argsort(own_bits, kind="stable")
        edges = np.flatnonzero(np.diff(own_bits[order])) + 1
        rest = [b for b in free if b not in set(p.tolist())]
        for own in np.split(order, edges):
            if len(own) > 1:
                out += [(int(own[i]), int(own[j])) for i, j in _dense(x[own], rest, distance)]
    return out


def _links(key: np.ndarray, x: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (places in x) within runs of equal keys; key is sorted."""
    starts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
    sizes = np.diff(np.concatenate((starts, [len(key)])))
    a, b = [], []
    for s, n in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
        if x.shape[1] == 1:
            closed = {bit for k in PAIRS[(int(key[s]) >> 26) & 15] for bit in range(LOW[k], LOW[k] + BLOCKS[k])}
            found = _dense(x[s : s + n], [bit for bit in range(64) if bit not in closed], distance)
        else:
            found = _forest(x[s : s + n], distance, direct=True)
        if found:
            i, j = np.array(found).T
            a.append(i + s)
            b.append(j + s)
    small = np.flatnonzero(np.repeat((sizes <= FEW) & (sizes > 1), sizes))
    key, x = key[small], x[small]
    for lag in range(1, min(FEW, int(sizes[sizes <= FEW].max(initial=0)))):
        hit = np.flatnonzero(key[lag:] == key[:-lag])
        hit = hit[near.within(x[hit + lag], x[hit], distance)]
        a.append(small[hit])
        b.append(small[hit + lag])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


LOW = tuple(sum(BLOCKS[:k]) for k in range(len(BLOCKS)))
PAIRS = tuple(combinations(range(len(BLOCKS)), 2))


def _block_keys() -> list[Column]:
    """Ten keys of column fp: each pair of its five blocks, and the pair's number above bit 26."""
    block = [F.shiftrightunsigned("fp", LOW[k]).bitwiseAND((1 << BLOCKS[k]) - 1) for k in range(len(BLOCKS))]
    return [F.lit(n << 26).bitwiseOR(F.shiftleft(block[i], 13)).bitwiseOR(block[j]) for n, (i, j) in enumerate(PAIRS)]


def links(keyed: DataFrame, distance: int) -> DataFrame:
    """a, b: links between the nodes of (key, _node, words of the fingerprint) that share a key."""

    def some(columns: tuple) -> pa.RecordBatch:
        from loomstone.llm.simhash import _links

        key, node, *words = columns
        a, b = _links(key, np.stack(words, axis=1).view(np.uint64), distance)
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    return near.by_key(keyed, some, "a long, b long")


def _thinned(keyed: DataFrame, distance: int) -> DataFrame:
    """keyed, where rows of a key with more than BUSY of them (by a sample of a 16th) have several narrower keys.

    By the same principle once more: of distance + 1 parts of the bits that the key leaves open, two near
    fingerprints agree on one. Rows of any other key stay as they are.
    """
    sample = keyed.where(F.pmod(F.xxhash64(F.lit("busy"), "_node"), F.lit(16)) == 0)
    busy = cut(sample.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > BUSY // 16).select("key", F.lit(True).alias("_busy")))
    if busy.isEmpty():
        return keyed
    parts = []
    for pair in PAIRS:
        closed = {bit for k in pair for bit in range(LOW[k], LOW[k] + BLOCKS[k])}
        parts.append([sum(1 << int(b) for b in p) for p in np.array_split(np.array([b for b in range(64) if b not in closed]), distance + 1)])
    # the number of the pair of blocks stands above bit 26 of a key; the narrower key keeps it, so that _links knows the open bits
    masks = F.array(*[F.array(*[F.lit(m - (1 << 64) if m >= 1 << 63 else m) for m in p]) for p in parts])
    own = F.get(masks, F.shiftright("key", 26).cast("int"))
    narrow = F.transform(own, lambda m, i: F.shiftleft(F.pmod(F.xxhash64("key", i, F.col("fp").bitwiseAND(m)), F.lit(1 << 30)), 32).bitwiseOR(F.col("key")))
    marked = keyed.join(busy, "key", "left")
    return marked.select(F.explode(F.when(F.col("_busy"), narrow).otherwise(F.array("key"))).alias("key"), "_node", "fp")


def near_duplicates(docs: DataFrame, shingle: int = 5, distance: int = 3, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, fp, component_id (the smallest id of the group), one row per row of docs.

    Groups are what links of up to distance bits (3 at most) of 64 connect; none is missed. Null and
    empty texts share fingerprint zero and are linked like any others; rows with the same text or id
    stay rows of their own; null ids count only if a group has no other. Other columns are ignored,
    an empty table gives an empty result. Texts may be of any length: shingles are hashed in parts.
    """
    if not 0 <= distance <= 3:
        raise ValueError("five blocks, two of them equal, allow for up to three differing bits")
    own = cut(fingerprints(docs, shingle, 1, id, text))
    nodes = own.groupBy("fp").agg(F.min(id).alias("_least"), F.count("*").alias("_n"))
    keyed = nodes.select(F.explode(F.array(*_block_keys())).alias("key"), F.col("fp").alias("_node"), "fp")
    roots = components(links(_thinned(keyed, distance), distance))
    nodes = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = nodes.groupBy("root").agg(F.min("_least").alias("component_id"))
    groups = cut(nodes.select("fp", "root", "_n").join(least, "root").select("fp", "component_id", "_n"))
    return join_hot(own, groups, ["fp"], "_n").select(id, "fp", "component_id")


#: Bits of the 128 carried ones that near copies may differ in: 19 are expected at similarity 0.8, with a deviation of 4.
DIFFER = 36


def table_sizes(nodes: int, missed: float = 0.0065) -> tuple[int, int, int]:
    """Bits of a block, blocks, and words of 64 bits, for so many different texts.

    Sets at similarity 0.8 differ in a share of acos(0.8 / 0.9) / pi = 0.15 of their bits, so they agree on a block
    with 0.85 ** bits. There are as many blocks as leave all of them different with the probability missed. Blocks grow
    with the logarithm of the number of texts, so that unlike texts seldom share one; what is missed stays the same.
    """
    of, whole = near.SIMILAR
    same = 1 - math.acos(2 * of / (of + whole)) / math.pi
    width = max(16, math.ceil(math.log2(max(1, nodes))) - 6)
    blocks = math.ceil(math.log(missed) / math.log1p(-(same**width)))
    return width, blocks, -(-blocks // (64 // width))


def _table_keys(words: list[str], width: int, tables: range) -> Column:
    """The number of each table above its block of the fingerprint; no block lies across two words."""
    per = 64 // width
    block = [F.shiftrightunsigned(words[t // per], width * (t % per)).bitwiseAND((1 << width) - 1) for t in tables]
    return F.array(*[F.lit(t << 40).bitwiseOR(x) for t, x in zip(tables, block, strict=True)])


def _set_sketches(docs: DataFrame, shingle: int, id: str, text: str, words: list[str]) -> DataFrame:
    """id, _node (a hash of the set of shingles), _size (of the set) and words of its fingerprint, for texts with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomstone.llm import near
        from loomstone.llm.simhash import set_fingerprint, shingle_set

        for b in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in b.column(1)]
            some = np.array([len(s) > 0 for s in sets], bool)
            rows = [[near.node_of(s), len(s), *set_fingerprint(s, len(words))] for s in sets if len(s)]
            x = np.array(rows, np.uint64).view(np.int64).reshape(-1, len(words) + 2)
            columns = [b.column(0).filter(pa.array(some)), *[pa.array(x[:, k].copy()) for k in range(len(words) + 2)]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_node", "_size", *words])

    ship(docs.sparkSession)
    schema = f"doc_id {dict(docs.dtypes)[id]}, _node long, _size long, " + ", ".join(f"{c} long" for c in words)
    return like(docs, [id, text]).mapInArrow(run, schema).withColumnRenamed("doc_id", id)


def similar_groups(
    docs: DataFrame, shingle: int = 5, id: str = "doc_id", text: str = "text", missed: float = 0.0065, differ: int = DIFFER
) -> DataFrame:
    """id, component_id of the documents that have near copies (Jaccard similarity of sets of shingles 0.8 or more).

    A fingerprint of the set of shingles is split into blocks (table_sizes), and texts meet that agree on one
    (near.groups). The Hamming distance of 128 bits is verified where they meet, then the sets themselves (as hashes of
    64 bits) decide: only pairs at near.SIMILAR are links. missed is the probability that two texts at just 0.8 agree on
    no block: the smaller, the more blocks; differ bits of 128 may differ (128 compares all that meet).

    Equal sets are one node. Null texts and texts without words belong to no group, rows with a null id to none unless
    their set is also another row's; repeated rows are a group, as equal texts are; an empty table gives no row. Texts
    may be of any length. Other columns are ignored. Ids may be of any type that has an order.
    """
    store = Tables(docs.sparkSession)
    width, blocks, n_words = table_sizes(docs.count(), missed)
    words = [f"w{k}" for k in range(n_words)]
    own = store.cut(_set_sketches(docs, shingle, id, text, words))
    nodes = store.cut(own.groupBy("_node", "_size", *words).agg(F.min(id).alias("_least"), F.count("*").alias("_n")).where("_least IS NOT NULL"))
    labels = near.groups(
        nodes,
        lambda tables: _table_keys(words, width, tables),
        blocks,
        differ,
        near.text_sets(docs, lambda t: shingle_set(t, shingle), id, text, store),
        store,
    )
    groups = store.cut(near.least_of(nodes, labels, store).where("_all > 1").select("_node", "component_id", "_n"))
    return join_hot(own.select(id, "_node"), groups, ["_node"], "_n").select(id, "component_id")


def drop_similar(docs: DataFrame, shingle: int = 5, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents of similar_groups, but for the one with the smallest id of each group.

    Rows with null texts, without words or with a null id stay; rows that repeat an id stay or go together; columns of any
    name are kept; an empty table gives none.
    """
    gone = similar_groups(docs, shingle, id, text).where(F.col(id) != F.col("component_id")).select(F.col(id).alias("_gone")).distinct()
    return docs.join(near.small(gone, Tables(docs.sparkSession)), F.col(f"`{id}`") == F.col("_gone"), "left_anti")
