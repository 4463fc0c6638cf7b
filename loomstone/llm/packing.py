"""Packing: Karmarkar-Karp multiway differencing into sequences of a fixed number of tokens.

Each task tokenises its documents (token_counts' two tiers, here with the ids themselves) and
packs them at once, a group of pieces at a time, so that nothing is shuffled and a task holds
one group. A document longer than a sequence gives full sequences of its own; what is left of
it, or the whole of a shorter one, is a piece of a group.

A group has WINDOWS windows' worth of tokens. Its pieces are partitions with one filled window
each; the two whose fullest and emptiest windows differ most are merged, fullest on emptiest,
until one partition is left: windows of nearly equal length. If one of them is longer than a
sequence, the number of windows rises by one and differencing starts anew. Windows can only be
equal if some pieces are small, so the remainders of documents that had to be cut anyway, and
then the longest others until CRUMBS of the group's tokens are reached, are cut into crumbs.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomstone.llm.common import like, ship
from loomstone.llm.token_counts import frequent_pieces, tokenizer

#: Windows of a group; part of its tokens that is cut into crumbs, and their length.
WINDOWS, CRUMBS, CRUMB = 48, 0.12, 32

_ids: dict = {}


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indexes of sizes, dealt to k windows by Karmarkar-Karp multiway differencing.

    A partition is k sums, fullest first, less the emptiest; at equal spread the older merges
    first, so the outcome depends on the sizes and their order alone.
    """
    if k <= 1:
        return [list(range(len(sizes)))]
    heap = []
    for i, s in enumerate(sizes):
        sums = np.zeros(k, dtype=np.int64)
        sums[0] = s
        heap.append((-s, i, sums, [i, *[None] * (k - 1)]))
    heapq.heapify(heap)
    age = len(sizes)
    # a window's content is None, an index, or a pair of contents
    while len(heap) > 1:
        _, _, a, own = heapq.heappop(heap)
        _, _, b, other = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        merged = [x if y is None else y if x is None else (x, y) for x, y in zip(own, reversed(other), strict=True)]
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), age, sums - sums[-1], [merged[j] for j in order.tolist()]))
        age += 1
    out = []
    for content in heap[0][3] if heap else [None] * k:
        flat, stack = [], [content]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            elif x is not None:
                flat.append(x)
        out.append(sorted(flat))
    return out


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """As few windows as differencing manages, none above capacity; no size may be above it."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = differencing(sizes, k)
        if max((sum(sizes[i] for i in w) for w in dealt), default=0) <= capacity:
            return [w for w in dealt if w]
        k += 1


def crumbled(group: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The pieces (document's place, start, length, whether it is a remainder) with some cut into crumbs."""
    want = int(CRUMBS * sum(p[2] for p in group))
    out, kept = [], []
    for p in sorted(group, key=lambda p: (-p[3], -p[2], p[0], p[1])):
        if want > 0 and p[2] > CRUMB:
            want -= p[2]
            out += [(p[0], p[1] + i, min(CRUMB, p[2] - i), p[3]) for i in range(0, p[2], CRUMB)]
        else:
            kept.append(p)
    return kept + out


def _pack(docs: Iterator[tuple], capacity: int, first: int, with_ids: bool) -> Iterator[dict[str, list]]:
    """Rows of pieces, a group at a time. docs: id and ids as bytes, four for each."""
    group, held, total, sequence = [], [], 0, first
    out: dict[str, list] = {k: [] for k in COLUMNS}

    def put(doc: tuple, start: int, length: int, offset: int) -> None:
        part = doc[1][4 * start : 4 * (start + length)]
        for k, v in zip(COLUMNS, (doc[0], start, length, zlib.crc32(part), len(doc[1]) // 4, sequence, offset, part if with_ids else None), strict=True):
            out[k].append(v)

    def close() -> None:
        nonlocal sequence
        some = crumbled(group)
        for window in windows_of([p[2] for p in some], capacity):
            offset = 0
            for i in window:
                put(held[some[i][0]], some[i][1], some[i][2], offset)
                offset += some[i][2]
            sequence += 1

    for doc in docs:
        n, start = len(doc[1]) // 4, 0
        while n - start >= capacity:
            put(doc, start, capacity, 0)
            sequence += 1
            start += capacity
            if len(out["start"]) >= 4096:
                yield out
                out = {k: [] for k in COLUMNS}
        if n > start:
            group.append((len(held), start, n - start, int(start > 0)))
            held.append(doc)
            total += n - start
        if total >= (WINDOWS - 0.6) * capacity:
            close()
            group, held, total = [], [], 0
            yield out
            out = {k: [] for k in COLUMNS}
    if group:
        close()
    yield out


COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")


def pack(docs: DataFrame, path: str, capacity: int = 2048, end: int = 1, with_ids: bool = False, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    A document is its tokens and the id end, so null and empty texts are a single id. Repeated
    rows are documents of their own. Sequence ids are unique, not gapless: a task's number times
    2^33 and its own count. Texts may be of any length: they are cut into pieces of capacity ids.
    An empty table gives no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    enc, special = tokenizer(path)
    frequent = [p for p in frequent_pieces(docs, text) if not any(s in p for s in special)]
    ids = {p: np.array(e.ids, "<u4").tobytes() for p, e in zip(frequent, enc.encode_batch_fast([" " + p for p in frequent], add_special_tokens=False), strict=True)}
    tier1 = docs.sparkSession.sparkContext.broadcast(ids)
    kind = dict(docs.dtypes)[id]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from loomstone.llm import packing as here
        from loomstone.llm import token_counts as tokens

        look = tokens.Lookup(path, tier1.value, lambda x: struct.pack(f"<{len(x)}I", *x), here._ids)
        last = int(end).to_bytes(4, "little")
        kinds: list = []

        def documents() -> Iterator[tuple]:
            for whole in batches:
                for b in tokens._slices(whole, 1):
                    kinds[:] = [b.schema.field(0).type]
                    yield from ((i, b"".join(look.values(t)) + last) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))

        first = TaskContext.get().partitionId() << 33
        names = here.COLUMNS if with_ids else here.COLUMNS[:-1]
        for out in here._pack(documents(), capacity, first, with_ids):
            if out["start"]:
                yield pa.RecordBatch.from_arrays([pa.array(out[c], kinds[0] if c == "doc_id" else pa.binary() if c == "ids" else pa.int64()) for c in names], list(names))

    return like(docs, [id, text]).mapInArrow(run, schema).withColumnRenamed("doc_id", id)
