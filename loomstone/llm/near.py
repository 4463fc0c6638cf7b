"""Groups of near copies: candidates that share a key, compared in place, confirmed by their sets, contracted.

Two operators use this with keys of their own: blocks of a wide SimHash, and bands of a MinHash sketch. Either gives each
text (a node: all texts with one set of shingles) some keys and a sketch of 128 bits. Nodes with a key in common meet in
one task, which compares their sketches and passes on pairs that no links connect yet. The sets of these pairs decide.
Their components become labels, and the next keys only look at pairs of different labels, so a dense group is never
listed pair by pair. Where a node has more candidates than it passes on, the key stays open, and what is near each other
there becomes a cluster. Later keys stay open only for pairs that are not of one cluster, so a dense group is clustered by
a few keys, not by all that it has. At the end, clusters of several labels are settled whole: their texts meet with
their sets, in blocks of bounded size, and every pair is compared in place; only the links that join labels leave a
task. So no link among candidates is lost, and what is written grows with the rows, not with their pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import Tables, join_hot, like, ship
from loomstone.llm.graph import components

#: Jaccard similarity of near copies, as a fraction.
SIMILAR = (4, 5)
#: Columns of a node's sketch, 64 bits each.
SKETCH = ("w0", "w1")
#: Rows of a key whose pairs are all looked at in one sweep over many keys.
FEW = 4
#: Rows of a key that one task should get at most, about; a key with more is split.
BUSY = 8192
#: Pairs that a node gives for a key, besides the one with the node in the middle of all.
NEAREST = 2
#: Texts of a cluster, and elements of their sets, that a block has on each of its two sides, about.
BLOCK, BLOCK_ELEMENTS = 512, 1_000_000
#: Ids or keys that a broadcast may hold (4 MB of numbers); more are joined by a shuffle.
SMALL = 500_000
#: Tables of keys whose rows are shuffled at once: some first, which give most labels and clusters, then more. A row is six numbers.
FIRST, AT_ONCE = 8, 30


def within(x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    """Whether rows of 64-bit words differ in distance bits or fewer."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64) <= distance


def across(
    key: np.ndarray, x: np.ndarray, label: np.ndarray, distance: int, most: int, cluster: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (places in x) within runs of equal keys that are near but have different labels, and whether some of different clusters were left out.

    Of a run of more than 2 * FEW, each place outside its most common label gives the nearest most of its pairs;
    every such pair has an end outside that label, so what is not left out is complete. The place nearest to all (to a few
    of them, evenly drawn) gives its pair with each other one, too, since copies are closer to what they were copied from than to each other;
    a place that has more than most and is near that one gives this pair alone. Without clusters each place is its own.
    """
    starts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
    sizes = np.diff(np.concatenate((starts, [len(key)])))
    mixed = np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts)
    few = 2 * FEW
    a, b, more = [], [], []
    for s, n in zip(starts[mixed & (sizes > few)].tolist(), sizes[mixed & (sizes > few)].tolist(), strict=True):
        y, own = x[s : s + n], label[s : s + n]
        known = np.arange(n) if cluster is None else cluster[s : s + n]
        values, times = np.unique(own, return_counts=True)
        outer = np.flatnonzero(own != values[times.argmax()])
        few_of_all = y[np.linspace(0, n - 1, min(n, 32)).astype(np.int64)]
        middle = int(np.bitwise_count(y[:, None] ^ few_of_all[None]).sum(axis=(1, 2), dtype=np.int64).argmin())
        star = np.flatnonzero((own != own[middle]) & within(y, y[middle], distance))
        to_middle, left_out = np.zeros(n, bool), np.zeros(n, bool)
        to_middle[star] = True
        step = max(1, 1_000_000 // n)
        for at in range(0, len(outer), step):
            i = outer[at : at + step]
            d = np.bitwise_count(y[i][:, None] ^ y[None]).sum(axis=-1, dtype=np.int64)
            d[own[i][:, None] == own[None]] = 1 << 20
            hits = (d <= distance).sum(axis=1)
            apart = (d <= distance) & (known[i][:, None] != known[None])
            apart[:, middle] &= ~to_middle[i]  # that pair is given anyway
            alone = (hits > most) & to_middle[i]
            left_out[i[alone]] = apart[alone].any(axis=1)
            # of what has more than it may pass on, and is near the middle, that one pair stands for all: the key stays open
            for k in np.flatnonzero((hits > 0) & ((hits <= most) | ~to_middle[i])).tolist():
                found = np.argsort(d[k], kind="stable")[: min(most, int(hits[k]))]
                a.append(np.full(len(found), s + i[k]))
                b.append(found + s)
                more.append(np.full(len(found), hits[k] > most and i[k] != middle and apart[k].sum() > apart[k, found].sum()))
        a.append(np.full(len(star), s + middle))
        b.append(star + s)
        more.append(left_out[star])
    small = np.flatnonzero(np.repeat(mixed & (sizes <= few), sizes))
    key, x, label = key[small], x[small], label[small]
    for lag in range(1, min(few, len(key))):
        hit = np.flatnonzero((key[lag:] == key[:-lag]) & (label[lag:] != label[:-lag]))
        hit = hit[within(x[hit + lag], x[hit], distance)]
        a.append(small[hit])
        b.append(small[hit + lag])
        more.append(np.zeros(len(hit), bool))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b]), np.concatenate([none.astype(bool), *more])


def by_key(keyed: DataFrame, some: Callable[[tuple], pa.RecordBatch], schema: str, by: str = "key") -> DataFrame:
    """What some makes of the columns of keyed (by is the first), given as arrays that hold their keys whole and sorted.

    One shuffle and a sort; each task reads its keys as a stream and holds one batch and the key at its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def joined(parts: list[tuple]) -> tuple:
            return tuple(np.concatenate(c) for c in zip(*parts, strict=True))

        for t in batches:
            if not t.num_rows:
                continue
            columns = [c.to_numpy() for c in t.columns]
            key = columns[0]
            last = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if last or (held and held[-1][0][-1] != key[0]):
                yield some(joined([*held, tuple(c[:last] for c in columns)]))
                held = []
            held.append(tuple(c[last:] for c in columns))
        if held:
            yield some(joined(held))

    return keyed.repartition(by).sortWithinPartitions(by, "_node").mapInArrow(run, schema)


def _candidates(rows: DataFrame, distance: int, most: int) -> DataFrame:
    """a, b, la, lb, key, more: pairs of nodes that share a run and have different labels, each node's nearest ones."""

    def some(columns: tuple) -> pa.RecordBatch:
        from loomstone.llm.near import across

        run, node, label, cluster, key, *fp = columns
        a, b, more = across(run, np.stack(fp, axis=1).view(np.uint64), label, distance, most, cluster)
        swap = node[a] > node[b]
        own = key[a]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        out = (node[a], node[b], label[a], label[b], own, more)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["a", "b", "la", "lb", "key", "more"])

    ship(rows.sparkSession)
    rows = rows.select("run", "_node", "label", "cluster", "key", *SKETCH)
    return by_key(rows, some, "a long, b long, la long, lb long, key long, more boolean", "run")


def small(rows: DataFrame, store: Tables) -> DataFrame:
    """rows as a table, broadcast if they are few, so that what they are joined to is not shuffled; many are joined by a shuffle."""
    rows = store.cut(rows)
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def _busy_keys(keyed: DataFrame, turn: int) -> DataFrame:
    """Of keys with more than BUSY rows (by a sample of a 16th): top (its most common label), pieces, and a node outside that label."""
    sample = keyed.where(F.pmod(F.xxhash64(F.lit("busy"), "_node"), F.lit(16)) == 0)
    own = F.struct("_node", "label", *SKETCH)
    per = sample.groupBy("key", "label").agg(F.count("*").alias("n"), F.min(own).alias("one"))
    by = F.xxhash64(F.lit(turn), "label")
    keys = per.groupBy("key").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"), F.min_by("one", by).alias("x"), F.max_by("one", by).alias("y")
    )
    centre = F.when(F.col("x.label") != F.col("top.label"), F.col("x")).otherwise(F.col("y"))
    outside = F.col("n") - F.col("top.n")
    pieces = lambda n: F.greatest(F.lit(1), F.ceil(n * 16 / (BUSY // 2)).cast("int"))
    return keys.where(F.col("n") > BUSY // 16).select(
        "key", F.col("top.label").alias("top"), pieces(outside).alias("outer"), pieces(F.col("top.n")).alias("inner"), outside.alias("outside"), centre.alias("centre")
    )


def _dealt(rows: DataFrame, tops: DataFrame, key: str) -> DataFrame:
    """rows with a run: their key, or for keys in tops (key, top, outer, inner) the blocks of its pieces that they belong to.

    Rows of the label top are dealt in inner pieces, all others in outer ones. Each outer piece meets each other one and each
    inner one in a block; inner ones don't meet, since nothing is to be compared there. So a block has two pieces, and any two rows
    of different labels share one.
    """
    o, i = F.col("outer"), F.col("inner")
    own_outer, own_inner = F.pmod(F.hash("_node"), o), F.pmod(F.hash("_node"), i)
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    with_outer = F.transform(upto(o), lambda j: F.struct(F.lit(0).alias("k"), F.least(own_outer, j).alias("i"), F.greatest(own_outer, j).alias("j")))
    with_inner = F.transform(upto(i), lambda j: F.struct(F.lit(1).alias("k"), own_outer.alias("i"), j.alias("j")))
    of_inner = F.transform(upto(o), lambda j: F.struct(F.lit(1).alias("k"), j.alias("i"), own_inner.alias("j")))
    blocks = F.when(F.col("label") == F.col("top"), of_inner).otherwise(F.concat(with_outer, with_inner))
    blocks = F.when(o.isNull(), F.array(F.struct(F.lit(0).alias("k"), F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(blocks)
    return rows.join(tops, key, "left").withColumn("_b", F.explode(blocks)).withColumn("run", F.xxhash64(key, "_b.k", "_b.i", "_b.j")).drop("_b", "top", "outer", "inner")


def chained(key: np.ndarray, x: np.ndarray, label: np.ndarray, distance: int, cluster: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A forest of pairs (places in x) that connects all places of a run that are near with different labels, breadth first.

    Places of one cluster are connected already, so pairs are given only as far as they connect clusters.
    """
    starts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
    a, b = [], []
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
        left = np.arange(s, e)
        known = left if cluster is None else cluster[s:e]
        if (known == known[0]).all() or (label[s:e] == label[s]).all():
            continue
        own = np.unique(known, return_inverse=True)[1]
        root = list(range(int(own.max()) + 1))

        def top(k: int, root: list[int] = root) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        while len(left) > 1:
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                at = queue.pop()
                hit = (label[left] != label[at]) & within(x[left], x[at], distance)
                if hit.any():
                    reached = left[hit].tolist()
                    for j in reached:
                        p, q = top(int(own[at - s])), top(int(own[j - s]))
                        if p != q:
                            root[p] = q
                            a.append(at)
                            b.append(j)
                    queue += reached
                    left = left[~hit]
    return np.array(a, np.int64), np.array(b, np.int64)


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets have in common: a product of 0-1 matrices, some columns at a time."""
    n = len(sets)
    every = np.concatenate(sets)
    values, place, times = np.unique(every, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    common = times[place] > 1
    column = np.cumsum(times > 1)[place[common]] - 1
    row, order = row[common], np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out, step = np.zeros((n, n), np.float32), max(64, (1 << 22) // n)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        i, j = np.searchsorted(column, [at, at + step])
        part = np.zeros((n, step), np.float32)
        part[row[i:j], column[i:j] - at] = 1
        out += part @ part.T
    return out


def settled(label: np.ndarray, x: np.ndarray, sets: list[np.ndarray], distance: int) -> list[tuple[int, int]]:
    """Pairs of labels that links join, as few as connect them all: every near pair of different labels is compared by its sets."""
    size = np.array([len(s) for s in sets], np.int64)
    of, whole = SIMILAR
    keep = []
    for i in range(len(label)):
        if ((label != label[i]) & within(x, x[i], distance)).any():
            keep.append(i)
    if not keep:
        return []
    keep = np.array(keep)
    label, x, size = label[keep], x[keep], size[keep]
    shared = _shared([sets[i] for i in keep.tolist()])
    root: dict[int, int] = {}

    def top(k: int) -> int:
        while root.setdefault(k, k) != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    out = []
    for i in range(len(keep)):
        hit = (label != label[i]) & (shared[i] * (of + whole) >= (size + size[i]) * of) & within(x, x[i], distance)
        for j in np.unique(label[hit]).tolist():
            p, q = top(int(label[i])), top(j)
            if p != q:
                root[p] = q
                out.append((int(label[i]), j))
    return out


def confirmed(pairs: DataFrame, nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pairs (a, b, ...) whose sets are as similar as SIMILAR says."""
    need = pairs.select(F.col("a").alias("_node")).unionByName(pairs.select(F.col("b").alias("_node"))).distinct()
    found = sets_of(nodes.join(need, "_node", "left_semi"))
    both = pairs.join(found.select(F.col("_node").alias("b"), F.col("_set").alias("_y")), "b")
    both = both.join(found.select(F.col("_node").alias("a"), F.col("_set").alias("_x")), "a")
    of, whole = SIMILAR
    shared = F.size(F.array_intersect("_x", "_y"))
    return both.where(shared * (of + whole) >= (F.size("_x") + F.size("_y")) * of).drop("_x", "_y")


def text_sets(docs: DataFrame, sets: Callable[[str | None], np.ndarray], id: str, text: str, store: Tables) -> Callable[[DataFrame], DataFrame]:
    """A function that gives _node and _set of some nodes (_node, _least): only the texts with these ids are read again, whole."""

    def of(nodes: DataFrame) -> DataFrame:
        nodes = store.cut(nodes.select("_node", "_least"))
        ids = small(nodes.select(F.col("_least").alias("_id")).distinct(), store)
        texts = docs.join(ids, F.col(f"`{id}`") == F.col("_id"), "left_semi")
        found = store.cut(_with_sets(texts, sets, text).join(nodes.select("_node"), "_node", "left_semi").dropDuplicates(["_node"]))
        store.drop(nodes)
        return found

    return of


def node_of(hashes: np.ndarray) -> int:
    """The node of a set of hashes."""
    import xxhash

    return xxhash.xxh64_intdigest(hashes.tobytes())


def _with_sets(docs: DataFrame, sets: Callable[[str | None], np.ndarray], text: str) -> DataFrame:
    """_node and the hashes of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomstone.llm.near import node_of

        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                own = [sets(t.as_py()) for t in whole.column(0).slice(at, 200)]
                node = np.array([node_of(s) for s in own], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([s.view(np.int64) for s in own], pa.list_(pa.int64()))], ["_node", "_set"])

    return like(docs, [text]).mapInArrow(run, "_node long, _set array<long>")


def groups(
    nodes: DataFrame,
    keys: Callable[[range], Column],
    n_tables: int,
    differ: int,
    sets_of: Callable[[DataFrame], DataFrame],
    store: Tables,
) -> DataFrame:
    """_node, label of the nodes that links connect with others; a label is one of the group's nodes.

    nodes: _node, _least, _size (of its set), SKETCH, and what keys(tables) needs to make an array of longs, one key for each
    of these tables. Pairs that share a key, differ in differ bits of the sketch or fewer, and whose sets (sets_of, see
    text_sets) are at SIMILAR are links.

    Keys with more rows than a task should get are dealt in pieces, once their rows are linked to one in the middle.
    Tables that are out of use are removed at once.
    """
    labels: DataFrame | None = None
    clusters: DataFrame | None = None
    tested: list[DataFrame] = []

    def named(rows: DataFrame, names: DataFrame | None, column: str) -> DataFrame:
        if names is None:
            return rows.withColumn(column, F.col("_node"))
        return rows.join(names.withColumnRenamed("label", column), "_node", "left").withColumn(column, F.coalesce(column, "_node"))

    def keyed(tables: range) -> DataFrame:
        rows = named(named(nodes, labels, "label"), clusters, "cluster")
        return rows.select(F.explode(keys(tables)).alias("key"), "_node", "label", "cluster", *SKETCH)

    def contract(pairs: DataFrame, sure: bool = False) -> bool:
        """New labels after the links among pairs (all of them, if they are sure); whether there are any."""
        nonlocal labels
        links = pairs if sure else confirmed(pairs, nodes, sets_of)
        edges = store.cut(links.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
        some = not edges.isEmpty()
        if some:
            labels = _relabelled(labels, edges, store)
        store.drop(edges)
        return some

    def untested(pairs: DataFrame) -> DataFrame:
        for t in tested:
            pairs = pairs.join(t, ["a", "b"], "left_anti")
        pairs = store.cut(pairs)
        tested.append(pairs.select("a", "b"))
        return pairs

    def differing(x: str, y: str) -> Column:
        return sum((F.bit_count(F.col(f"{x}.{w}").bitwiseXOR(F.col(f"{y}.{w}"))) for w in SKETCH), F.lit(0))

    # the middle of each busy key of the first tables
    fruitless, turn = 0, 0
    while fruitless < 3:
        rows = keyed(range(min(FIRST, n_tables)))
        busy = store.cut(_busy_keys(rows, turn).where(F.col("outside") > BUSY // 16).select("key", "centre"))
        if busy.isEmpty():
            break
        met = rows.withColumn("own", F.struct(*SKETCH)).join(busy, "key").where(F.col("label") != F.col("centre.label"))
        met = met.where(differing("own", "centre") <= differ)
        stars = met.select(F.col("_node").alias("a"), F.col("centre._node").alias("b"), F.col("label").alias("la"), F.col("centre.label").alias("lb"))
        stars = store.cut(stars.distinct())
        fruitless, turn = 0 if contract(stars) else fruitless + 1, turn + 1
        store.drop(busy, stars)

    def runs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        busy = store.cut(_busy_keys(rows, 0).select("key", "top", "outer", "inner"))
        return (rows.withColumn("run", F.col("key")) if busy.isEmpty() else _dealt(rows, busy, "key")), busy

    start = 0
    while start < n_tables:
        tables = range(start, min(n_tables, start + (AT_ONCE if start else FIRST)))
        rows, busy = runs(keyed(tables))
        found = store.cut(_candidates(rows, differ, NEAREST))
        pairs = untested(found.groupBy("a", "b").agg(F.first("la").alias("la"), F.first("lb").alias("lb")))
        if not pairs.isEmpty():
            contract(pairs)
        still = small(found.where("more").select("key").distinct(), store)
        store.drop(busy, found)
        if not still.isEmpty():
            held = store.cut(keyed(tables).join(still, "key", "left_semi"))
            rows, busy = runs(held)
            edges = store.cut(_clustered(rows, differ).distinct())
            if not edges.isEmpty():
                clusters = _relabelled(clusters, edges, store)
            store.drop(held, busy, edges)
        start = tables.stop
    if clusters is not None:
        own = nodes.select("_node", "_least", "_size", *SKETCH).join(clusters.withColumnRenamed("label", "cluster"), "_node")
        own = named(own, labels, "label")
        mixed = own.groupBy("cluster").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("cluster")
        own = store.cut(own.join(small(mixed, store), "cluster", "left_semi"))
        contract(_settle(own, sets_of, differ, store), sure=True)
    return labels if labels is not None else nodes.select("_node", F.col("_node").alias("label")).limit(0)


def _relabelled(labels: DataFrame | None, edges: DataFrame, store: Tables) -> DataFrame:
    """_node, label after links (a, b) between labels. A node without a row is its own label; the table of labels is removed."""
    roots = store.cut(components(edges, store=store).select(F.col("node").alias("label"), "root"))
    new = roots.select(F.col("label").alias("_node"), F.col("root").alias("label"))
    if labels is not None:
        moved = labels.join(roots, "label", "left").select("_node", F.coalesce("root", "label").alias("label"))
        new = moved.unionByName(new.join(labels, "_node", "left_anti"))
    out = store.cut(new)
    store.drop(labels, roots)
    return out


def _clustered(rows: DataFrame, distance: int) -> DataFrame:
    """a, b: pairs of clusters that connect what is near with different labels within runs."""

    def some(columns: tuple) -> pa.RecordBatch:
        from loomstone.llm.near import chained

        run, _, label, cluster, *fp = columns
        a, b = chained(run, np.stack(fp, axis=1).view(np.uint64), label, distance, cluster)
        return pa.RecordBatch.from_arrays([pa.array(cluster[a]), pa.array(cluster[b])], ["a", "b"])

    ship(rows.sparkSession)
    return by_key(rows.select("run", "_node", "label", "cluster", *SKETCH), some, "a long, b long", "run")


def _settle(own: DataFrame, sets_of: Callable[[DataFrame], DataFrame], distance: int, store: Tables) -> DataFrame:
    """la, lb: labels that links join. own: _node, cluster, label, _least, _size and SKETCH of all nodes of clusters."""
    per = own.groupBy("cluster", "label").agg(F.count("*").alias("n"), F.sum("_size").alias("e"))
    keys = per.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.max(F.struct("n", "e", "label")).alias("top"))
    pieces = lambda n, e: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(e / BLOCK_ELEMENTS)).cast("int")
    tops = keys.where((F.col("n") > BLOCK) | (F.col("e") > BLOCK_ELEMENTS)).select(
        "cluster",
        F.col("top.label").alias("top"),
        pieces(F.col("n") - F.col("top.n"), F.col("e") - F.col("top.e")).alias("outer"),
        pieces(F.col("top.n"), F.col("top.e")).alias("inner"),
    )
    rows = _dealt(own, tops, "cluster").select("run", "_node", "label", *SKETCH)
    rows = rows.join(sets_of(own), "_node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomstone.llm.near import settled

        held: list[tuple] = []
        key = None

        def done() -> pa.RecordBatch:
            found = settled(
                np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64).view(np.uint64), [h[2] for h in held], distance
            )
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["la", "lb"])

        for t in batches:
            c = {n: t.column(n) for n in t.schema.names}
            sketches = list(zip(*[c[w].to_pylist() for w in SKETCH], strict=True))
            for i, (r, label) in enumerate(zip(c["run"].to_pylist(), c["label"].to_pylist(), strict=True)):
                if r != key and held:
                    yield done()
                    held = []
                key = r
                held.append((label, sketches[i], c["_set"][i].values.to_numpy().view(np.uint64).copy()))
        if held:
            yield done()

    ship(own.sparkSession)
    return rows.repartition("run").sortWithinPartitions("run", "_node").mapInArrow(run, "la long, lb long")


def least_of(nodes: DataFrame, labels: DataFrame, store: Tables) -> DataFrame:
    """_node, component_id (the smallest id of its group), _n (its texts), _all (the group's) of every node."""
    linked = nodes.select("_node", "_least", "_n").join(labels, "_node")
    per = linked.groupBy("label").agg(F.min("_least").alias("component_id"), F.sum("_n").alias("_all"), F.count("*").alias("_nodes"))
    found = join_hot(labels, store.cut(per), ["label"], "_nodes").select("_node", "component_id", "_all")
    rows = nodes.select("_node", "_least", "_n").join(found, "_node", "left")
    return rows.select("_node", F.coalesce("component_id", "_least").alias("component_id"), "_n", F.coalesce("_all", "_n").alias("_all"))
