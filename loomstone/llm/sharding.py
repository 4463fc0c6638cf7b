"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

Shards stand in racks and racks in regions; a node weighs what its shards weigh. A row descends
from level to level: at each, every child draws -ln(u) / weight with a uniform u hashed from the row's
id and the child's name, and the smallest draw wins, so children win in proportion to weight. If a
weight changes, draws of other nodes don't: rows move only into or out of subtrees whose weight
changed. A grown tree gets the new shard in a region of its own, so nothing moves between old shards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int, racks: int = 2, per_rack: int = 2) -> tuple[Shard, ...]:
    """Shards of equal weight in regions of racks x per_rack."""
    size = racks * per_rack
    return tuple(Shard(s // size, s % size // per_rack, s) for s in range(shards))


def grown(nodes: tuple[Shard, ...], weight: float = 1.0) -> tuple[Shard, ...]:
    """One more shard, in a region of its own: it takes rows from all others, and no other takes any."""
    return (*nodes, Shard(max(s.region for s in nodes) + 1, 0, max(s.shard for s in nodes) + 1, weight))


def _draw(id: Column, level: int, name: int, weight: float) -> Column:
    """-ln(u) / weight; u in (0, 1) from 52 bits of the hash, so that both ends are left out."""
    u = (F.shiftrightunsigned(F.xxhash64(id, F.lit(level), F.lit(name)), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / F.lit(float(weight))


def _least(draws: list[tuple[Column, Column]]) -> Column:
    """The outcome with the smallest draw; at equal draws the one listed first."""
    return F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i"), v.alias("v")) for i, (d, v) in enumerate(draws)]))["v"]


def place(id: Column, nodes: tuple[Shard, ...]) -> Column:
    """The shard of an id: a function of the id and the tree alone; null ids are an id like any other."""
    id = F.coalesce(id.cast("string"), F.lit("\0"))

    def leaf(group: list[Shard]) -> Column:
        return _least([(_draw(id, 2, s.shard, s.weight), F.lit(s.shard)) for s in group]) if len(group) > 1 else F.lit(group[0].shard)

    def level(group: list[Shard], depth: int) -> Column:
        if depth == 2:
            return leaf(group)
        by: dict[int, list[Shard]] = {}
        for s in group:
            by.setdefault((s.region, s.rack)[depth], []).append(s)
        if len(by) == 1:
            return level(group, depth + 1)
        name = {k: k if depth == 0 else group[0].region * 1_000_003 + k for k in by}
        won = _least([(_draw(id, depth, name[k], sum(s.weight for s in own)), F.lit(k)) for k, own in by.items()])
        out = F.lit(None).cast("int")
        for k, own in by.items():
            out = F.when(won == k, level(own, depth + 1)).otherwise(out)
        return out

    return level([s for s in nodes if s.weight > 0], 0)


def assign(docs: DataFrame, nodes: tuple[Shard, ...], grown: tuple[Shard, ...] | None = None, buckets: int = 256, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, size (UTF-8 bytes + 1), text_crc32, shard, slot (gapless from 0 in its shard), grown_shard.

    Null texts have size 1 and crc32 zero, like empty ones; repeated rows get slots of their own.
    Slots: rows are numbered within (shard, hash bucket), and buckets of a shard follow one another
    by prefix sums over at most shards x buckets counts, so no task numbers a whole shard. Texts may
    be of any length; an empty table gives no rows; other columns are ignored.
    """
    raw = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    key = F.col(f"`{id}`")
    rows = docs.select(
        key.alias(id), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), place(key, nodes).alias("shard"),
        (place(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(id, "text_crc32"), F.lit(buckets)).cast("int"))
    from pyspark.sql import Window

    before = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    sums = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("shard", "_bucket", F.coalesce(F.sum("_n").over(sums), F.lit(0)).alias("_before"))
    numbered = rows.withColumn("_k", F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy(id, "text_crc32", "size")) - 1)
    # shards x buckets rows, whatever the input
    return numbered.join(F.broadcast(before), ["shard", "_bucket"]).select(id, "size", "text_crc32", "shard", (F.col("_before") + F.col("_k")).cast("long").alias("slot"), "grown_shard")
