"""Search for places by name: documents for it, and ranked matches of many queries at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.names import search_text
from loomstone.operators.latest import ranked


def search_document(names: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """key and its distinct normal names, a line each, in the order given; a key's names are few, so they meet in one row."""
    rows = names.select(key, order, search_text(name).alias("_n")).where("_n <> ''")
    first = rows.groupBy(key, "_n").agg(F.min(order).alias("_o"))
    pairs = F.array_sort(F.collect_list(F.struct("_o", "_n")))
    return first.groupBy(key).agg(F.array_join(F.transform(pairs, lambda p: p["_n"]), "\n").alias("document"))


def rank_of(name: Column, asked: Column, canonical: Column) -> Column:
    """0 to 5: exact, prefix, contained, each for the canonical name before an alias; null without a match. Both are normal forms."""
    at = F.when(name == asked, 0).when(F.startswith(name, asked), 2).when(F.contains(name, asked), 4)
    return F.when((name != "") & (asked != ""), at + F.when(canonical, 0).otherwise(1))


#: Letters of a part that names are found by, and how many tasks may share the names of one part (all may have it).
GRAM, SHARES = 3, 64


def _parts(c: Column, sizes: Sequence[int]) -> Column:
    """All different parts of these lengths."""
    every = []
    for n in sizes:
        size = F.lit(n)
        every.append(F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), _part_of(c, size))))
    return F.array_distinct(F.flatten(F.array_compact(F.array(*every))))


def _part_of(c: Column, size: Column):
    return lambda i: F.substr(c, i, size)


def name_index(names: DataFrame) -> DataFrame:
    """part, id, matched, canonical, form: an inverted index of names (id, name, canonical) by the parts of up to three letters of their normal forms.

    It may be written as a table and kept; search() makes it where none is given.
    """
    n = names.select("id", F.col("name").alias("matched"), "canonical", search_text("name").alias("form")).where("form <> ''")
    return n.select(F.explode(_parts(F.col("form"), range(1, GRAM + 1))).alias("part"), "id", "matched", "canonical", "form")


def search(places: DataFrame, names: DataFrame, queries: DataFrame, limit: int, index: DataFrame | None = None) -> DataFrame:
    """query, position, id, matched, kind (canonical_exact to alias_contains): at most limit places of each query.

    places: id, name, country, city; names: id, name, canonical (boolean); queries: query, asked (text), any number of them; a
    query without letters finds nothing. What contains a query contains each part of it, so a query is looked up in an
    index of parts of three letters (a shorter query as a whole) by its rarest part, and only what has that part is tested. Of a
    place's names the best rank counts, then the shortest. Places are ordered by rank, length of the match, name, country,
    city and id. Each task keeps limit rows of a query before the shuffle. A part that most names have is dealt over SHARES tasks by id,
    each of which gets the queries' parts, so no task reads all of its names.
    """
    index = (name_index(names) if index is None else index).withColumn("_share", F.pmod(F.hash("id"), F.lit(SHARES)))
    shares = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("_share")
    q = queries.select("query", search_text("asked").alias("_q")).where("_q <> ''")
    sizes = F.when(F.length("_q") >= GRAM, _parts(F.col("_q"), [GRAM])).otherwise(F.array("_q"))
    asked = q.select("query", "_q", F.explode(sizes).alias("part"))
    often = index.join(asked.select("part").distinct().select("part", shares), ["part", "_share"], "left_semi").groupBy("part").agg(F.count("*").alias("_f"))
    rarest = asked.join(often, "part", "left").groupBy("query", "_q").agg(F.min_by("part", F.struct(F.coalesce("_f", F.lit(0)), F.col("part"))).alias("part"))
    n = index.join(rarest.select("*", shares), ["part", "_share"]).where(F.contains(F.col("form"), F.col("_q"))).withColumnRenamed("form", "_n")
    hits = n.withColumn("_rank", rank_of(F.col("_n"), F.col("_q"), F.col("canonical"))).where("_rank IS NOT NULL")
    best = hits.groupBy("query", "id").agg(
        F.min_by(F.struct("matched", "_n", "_rank"), F.struct("_rank", F.length("matched").alias("l"), "matched")).alias("m")
    )
    rows = best.join(places.select("id", F.col("name").alias("_name"), "country", "city"), "id")
    rows = rows.withColumn("_name", search_text("_name"))
    order = [F.col("m._rank"), F.length("m._n"), F.col("_name"), F.lower("country"), F.lower("city"), F.col("id").cast("string")]
    top = ranked(rows, ["query"], order, "position").where(F.col("position") <= limit)
    kinds = F.array(*[F.lit(f"{who}_{how}") for how in ("exact", "prefix", "contains") for who in ("canonical", "alias")])
    return top.select("query", "position", "id", F.col("m.matched").alias("matched"), F.element_at(kinds, F.col("m._rank") + 1).alias("kind"))

