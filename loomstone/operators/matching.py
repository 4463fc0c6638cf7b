"""Which known entity a record means, and merges of records that turn out to be one."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions import text
from loomstone.operators.latest import first_per_key


def resolve(incoming: DataFrame, known: DataFrame, key: str, exact: Sequence[Sequence[str]], block: Sequence[str], name: str, alike: Callable[[Column, Column], Column], at_least: float) -> DataFrame:
    """key, match (the known key, or null) and rule of each incoming row.

    Each list of columns in exact is a rule, in this order: the known row that is alone with these
    values. Then within block the most similar name. Names are compared once for each pair of
    different names of a block, so repeated rows don't multiply the pairs.
    """
    found = []
    for i, columns in enumerate(exact):
        # only what is alone can decide, so the known side has one row per value
        alone = known.groupBy(*columns).agg(F.min(key).alias("match"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
        found.append(incoming.join(alone, list(columns)).select(key, "match", F.lit(i).alias("_rule"), F.lit(1.0).alias("_score")))
    ours = incoming.select(*block, F.col(name).alias("_a")).distinct()
    theirs = known.groupBy(*block, F.col(name).alias("_b")).agg(F.min(key).alias("match"))
    pairs = ours.join(theirs, list(block)).withColumn("_score", alike(F.col("_a"), F.col("_b"))).where(F.col("_score") >= at_least)
    best = first_per_key(pairs, [*block, "_a"], [F.desc("_score"), F.col("match")])
    fuzzy = incoming.withColumn("_a", F.col(name)).join(best, [*block, "_a"])
    found.append(fuzzy.select(key, "match", F.lit(len(exact)).alias("_rule"), "_score"))
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    first = rows.groupBy(key).agg(F.min_by(F.struct("match", "_rule", "_score"), F.col("_rule")).alias("_m"))
    out = incoming.select(key).join(first, key, "left")
    return out.select(key, F.col("_m.match").alias("match"), F.coalesce(F.col("_m._rule"), F.lit(-1)).alias("rule"), F.col("_m._score").alias("score"))


def keepers(df: DataFrame, identity: Sequence[str], key: str, order: Sequence[Column]) -> DataFrame:
    """key and keeper of each row: of rows with one identity the first in order stays."""
    best = first_per_key(df, identity, order).select(*identity, F.col(key).alias("keeper"))
    return df.join(best, list(identity)).select(key, "keeper")


def repoint(children: DataFrame, moved: DataFrame, key: str, unique: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Children under their keeper; of those that then share unique columns the first in order stays."""
    own = children.join(moved, key, "left").withColumn(key, F.coalesce("keeper", key)).drop("keeper")
    return first_per_key(own, unique, order)


def longest_prefix(df: DataFrame, places: DataFrame, key: str, name: str, place: str) -> DataFrame:
    """key and place: the longest run of a name's first words that is a place."""
    words = F.split(name, " ")
    runs = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    own = df.select(key, F.explode(runs).alias(place))
    return own.join(places.select(place).distinct(), place).groupBy(key).agg(F.max_by(place, F.length(place)).alias(place))


#: Names shorter than this may share no pair of letters with a similar one; they and names up to LONG meet by letters.
SHORT, LONG = 6, 8


def _numbered(parts: Column) -> Column:
    """Parts with how often each stood before, so that equal ones differ and an array's intersection counts repeats."""
    return F.transform(parts, lambda p, i: F.concat(p, F.size(F.filter(F.slice(parts, F.lit(1), i), lambda q: q == p)).cast("string")))


def letters(c: Column) -> Column:
    return _numbered(F.split(c, ""))


def _prefixed(rows: DataFrame, block: Sequence[str], name: str, ratio: float) -> DataFrame:
    """block, name, token: the tokens of each name, of which only the rarest will be keys; need says how many."""
    n = F.length(name)
    # the shorter name that may still be similar is this part of n; what the two must share at least
    least = ratio / (2 - ratio)
    both = n * (1 + least)
    of_letters = F.ceil(both * (ratio / 2))
    of_pairs = F.ceil(both * (1.5 * ratio - 1) - 1)
    chars = F.split(name, "")
    pairs = _numbered(F.transform(F.slice(chars, F.lit(1), n - 1), lambda a, i: F.concat(a, F.get(chars, i + 1))))
    kinds = F.array_compact(F.array(
        F.when(n <= LONG, F.struct(F.lit("l").alias("kind"), letters(F.col(name)).alias("tokens"), (n - of_letters + 1).alias("need"))),
        F.when(n >= SHORT, F.struct(F.lit("p").alias("kind"), pairs.alias("tokens"), (n - of_pairs).alias("need"))),
    ))
    k = rows.select(*block, name, F.explode(kinds).alias("k"))
    return k.select(*block, name, "k.kind", F.col("k.need").cast("int").alias("need"), F.explode("k.tokens").alias("token"))


def similar_pairs(ours: DataFrame, theirs: DataFrame, block: Sequence[str], x: str, y: str, ratio: float) -> DataFrame:
    """block, x, y: all pairs of different names of a block (x of ours, y of theirs) that can reach a ratio of 2 * matched letters / all letters.

    No such ratio is above that of the letters that two names share at all, so this bound decides; it also holds for
    1 - edits / longer. Pairs are found by a prefix filter: names that reach the ratio share so many pairs of neighbouring letters (each
    gap between matching runs costs one) that the rarest few of each must have one in common; short names meet by single letters in
    the same way. So nothing is compared but names with a rare part in common. Tokens are counted per block, keys are joined by a
    shuffle, and pairs are told apart once. The ratio must be above 2 / 3. Empty and null names are in no pair.
    """
    block = list(block)
    a = ours.select(*block, F.col(x).alias("_n")).where("_n <> ''").distinct()
    b = theirs.select(*block, F.col(y).alias("_n")).where("_n <> ''").distinct()
    tokens = _prefixed(a, block, "_n", ratio).withColumn("_side", F.lit(0)).unionByName(_prefixed(b, block, "_n", ratio).withColumn("_side", F.lit(1)))
    often = tokens.groupBy(*block, "kind", "token").agg(F.count("*").alias("_f"))
    listed = tokens.join(often, [*block, "kind", "token"]).groupBy(*block, "_n", "kind", "_side", "need").agg(F.sort_array(F.collect_list(F.struct("_f", "token"))).alias("_t"))
    keys = listed.select(*block, "_n", "kind", "_side", F.explode(F.transform(F.slice("_t", F.lit(1), F.greatest(F.lit(1), F.col("need"))), lambda t: t["token"])).alias("token"))
    left = keys.where("_side = 0").select(*block, "kind", "token", F.col("_n").alias(x))
    right = keys.where("_side = 1").select(*block, "kind", "token", F.col("_n").alias(y))
    met = left.join(right, [*block, "kind", "token"])
    long, wide = F.length(x), F.length(y)
    near = (long >= wide * (ratio / (2 - ratio))) & (wide >= long * (ratio / (2 - ratio)))
    pairs = met.where(near).select(*block, x, y).distinct()
    shared = F.size(F.array_intersect(letters(F.col(x)), letters(F.col(y))))
    return pairs.where(shared * 2 >= (long + wide) * ratio - 1e-9)


def spelled_alike(words: DataFrame) -> DataFrame:
    """word, other: words of which another one in the table is a spelling (see text.spellings).

    words: word, once or more each; null and empty ones are nowhere. An equality join on the spelling, of which a word has
    eight at most, so no pair is made that is not a result.
    """
    own = words.select("word").distinct()
    said = own.select("word", F.explode(text.spellings(F.col("word"))).alias("other")).where("word <> other")
    return said.join(own.select(F.col("word").alias("other")), "other", "left_semi").select("word", "other")
