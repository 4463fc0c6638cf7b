"""Mixing sources to target weights, in DataFrame functions only.

Every row gets a hash-random key; within its source, rows are in the order of that key, dealt to
key ranges of equal width. Prefix sums of the sizes come in two steps, over the sums of the ranges
and within each range, so no task holds a source. A source's budget is whole epochs of all its rows
and then a prefix of that order, cut at the exact word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.common import WORD

#: Key ranges of a source: so many hexadecimal digits of the key.
DIGITS = 3


def words(text: Column) -> Column:
    """How many words a text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def budgets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = (5, 2, 1), source: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """source, source_size, target of each source of (source, source_size).

    Sources in code-point order, null last, weigh what weights says, repeating. The total is share
    times all sizes, dealt by weight; a target stops at most times its source's size and the excess
    is dealt anew among the others until none is above. So a target is the smaller of its cap and
    its weight times one common level, found here by one pass in the order of cap by weight.
    """
    # the number of sources is that of one column's values; the rows here are counts, not documents
    rank = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    level = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    s = sizes.withColumn("_rank", rank).withColumn("_w", level).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    s = s.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    up = Window.orderBy("_ratio", "_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(F.lit(0))
    s = s.withColumn("_capped", F.sum("_cap").over(up) - F.col("_cap")).withColumn("_open", F.sum("_w").over(every) - F.sum("_w").over(up) + F.col("_w"))
    s = s.withColumn("_level", (F.sum("source_size").over(every) * F.lit(float(share)) - F.col("_capped")) / F.col("_open"))
    # the first source whose cap is above its share at the level it would set fixes the level for all that follow
    s = s.withColumn("_fixed", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_rank", "_level"))).over(every)["_level"])
    target = F.when(F.col("_fixed").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_w") * F.col("_fixed")))
    return s.select(source, *carry, "source_size", target.alias("target"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = (5, 2, 1), seed: str = "mix", id: str = "doc_id", text: str = "text", source: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, size, source_size, target, taken of each row, and the columns in carry.

    taken counts the words that the mix takes of a row, epochs added: size for each whole epoch and,
    in the last one, size up to the row that reaches the budget, which gives just the words missing.
    Sizes are words; a null text has none and takes none. Repeated rows are rows of their own, null
    sources one source, the last. An empty table gives an empty result. Reruns agree: keys are MD5 of
    seed and id, equal keys are ordered by id and text.
    """
    base = docs.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{source}`").alias("_source"), words(F.col(f"`{text}`")).alias("size"), F.coalesce(F.xxhash64(F.col(f"`{text}`")), F.lit(0)).alias("_tie"), *[F.col(f"`{c}`").alias(f"_c_{c}") for c in carry])
    base = base.withColumn("_key", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("_id").cast("string"), F.lit(""))).cast("binary"))).withColumn("_range", F.substring("_key", 1, DIGITS))
    # a key without nulls, so that the window, the sums and their join share one partitioning
    base = base.withColumn("_group", F.coalesce(F.concat(F.lit("="), F.col("_source").cast("string")), F.lit("-")))
    ranges = base.groupBy("_group", "_range").agg(F.sum("size").alias("_sum"), F.first("_source").alias("_source"))
    per = budgets(ranges.groupBy("_group").agg(F.sum("_sum").alias("source_size"), F.first("_source").alias("_source")), share, most, weights, "_source", ("_group",))
    up = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_group", "_range", F.coalesce(F.sum("_sum").over(up), F.lit(0)).alias("_before")).join(per.drop("_source"), "_group")
    within = Window.partitionBy("_group", "_range").orderBy("_key", "_id", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    joined = base.withColumn("_ahead", F.coalesce(F.sum("size").over(within), F.lit(0))).join(ranges, ["_group", "_range"])
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least("size", rest - F.col("_before") - F.col("_ahead")))
    return joined.select(F.col("_id").alias(id), "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), *[F.col(f"_c_{c}").alias(c) for c in carry])


def mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each epoch that takes any of its words.

    A row that the last epoch cuts has only the words taken (and n_chars of those, if docs has it);
    words keep the white space between them. Null texts have no words and are not taken; null sources
    are one source; repeated rows are taken each for itself; an empty table gives none.
    """
    # carried columns get names of their own: docs may have one called size or taken
    own = docs.select(*[F.col(f"`{c}`").alias(c if c in (id, more.get("source", "source")) else f"_own_{c}") for c in docs.columns])
    source = more.pop("source", "source")
    carry = tuple(c for c in own.columns if c != id)
    rows = mix(own, id=id, text=f"_own_{text}", source=source, carry=carry, **more).where("taken > 0")
    rows = rows.withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("size")))))
    left = F.col("taken") - F.col("_epoch") * F.col("size")
    # text up to the end of the left-th word: a word and what is white before it, that many times
    whole = F.col(f"`_own_{text}`")
    cut = F.array_join(F.slice(F.regexp_extract_all(whole, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), 0), F.lit(1), left.cast("int")), "")
    shorter = left < F.col("size")
    new = {text: F.when(shorter, cut).otherwise(whole)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(shorter, F.length(cut).cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("_own_n_chars"))
    return rows.select(*[(new[c] if c in new else F.col(f"`{c}`" if c in (id, source) else f"`_own_{c}`")).alias(c) for c in docs.columns])
