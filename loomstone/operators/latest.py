"""One row per key out of an append-only log, and other picks within groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key. order should be total; each task drops all but n of a key before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], before: Column | None = None, after: Column | None = None) -> DataFrame:
    """The newest row of each key. before filters the log (and may bring an older row back), after the newest rows."""
    rows = first_per_key(df if before is None else df.where(before), keys, order)
    return rows if after is None else rows.where(after)


def ties_of_latest(df: DataFrame, keys: Sequence[str], stamp: str) -> DataFrame:
    """All rows that share their key's greatest stamp."""
    newest = df.groupBy(*keys).agg(F.max(stamp).alias("_max"))
    return df.join(newest, list(keys)).where(F.col(stamp) == F.col("_max")).drop("_max")


def round_robin(df: DataFrame, keys: Sequence[str], order: Sequence[Column], per_key: int, limit: int, offset: int = 0) -> DataFrame:
    """At most per_key rows of each key, dealt by turns, then offset and limit."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("turn", rn.cast("long")).where(F.col("turn") <= per_key).orderBy("turn", *keys).offset(offset).limit(limit)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def rank_percentile(value: str, keys: Sequence[str]) -> Column:
    """(rows not above this one - 1) / (rows - 1): ties take the highest rank; a group of one gives 0.5."""
    own = Window.partitionBy(*keys)
    n = F.count(value).over(own)
    return F.when(n <= 1, 0.5).otherwise((F.cume_dist().over(own.orderBy(value)) * n - 1) / (n - 1))
