"""Filters that users of a read model set, and checks of single rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.text import domain
from loomstone.operators.quality import on_surface


def equal(df: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    """Rows where each column, as a string, is what is wanted; empty and missing wishes are no filter.

    A column that df does not have is an error. Filters are plain comparisons, so they reach the scan.
    """
    unknown = [c for c in wanted if c not in df.columns]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    for c, v in wanted.items():
        if v is None or v == "":
            continue
        text = str(v).lower() if isinstance(v, bool) else str(v)
        df = df.where(F.col(c).cast("string") == text)
    return df


def read_model(df: DataFrame, wanted: Mapping[str, object], flags: Mapping[str, bool | None], surface: str | None = None, blocked_too: bool = False) -> DataFrame:
    """equal, and flags that must be as said (None: either), and what a surface may show."""
    out = equal(df, wanted)
    for c, v in flags.items():
        if v is not None:
            out = out.where(F.coalesce(F.col(c), F.lit(False)) == v)
    return out if surface is None else on_surface(out, surface, blocked_too)


def row_issues(lat: str, lon: str, annual: str, required: Sequence[str], url: str) -> Column:
    """What is wrong with a row: missing strings, degrees out of range, visits that are not positive, an address that is not public."""
    missing = [F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(f"{c} missing")) for c in required]
    host = domain(F.col(url))
    local = host.rlike(r"^(localhost|127\.|10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)") | host.endswith(".local") | ~host.contains(".")
    checks = [
        F.when(~F.coalesce(F.col(lat).between(-90, 90), F.lit(False)), f"{lat} out of range"), F.when(~F.coalesce(F.col(lon).between(-180, 180), F.lit(False)), f"{lon} out of range"),
        F.when(F.col(annual) <= 0, f"{annual} not positive"), F.when(~F.coalesce(F.col(url).rlike("^https?://[^/?#]+"), F.lit(False)) | local, f"{url} not public"),
    ]
    return F.array_compact(F.array(*missing, *checks))
