"""Numbers with units out of texts, by field, and what is right for a field's period.

A text is scanned once, in Arrow batches, by functions.scanner: its tokens give the numbers, and each field's rule names
what may stand around them. Of several numbers the greatest counts, unless a rule says otherwise. Differences to a reading
by windows of characters: a word like million scales only the number it stands behind, digits with spaces between them are
one number only as groups of three, names of months are whole words or their usual short forms, and a dot within a number
ends no clause.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.functions import periods, scanner
from loomstone.functions.scanner import ANNUAL_FIELDS, AREA_FIELDS, DAILY_FIELDS, PEOPLE_FIELDS, SQUARE_FOOT, VOLUME_FIELDS  # noqa: F401


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


_D, _S = T.DoubleType(), T.StringType()


@F.pandas_udf(_struct(value=_D, unit=_S))
def _value_and_unit(field: pd.Series, text: pd.Series) -> pd.DataFrame:
    none = (None, None)
    rows = [none if f is None or t is None else scanner.value_and_unit(f, t) for f, t in zip(field, text, strict=True)]
    return pd.DataFrame(rows, columns=["value", "unit"]).astype({"value": "float64", "unit": "object"})


def value_and_unit(field: Column, c: Column) -> Column:
    """Struct (value, unit) of a field's text; both null where nothing is found, or either is null."""
    return _value_and_unit(field, c)


@F.pandas_udf(_D)
def _workbook_value(key: pd.Series, text: pd.Series) -> pd.Series:
    rows = [None if k is None or t is None else scanner.workbook_value(k, t) for k, t in zip(key, text, strict=True)]
    return pd.Series(rows, dtype="float64")


def workbook_value(key: Column, c: Column) -> Column:
    """The number by which a workbook sorts a key's text (international and domestic passengers are added up, reporting years left out)."""
    return _workbook_value(key, c)


@F.pandas_udf(T.ArrayType(_struct(value=_D, raw=_S, year=T.BooleanType(), clause=T.IntegerType())))
def _numbers(text: pd.Series) -> pd.Series:
    def of(t: str | None) -> list[dict] | None:
        if t is None:
            return None
        s = scanner.Scan(t)
        every = [(n, s.tokens[n.at]) for n, _ in s.numbers()]
        return [{"value": n.value, "raw": k.text, "year": n.year, "clause": k.clause} for n, k in every]

    return pd.Series([of(t) for t in text], dtype="object")


def numbers(c: Column) -> Column:
    """Structs (value, raw, year, clause) of all numbers of a text that are no part of a word, scaled by the word behind; null for a null text."""
    return _numbers(c)


def period_issue(field: Column, value: Column, context: Column) -> Column:
    """Why a yearly field's value is not a year's: a quarter's, month's or day's without a sum over the year, or read off a chart. Null if it may be."""
    return periods.issue(field, F.concat_ws(" ", value, context))


@F.pandas_udf(T.ArrayType(_struct(name=_S, value=_S, context=_S)))
def _indicators(names: pd.Series, text: pd.Series) -> pd.Series:
    from loomstone.functions import indicators as own

    return pd.Series([own.found(t or "", list(n) if n is not None else None) for n, t in zip(names, text, strict=True)], dtype="object")


def with_indicators(rows: DataFrame, text: str, names: Column | None = None, name: str = "indicators") -> DataFrame:
    """rows with structs (name, value, context) of what a text says of indicators (all that functions.indicators knows, or these), each value once.

    Values of yearly indicators that are another period's are left out. Indicators come in the order asked, their values in the text's.
    """
    rows = rows.withColumn(name, _indicators(names if names is not None else F.lit(None).cast("array<string>"), F.col(text)))
    fine = F.filter(name, lambda x: period_issue(x["name"], x["value"], x["context"]).isNull())
    key = lambda x: F.struct(x["name"], F.lower(x["value"]))
    return rows.withColumn(name, F.filter(fine, lambda x, i: F.array_position(F.transform(fine, key), key(x)) == i + 1))


#: Signs of doubt beside a value.
DOUBT = r"\b(?:about to|planned|proposed|target|up to|estimated?|projected|expected)\b"


def cleaned(rows: DataFrame, field: str, raw: str, context: str, provider: str | None = None) -> DataFrame:
    """rows with decision, reason, value, unit, confidence of a raw metric: accepted, rejected, or needs_review where the rules cannot tell.

    Text without a digit, a yearly field's value of another period and shares beyond a hundred are rejected; a text whose
    number no parser finds, or which has a sign of doubt, needs a look. provider names a column of structs (decision, reason,
    value, unit, confidence), what a provider said of a row before, or null: it decides where the rules cannot, if it has a
    decision of these three, and its value and unit hold; without it the rules' confidence holds, 0.72.
    """
    c = F.col(raw)
    # a column of its own, so that it is computed once
    rows = rows.withColumn("_v", value_and_unit(F.col(field), c)).withColumn("_issue", period_issue(F.col(field), c, F.col(context)))
    v, issue = F.col("_v"), F.col("_issue")
    doubt = F.lower(F.concat_ws(" ", c, F.col(context))).rlike(DOUBT)
    share = F.coalesce((v["unit"] == "percent") & (v["value"] > 100), F.lit(False))
    empty = ~F.coalesce(c.rlike(r"\d"), F.lit(False))
    reason = F.when(empty, "no number").when(issue.isNotNull(), issue).when(share, "share beyond 100").when(v["value"].isNull(), "no parser").when(doubt, "doubtful")
    decision = F.when(empty | issue.isNotNull() | share, "rejected").when(v["value"].isNull() | doubt, "needs_review").otherwise("accepted")
    out = {"decision": decision, "reason": reason, "value": v["value"], "unit": v["unit"], "confidence": F.lit(RULES_CONFIDENCE)}
    if provider:
        said = F.col(provider)
        ask = (decision == "needs_review") & F.coalesce(said["decision"].isin("accepted", "rejected", "needs_review"), F.lit(False))
        sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(said["confidence"], F.lit(RULES_CONFIDENCE))))
        theirs = {"decision": said["decision"], "reason": said["reason"], "value": said["value"], "unit": said["unit"], "confidence": sure}
        out = {k: F.when(ask, theirs[k]).otherwise(x) for k, x in out.items()}
    return rows.withColumns(out).drop("_v", "_issue")


#: Fixed value: how sure the rules alone are.
RULES_CONFIDENCE = 0.72


def _grouped(raw: Column) -> Column:
    """A number whose thousands dots or commas group."""
    plain = F.replace(raw, F.lit(","), F.lit(""))
    return F.when(raw.rlike(r"^\d{1,3}(\.\d{3})+$"), F.replace(raw, F.lit("."), F.lit(""))).otherwise(plain).try_cast("double")


def infobox(c: Column, fields: dict[str, str]) -> Column:
    """Structs (metric, value) of the lines "| key = number" of an infobox whose key is one of fields (key to metric), in the text's order.

    References, comments and templates around a value are left out; what is no number gives nothing.
    """
    line = F.lit(r"(?m)^[ \t]*\|[ \t]*([\w ]+?)[ \t]*=[ \t]*(.*)$")
    keys, raw = F.regexp_extract_all(c, line, 1), F.regexp_extract_all(c, line, 2)
    bare = F.transform(raw, lambda r: F.regexp_replace(r, r"(?s)<ref[^>]*/>|<ref.*?</ref>|<!--.*?-->|\{\{[^}]*\}\}|\[\[|\]\]", ""))
    known = F.create_map(*[F.lit(x) for kv in fields.items() for x in kv])
    every = F.zip_with(keys, bare, lambda k, r: F.struct(F.try_element_at(known, F.lower(k)).alias("metric"), _grouped(F.rtrim(F.regexp_extract(r, r"(\d[\d,.]*)", 1), F.lit(".,"))).alias("value")))
    return F.filter(every, lambda x: x["metric"].isNotNull() & x["value"].isNotNull())
