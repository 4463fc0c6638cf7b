"""Which period a value's text speaks of: a sum over a year, a part of one, a whole one, or what is read off a chart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields whose values are a year's.
YEARLY_FIELDS = ("annual_passenger_throughput", "annual_footfall", "annual_visits")
PARTIAL, CHART = "non-annual period", "read off a chart"
#: Months, short and long; words for a year, and for what is counted.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
LONG = "january february march april may june july august september october november december sept".split()
COUNTED = ("passenger", "passengers", "visitor", "visitors", "visit", "visits", "pax")


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), F.lit(r"[a-z]+\d*|\d+[a-z]*|%"), 0)


class Said:
    """A text's words, as an array and as a line with a space on either side of each."""

    def __init__(self, words: Column, line: Column):
        self.words, self.line = words, line

    def phrase(self, *phrases: str) -> Column:
        """Whether one of these stands in it, whole words in a row."""
        out = F.lit(False)
        for p in phrases:
            out = out | F.contains(self.line, F.lit(f" {p} "))
        return out

    def begins(self, *starts: str) -> Column:
        """Whether a word begins with one of these."""
        out = F.lit(False)
        for p in starts:
            out = out | F.contains(self.line, F.lit(f" {p}"))
        return out

    def summed(self) -> Column:
        """A year put together from its parts, or one part times as many as a year has."""
        quarters = self.phrase("q1") & self.phrase("q2") & self.phrase("q3") & self.phrase("q4")
        # a sum, then up to four words, then quarterly
        after = F.transform(self.words, lambda w, i: F.startswith(w, F.lit("summ")) & F.array_contains(F.slice(self.words, i + 2, F.lit(5)), "quarterly"))
        stated = self.phrase(
            "sum of quarterly", "q1 q2 q3 q4", "four quarters", "sum of monthly", " ".join(MONTHS), "annualized by", "annualised by", "x12", "x365", "x 12", "x 365"
        )
        return (quarters & (self.begins("annual", "sum") | self.phrase("derived"))) | F.exists(after, lambda x: x) | stated

    def partial(self) -> Column:
        """A quarter, a month, or a rate by day, week or month."""
        named = [*MONTHS, *LONG, "q1", "q2", "q3", "q4", "quarter", "quarterly", "month", "monthly"]
        return F.arrays_overlap(self.words, F.array(*map(F.lit, named))) | self.phrase("per day", "per week", "per month")

    def whole(self) -> Column:
        """A year as such; a year to date only by its end."""
        to_date = self.phrase("ytd", "year to date") & self.phrase("dec", "december", "12")
        return self.begins("annual") | self.phrase("per year", "per annum", "full year", "calendar year", *[f"{c} year" for c in COUNTED]) | to_date


def issue(field: Column, text: Column) -> Column:
    """What is wrong with a yearly field's text, or null; a sum over the year outweighs its parts, and these a word for a year. A null text has none."""
    key = F.trim(F.regexp_replace(F.lower(field), "[^a-z0-9]+", "_"), F.lit("_"))

    def judged(x: Column) -> Column:
        s = Said(x["words"], F.concat(F.lit(" "), x["line"], F.lit(" ")))
        charted = (s.begins("chart") | s.phrase("statistics averages")) & ~s.whole()
        return F.when(s.summed(), F.lit(None).cast("string")).when(s.partial(), PARTIAL).when(charted, CHART)

    # the words are bound by a lambda, so that they are found once
    words = _words(F.coalesce(text, F.lit("")))
    once = F.transform(F.array(words), lambda w: F.struct(w.alias("words"), F.array_join(w, " ").alias("line")))
    return F.when(key.isin(*YEARLY_FIELDS), F.get(F.transform(once, judged), F.lit(0)))
