"""URL filters: a weighted vocabulary, counted by an Aho-Corasick automaton, behind host and path rules.

One automaton finds all terms of the vocabulary in the lower-cased url. A hit counts if neither
neighbour is a letter or digit, and each term once. One strict term rejects a url, or several
different soft ones whose weights add up; a rule that fits decides before the vocabulary does.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import ship

#: What a url is rejected for, in hundredths: a term of 100 or more is strict, lighter ones add up.
REJECT = 100
#: The vocabulary by weight: gambling, pornography, pills, fraud and traps in four languages. Load another one where it falls short.
WEIGHTED: tuple[tuple[int, str], ...] = (
    (100, "casino porn porno porn0 pornos xxx hentai escort escorts milf camgirl camgirls viagra cialis levitra malware phishing warez keygen torrentz"),
    (100, "onlinecasino sexcam sexcams pornhub xvideos kasino spielhalle prostituta prostitutas putas escortes pornographie pornografia pornografie"),
    (50, "adult ads bet bets betting bonus click cheap dating free gambling hot jackpot lottery nude nudes pills poker sex slots slot track tracker win"),
    (50, "erotic erotik erotica sexo sexe nackt nu nue desnuda apuesta apuestas pari paris wette wetten gratis gratuit kostenlos gewinn gewinnspiel premio"),
    (50, "crack cracked serial replica rolex payday loan loans kredit credito forex binary viagr pharma pharmacy apotheke farmacia roulette blackjack bingo"),
    (34, "ad banner popup redirect redir promo coupon deal deals offer offers discount sale spam proxy unblocked download mp3 streaming hack cheat cheats"),
)
VOCABULARY: dict[str, int] = {term: weight for weight, terms in WEIGHTED for term in terms.split()}


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first :// up to /, ?, # or the end, A-Z lower-cased) and path (from there up to ?, # or the end)."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, lower), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def hits(urls: Iterator[pd.Series], vocabulary: Mapping[str, int], reject: int) -> Iterator[pd.DataFrame]:
    """How many different strict and soft terms each url has, and what the soft ones weigh."""
    import ahocorasick

    find = ahocorasick.Automaton()
    for t, weight in vocabulary.items():
        find.add_word(t, (weight, t))
    find.make_automaton()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    inside = set("abcdefghijklmnopqrstuvwxyz0123456789")

    def count(url: str | None) -> tuple[int, int, int]:
        url = (url or "").translate(lower)
        ends = find.iter(url) if vocabulary else ()
        found = {x for end, x in ends if url[end + 1 : end + 2] not in inside and (end < len(x[1]) or url[end - len(x[1])] not in inside)}
        soft = [weight for weight, _ in found if weight < reject]
        return len(found) - len(soft), len(soft), sum(soft)

    for s in urls:
        yield pd.DataFrame([count(u) for u in s], columns=["strict", "soft", "weight"], dtype="int32")


def judge(pages: DataFrame, rules: tuple[Rule, ...], vocabulary: Mapping[str, int] = VOCABULARY, reject: int = REJECT, id: str = "page_id", url: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, strict_hits, soft_hits, soft_weight of each row.

    A rule fits its host and all subdomains of it if the path starts with the rule's; of those that
    fit, the longest (host and path together) decides. Null urls and those without :// have an empty
    host and path, so no rule fits, and null ones have no hits. Urls may be of any length. Rows keep
    their partition, repeated ones each give a row; only id and url are read; an empty table gives none.
    """
    ship(pages.sparkSession)

    @F.pandas_udf("strict int, soft int, weight int")
    def counted(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from loomstone.llm.urls import hits

        yield from hits(urls, vocabulary, reject)

    host, path = split_url(F.col(f"`{url}`"))
    rows = pages.select(F.col(f"`{id}`").alias(id), host.alias("host"), path.alias("path"), counted(F.col(f"`{url}`")).alias("_n"))
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.host + r.path)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    by_terms = F.when((F.col("_n.strict") >= 1) | ((F.col("_n.soft") >= 2) & (F.col("_n.weight") >= reject)), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(id, "host", "path", rule.alias("rule"), F.coalesce(verdict, by_terms).alias("verdict"), F.col("_n.strict").alias("strict_hits"), F.col("_n.soft").alias("soft_hits"), F.col("_n.weight").alias("soft_weight"))
