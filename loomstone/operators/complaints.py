"""Complaints about a network: which texts are one, whose they are, and what they add up to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.operators.latest import first_per_key
from loomstone.operators.ranks import share_in_order

#: Fixed values. A text with one of these is about something else.
EXCLUDED = (
    "billing", "invoice", "charged", "charge", "cobranca", "fatura", "atendimento",
    "customer service", "room service", "hotel service",
)
#: Fixed values. A text about wireless networks counts only if it also has one of these.
MOBILE = ("4g", "5g", "celular", "mobile", "movel", "sinal", "signal", "ligacao", "call")
WIRELESS = ("wi fi", "wifi")
#: Kinds in order of precedence, their weights and markers.
KINDS = (
    ("no_signal", 1.0, ("sem sinal", "no signal", "sem rede", "no service", "fora de cobertura")),
    ("network_outage", 1.0, ("rede caiu", "network outage", "indisponivel", "servico fora")),
    ("dropped_call", 0.8, ("queda de chamada", "queda de ligacao", "dropped call", "call drops")),
    ("weak_signal", 0.8, ("sinal fraco", "weak signal", "poor signal", "baixa cobertura")),
    ("slow_data", 0.6, ("internet lenta", "internet movel muito lenta", "dados lentos", "dados moveis lentos", "slow data", "slow internet", "velocidade baixa")),
)
#: Days that an observation counts, and its weight up to an age in days.
DAYS = 365
FRESH = ((90, 1.0), (180, 0.6))
STALE = 0.3
HIGH_VALUE = ("National Flagship", "City Core")


def any_of(text: Column, words: Sequence[str]) -> Column:
    """Whether text contains one of words."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def kind(plain: Column) -> Column:
    """Struct (kind, weight) of a plain text (names.plain_text), null if it is no complaint about a network."""
    about = ~any_of(plain, EXCLUDED) & (~any_of(plain, WIRELESS) | any_of(plain, MOBILE)) & (plain != "")
    out = F.lit(None).cast("struct<kind:string,weight:double>")
    for name, weight, words in reversed(KINDS):
        out = F.when(any_of(plain, words), F.struct(F.lit(name).alias("kind"), F.lit(weight).alias("weight"))).otherwise(out)
    return F.when(about, out)


def age_days(at: Column, now: Column) -> Column:
    """Whole days of 24 hours between two timestamps, zero for the future."""
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))
    return F.greatest(F.lit(0), F.floor(micros / 86_400_000_000))


def freshness(age: Column) -> Column:
    out = F.lit(STALE)
    for days, weight in reversed(FRESH):
        out = F.when(age <= days, weight).otherwise(out)
    return out


def pressure(n: Column, weighted: Column) -> Column:
    return (
        F.when(n < 3, "insufficient")
        .when((n >= 5) & (weighted >= 4), "high")
        .when(weighted >= 2, "medium")
        .otherwise("low")
    )


def confidence(n: Column, weighted: Column, hosts: Column) -> Column:
    """As the pressure, but a high one from a single host is only medium."""
    p = pressure(n, weighted)
    return F.when((p == "high") & (hosts < 2), "medium").otherwise(p)


def rollup(rows: DataFrame, key: str, now: Column, tie: Sequence[Column] = ()) -> DataFrame:
    """One row per key of observations (key, kind, weight, at, url, digest).

    n, weighted, hosts, kinds (map of counts), pressure, confidence, and latest: the newest stamp of all
    rows, old ones too. Only the newest row of a digest counts, and none older than DAYS; null digests are
    one digest. Keys whose rows are all too old stay, with nothing counted. tie orders rows of one stamp.
    """
    latest = rows.groupBy(key).agg(F.max("at").alias("latest"))
    fresh = rows.withColumn("_age", age_days(F.col("at"), now)).where(F.col("_age") <= DAYS)
    once = first_per_key(fresh, [key, "digest"], [F.desc("at"), *tie])
    host = F.lower(F.parse_url("url", F.lit("HOST")))
    weight = F.greatest(F.lit(0.0), F.col("weight")) * freshness(F.col("_age"))
    # counted per (key, kind, host) first, so that a busy key passes its shuffle as few rows
    part = once.groupBy(key, "kind", host.alias("host")).agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    sums = part.groupBy(key).agg(
        F.sum("n").alias("n"), F.sum("w").alias("weighted"), F.count_distinct("host").alias("hosts")
    )
    of_kind = part.groupBy(key, "kind").agg(F.sum("n").alias("n")).where("kind IS NOT NULL")
    kinds = of_kind.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    out = latest.join(sums, key, "left").join(kinds, key, "left").fillna(0, ["n", "weighted", "hosts"])
    n, w, h = F.col("n"), F.bround("weighted", 4), F.col("hosts")
    return out.select(
        key, "n", w.alias("weighted"), "hosts", F.coalesce("kinds", F.create_map().cast("map<string,bigint>")).alias("kinds"),
        pressure(n, F.col("weighted")).alias("pressure"), confidence(n, F.col("weighted"), h).alias("confidence"), "latest",
    )


def by_percentile(rollups: DataFrame, groups: Sequence[str], tie: str) -> DataFrame:
    """rollups with at least three observations, with percentile and the pressure that it gives within its group."""
    rows = share_in_order(rollups.where("n >= 3"), groups, "weighted", tie)
    p = F.col("percentile")
    return rows.withColumn("pressure", F.when(p >= 0.8, "high").when(p >= 0.6, "medium").otherwise("low"))


def input_hash(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key and a digest of its rows that does not depend on their order: unchanged input needs no new rollup.

    Rows are hashed one by one and the hashes added up, so no group is collected.
    """
    line = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]), 256)
    part = lambda at: F.sum(F.conv(F.substring(line, at, 15), 16, 10).cast("decimal(38,0)"))
    sums = rows.groupBy(key).agg(F.count("*").alias("_n"), part(1).alias("_a"), part(16).alias("_b"))
    return sums.select(key, F.sha2(F.concat_ws("|", "_n", "_a", "_b"), 256).alias("input_hash"))


def allowed_source(rows: DataFrame, url: str, policies: DataFrame, denied: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """rows with allowed: whether policy and record let the source of url be used.

    policies: place (order), domain, approved. The first policy whose domain is the host or above it decides;
    no policy, a denied pattern, another scheme than http(s) or a record flag that is not true mean no.
    Hosts are exploded to their suffixes, so that policies meet them by an equi-join.
    """
    host = F.lower(F.parse_url(url, F.lit("HOST")))
    web = F.lower(F.parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & (host != "")
    hosts = rows.select(host.alias("_host")).distinct().where("_host IS NOT NULL")
    parts = F.split("_host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    suffixes = hosts.select("_host", F.explode(ends).alias("_end"))
    own = policies.select(F.lower("domain").alias("_end"), "place", "approved").where("_end <> ''")
    first = suffixes.join(own, "_end").groupBy("_host").agg(F.min_by("approved", "place").alias("_approved"))
    checked = F.lit(True)
    for f in flags:
        checked = checked & F.coalesce(F.col(f), F.lit(False))
    bad = any_of(F.lower(F.col(url)), [d.lower() for d in denied])
    out = rows.withColumn("_host", host).join(first, "_host", "left")
    ok = web & ~bad & F.coalesce("_approved", F.lit(False)) & checked
    return out.withColumn("allowed", F.coalesce(ok, F.lit(False))).drop("_host", "_approved")


def named(texts: DataFrame, key: str, text: str, places: DataFrame) -> DataFrame:
    """key, place, verdict of each text: exact, possible_duplicate or unmatched.

    texts: key, text (plain), given (the place that the record names, or null). places: place, names (plain,
    an array), city and country (plain). A place matches if a name of four letters or more stands in the text,
    and so does its city or country; exactly one place must match. Names are contained as a run of letters, as
    city and country are; a name's run meets the text by hashed pieces (see passages.contained), not by pairs.
    """
    from loomstone.operators.passages import contained

    names = places.select("place", "city", "country", F.explode("names").alias("name")).where(F.length("name") >= 4)
    known = places.select(F.col("place").alias("given")).distinct().withColumn("_known", F.lit(True))
    texts = texts.join(known, "given", "left").withColumn("given", F.when(F.col("_known"), F.col("given")))
    hits = contained(texts.select(key, text, "given"), key, text, names.select("name").distinct(), "name", keep=["given"])
    found = hits.join(names, "name").where(F.col("given").isNull() | (F.col("given") == F.col("place")))
    near = lambda c: (F.col(c) != "") & F.contains(F.col(text), F.col(c))
    found = found.where(F.coalesce(near("city"), F.lit(False)) | F.coalesce(near("country"), F.lit(False)))
    per = found.groupBy(key).agg(F.count_distinct("place").alias("_n"), F.min("place").alias("_place"))
    out = texts.select(key).join(per, key, "left")
    n = F.coalesce("_n", F.lit(0))
    verdict = F.when(n == 1, "exact").when(n > 1, "possible_duplicate").otherwise("unmatched")
    return out.select(key, F.when(n == 1, F.col("_place")).alias("place"), verdict.alias("verdict"))


def validation(value_class: Column, complaint: Column, mobile: tuple[Column, Column], fixed: tuple[Column, Column]) -> Column:
    """Struct (priority, reasons): why a place's network should be looked at. mobile, fixed: class and confidence."""
    poor = lambda s: (s[0] == "poor") & s[1].isin("high", "medium")
    reasons = F.array_compact(
        F.array(
            F.when(complaint == "high", "high property-level network complaint pressure"),
            F.when(poor(mobile), "mobile tile performance is poor"),
            F.when(poor(fixed), "fixed tile performance is poor"),
        )
    )
    some = F.size(reasons) > 0
    priority = F.when(some & value_class.isin(*HIGH_VALUE), "High").when(some, "Medium").otherwise("Normal")
    return F.struct(priority.alias("priority"), reasons.alias("reasons"))
