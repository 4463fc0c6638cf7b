"""Which known place an incoming record is: exact rules first, then the most similar name of its block."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions import names, text
from loomstone.operators.latest import first_per_key
from loomstone.operators.matching import similar_pairs
from loomstone.sources.tables import Scratch

KNOWN, POSSIBLE, NEW = "known_property", "possible_duplicate", "new_opportunity"
#: Least similarity of cities and of names, what the same place on the map adds, and the most that a fuzzy match says.
CITY, NAME, BONUS, MOST = 0.82, 0.90, 0.08, 0.99


def bucket(lat: Column, lon: Column) -> Column:
    """Degrees to three places; null unless both are finite."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.when(fine(lat) & fine(lon), F.format_string("%.3f,%.3f", lat, lon))


def with_identity(rows: DataFrame) -> DataFrame:
    """rows (country, city, name, scene, lat, lon) with their normal forms, identity key and bucket, all with an underscore."""
    full = lambda c: F.coalesce(F.col(c), F.lit(""))
    out = rows.withColumn("_country", names.identity_text(full("country"))).withColumn("_city", names.identity_text(full("city")))
    out = out.withColumn("_scene", names.identity_text(full("scene"))).withColumn("_name", names.entity_name(full("name")))
    return out.withColumn("_key", F.concat_ws("|", "_country", "_scene", "_city", "_name")).withColumn("_bucket", bucket(F.col("lat"), F.col("lon")))


def similarity(a: Column, b: Column, alike: Callable[[Column, Column], Column]) -> Column:
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(alike(a, b))


def match(incoming: DataFrame, known: DataFrame, alike: Callable[[Column, Column], Column] = names.sequence_ratio) -> DataFrame:
    """id, status, match (a known id), confidence, rule of each incoming row.

    Both have id, country, city, name, scene, lat, lon and maps (a link or null); incoming has url, known urls (an array).
    Rules in order: the address is known (no record is named); the identity key is; the name is, alone in its country and
    scene, and the incoming city is missing; the link to the map is a record's of that country and scene; the most similar
    name there whose city, if both have one, is similar. Known rows with one key are one record, with the smallest id.
    Every link and every bucket of a record counts, whichever of its rows has it. Only names that can be similar enough are
    compared (matching.similar_pairs), each two once, and cities only where the names are. Normal forms are made once.
    """
    store = Scratch(incoming.sparkSession)
    a = with_identity(incoming.select("id", "country", "city", "name", "scene", "lat", "lon", "maps", "url"))
    a = store.cut(a.withColumn("_url", text.source_url(F.col("url"))).withColumn("_maps", text.source_url(F.col("maps"))))
    k = store.cut(with_identity(known.select("id", "country", "city", "name", "scene", "lat", "lon", "maps")).withColumn("_maps", text.source_url(F.col("maps"))))
    urls = known.select(F.explode(F.concat(F.coalesce("urls", F.array().cast("array<string>")), F.array("maps"))).alias("u"))
    urls = urls.select(text.source_url(F.col("u")).alias("_url")).where("_url <> ''").distinct()
    records = k.groupBy("_key", "_country", "_scene", "_name", "_city").agg(F.min("id").alias("match"))

    def rule(n: int, rows: DataFrame, status: str, confidence: Column, match: Column, why: str) -> DataFrame:
        return rows.select("id", F.lit(n).alias("_rule"), F.lit(status).alias("status"), match.alias("match"), confidence.alias("confidence"), F.lit(why).alias("rule"))

    none = F.lit(None).cast(dict(known.dtypes)["id"])
    found = [rule(0, a.join(urls, "_url", "left_semi"), KNOWN, F.lit(1.0), none, "source address")]
    found.append(rule(1, a.join(records.select("_key", "match"), "_key"), KNOWN, F.lit(1.0), F.col("match"), "identity key"))
    block = ["_country", "_scene"]
    alone = records.groupBy(*block, "_name").agg(F.min("match").alias("match"), F.count("*").alias("_n")).where("_n = 1")
    found.append(rule(2, a.where("_city = ''").join(alone, [*block, "_name"]), KNOWN, F.lit(0.98), F.col("match"), "name without city"))
    linked = k.where("_maps <> ''").select("_key", "_maps").join(records, "_key").groupBy(*block, "_maps").agg(F.min("match").alias("match"))
    found.append(rule(3, a.join(linked, [*block, "_maps"]), POSSIBLE, F.lit(0.95), F.col("match"), "map link"))
    # what no exact rule decides is compared by name
    decided = found[0].select("id")
    for f in found[1:]:
        decided = decided.unionByName(f.select("id"))
    open_rows = a.join(decided.distinct(), "id", "left_anti").where("_name <> ''")
    ours = open_rows.select(*block, F.col("_name").alias("x"), F.col("_city").alias("xc"), F.col("_bucket").alias("xb")).distinct()
    places = records.where("_name <> ''").select(*block, F.col("_name").alias("y"), F.col("_city").alias("yc"), "_key", "match")
    buckets = k.where("_bucket IS NOT NULL").select(F.col("_key").alias("_k"), F.col("_bucket").alias("yb")).distinct().withColumn("_there", F.lit(True))
    pairs = store.cut(similar_pairs(ours, places, block, "x", "y", NAME - BONUS).withColumn("_alike", similarity(F.col("x"), F.col("y"), alike)).where(F.col("_alike") >= NAME - BONUS - 1e-12))
    met = pairs.join(ours, [*block, "x"]).join(places, [*block, "y"])
    met = met.join(buckets, (F.col("_key") == F.col("_k")) & (F.col("xb") == F.col("yb")), "left")
    near_city = (F.col("xc") == "") | (F.col("yc") == "") | (similarity(F.col("xc"), F.col("yc"), alike) >= CITY)
    scored = met.withColumn("confidence", F.col("_alike") + F.when(F.col("_there"), BONUS).otherwise(0.0)).where(F.col("confidence") >= NAME)
    scored = store.cut(scored.drop("_there", "yb", "_k", "_key")).where(near_city)
    best = first_per_key(scored, [*block, "x", "xc", "xb"], [F.desc("confidence"), F.col("match")])
    same = (F.col("_name") == F.col("x")) & (F.col("_city") == F.col("xc")) & F.col("_bucket").eqNullSafe(F.col("xb"))
    fuzzy = open_rows.select("id", *block, "_name", "_city", "_bucket").join(best.select(*block, "x", "xc", "xb", "match", "confidence"), block).where(same)
    found.append(rule(4, fuzzy, POSSIBLE, F.least(F.col("confidence"), F.lit(MOST)), F.col("match"), "similar name"))
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    first = rows.groupBy("id").agg(F.min_by(F.struct("status", "match", "confidence", "rule"), "_rule").alias("_m"))
    out = incoming.select("id").join(first, "id", "left")
    return out.select(
        "id", F.coalesce("_m.status", F.lit(NEW)).alias("status"), F.col("_m.match").alias("match"),
        F.coalesce("_m.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("_m.rule", F.lit("")).alias("rule"),
    )


def locate(incoming: DataFrame, known: DataFrame, reach: float = 0.01) -> DataFrame:
    """id, match, rule: by address, then by name within country and scene, then by a box of reach degrees there.

    Both have id, country, scene, name (normal form), url, lat, lon. The smallest known id stands for equals. Boxes meet by
    cells as wide as the box reaches, so only neighbours are compared.
    """
    order = [F.col("match")]
    k = known.select(F.col("id").alias("match"), "country", "scene", "name", "url", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    by_url = incoming.join(k.where("url <> ''").groupBy("url").agg(F.min("match").alias("match")), "url").select("id", "match", F.lit("url").alias("rule"), F.lit(0).alias("_r"))
    named = k.where("name <> ''").groupBy("country", "scene", "name").agg(F.min("match").alias("match"))
    by_name = incoming.join(named, ["country", "scene", "name"]).select("id", "match", F.lit("name").alias("rule"), F.lit(1).alias("_r"))
    cell = lambda c: F.floor(F.col(c) / reach)
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    ours = incoming.where("lat IS NOT NULL AND lon IS NOT NULL").select("id", "country", "scene", "lat", "lon", around("lat").alias("_i")).withColumn("_j", around("lon"))
    theirs = k.select("match", "country", "scene", "_lat", "_lon", cell("_lat").alias("_i"), cell("_lon").alias("_j"))
    near = ours.join(theirs, ["country", "scene", "_i", "_j"]).where((F.abs(F.col("lat") - F.col("_lat")) <= reach) & (F.abs(F.col("lon") - F.col("_lon")) <= reach))
    by_box = first_per_key(near, ["id"], order).select("id", "match", F.lit("box").alias("rule"), F.lit(2).alias("_r"))
    best = by_url.unionByName(by_name).unionByName(by_box).groupBy("id").agg(F.min_by(F.struct("match", "rule"), F.struct("_r", "match")).alias("m"))
    return incoming.select("id").join(best, "id", "left").select("id", "m.match", F.coalesce("m.rule", F.lit("none")).alias("rule"))
