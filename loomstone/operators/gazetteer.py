"""Cities of places: overrides, names, localities, boxes and reference points; matches with a gazetteer."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import names as forms
from loomstone.functions.geo import haversine, radius_join
from loomstone.operators.latest import first_per_key
from loomstone.operators.spatial import nearest, within_boxes


def assign_cities(places: DataFrame, cities: DataFrame, names: DataFrame, points: DataFrame, overrides: DataFrame) -> DataFrame:
    """id, city, status (verified, review_required, unmapped), method of each place.

    places: id, country, source (normal form), lat, lon. cities: city, country, bounds (struct south, west, north, east or
    null), needs_point, reach_km. names: city, country, name (normal form), kind (canonical, alias or locality). points:
    city, lat, lon. overrides: id, city, reach_km (null: none asked).

    An override decides, if its city exists and a point of it is within reach. Else the cities whose name the source is (of
    those that need a point near, only the ones that have it) and the cities whose box holds the place are counted: more
    than one of either is ambiguous, one of each that differ are a conflict, one alone is the city. Names meet by an
    equi-join, boxes meet places by the cells that they touch.
    """
    km = lambda a, b, c, d: haversine(a, b, c, d, 6371.0)
    c = F.col
    near = points.withColumnRenamed("lat", "_plat").withColumnRenamed("lon", "_plon")
    # overrides
    o = places.join(overrides.select("id", c("city").alias("_oc"), c("reach_km").alias("_or")), "id")
    o = o.join(cities.select(c("city").alias("_oc"), c("country").alias("country"), F.lit(True).alias("_there")), ["_oc", "country"], "left")
    reached = o.join(near.select(c("city").alias("_oc"), "_plat", "_plon"), "_oc", "left").groupBy("id").agg(
        F.max("_there").alias("_there"), F.first("_oc").alias("_oc"), F.first("_or").alias("_or"), F.min(km(c("lat"), c("lon"), c("_plat"), c("_plon"))).alias("_d")
    )
    fits = c("_or").isNull() | (c("_d") <= c("_or"))
    forced = reached.select(
        "id", F.when(c("_there") & fits, c("_oc")).alias("f_city"),
        F.when(c("_there").isNull(), "property_override_city_missing").when(F.coalesce(fits, F.lit(False)), "property_override").otherwise("property_override_coordinate_conflict").alias("f_method"),
    )
    # names
    by_name = places.join(names.select("country", c("name").alias("source"), "city", "kind"), ["country", "source"])
    by_name = by_name.groupBy("id", "city", "lat", "lon").agg(F.max(c("kind") != "locality").alias("canonical")).join(cities.select("city", "needs_point", "reach_km"), "city")
    within = by_name.join(near, "city", "left").groupBy("id", "city", "canonical", "needs_point").agg(F.max(km(c("lat"), c("lon"), c("_plat"), c("_plon")) <= c("reach_km")).alias("_near"))
    within = within.withColumn("ok", ~c("needs_point") | F.coalesce("_near", F.lit(False)))
    named = within.groupBy("id").agg(
        F.count("*").alias("n_all"), F.count_if("ok").alias("n_name"), F.min(F.when(c("ok"), F.struct("city", "canonical", "needs_point"))).alias("name")
    )
    # boxes
    box = cities.where("bounds IS NOT NULL").select("country", c("city").alias("region"), "bounds.*")
    held = within_boxes(places.select("id", "country", "lat", "lon"), box, ["country"])
    boxed = held.groupBy("id").agg(F.count("*").alias("n_box"), F.min("region").alias("box"))
    known = cities.select("country").distinct().withColumn("_model", F.lit(True))
    out = places.select("id", "country").join(known, "country", "left").join(forced, "id", "left").join(named, "id", "left").join(boxed, "id", "left")
    nn, nb = F.coalesce("n_name", F.lit(0)), F.coalesce("n_box", F.lit(0))
    one_name, one_box = nn == 1, nb == 1
    method = (
        F.when(c("_model").isNull(), "no_official_match")
        .when(c("f_method").isNotNull(), c("f_method"))
        .when((F.coalesce("n_all", F.lit(0)) > 0) & (nn == 0), "official_name_coordinate_conflict")
        .when(one_name & one_box & (c("name.city") != c("box")), "coordinate_name_conflict")
        .when((nn > 1) | (nb > 1), "ambiguous_official_mapping")
        .when(~one_name & ~one_box, "no_official_match")
        .when(one_name & c("name.needs_point"), F.when(c("name.canonical"), "reference_exact_coordinate").otherwise("reference_alias_coordinate"))
        .when(~one_name, "coordinate_boundary")
        .when(c("name.canonical"), "canonical_exact")
        .otherwise("official_crosswalk")
    )
    found = F.coalesce(F.when(one_box, c("box")), F.when(one_name, c("name.city")))
    out = out.withColumn("method", method)
    good = c("method").isin("property_override", "reference_exact_coordinate", "reference_alias_coordinate", "coordinate_boundary", "canonical_exact", "official_crosswalk")
    city = F.when(good, F.when(c("method") == "property_override", c("f_city")).otherwise(found))
    status = F.when(good, "verified").when(c("method") == "no_official_match", "unmapped").otherwise("review_required")
    return out.select("id", city.alias("city"), status.alias("status"), "method")


def gazetteer_match(places: DataFrame, locations: DataFrame, reach_km: float = 75.0, apart_km: float = 1.0) -> DataFrame:
    """id, code, distance_km, verdict: the nearest location of the place's name within reach; ambiguous if the next is less than apart_km farther.

    places: id, country, name, lat, lon; locations: code, country, name, lat, lon (a row for each of its names). The two nearest are sought
    by cells within country and name, once for each spot (spatial.nearest).
    """
    same = ["country", "name"]
    two = nearest(places, locations.select(*same, F.col("code").alias("point"), "lat", "lon"), 2, reach_km, same, 6371.0, repeated=True)
    pick = lambda n, x: F.max(F.when(F.col("position") == n, F.col(x)))
    top = two.groupBy("id").agg(pick(1, "point").alias("code"), pick(1, "distance_m").alias("distance_km"), pick(2, "distance_m").alias("_next"))
    verdict = F.when(F.col("_next") - F.col("distance_km") < apart_km, "ambiguous").when(F.col("code").isNotNull(), "matched").otherwise("none")
    return places.select("id").join(top, "id", "left").select("id", "code", "distance_km", verdict.alias("verdict"))


def first_answer(places: DataFrame, answers: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """id, code, source: of several matches (id, code or null) the first that has a code, in order."""
    out = places.select("id")
    for i, (_, a) in enumerate(answers):
        out = out.join(a.select("id", F.col("code").alias(f"_c{i}")), "id", "left")
    source = F.coalesce(*[F.when(F.col(f"_c{i}").isNotNull(), name) for i, (name, _) in enumerate(answers)], F.lit("none"))
    return out.select("id", F.coalesce(*[F.col(f"_c{i}") for i in range(len(answers))]).alias("code"), source.alias("source"))


def assignment_plan(rows: DataFrame, identity: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """Of rows (id, before, after, status): counts by before, after and status; and identities that more than one row would have."""
    flow = rows.groupBy("before", "after", "status").agg(F.count("*").alias("n"))
    keyed = rows.withColumn("identity", F.concat_ws("|", *identity))
    clashes = keyed.where("after IS NOT NULL").groupBy("identity").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
    return flow, clashes


def preferred_exact(points: DataFrame, locations: DataFrame, reach_km: float, apart_km: float = 1.0) -> DataFrame:
    """group, code, mean_km: for each group of points the location of its name with the least mean distance, where all points are within reach.

    points: group, name, lat, lon (of one name for a group); locations: code, name, lat, lon (a row for each of its names). The next
    location must be apart_km farther on average, or the group has none; points without coordinates and groups without any don't count.
    Points of one spot count as one with a weight, and of a name's locations in one spot only two can be among the nearest.
    """
    p = points.where("lat IS NOT NULL AND lon IS NOT NULL").groupBy("group", "name", "lat", "lon").agg(F.count("*").alias("_n"))
    l = locations.select("code", "name", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).dropDuplicates(["code", "name"])  # noqa: E741
    l = first_per_key(l, ["name", "_lat", "_lon"], [F.col("code")], 2)  # noqa: E741
    d = haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"), 6371.0)
    per = p.join(l, "name").groupBy("group", "code").agg((F.sum(d * F.col("_n")) / F.sum("_n")).alias("mean_km"), F.max(d).alias("_far")).where(F.col("_far") <= reach_km)
    w = Window.partitionBy("group").orderBy("mean_km", "code")
    two = first_per_key(per, ["group"], [F.col("mean_km"), F.col("code")], 2)
    top = two.withColumn("_next", F.lead("mean_km").over(w)).withColumn("_k", F.row_number().over(w)).where("_k = 1")
    return top.where(F.col("_next").isNull() | (F.col("_next") - F.col("mean_km") >= apart_km)).select("group", "code", "mean_km")


def preferred_variant(
    points: DataFrame, locations: DataFrame, reach_km: float, alike: Callable[[Column, Column], Column] = forms.sequence_ratio, least: float = 0.5
) -> DataFrame:
    """group, code, similarity, median_km, status of each group of points whose name no location has: the location with the most similar name near it.

    points: group, name, lat, lon; locations: code, name, lat, lon (a row for each of its names). The upper median of a group's
    distances must be within reach_km, so half of its points are, and a location is only looked at where one of them is: they meet by cells.
    Names below least in similarity don't count. The most similar name is the answer, then the nearer one, then the smaller code; it is
    for review if the next is less than 0.05 less similar and its distance differs by less than 5 km.
    """
    p = points.where("lat IS NOT NULL AND lon IS NOT NULL AND name <> ''").select("group", "name", "lat", "lon")
    p = p.join(locations.select("name").distinct(), "name", "left_anti")
    where = locations.where("lat IS NOT NULL AND lon IS NOT NULL").groupBy("code").agg(F.min_by("lat", F.struct("lat", "lon")).alias("_lat"), F.min_by("lon", F.struct("lat", "lon")).alias("_lon"))
    met = radius_join(p.select("group", F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon")), where.select("code", F.col("_lat").alias("r_lat"), F.col("_lon").alias("r_lon")), reach_km * 1000 * 1.001)
    some = met.select("group", "code").distinct()
    d = haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"), 6371.0)
    far = some.join(where, "code").join(p, "group").withColumn("_d", d)
    # the upper median is an element: the smallest with more than half of all at or below it
    median = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _d DESC)")
    near = far.groupBy("group", "code").agg(median.alias("median_km"), F.first("name").alias("name")).where(F.col("median_km") <= reach_km)
    scored = near.join(locations.select("code", F.col("name").alias("_alias")), "code").select("group", "code", "median_km", "name", "_alias").withColumn("_s", alike(F.col("name"), F.col("_alias")))
    best = scored.groupBy("group", "code").agg(F.max("_s").alias("similarity"), F.first("median_km").alias("median_km")).where(F.col("similarity") >= least)
    order = [F.desc("similarity"), F.col("median_km"), F.col("code")]
    w = Window.partitionBy("group").orderBy(*order)
    two = first_per_key(best, ["group"], order, 2)
    top = two.withColumn("_s2", F.lead("similarity").over(w)).withColumn("_d2", F.lead("median_km").over(w)).withColumn("_k", F.row_number().over(w)).where("_k = 1")
    close = (F.col("similarity") - F.col("_s2") < 0.05) & (F.abs(F.col("median_km") - F.col("_d2")) < 5.0)
    return top.select("group", "code", "similarity", "median_km", F.when(F.coalesce(close, F.lit(False)), "review_required").otherwise("verified").alias("status"))


#: How a step's answer came about, and what the other gazetteer said of it.
AGREED, ALONE, DISPUTED = "agreed", "alone", "disputed"


def registry(places: DataFrame, first: DataFrame, second: DataFrame, hints: DataFrame, nearest: DataFrame, apart_km: float = 25.0) -> tuple[DataFrame, DataFrame]:
    """Each place's city out of five steps, and how many places each step and check settled.

    places: id; first, second: id, code, lat, lon of two gazetteers' matches (code null: none); hints, nearest: id, code, by a place's
    own name and by distance. The first gazetteer's answer counts unless the second one puts the city more than apart_km away, which is
    disputed and goes no further; without an answer of the first the second one's counts, then the name's hint, then the nearest.
    Result: id, code, step (first, second, hint, nearest, none), checked (agreed, alone, disputed, or null beyond the first step).
    Audit: step, checked, n, in one pass over the result.
    """
    one = first.select("id", F.col("code").alias("_a"), F.col("lat").alias("_alat"), F.col("lon").alias("_alon"))
    two = second.select("id", F.col("code").alias("_b"), F.col("lat").alias("_blat"), F.col("lon").alias("_blon"))
    rows = places.select("id").join(one, "id", "left").join(two, "id", "left")
    rows = rows.join(hints.select("id", F.col("code").alias("_c")), "id", "left").join(nearest.select("id", F.col("code").alias("_d")), "id", "left")
    km = haversine(F.col("_alat"), F.col("_alon"), F.col("_blat"), F.col("_blon"), 6371.0)
    checked = F.when(F.col("_a").isNotNull(), F.when(F.col("_b").isNull() | km.isNull(), ALONE).when(km <= apart_km, AGREED).otherwise(DISPUTED))
    step = F.when(F.col("_a").isNotNull(), "first").when(F.col("_b").isNotNull(), "second").when(F.col("_c").isNotNull(), "hint").when(F.col("_d").isNotNull(), "nearest").otherwise("none")
    code = F.when(F.coalesce(checked == DISPUTED, F.lit(False)), F.lit(None)).otherwise(F.coalesce("_a", "_b", "_c", "_d"))
    out = rows.select("id", code.alias("code"), step.alias("step"), checked.alias("checked"))
    return out, out.groupBy("step", "checked").agg(F.count("*").alias("n"))
