"""Regions as rows, nearest neighbours without a fixed radius, and collapse of near duplicates, all by equi-joins on cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions import grid
from loomstone.functions.geo import EARTH_M, haversine
from loomstone.operators.latest import first_per_key
from loomstone.operators.ranks import join_keys
from loomstone.sources.tables import Scratch

#: Levels of the cover's cells, halves of a level's width and height at each step; how often a cell on an edge is split in 16.
STEP, SPLITS = 2, 2


def edges(rings: Column) -> Column:
    """Structs (la, lo, lb, lob) of all sides of rings, which are arrays of structs (lat, lon); the last point meets the first."""

    def of_ring(r: Column) -> Column:
        n = F.size(r)
        return F.transform(r, lambda p, i: F.struct(p["lat"].alias("la"), p["lon"].alias("lo"), F.get(r, (i + 1) % n)["lat"].alias("lb"), F.get(r, (i + 1) % n)["lon"].alias("lob")))

    return F.flatten(F.transform(rings, of_ring))


def in_edges(lat: Column, lon: Column, sides: Column) -> Column:
    """Whether a point is inside, by the parity of sides that a ray to the east crosses; so holes are outside."""

    def crosses(e: Column) -> Column:
        up = (e["la"] > lat) != (e["lb"] > lat)
        return up & (lon < (lat - e["la"]) * ((e["lob"] - e["lo"]) / (e["lb"] - e["la"])) + e["lo"])

    return F.size(F.filter(sides, lambda e: F.when(e["la"] == e["lb"], False).otherwise(crosses(e)))) % 2 == 1


def _square(level: Column, i: Column, j: Column) -> tuple[Column, Column, Column, Column]:
    """South, west, north, east of a cell of the plain grid."""
    n = F.pow(F.lit(2.0), level)
    return i / n * 180.0 - 90.0, j / n * 360.0 - 180.0, (i + 1) / n * 180.0 - 90.0, (j + 1) / n * 360.0 - 180.0


def cover(regions: DataFrame) -> DataFrame:
    """region, level, i, j, sides: cells that cover regions (region, rings); sides is null where a cell is inside its region.

    rings: arrays of structs (lat, lon), the first one the border, others holes (or more borders, which alternate by parity).
    Longitudes may go beyond 180 where a region crosses that meridian. A region starts at cells as large as itself; those on
    its edge are split twice in 16. A cell on the edge carries the sides that a ray to the east from a point in it may cross,
    so a point's test needs no other row. Null rings and rings of fewer than three points cover nothing.
    """
    every = edges(F.filter(F.col("rings"), lambda r: F.size(r) >= 3))
    rows = regions.where("rings IS NOT NULL").select("region", every.alias("sides")).where(F.size("sides") > 0)
    # the part beyond a meridian once more, a turn away
    turns = F.explode(F.array(F.lit(0.0), F.lit(-360.0), F.lit(360.0)))
    moved = F.transform("sides", lambda e: F.struct(e["la"].alias("la"), (e["lo"] + F.col("_turn")).alias("lo"), e["lb"].alias("lb"), (e["lob"] + F.col("_turn")).alias("lob")))
    rows = rows.withColumn("_turn", turns).select("region", moved.alias("sides"))
    lat = [F.array_min(F.transform("sides", lambda e: e["la"])), F.array_max(F.transform("sides", lambda e: e["la"]))]
    lon = [F.array_min(F.transform("sides", lambda e: e["lo"])), F.array_max(F.transform("sides", lambda e: e["lo"]))]
    rows = rows.select("region", "sides", lat[0].alias("s"), lat[1].alias("n"), lon[0].alias("w"), lon[1].alias("e")).where("e >= -180 AND w < 180")
    span = F.greatest(F.lit(1e-3), F.greatest(F.col("n") - F.col("s"), (F.col("e") - F.col("w")) / 2))
    level = (F.floor(F.log2(F.lit(180.0) / span) / STEP) * STEP).cast("int")
    rows = rows.withColumn("level", F.greatest(F.lit(0), F.least(F.lit(grid.DEEPEST // STEP * STEP - STEP * SPLITS), level)))
    n = F.pow(F.lit(2.0), F.col("level"))
    place = lambda c, low, whole: F.greatest(F.lit(0), F.least(n - 1, F.floor((c - low) / whole * n))).cast("long")
    rows = rows.withColumn("i", F.explode(F.sequence(place(F.col("s"), -90.0, 180.0), place(F.col("n"), -90.0, 180.0))))
    rows = rows.withColumn("j", F.explode(F.sequence(place(F.greatest(F.lit(-180.0), F.col("w")), -180.0, 360.0), place(F.least(F.lit(180.0), F.col("e")), -180.0, 360.0))))
    rows = rows.select("region", "level", "i", "j", "sides")
    out = []
    for split in range(SPLITS + 1):
        s, w, n_, e_ = _square(F.col("level"), F.col("i"), F.col("j"))
        # a ray from this cell crosses only sides that reach its latitudes and do not lie wholly in the west
        ray = F.filter("sides", lambda x: (F.greatest(x["la"], x["lb"]) >= s) & (F.least(x["la"], x["lb"]) <= n_) & (F.greatest(x["lo"], x["lob"]) >= w))  # noqa: B023
        rows = rows.withColumn("sides", ray)
        touches = F.exists("sides", lambda x: _meets(x, s, w, n_, e_))  # noqa: B023
        rows = rows.withColumn("_edge", touches).withColumn("_in", in_edges((s + n_) / 2, (w + e_) / 2, F.col("sides")))
        out.append(rows.where("NOT _edge AND _in").select("region", "level", "i", "j", F.lit(None).cast(dict(rows.dtypes)["sides"]).alias("sides")))
        rows = rows.where("_edge").drop("_edge", "_in")
        if split < SPLITS:
            parts = 1 << STEP
            rows = rows.withColumn("_a", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
            rows = rows.select("region", (F.col("level") + STEP).alias("level"), (F.col("i") * parts + F.col("_a")).alias("i"), (F.col("j") * parts + F.col("_b")).alias("j"), "sides")
    out.append(rows)
    all_rows = out[0]
    for r in out[1:]:
        all_rows = all_rows.unionByName(r)
    return all_rows


def _meets(x: Column, s: Column, w: Column, n: Column, e: Column) -> Column:
    """Whether a side may touch a box: their extents overlap, and the box's corners are not all on one side of its line."""
    near = (F.greatest(x["la"], x["lb"]) >= s) & (F.least(x["la"], x["lb"]) <= n) & (F.greatest(x["lo"], x["lob"]) >= w) & (F.least(x["lo"], x["lob"]) <= e)
    at = lambda la, lo: (x["lb"] - x["la"]) * (lo - x["lo"]) - (x["lob"] - x["lo"]) * (la - x["la"])
    corners = [at(s, w), at(s, e), at(n, w), at(n, e)]
    return near & (F.least(*corners) <= 1e-9) & (F.greatest(*corners) >= -1e-9)


def within_regions(points: DataFrame, covered: DataFrame) -> DataFrame:
    """points (id, lat, lon) with region, a row for each region of a cover that holds the point; a point on a border is in at most one of two that share it.

    Longitudes are taken modulo 360. Points without coordinates are in no region. A point meets a region once for each level of the
    cover, by an equi-join; only cells on an edge test sides.
    """
    levels = list(range(0, grid.DEEPEST + 1, STEP))
    lon = F.pmod(F.col("lon") + 180.0, F.lit(360.0)) - 180.0
    rows = points.where("lat BETWEEN -90 AND 90 AND lon IS NOT NULL").withColumn("_x", lon).withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    n = F.pow(F.lit(2.0), F.col("level"))
    rows = rows.withColumn("i", F.least(n - 1, F.floor((F.col("lat") + 90.0) / 180.0 * n)).cast("long")).withColumn("j", F.least(n - 1, F.floor((F.col("_x") + 180.0) / 360.0 * n)).cast("long"))
    met = rows.join(covered, ["level", "i", "j"]).where(F.col("sides").isNull() | in_edges(F.col("lat"), F.col("_x"), F.col("sides")))
    return met.select(*points.columns, "region")


def within_boxes(points: DataFrame, boxes: DataFrame, same: Sequence[str] = ()) -> DataFrame:
    """points (id, lat, lon) with region, for each box (region, south, west, north, east) that holds the point, borders included.

    A box whose west is greater than its east crosses the 180th meridian. Columns in same must be equal on both sides, too (a
    country). A box is listed in the few cells, about as large as itself, that it touches; null coordinates and null borders hold nothing.
    """
    b = boxes.where("south <= north AND west IS NOT NULL AND east IS NOT NULL")
    wide = F.col("west") > F.col("east")
    parts = F.when(wide, F.array(F.struct(F.col("west").alias("w"), F.lit(180.0).alias("e")), F.struct(F.lit(-180.0).alias("w"), F.col("east").alias("e"))))
    b = b.withColumn("_p", F.explode(parts.otherwise(F.array(F.struct(F.col("west").alias("w"), F.col("east").alias("e"))))))
    span = F.greatest(F.lit(1e-3), F.greatest(F.col("north") - F.col("south"), (F.col("_p.e") - F.col("_p.w")) / 2))
    b = b.withColumn("level", F.greatest(F.lit(0), F.least(F.lit(grid.DEEPEST // STEP * STEP), (F.floor(F.log2(F.lit(180.0) / span) / STEP) * STEP).cast("int"))))
    n = F.pow(F.lit(2.0), F.col("level"))
    place = lambda c, low, whole: F.greatest(F.lit(0), F.least(n - 1, F.floor((c - low) / whole * n))).cast("long")
    b = b.withColumn("i", F.explode(F.sequence(place(F.col("south"), -90.0, 180.0), place(F.col("north"), -90.0, 180.0))))
    b = b.withColumn("j", F.explode(F.sequence(place(F.col("_p.w"), -180.0, 360.0), place(F.col("_p.e"), -180.0, 360.0))))
    b = b.select("region", *same, "level", "i", "j", F.col("south").alias("_s"), F.col("north").alias("_n"), F.col("_p.w").alias("_w"), F.col("_p.e").alias("_e"))
    levels = F.explode(F.array(*[F.lit(k) for k in range(0, grid.DEEPEST + 1, STEP)]))
    rows = points.where("lat IS NOT NULL AND lon IS NOT NULL").withColumn("level", levels).withColumn("i", place(F.col("lat"), -90.0, 180.0)).withColumn("j", place(F.col("lon"), -180.0, 360.0))
    met = rows.join(b, [*same, "level", "i", "j"]).where(F.col("lat").between(F.col("_s"), F.col("_n")) & F.col("lon").between(F.col("_w"), F.col("_e")))
    return met.select(*points.columns, "region").distinct()


def nearest(
    places: DataFrame, points: DataFrame, k: int, most_m: float = 21_000_000.0, same: Sequence[str] = (), earth: float = EARTH_M, repeated: bool = False
) -> DataFrame:
    """id, point, distance_m, position: the k nearest points (point, lat, lon) of each place (id, lat, lon) within most_m, ties to the smaller point.

    Places of one spot have one answer, so it is sought once for each spot and joined to the places; of points in one spot only the k
    smallest can be among the nearest, so no more of them are looked at. Points are counted per cell of every second level, coarse to
    fine. A place looks up its deepest cell that holds k points: all of these are within the cell's diagonal, so the k nearest lie in a
    circle as wide, however far or dense they are. The circle is then met by cells about as large as itself, some dozens of them. A place
    for which no cell holds k points takes the widest circle. Counts are as many as occupied cells and are joined, not
    broadcast. Null coordinates take no part. Columns in same must be equal on both sides, too, and not null; earth is the radius in the
    unit of distance_m and most_m; repeated says that a point may be in several spots, of which the nearest counts.
    """
    levels = list(range(0, grid.DEEPEST - 1, 2))
    metres = EARTH_M / earth
    keys = [*same, "lat", "lon"]
    p = points.where("lat IS NOT NULL AND lon IS NOT NULL").select(*same, "point", "lat", "lon")
    if repeated:
        p = p.distinct()
    p = first_per_key(p, keys, [F.col("point")], k).select(*same, "point", F.col("lat").alias("_plat"), F.col("lon").alias("_plon"))
    there = places.where("lat IS NOT NULL AND lon IS NOT NULL").select("id", *keys)
    own = there.select(*keys).distinct()
    cells = lambda lat, lon: F.explode(F.array(*[F.struct(F.lit(v).alias("level"), grid.cell(F.col(lat), F.col(lon), v).alias("cell")) for v in levels])).alias("_c")
    number = F.count_distinct("point") if repeated else F.count("*")
    counts = p.select(*same, "point", cells("_plat", "_plon")).groupBy(*same, "_c.level", "_c.cell").agg(number.alias("_n")).where(F.col("_n") >= k)
    ranked = own.select(*keys, cells("lat", "lon")).select(*keys, "_c.level", "_c.cell").join(counts, [*same, "level", "cell"], "left")
    deepest = ranked.groupBy(*keys).agg(F.max(F.when(F.col("_n").isNotNull(), F.col("level"))).alias("_level"))
    # a cell is at most twice as wide as high
    diagonal = F.lit(3.1416 * 6_371_100.0 * 2.2361 / metres) / F.pow(F.lit(2.0), F.col("_level"))
    asked = deepest.withColumn("_radius", F.least(F.lit(most_m), F.coalesce(diagonal, F.lit(most_m))))
    # the deepest of the levels whose cells have a diagonal not below the radius: a few dozen of them cover the circle
    fits = F.floor((F.log2(F.lit(3.1416 * 6_371_100.0 * 2.2361 / metres) / F.col("_radius")) + 0.01) / 2) * 2
    asked = asked.withColumn("_at", F.greatest(F.lit(0), F.least(F.lit(levels[-1] + 2), fits.cast("int"))))
    left = asked.withColumn("_cell", F.explode(grid.around(F.col("lat"), F.col("lon"), F.col("_radius") * metres, F.col("_at"))))
    reached = [*levels, levels[-1] + 2]
    right = p.withColumn("_cell", F.explode(F.array(*[grid.cell(F.col("_plat"), F.col("_plon"), v) for v in reached])))
    near = left.join(right, [*same, "_cell"]).withColumn("distance_m", haversine(F.col("lat"), F.col("lon"), F.col("_plat"), F.col("_plon"), earth)).where(F.col("distance_m") <= F.col("_radius"))
    near = near.select(*keys, "point", "distance_m")
    if repeated:
        near = near.groupBy(*keys, "point").agg(F.min("distance_m").alias("distance_m"))
    best = first_per_key(near, keys, [F.col("distance_m"), F.col("point")], k)
    lists = best.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("distance_m", "point"))).alias("_b"))
    return there.join(lists, keys).select("id", F.posexplode("_b").alias("_p", "_s")).select("id", "_s.point", "_s.distance_m", (F.col("_p") + 1).cast("int").alias("position"))


def nearest_city(places: DataFrame, cities: DataFrame, limits: Column, admin_limits: Column, gap_km: float = 5.0, ratio: float = 1.5) -> DataFrame:
    """id, city, distance_km, status, reason: the nearest city of each place (id, lat, lon, and what the limits read).

    cities: city, lat, lon, admin (whether it is an administrative seat). Seats within admin_limits (km) go first; only where there
    is none, any city within limits. The next one must be gap_km farther and ratio times as far (of at least 100 m), or it is for review.
    """
    seats = nearest(places, cities.where("admin").select(F.col("city").alias("point"), "lat", "lon"), 2)
    every = nearest(places, cities.select(F.col("city").alias("point"), "lat", "lon"), 2)
    own = places.select("id", "lat", "lon", admin_limits.alias("_al"), limits.alias("_l"))

    def two(found: DataFrame, limit: str, tag: str) -> DataFrame:
        rows = own.join(found, "id").where(F.col("distance_m") / 1000 <= F.col(limit))
        pick = lambda n, c: F.max(F.when(F.col("position") == n, F.col(c)))
        return rows.groupBy("id").agg(pick(1, "point").alias(f"{tag}1"), (pick(1, "distance_m") / 1000).alias(f"{tag}d1"), (pick(2, "distance_m") / 1000).alias(f"{tag}d2"))

    rows = own.join(two(seats, "_al", "a"), "id", "left").join(two(every, "_l", "c"), "id", "left")
    seat = F.col("a1").isNotNull()
    city, d1, d2 = F.when(seat, F.col("a1")).otherwise(F.col("c1")), F.when(seat, F.col("ad1")).otherwise(F.col("cd1")), F.when(seat, F.col("ad2")).otherwise(F.col("cd2"))
    close = F.coalesce((d2 - d1 < gap_km) | (d2 / F.greatest(d1, F.lit(0.1)) < ratio), F.lit(False))
    reason = (
        F.when(F.col("lat").isNull() | F.col("lon").isNull(), "coordinate required").when(city.isNull(), "none within reach").when(close, "the next is as near")
        .when(seat, "nearest seat").otherwise("nearest place")
    )
    status = F.when(city.isNull(), "unmapped").when(close, "review_required").otherwise("verified")
    return rows.select("id", F.when(~close, city).alias("city"), F.when(city.isNotNull(), d1).alias("distance_km"), status.alias("status"), reason.alias("reason"))


def collapse(places: DataFrame, reach_km: float = 5.0, most_rounds: int = 10_000) -> DataFrame:
    """code, keeper of each place (code, name, lat, lon): in the order of codes a place of the same name near one that was kept folds into it.

    The first kept one by code that is within reach counts. Names are compared as they are (null names are one name); places
    without coordinates are near nothing; codes are distinct. This is the lexicographically first independent set of the
    neighbour graph, found in rounds: the first open place of each cell is kept unless an open one with a smaller code is near it, in its
    own cell or around; what is near it is closed. Any two places of a cell are neighbours, so a round compares each place with the
    first ones of the cells around, and ten thousand places of one name in one spot end in one round. A chain takes a round for
    each two of its links.
    """
    store = Scratch(places.sparkSession)
    level, metres = grid.inner_level(reach_km * 1000), reach_km * 1000
    c = F.col
    apart = places.where("lat IS NULL OR lon IS NULL").select("code", c("code").alias("keeper"))
    rows = store.cut(places.where("lat IS NOT NULL AND lon IS NOT NULL").select("code", "name", "lat", "lon", grid.cell(c("lat"), c("lon"), level).alias("cell")))
    km = haversine(c("lat"), c("lon"), c("_lat"), c("_lon"), 6_371_000.0)
    around = F.explode(grid.around(c("_lat"), c("_lon"), metres, level)).alias("cell")
    open_rows, kept = rows, None
    for _ in range(most_rounds):
        if open_rows.isEmpty():
            break
        first = open_rows.groupBy("name", "cell").agg(F.min_by(F.struct("code", "lat", "lon"), "code").alias("f")).select(
            "name", c("f.code").alias("_code"), c("f.lat").alias("_lat"), c("f.lon").alias("_lon"))
        spread = first.select("name", "_code", "_lat", "_lon", around)
        met = join_keys(open_rows, spread, ["name", "cell"]).where(km <= metres)
        blocked = met.where("code < _code").select("_code").distinct()
        now = store.cut(first.join(blocked, "_code", "left_anti"))
        kept = now if kept is None else store.cut(kept.unionByName(now))
        closing = now.select("name", "_code", "_lat", "_lon", around)
        gone = join_keys(open_rows, closing, ["name", "cell"]).where(km <= metres).select("code").distinct()
        before, open_rows = open_rows, store.cut(open_rows.join(gone, "code", "left_anti"))
        store.drop(before if before is not rows else None)
    else:
        raise RuntimeError(f"places are still open after {most_rounds} rounds")
    if kept is None:
        return apart
    spread = kept.select("name", "_code", "_lat", "_lon", around)
    folded = join_keys(rows, spread, ["name", "cell"]).where((km <= metres) & (c("_code") <= c("code")))
    return folded.groupBy("code").agg(F.min("_code").alias("keeper")).unionByName(apart)


def merged(places: DataFrame, keepers: DataFrame) -> DataFrame:
    """code, aliases, duplicates of each keeper: the aliases of its own and of what folds into it, each once, in the order of codes; duplicates are all codes, sorted, if there are several.

    places: code, aliases (an array or null). A keeper's row holds the aliases of all of its duplicates.
    """
    rows = places.join(keepers, "code")
    per = rows.groupBy("keeper").agg(F.sort_array(F.collect_list(F.struct("code", F.coalesce("aliases", F.array().cast("array<string>")).alias("a")))).alias("_r"))
    codes = F.transform("_r", lambda r: r["code"])
    return per.select(F.col("keeper").alias("code"), F.array_distinct(F.flatten(F.transform("_r", lambda r: r["a"]))).alias("aliases"), F.when(F.size("_r") > 1, codes).otherwise(F.array().cast("array<string>")).alias("duplicates"))
