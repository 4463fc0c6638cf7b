"""Values, contexts, links and vectors out of texts; nested output."""

from pyspark.sql import functions as F

from loomstone.functions import geo, text
from loomstone.functions.names import hash_vector, plain_text
from loomstone.operators.latest import first_per_key
from loomstone.plans.geography import _C, _D, _S, _customers, _suppliers
from loomstone.plans.registry import Tables, query

_VALUE = r"([0-9][0-9.,]*[0-9]|[0-9]) +[a-z]{2,}"
_MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_RING = [(-50.0, -120.0), (40.0, -150.0), (65.0, 10.0), (10.0, 20.0), (30.0, 140.0), (-60.0, 100.0)]


@query(rf"""WITH v AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_VALUE}', 1)) AS x FROM documents),
n AS (SELECT doc_id, CASE WHEN regexp_matches(x, '^[0-9]{{1,3}}(\.[0-9]{{3}}){{2,}}$') THEN replace(x, '.', '')::DOUBLE WHEN regexp_matches(x, '^[0-9]{{1,3}}(,[0-9]{{3}})+(\.[0-9]+)?$') THEN replace(x, ',', '')::DOUBLE WHEN regexp_matches(x, '^[0-9]+(\.[0-9]+)?$') THEN x::DOUBLE END AS v FROM v)
SELECT doc_id, count(*) AS found, count(v) AS numbers, max(CASE WHEN v = floor(v) AND v BETWEEN 1900 AND 2100 THEN NULL ELSE v END) AS largest FROM n GROUP BY 1""")
def metric_extraction(t: Tables):
    """Numbers before a word, in either grouping; whole ones that may be years don't count as values."""
    n = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_VALUE), F.lit(1))).alias("x")).select("doc_id", text.number(F.col("x")).alias("v"))
    year = (F.col("v") == F.floor("v")) & F.col("v").between(1900, 2100)
    return n.groupBy("doc_id").agg(F.count("*").alias("found"), F.count("v").alias("numbers"), F.max(F.when(~year, F.col("v"))).alias("largest"))


@query(rf"""WITH p AS (SELECT doc_id, regexp_split_to_array(text, '{_MAIL}') AS parts, regexp_extract_all(text, '{_MAIL}') AS hits FROM documents),
e AS (SELECT doc_id, parts, hits, unnest(range(1, len(hits) + 1)) AS i FROM p)
SELECT doc_id, i - 1 AS pos, sha256(hits[i]) AS hit, right(parts[i], 40) AS ahead, left(parts[i + 1], 40) AS behind FROM e""")
def matches_with_context(t: Tables):
    """Every match of a pattern with up to 40 characters on either side, as far as the next match."""
    p = t.documents.select("doc_id", F.split("text", _MAIL, -1).alias("parts"), F.regexp_extract_all("text", F.lit(_MAIL), F.lit(0)).alias("hits"))
    e = p.select("doc_id", "parts", F.posexplode("hits").alias("pos", "hit"))
    return e.select("doc_id", F.col("pos").cast("long").alias("pos"), F.sha2("hit", 256).alias("hit"), F.right(F.get("parts", F.col("pos")), F.lit(40)).alias("ahead"), F.left(F.get("parts", F.col("pos") + 1), F.lit(40)).alias("behind"))


@query(r"""WITH a AS (SELECT page_id, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS site, regexp_extract_all(html, '<a [^>]*href="([^"#]+)', 1) AS l FROM pages),
e AS (SELECT page_id, site, unnest(l) AS link, generate_subscripts(l, 1) AS pos FROM a)
SELECT page_id, CASE WHEN starts_with(link, '/') THEN site || link ELSE link END AS target, min(pos)::BIGINT AS first_at FROM e GROUP BY 1, 2""")
def page_links(t: Tables):
    """Links of a page, made absolute, each once with its first place."""
    site = F.regexp_extract("url", "^([A-Za-z]+://[^/?#]*)", 1)
    e = t.pages.select("page_id", site.alias("site"), F.posexplode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"#]+)'), F.lit(1))).alias("pos", "link"))
    target = F.when(F.startswith("link", F.lit("/")), F.concat("site", "link")).otherwise(F.col("link"))
    return e.groupBy("page_id", target.alias("target")).agg((F.min("pos") + 1).cast("long").alias("first_at"))


@query(r"""SELECT doc_id, sha256(trim(regexp_replace(replace(lower(strip_accents(text)), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g'))) AS plain FROM documents""")
def plain_names(t: Tables):
    return t.documents.select("doc_id", F.sha2(plain_text("text"), 256).alias("plain"))


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM documents),
h AS (SELECT doc_id, ('0x' || substr(sha256(w), 1, 8))::BIGINT % 8 AS d, sum(CASE WHEN ('0x' || substr(sha256(w), 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS n FROM w GROUP BY 1, 2),
s AS (SELECT doc_id, d, n, sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS norm FROM h),
a AS (SELECT doc_id, i AS dim FROM documents, range(8) r(i))
SELECT a.doc_id, dim::INT AS dim, round(coalesce(CASE WHEN norm > 0 THEN n / norm END, 0), 6) AS x FROM a LEFT JOIN s ON a.doc_id = s.doc_id AND dim = d""")
def hash_embedding(t: Tables):
    """Signed word counts by hash, normalised; all within the row, without a shuffle."""
    v = hash_vector(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), 8)
    return t.documents.select("doc_id", F.posexplode(v).alias("dim", "x")).select("doc_id", "dim", F.round("x", 6).alias("x"))


@query(f"""SELECT k, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || round(lo, 1) || ',' || round(la, 1) || ']}},"properties":{{"nation":' || nation || '}}}}' AS feature FROM ({_C})""")
def geojson_features(t: Tables):
    point = F.struct(F.lit("Point").alias("type"), F.array(F.round("l_lon", 1), F.round("l_lat", 1)).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct("nation").alias("properties"))
    return _customers(t).select("k", F.to_json(feature).alias("feature"))


def _crossings() -> str:
    edges = zip(_RING, [*_RING[1:], _RING[0]], strict=True)
    return " + ".join(f"CASE WHEN (({a} > la) <> ({b} > la)) AND lo < (la - ({a})) * {(bo - ao) / (b - a)}::DOUBLE + ({ao}) THEN 1 ELSE 0 END" for (a, ao), (b, bo) in edges if a != b)


@query(f"SELECT k, ({_crossings()}) % 2 = 1 AS inside FROM ({_C})")
def point_in_polygon(t: Tables):
    return _customers(t).select("k", geo.in_ring(F.col("l_lat"), F.col("l_lon"), _RING).alias("inside"))


@query(f"""WITH e AS (SELECT s AS k, ra AS la, ro AS lo, floor((ro + 180.0) / 360.0 * 64)::BIGINT AS x, floor((0.5 - ln((1 + sin(radians(ra))) / (1 - sin(radians(ra)))) / (4 * pi())) * 64)::BIGINT AS y FROM ({_S})),
c AS (SELECT k, la, lo, x + i AS tx, y + j AS ty FROM e, range(-1, 2) a(i), range(-1, 2) b(j) WHERE x + i BETWEEN 0 AND 63 AND y + j BETWEEN 0 AND 63),
p AS (SELECT *, degrees(atan(sinh(pi() * (1 - 2 * (ty + 0.5) / 64)))) AS ra, (tx + 0.5) / 64 * 360.0 - 180.0 AS ro FROM c)
SELECT k AS s, tx, ty FROM p WHERE {_D} <= 400000""")
def tile_cover(t: Tables):
    """Tiles whose centre is within 400 km; at this zoom they are at most one tile away."""
    n = F.explode(geo.neighbours(geo.tile_x(F.col("r_lon"), 6), geo.tile_y(F.col("r_lat"), 6), 6))
    c = _suppliers(t).withColumn("n", n).select("s", "r_lat", "r_lon", F.col("n.x").alias("tx"), F.col("n.y").alias("ty"))
    return c.where(geo.haversine(F.col("r_lat"), F.col("r_lon"), geo.tile_lat(F.col("ty"), 6), geo.tile_lon(F.col("tx"), 6)) <= 400_000).select("s", "tx", "ty")


_HOLE = [(_RING[0][0] * 0.3, _RING[0][1] * 0.3), (_RING[1][0] * 0.3, _RING[1][1] * 0.3), (_RING[2][0] * 0.3, _RING[2][1] * 0.3)]


def _crossed(ring) -> str:
    edges = zip(ring, [*ring[1:], ring[0]], strict=True)
    return " + ".join(f"CASE WHEN (({a}::DOUBLE > la) <> ({b}::DOUBLE > la)) AND lo < (la - ({a})::DOUBLE) * {(bo - ao) / (b - a)}::DOUBLE + ({ao})::DOUBLE THEN 1 ELSE 0 END" for (a, ao), (b, bo) in edges if a != b)


@query(f"SELECT k, ({_crossed(_RING)}) % 2 = 1 AND NOT (({_crossed(_HOLE)}) % 2 = 1) AS inside FROM ({_C})")
def point_in_polygon_with_hole(t: Tables):
    return _customers(t).select("k", geo.in_polygon(F.col("l_lat"), F.col("l_lon"), [_RING, _HOLE]).alias("inside"))


@query(f"""WITH e AS (SELECT s AS k, ra AS la, ro AS lo FROM ({_S})), c AS (SELECT k, la, lo, x::BIGINT AS tx, y::BIGINT AS ty FROM e, range(64) a(x), range(64) b(y)),
p AS (SELECT *, degrees(atan(sinh(pi() * (1 - 2 * (ty + 0.5) / 64)))) AS ra, (tx + 0.5) / 64 * 360.0 - 180.0 AS ro FROM c WHERE abs((tx + 0.5) / 64 * 360.0 - 180.0 - lo) < 180)
SELECT k AS s, tx, ty, round(tx / 64.0::DOUBLE * 360.0 - 180.0, 6) AS west, round(degrees(atan(sinh(pi() * (1 - 2 * ty / 64.0::DOUBLE)))), 6) AS north FROM p WHERE {_D} <= 1500000""")
def radius_cover(t: Tables):
    """All tiles whose centre is within 1500 km, however many tiles away, with a corner of each; the window does not wrap."""
    c = _suppliers(t).withColumn("n", F.explode(geo.radius_cover(F.col("r_lat"), F.col("r_lon"), 1_500_000.0, 6))).select("s", F.col("n.x").alias("tx"), F.col("n.y").alias("ty"), "r_lon")
    corner = geo.tile_polygon(F.col("tx"), F.col("ty"), 6)[0]
    return c.where(F.abs(geo.tile_lon(F.col("tx"), 6) - F.col("r_lon")) < 180).select("s", "tx", "ty", F.round(corner[0], 6).alias("west"), F.round(corner[1], 6).alias("north"))


@query("""SELECT o_orderkey, year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS rank, 'Q' || quarter(o_orderdate) AS quarter,
  CASE o_orderstatus WHEN 'F' THEN o_orderdate + INTERVAL 30 MINUTE WHEN 'O' THEN o_orderdate + INTERVAL 1 HOUR WHEN 'P' THEN o_orderdate + INTERVAL 7 DAY ELSE o_orderdate + INTERVAL 6 HOUR END AS retry_at FROM orders""")
def dates_and_backoff(t: Tables):
    d, status = F.col("o_orderdate"), F.col("o_orderstatus")
    wait = F.when(status == "F", F.expr("INTERVAL 30 MINUTES")).when(status == "O", F.expr("INTERVAL 60 MINUTES")).when(status == "P", F.expr("INTERVAL 10080 MINUTES")).otherwise(F.expr("INTERVAL 360 MINUTES"))
    rank = F.year(d).cast("long") * 10000 + F.month(d) * 100 + F.day(d)
    return t.orders.select("o_orderkey", rank.alias("rank"), F.concat(F.lit("Q"), F.quarter(d).cast("string")).alias("quarter"), (d + wait).alias("retry_at"))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity * CASE l_returnflag WHEN 'A' THEN 365 WHEN 'N' THEN 15 ELSE 900 END AS annual, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS pos FROM lineitem)
SELECT l_orderkey, l_returnflag AS field, annual, concat_ws('; ', CASE WHEN annual > 12000 THEN 'above cap' END, CASE WHEN annual < 100 THEN 'too few' END) AS reasons FROM m
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY pos, annual DESC, l_linenumber) = 1""")
def annual_proxy(t: Tables):
    """The preferred field with its multiplier, and why the estimate needs a look."""
    factors = F.broadcast(t.spark.createDataFrame([("A", 365, 0), ("N", 15, 1), ("R", 900, 2)], "l_returnflag string, factor int, pos int"))
    m = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity").join(factors, "l_returnflag").withColumn("annual", F.col("l_quantity") * F.col("factor"))
    best = first_per_key(m, ["l_orderkey"], [F.col("pos"), F.desc("annual"), F.col("l_linenumber")])
    reasons = F.array_compact(F.array(F.when(F.col("annual") > 12000, "above cap"), F.when(F.col("annual") < 100, "too few")))
    return best.select("l_orderkey", F.col("l_returnflag").alias("field"), "annual", F.array_join(reasons, "; ").alias("reasons"))
