"""Identity, merges, places of names, lookups by priority, nested packets."""

from pyspark.sql import functions as F

from loomstone.functions import geo, text
from loomstone.functions.names import edit_ratio
from loomstone.operators import matching
from loomstone.operators.latest import first_per_key
from loomstone.plans.geography import _C, _D, _S, _customers, _suppliers
from loomstone.plans.registry import Tables, query


@query("""WITH p AS (SELECT p_partkey AS k, p_brand AS b, p_type AS t, CASE WHEN p_partkey % 10 = 0 AND p_partkey % 3 = 0 THEN p_name || 's' ELSE p_name END AS n, p_partkey % 10 = 0 AS inc FROM part),
i AS (SELECT * FROM p WHERE inc), kn AS (SELECT * FROM p WHERE NOT inc),
a AS (SELECT i.k, min(kn.k) AS m FROM i JOIN kn USING (b, t, n) GROUP BY i.k HAVING count(*) = 1),
c AS (SELECT i.k, min(kn.k) AS m FROM i JOIN kn USING (b, n) GROUP BY i.k HAVING count(*) = 1),
f AS (SELECT i.k, kn.k AS m, 1 - levenshtein(i.n, kn.n) / greatest(length(i.n), length(kn.n))::DOUBLE AS s FROM i JOIN kn USING (b, t) WHERE s >= 0.8),
g AS (SELECT k, arg_min(m, (-s, m)) AS m, max(s) AS s FROM f GROUP BY k)
SELECT i.k, coalesce(a.m, c.m, g.m) AS match, CASE WHEN a.m IS NOT NULL THEN 0 WHEN c.m IS NOT NULL THEN 1 WHEN g.m IS NOT NULL THEN 2 ELSE -1 END AS rule,
  round(CASE WHEN a.m IS NOT NULL OR c.m IS NOT NULL THEN 1.0 ELSE g.s END, 6) AS score FROM i LEFT JOIN a USING (k) LEFT JOIN c USING (k) LEFT JOIN g USING (k)""")
def identity_resolution(t: Tables):
    """Brand, type and name; brand and name where one row has them; else a similar name of brand and type."""
    k = F.col("p_partkey")
    name = F.when((k % 10 == 0) & (k % 3 == 0), F.concat("p_name", F.lit("s"))).otherwise(F.col("p_name"))
    p = t.part.select(k.alias("k"), F.col("p_brand").alias("b"), F.col("p_type").alias("t"), name.alias("n"))
    out = matching.resolve(p.where("k % 10 = 0"), p.where("k % 10 <> 0"), "k", [["b", "t", "n"], ["b", "n"]], ["b", "t"], "n", edit_ratio, 0.8)
    return out.withColumn("score", F.round("score", 6))


@query(f"""WITH c AS (SELECT k, la, lo, floor((lo + 180.0) / 360.0 * 64)::BIGINT AS x, floor((0.5 - ln((1 + sin(radians(la))) / (1 - sin(radians(la)))) / (4 * pi())) * 64)::BIGINT AS y FROM ({_C})),
t AS (SELECT DISTINCT floor((ro + 180.0) / 360.0 * 64)::BIGINT AS tx, floor((0.5 - ln((1 + sin(radians(ra))) / (1 - sin(radians(ra)))) / (4 * pi())) * 64)::BIGINT AS ty FROM ({_S})),
p AS (SELECT *, degrees(atan(sinh(pi() * (1 - 2 * (ty + 0.5) / 64)))) AS ra, (tx + 0.5) / 64 * 360.0 - 180.0 AS ro FROM t),
m AS (SELECT k, tx, ty, x = tx AND y = ty AS containing, {_D} AS d FROM c JOIN p ON abs(x - tx) <= 1 AND abs(y - ty) <= 1)
SELECT k, tx, ty, containing, round(d, 0) AS distance_m FROM m WHERE containing OR d <= 600000 QUALIFY row_number() OVER (PARTITION BY k ORDER BY NOT containing, d, tx, ty) = 1""")
def containing_or_nearest_tile(t: Tables):
    """The tile around a point, else the nearest centre within 600 km among the eight around it."""
    z = 6
    c = _customers(t).withColumn("n", F.explode(geo.neighbours(geo.tile_x(F.col("l_lon"), z), geo.tile_y(F.col("l_lat"), z), z)))
    c = c.select("k", "l_lat", "l_lon", F.col("n.x").alias("tx"), F.col("n.y").alias("ty"), ((F.col("n.x") == geo.tile_x(F.col("l_lon"), z)) & (F.col("n.y") == geo.tile_y(F.col("l_lat"), z))).alias("containing"))
    tiles = _suppliers(t).select(geo.tile_x(F.col("r_lon"), z).alias("tx"), geo.tile_y(F.col("r_lat"), z).alias("ty")).distinct()
    d = geo.haversine(F.col("l_lat"), F.col("l_lon"), geo.tile_lat(F.col("ty"), z), geo.tile_lon(F.col("tx"), z))
    near = c.join(tiles, ["tx", "ty"]).withColumn("d", d).where("containing OR d <= 600000")
    best = first_per_key(near, ["k"], [~F.col("containing"), F.col("d"), F.col("tx"), F.col("ty")])
    return best.select("k", "tx", "ty", "containing", F.round("d", 0).alias("distance_m"))


@query("""WITH c AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN lower(substr(n_name, 1, 3)) WHEN 2 THEN '' ELSE 'nowhere' END AS city, n_nationkey, c_custkey % 97 = 0 AS forced FROM customer JOIN nation ON c_nationkey = n_nationkey),
n AS (SELECT n_nationkey AS id, lower(n_name) AS label FROM nation), a AS (SELECT n_nationkey AS id, lower(substr(n_name, 1, 3)) AS label FROM nation),
nn AS (SELECT k, min(id) AS id, count(*) AS n FROM c JOIN n ON city = label GROUP BY k), aa AS (SELECT k, min(id) AS id, count(*) AS n FROM c JOIN a ON city = label GROUP BY k)
SELECT c.k, CASE WHEN forced THEN 0 WHEN nn.n = 1 THEN nn.id WHEN aa.n = 1 THEN aa.id END AS city_id,
  CASE WHEN forced THEN 'override' WHEN nn.n = 1 THEN 'name' WHEN nn.n > 1 OR aa.n > 1 THEN 'ambiguous' WHEN aa.n = 1 THEN 'alias' WHEN city = '' THEN 'blank' ELSE 'unknown' END AS method FROM c LEFT JOIN nn USING (k) LEFT JOIN aa USING (k)""")
def city_cascade(t: Tables):
    """Override, then name, then alias; two cities behind one label decide nothing."""
    name = F.lower("n_name")
    k = F.col("c_custkey")
    city = F.when(k % 4 == 0, name).when(k % 4 == 1, F.substring(name, 1, 3)).when(k % 4 == 2, "").otherwise("nowhere")
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(k.alias("k"), city.alias("city"), (k % 97 == 0).alias("forced"))
    label = lambda of, to: t.nation.groupBy(of.alias("city")).agg(F.min("n_nationkey").alias(to), F.count("*").alias(f"{to}_n"))
    c = c.join(label(name, "a"), "city", "left").join(label(F.substring(name, 1, 3), "b"), "city", "left")
    method = (
        F.when(F.col("forced"), "override").when(F.col("a_n") == 1, "name").when((F.col("a_n") > 1) | (F.col("b_n") > 1), "ambiguous")
        .when(F.col("b_n") == 1, "alias").when(F.col("city") == "", "blank").otherwise("unknown")
    )
    found = F.when(F.col("forced"), 0).when(F.col("a_n") == 1, F.col("a")).when(F.col("b_n") == 1, F.col("b"))
    return c.select("k", found.alias("city_id"), method.alias("method"))


@query("""WITH p AS (SELECT p_partkey AS k, lower(p_name || ' ' || p_type || ' hall') AS n FROM part), pl AS (SELECT DISTINCT lower(p_name) AS place FROM part WHERE p_size > 25 UNION SELECT DISTINCT split_part(lower(p_name), ' ', 1) FROM part WHERE p_size > 25)
SELECT k, arg_max(place, length(place)) AS place FROM p JOIN pl ON n = place OR starts_with(n, place || ' ') GROUP BY k""")
def name_prefix_match(t: Tables):
    own = t.part.select(F.col("p_partkey").alias("k"), F.lower(F.concat_ws(" ", "p_name", "p_type", F.lit("hall"))).alias("n"))
    large = t.part.where("p_size > 25").select(F.lower("p_name").alias("place"))
    return matching.longest_prefix(own, large.union(large.select(F.split("place", " ")[0])), "k", "n", "place")


@query(f"""WITH pr AS (SELECT DISTINCT k, nation, s, {_D} AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN ({_C}) ON o_custkey = k JOIN ({_S}) ON l_suppkey = s),
g AS (SELECT nation, s, avg(d) AS mean, max(d) AS far, list_sort(list(d))[count(*) // 2 + 1] AS mid FROM pr GROUP BY 1, 2)
SELECT nation, s, round(mean, 0) AS mean_m, round(mid, 0) AS median_m FROM g WHERE far <= 19500000 QUALIFY row_number() OVER (PARTITION BY nation ORDER BY mean, s) = 1""")
def preferred_place_of_group(t: Tables):
    """Per group the place with the least mean distance; the median is the upper one, an element of the group."""
    lines = t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("s")).join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("k")), "l_orderkey")
    pairs = lines.select("k", "s").distinct().join(_customers(t), "k").join(_suppliers(t), "s")
    pairs = pairs.withColumn("d", geo.haversine(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon")))
    # the discrete percentile is the smallest value with at least this share below or at it: with (n // 2 + 0.5) / n the upper median
    g = pairs.groupBy("nation", "s").agg(F.avg("d").alias("mean"), F.max("d").alias("far"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY d DESC)").alias("mid"))
    best = first_per_key(g.where("far <= 19500000"), ["nation"], [F.col("mean"), F.col("s")])
    return best.select("nation", "s", F.round("mean", 0).alias("mean_m"), F.round("mid", 0).alias("median_m"))


@query("""SELECT p_name AS name, p_brand AS brand, min(p_partkey) AS target, arg_min(p_size, p_partkey) FILTER (p_partkey % 3 <> 0) AS size, array_to_string(list_sort(list(DISTINCT p_type)), '|') AS aliases, count(*) AS merged FROM part GROUP BY 1, 2""")
def duplicate_variant_merge(t: Tables):
    """Rows of one name: the first is the target, its missing size comes from the next that has one, aliases unite."""
    size = F.when(F.col("p_partkey") % 3 != 0, F.col("p_size"))
    return t.part.groupBy(F.col("p_name").alias("name"), F.col("p_brand").alias("brand")).agg(
        F.min("p_partkey").alias("target"), F.min_by(size, F.when(size.isNotNull(), F.col("p_partkey"))).alias("size"), F.array_join(F.sort_array(F.collect_set("p_type")), "|").alias("aliases"), F.count("*").alias("merged")
    )


@query("""WITH n AS (SELECT l_suppkey AS s, count(*) AS n FROM lineitem GROUP BY 1), e AS (SELECT s_suppkey AS s, s_nationkey AS nation, floor(s_acctbal / 2000) AS band, coalesce(n, 0) AS n, s_acctbal AS bal FROM supplier LEFT JOIN n ON s_suppkey = s),
k AS (SELECT s, first_value(s) OVER (PARTITION BY nation, band ORDER BY n DESC, bal DESC, s) AS keeper FROM e)
SELECT l_orderkey, l_linenumber, coalesce(keeper, l_suppkey) AS supp FROM lineitem LEFT JOIN k ON l_suppkey = s QUALIFY row_number() OVER (PARTITION BY coalesce(keeper, l_suppkey), l_orderkey, l_partkey ORDER BY l_linenumber) = 1""")
def collision_merge(t: Tables):
    """Suppliers of one identity become the one with most lines; their lines move, those in conflict go."""
    n = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    e = t.supplier.join(n, "s_suppkey", "left").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey", F.floor(F.col("s_acctbal") / 2000).alias("band"), F.coalesce("n", F.lit(0)).alias("n"), "s_acctbal")
    moved = matching.keepers(e, ["s_nationkey", "band"], "l_suppkey", [F.desc("n"), F.desc("s_acctbal"), F.col("l_suppkey")])
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    out = matching.repoint(lines, moved, "l_suppkey", ["l_suppkey", "l_orderkey", "l_partkey"], [F.col("l_linenumber")])
    return out.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("supp"))


@query("""SELECT p_partkey, l_orderkey, l_linenumber, l_returnflag = 'A' AS ok FROM part JOIN lineitem ON l_partkey = p_partkey
QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY (l_linestatus = 'O') DESC, (l_returnflag = 'A') DESC, l_shipdate DESC, l_orderkey, l_linenumber) = 1""")
def cache_lookup(t: Tables):
    """Of what a cache holds for a text: the wanted locale, then a good status, then the newest."""
    rows = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag", "l_shipdate")
    best = first_per_key(rows, ["p_partkey"], [F.desc(F.col("l_linestatus") == "O"), F.desc(F.col("l_returnflag") == "A"), F.desc("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")])
    return t.part.select("p_partkey").join(best, "p_partkey").select("p_partkey", "l_orderkey", "l_linenumber", (F.col("l_returnflag") == "A").alias("ok"))


@query("""SELECT o_orderkey, o_orderstatus AS status, count(*) AS parts, sha256(string_agg(l_linenumber || ':' || l_partkey || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_partkey, l_returnflag)) AS packet FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def packet_assembly(t: Tables):
    """An entity with its children nested; without any it has no packet."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))).alias("lines"))
    p = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status")).join(lines, "o_orderkey")
    flat = F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x.l_linenumber.cast("string"), x.l_partkey.cast("string"), x.l_returnflag)), ",")
    return p.select("o_orderkey", "status", F.size("lines").cast("long").alias("parts"), F.sha2(flat, 256).alias("packet"))


@query("""WITH w AS (SELECT p_name AS t, locale, count(DISTINCT p_brand) AS brands FROM part, (VALUES ('fr'), ('es'), ('ar')) l(locale) GROUP BY 1, 2)
SELECT t AS text, locale, brands FROM w WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_name = t AND p_size = 7 AND locale = 'fr')""")
def translation_work_set(t: Tables):
    """Texts by locale that a cache lacks, with how many entities need them; locales are a fixed list."""
    cache = t.part.where("p_size = 7").select(F.col("p_name").alias("text"), F.lit("fr").alias("locale")).distinct()
    texts = t.part.groupBy(F.col("p_name").alias("text")).agg(F.count_distinct("p_brand").alias("brands"))
    return texts.withColumn("locale", F.explode(F.array(*[F.lit(x) for x in ("fr", "es", "ar")]))).join(cache, ["text", "locale"], "left_anti")


@query("""WITH r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT user_id, CASE WHEN max(CASE WHEN rn = 1 THEN event_type END) = 'error' THEN 'blocked_review' WHEN count(*) = 2 AND max(value) < 20 THEN 'exhausted' ELSE 'pending' END AS status FROM r WHERE rn <= 2 GROUP BY 1""")
def progress_settlement(t: Tables):
    """A failed last cycle blocks, two empty cycles in a row exhaust, else work goes on."""
    two = first_per_key(t.events.select("user_id", "event_type", "value", "ts", "event_id"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 2)
    g = two.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), F.count("*").alias("n"), F.max("value").alias("most"))
    return g.select("user_id", F.when(F.col("last") == "error", "blocked_review").when((F.col("n") == 2) & (F.col("most") < 20), "exhausted").otherwise("pending").alias("status"))


@query("""WITH old AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 0), new AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 11 <> 0)
SELECT doc_id, CASE WHEN old.h IS NULL THEN 'new' WHEN new.h IS NULL THEN 'gone' WHEN old.h = new.h THEN 'unchanged' ELSE 'changed' END AS state FROM old FULL JOIN new USING (doc_id)""")
def incremental_index(t: Tables):
    """Which texts an index must chunk anew, from hashes alone."""
    h = lambda c, n: F.sha2(c, 256).alias(n)
    old = t.documents.where("doc_id % 7 <> 0").select("doc_id", h(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), "a"))
    new = t.documents.where("doc_id % 11 <> 0").select("doc_id", h(F.col("text"), "b"))
    state = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(F.col("a") == F.col("b"), "unchanged").otherwise("changed")
    return old.join(new, "doc_id", "full_outer").select("doc_id", state.alias("state"))


_SPELLED = ", ".join(f"replace(word, '{a}', '{b}')" for a, b in text.SPELLED)
_KNOWN = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in text.SPELLINGS.items())


@query(rf"""WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM documents),
s AS (SELECT DISTINCT word, unnest([CASE word {_KNOWN} END, CASE WHEN ends_with(word, 'a') AND length(word) >= 6 THEN left(word, length(word) - 1) END,
  CASE WHEN ends_with(word, 'y') THEN left(word, length(word) - 1) || 'iy' END, CASE WHEN ends_with(word, 'y') THEN left(word, length(word) - 1) || 'i' END, {_SPELLED}]) AS other FROM w)
SELECT s.word, other FROM s JOIN w ON w.word = other WHERE other <> s.word""")
def words_spelled_alike(t: Tables):
    """Words of the texts that the texts hold in another romanized spelling, too."""
    words = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("word")
    return matching.spelled_alike(t.documents.select(words).select(F.lower("word").alias("word")))
