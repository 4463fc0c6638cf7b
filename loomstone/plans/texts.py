"""Text operators over documents, conversations, pages and names."""

from pyspark.sql import functions as F

from loomstone.functions import text
from loomstone.operators.passages import contained
from loomstone.plans.registry import Tables, query


@query(r"""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '')
  || CASE WHEN regexp_extract(url, '\?([^#]*)', 1) <> '' THEN '?' || array_to_string(list_sort(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')), '&') ELSE '' END AS normal,
  regexp_replace(lower(regexp_extract(url, 'https?://([^/?#]+)', 1)), '^www\.', '') AS domain FROM pages""")
def url_normalize(t: Tables):
    return t.pages.select("page_id", text.normal_url(F.col("url")).alias("normal"), text.domain(F.col("url")).alias("domain"))


@query(r"""WITH a AS (SELECT conv_id, turn, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g') AS x FROM conversations),
b AS (SELECT conv_id, turn, regexp_replace(regexp_replace(x, '@[A-Za-z0-9_]{2,}', '[handle]', 'g'), '\+?[0-9][0-9 ().-]{7,}[0-9]', '[phone]', 'g') AS x FROM a),
c AS (SELECT conv_id, turn, trim(regexp_replace(x, '[ \t\n\r]+', ' ', 'g')) AS clean FROM b)
SELECT conv_id, turn, clean, sha256(conv_id::VARCHAR || '|' || clean) AS content_hash FROM c""")
def redact_and_hash(t: Tables):
    rows = t.conversations.select("conv_id", "turn", text.redact(F.col("text")).alias("clean"))
    return rows.withColumn("content_hash", F.sha2(F.concat_ws("|", F.col("conv_id").cast("string"), "clean"), 256))


@query(r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')) AS t FROM documents),
e AS (SELECT doc_id, unnest(list_filter(list_transform(range(0, ((length(t) + 1199) // 1200)::BIGINT), lambda i: trim(substr(t, (i * 1200 + 1)::BIGINT, 1200))), lambda p: p <> '')) AS chunk, generate_subscripts(list_filter(list_transform(range(0, ((length(t) + 1199) // 1200)::BIGINT), lambda i: trim(substr(t, (i * 1200 + 1)::BIGINT, 1200))), lambda p: p <> ''), 1) - 1 AS pos FROM f)
SELECT doc_id, pos, length(chunk) AS n, sha256(chunk) AS h FROM e""")
def chunk_documents(t: Tables):
    rows = t.documents.select("doc_id", F.posexplode(text.chunks(F.col("text"), 1200)).alias("pos", "chunk"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.length("chunk").cast("long").alias("n"), F.sha2("chunk", 256).alias("h"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_'']+')) AS tokens, CASE WHEN contains(text, 'benchmark') THEN 'benchmark' WHEN contains(text, '@') THEN 'contact' WHEN contains(text, 'http') THEN 'link' ELSE 'plain' END AS kind,
  len(regexp_extract_all(text, '[A-Za-z]')) AS latin, len(regexp_extract_all(text, '[0-9]')) AS digits FROM documents""")
def text_statistics(t: Tables):
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    kind = text.first_class(F.col("text"), [("benchmark", ("benchmark",)), ("contact", ("@",)), ("link", ("http",))], "plain")
    return t.documents.select("doc_id", n(r"[A-Za-z0-9_']+").alias("tokens"), kind.alias("kind"), n("[A-Za-z]").alias("latin"), n("[0-9]").alias("digits"))


@query(r"""SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') || '|' || lower(trim(p_brand)) AS identity FROM part""")
def identity_key(t: Tables):
    return t.part.select("p_partkey", F.concat_ws("|", text.key_text(F.col("p_type")), F.lower(F.trim("p_brand"))).alias("identity"))


@query(r"""WITH s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN floor(o_totalprice)::BIGINT::VARCHAR WHEN 1 THEN CASE WHEN o_orderkey % 8 = 1 THEN '1.234.' ELSE '7.' END || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') WHEN 2 THEN '12,' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') || '.5' ELSE 'n/a' END AS x FROM orders)
SELECT o_orderkey, CASE WHEN regexp_matches(x, '^[0-9]{1,3}(\.[0-9]{3})+$') THEN replace(x, '.', '')::DOUBLE WHEN regexp_matches(x, '^[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$') THEN replace(x, ',', '')::DOUBLE WHEN regexp_matches(x, '^[0-9]+(\.[0-9]+)?$') THEN x::DOUBLE END AS value FROM s""")
def number_grammar(t: Tables):
    k = F.col("o_orderkey")
    three = F.lpad((k % 1000).cast("string"), 3, "0")
    x = F.when(k % 4 == 0, F.floor("o_totalprice").cast("string")).when(k % 4 == 1, F.concat(F.when(k % 8 == 1, "1.234.").otherwise("7."), three)).when(k % 4 == 2, F.concat(F.lit("12,"), three, F.lit(".5"))).otherwise("n/a")
    return t.orders.select("o_orderkey", x.alias("x")).select("o_orderkey", text.number(F.col("x")).alias("value"))


@query("""WITH d AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, 'https?://([^/?#]+)', 1)), '^www\\.', '') AS h FROM pages), p(pos, dom, ok) AS (VALUES (1, 'example.net', true), (2, 'blog.example.com', false), (3, 'example.com', true), (4, 'com', false))
SELECT page_id, arg_min(dom, pos) AS policy, coalesce(arg_min(ok, pos), false) AS allowed FROM d LEFT JOIN p ON h = dom OR ends_with(h, '.' || dom) GROUP BY page_id""".replace("\\\\", "\\"))
def domain_allow_list(t: Tables):
    """The first policy whose domain is the host or above it decides; without one nothing is allowed.

    Every host is exploded to its suffixes, so that policies meet it by an equi-join.
    """
    policy = t.spark.createDataFrame([(1, "example.net", True), (2, "blog.example.com", False), (3, "example.com", True), (4, "com", False)], "pos int, dom string, ok boolean")
    parts = F.split(text.domain(F.col("url")), r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = t.pages.select("page_id", F.explode(ends).alias("dom"))
    first = hosts.join(F.broadcast(policy), "dom").groupBy("page_id").agg(F.min_by("dom", "pos").alias("policy"), F.min_by("ok", "pos").alias("ok"))
    return t.pages.select("page_id").join(first, "page_id", "left").select("page_id", "policy", F.coalesce("ok", F.lit(False)).alias("allowed"))


@query("""SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def passage_containment(t: Tables):
    """Documents that hold a passage whole, however short it is."""
    b = t.benchmark.select("item_id", F.col("text").alias("passage"))
    return contained(t.documents, "doc_id", "text", b, "passage").join(b, "passage").select("doc_id", "item_id")


@query("""WITH a AS (SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_id, k, coalesce(k, 0) % 10 AS bucket FROM a""")
def tolerant_json(t: Tables):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return t.events.select("event_id", k.alias("k"), (F.coalesce(k, F.lit(0)) % 10).alias("bucket"))
