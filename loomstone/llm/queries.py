"""The numbered queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import ann, exact_dedup, fim, langid, minhash, mixing, packing, sharding, simhash, token_counts, toxicity, urls, whitening
from loomstone.llm.common import fold, table

VOCABULARY = "byte_bpe_50k.json"
RULES = (
    urls.Rule("allow", "com"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
)


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary(), limit=1024)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), capacity=2048, end=1)


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(table(spark, sf_dir, "documents"), sharding.tree(16), sharding.grown(sharding.tree(16)))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = langid.train(docs, ~held_out)
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), share=1.5, most=2.0, weights=(5, 2, 1))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), most=16, step=64.0, offset=1_000_000)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.transform(table(spark, sf_dir, "documents"), seed=42, rate=50, spm=80, unit="token")
    digests = fim.sha256(F.col("output")), fim.sha256(fim.restored(F.col("output"), F.col("form")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digests[0].alias("output_sha256"), digests[1].alias("restored_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_token_counts,
        op3_packing,
        op4_nearest,
        op5_sharding,
        op6_language,
        op7_mixing,
        op8_simhash,
        op9_urls,
        op10_exact_dedup,
        op11_minhash,
        op12_whitening,
        op13_fill_in_middle,
        pipeline,
    )
}

_WORDS = r"len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))"

_MIXING = rf"""
WITH base AS (
  SELECT doc_id, source, coalesce({_WORDS}, 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
ranked AS (
  SELECT *, ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS rk
  FROM per),
ordered AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS ratio FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - (sum(cap) OVER (ORDER BY ratio, rk) - cap))
            / (sum(w) OVER () - sum(w) OVER (ORDER BY ratio, rk) + w) AS lv
  FROM ordered),
fixed AS (SELECT arg_min(lv, (ratio, rk)) AS f FROM levels WHERE lv <= ratio),
targets AS (SELECT source, source_size, CASE WHEN f IS NULL THEN cap ELSE least(cap, w * f) END AS target FROM levels LEFT JOIN fixed ON true),
summed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM base),
budget AS (
  SELECT s.doc_id, s.size, s.ahead, t.source_size, t.target, round(t.target)::BIGINT AS b,
         CASE WHEN t.source_size > 0 THEN (round(t.target)::BIGINT // t.source_size) ELSE 0 END AS e
  FROM summed s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (e * size + greatest(0, least(size, b - e * source_size - ahead)))::BIGINT AS taken
FROM budget
"""

_DEDUP = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM n
"""


def _terms(strict: bool, weigh: bool = False) -> str:
    """How many terms of a kind a url has, or what they weigh: its words, looked up in the vocabulary."""
    own = [(t, w) for t, w in urls.VOCABULARY.items() if (w >= urls.REJECT) == strict]
    rows = ", ".join(f"('{t}', {w})" for t, w in own)
    value = "coalesce(sum(w), 0)" if weigh else "count(*)"
    return f"(SELECT {value} FROM (VALUES {rows}) v(t, w) WHERE list_contains(words, t))::INT"


_URLS = f"""
WITH p AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
q AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract_all(u, '[a-z0-9]+') AS words
  FROM p),
s AS (SELECT *, {_terms(True)} AS strict_hits, {_terms(False)} AS soft_hits, {_terms(False, True)} AS soft_weight FROM q),
r(verdict, rhost, rpath) AS (VALUES {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)}),
fits AS (
  SELECT page_id, arg_max(r, length(rhost || rpath)) AS r
  FROM q JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT s.page_id, host, path, fits.r.rhost || fits.r.rpath AS rule,
       coalesce(fits.r.verdict, CASE WHEN strict_hits >= 1 OR soft_hits >= 2 AND soft_weight >= {urls.REJECT} THEN 'block' ELSE 'allow' END) AS verdict,
       strict_hits, soft_hits, soft_weight
FROM s LEFT JOIN fits USING (page_id)
"""

#: Near copies of whole texts by their shingles; components by the smallest id that is reached.
_MINHASH = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
  WHERE 100 * shared.n >= 80 * (a.n + b.n - shared.n)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT x AS doc_id, x AS other FROM both_ways UNION SELECT r.doc_id, e.y FROM reached r JOIN both_ways e ON e.x = r.other)
SELECT d.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(r.other), d.doc_id)) AS component_id,
       least(d.doc_id, coalesce(min(r.other), d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN reached r USING (doc_id) GROUP BY d.doc_id
"""

#: Cuts, forms and digests; the text itself is what an output has to give back.
_FIM = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || doc_id::VARCHAR) AS h
  FROM documents),
e AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM e),
p AS (
  SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

ORACLES = {
    "op7_mixing": _MIXING,
    "op9_urls": _URLS,
    "op10_exact_dedup": _DEDUP,
    "op11_minhash": _MINHASH,
    "op13_fill_in_middle": _FIM,
}
