"""Derived rows of places: the chosen metric and what follows from it, network signals, targets, gaps, status counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.text import chunks as text_chunks
from loomstone.operators import visits
from loomstone.operators.latest import first_per_key


def derived(evidence: DataFrame, key: str, primary: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per (key, scene) of evidence (key, scene, metric, value, unit, tier, domain, id): the metric that counts and what it gives.

    primary: the hard metrics of a scene, the most telling first. The first of them that a place has counts, then the better
    tier, the greater value, the smaller id; without one the best visit metric. Columns: metric, value, visits, class,
    status, hard, domains, action.
    """
    spark = evidence.sparkSession
    ranks = spark.createDataFrame([(s, m, i) for s, ms in primary.items() for i, m in enumerate(ms)], "scene string, metric string, _rank int")
    rows = evidence.join(F.broadcast(ranks), ["scene", "metric"], "left")  # as small as the configuration
    proxy = visits.annual_proxy(F.col("scene"), F.col("metric"), F.col("value"), F.col("unit"))
    rows = rows.withColumn("_p", proxy)
    hard = F.col("_rank").isNotNull() & F.col("value").isNotNull()
    order = F.struct(F.coalesce("_rank", F.lit(99)), "tier", -F.col("value"), F.col("id"))
    own = F.struct("metric", "value", "_p", "_rank")
    d = rows.groupBy(key, "scene").agg(
        F.min_by(F.when(F.col("value").isNotNull(), own), F.when(F.col("value").isNotNull(), order)).alias("m"),
        F.max(hard).alias("hard"), F.count_distinct("domain").alias("domains"),
    )
    v = visits.safe_visits(F.col("m._p.visits"))
    cls = visits.value_class(v)
    status = visits.evidence_status(F.col("hard"), F.col("domains"))
    action = F.when(~F.col("hard"), "find primary metric").when(F.col("domains") < 2, "find second source").otherwise("survey")
    return d.select(key, "scene", F.col("m.metric").alias("metric"), F.col("m.value").alias("value"), v.alias("visits"), cls.alias("class"), status.alias("status"), "hard", "domains", action.alias("action"))


def latest_targets(candidates: DataFrame, places: DataFrame, assignments: DataFrame, models: DataFrame, lead: Column | None = None) -> DataFrame:
    """The newest candidate (pid, run) of each place with its place, the city it is assigned to, and its model of that run.

    candidates: pid, run, stamp, id; places: pid, ...; assignments: pid, city; models: pid, run, stamp, id, visits.
    """
    newest = [F.desc("stamp"), F.desc("id")]
    c = first_per_key(candidates if lead is None else candidates.where(lead), ["pid"], newest).select("pid", "run")
    m = first_per_key(models, ["pid", "run"], newest).select("pid", "run", "visits")
    return c.join(places, "pid").join(assignments.select("pid", F.col("city").alias("assigned")), "pid", "left").join(m, ["pid", "run"], "left")


def in_run_order(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """The candidate of each place by its run's start (none last), the run's and its own stamp, and ids; candidates without a run are out.

    candidates: pid, run, stamp, id; runs: run, started, created.
    """
    rows = candidates.join(runs, "run")
    return first_per_key(rows, ["pid"], [F.desc_nulls_last("started"), F.desc_nulls_last("created"), F.desc("stamp"), F.desc("run"), F.desc("id")]).select("pid", "run", "id")


def network_signals(rollups: DataFrame, observations: DataFrame) -> DataFrame:
    """pid and, for mobile and fixed, class, confidence and download of the newest rollup with its observation.

    rollups: pid, service, observation, stamp, id, class, confidence; observations: observation, download. A rollup
    whose observation is gone gives nothing.
    """
    r = first_per_key(rollups, ["pid", "service"], [F.desc("stamp"), F.desc("id")]).join(observations, "observation")
    pick = lambda s, c: F.max(F.when(F.col("service") == s, F.col(c))).alias(f"{s}_{c}")
    return r.groupBy("pid").agg(*[pick(s, c) for s in ("mobile", "fixed") for c in ("class", "confidence", "download")])


def gaps(places: DataFrame, evidence: DataFrame, scene: str) -> DataFrame:
    """scene, places, without: how many places have no evidence at all. places: pid, scene; evidence: pid."""
    marks = evidence.select("pid").distinct().withColumn("_has", F.lit(True))
    rows = places.join(marks, "pid", "left")
    return rows.groupBy(scene).agg(F.count("*").alias("places"), F.count_if(F.col("_has").isNull()).alias("without"))


def relabelled(reviews: DataFrame, low: DataFrame, kind: str) -> DataFrame:
    """reviews (pid, kind, text) without the rows of kind, and one of that kind for each place of low (pid, text)."""
    own = low.select("pid", F.lit(kind).alias("kind"), "text")
    return reviews.where(F.col("kind") != kind).unionByName(own)


def status_counts(tasks: DataFrame, groups: Sequence[str], status: str, known: Sequence[str]) -> DataFrame:
    """Counts of each known status in a column of its own, other ones together, and all."""
    each = [F.count_if(F.col(status) == s).alias(s) for s in known]
    other = F.count_if(~F.coalesce(F.col(status).isin(*known), F.lit(False))).alias("other")
    return tasks.groupBy(*groups).agg(*each, other, F.count("*").alias("total"))


def discovery_status(tasks: DataFrame, progress: DataFrame, evidence: DataFrame, runs: DataFrame) -> DataFrame:
    """section, name, n, at: how far a discovery has come.

    tasks, progress and evidence (status): n rows of each status, in sections task_backlog, progress_status and
    raw_evidence_status; a null status is a name of its own. pending_evidence: new evidence that needs curation
    (curation_needed), 0 if there is none. latest_run: of runs (run, started_at) the one started last, of
    ties the largest run, with its start as at; no row without runs that have a start.

    One shuffle for all sections, of counts that are made before it.
    """
    sections = {"task_backlog": tasks, "progress_status": progress, "raw_evidence_status": evidence}
    tagged = [df.select(F.lit(s).alias("section"), F.col("status").cast("string").alias("name")) for s, df in sections.items()]
    per = tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).groupBy("section", "name").agg(F.count("*").alias("n"))
    waits = F.coalesce((F.col("status") == "new") & F.col("curation_needed"), F.lit(False))
    pending = evidence.agg(F.count_if(waits).alias("n")).select(F.lit("pending_evidence").alias("section"), F.lit("new").alias("name"), "n")
    last = runs.where("started_at IS NOT NULL").agg(F.max(F.struct("started_at", "run")).alias("r")).where("r IS NOT NULL")
    latest = last.select(F.lit("latest_run").alias("section"), F.col("r.run").cast("string").alias("name"), F.col("r.started_at").alias("at"))
    return per.unionByName(pending).unionByName(latest, allowMissingColumns=True)


def top_targets(rows: DataFrame, scenes: Sequence[str], n: int) -> DataFrame:
    """The n first rows (scene, visits, country, name): scenes in the order given, others last, then most visits, country, name."""
    rank = F.lit(len(scenes))
    for i, s in reversed(list(enumerate(scenes))):
        rank = F.when(F.col("scene") == s, i).otherwise(rank)
    return rows.orderBy(rank, F.desc_nulls_last("visits"), "country", "name").limit(n)


def venue_score(rooms: Column, square_feet: Column) -> Column:
    """What a venue offers: its rooms, thirty each, or its area, whichever is more; a missing one is none."""
    return F.greatest(F.coalesce(rooms, F.lit(0)) * 30, F.coalesce(square_feet, F.lit(0)))


def snapshot_state(manifest: DataFrame, seen: DataFrame) -> DataFrame:
    """name, action of each snapshot: load if its hash is new or another, skip if it is the same, drop if it is gone."""
    now, before = manifest.select("name", F.col("hash").alias("_now")), seen.select("name", F.col("hash").alias("_before"))
    action = F.when(F.col("_now").isNull(), "drop").when(F.col("_now") == F.col("_before"), "skip").otherwise("load")
    return now.join(before, "name", "full_outer").select("name", action.alias("action"))


#: Groups, scenes and kinds of sources that must all be exhausted before a country counts as nearly done.
SATURATED = (12, 6, 2)


def maturity(summaries: DataFrame, progress: DataFrame) -> DataFrame:
    """country, level, basis, density, groups, exhausted, rounds of summaries (country, n, scenes, sources) and progress
    (country, scene, source, status, cycle): seed_scan, deep_expansion or near_saturation; how many candidates there are
    says nothing of how many there could be.
    """
    some = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    p = progress.groupBy("country").agg(
        F.count("*").alias("groups"), F.count_distinct(some("scene")).alias("_scenes"), F.count_distinct(some("source")).alias("_kinds"),
        F.count_if(F.col("status") == "exhausted").alias("exhausted"), F.max(F.coalesce("cycle", F.lit(0))).alias("rounds"),
    )
    r = summaries.join(p, "country", "left").fillna(0, ["groups", "_scenes", "_kinds", "exhausted", "rounds"])
    density = F.when(F.col("n") > 0, F.bround(F.col("sources") / F.col("n"), 2)).otherwise(0.0)
    r = r.withColumn("density", density)
    groups, scenes, kinds = SATURATED
    full = (F.col("groups") >= groups) & (F.col("_scenes") >= scenes) & (F.col("_kinds") >= kinds) & (F.col("exhausted") == F.col("groups"))
    tracked = (F.col("rounds") >= 2) & (F.col("_scenes") >= 4) & (F.col("_kinds") >= 2)
    dense = ((F.col("n") >= 100) & (F.col("density") >= 1.2)) | ((F.col("n") >= 50) & (F.col("density") >= 1.5))
    inferred = (F.col("scenes") >= 6) & dense
    level = F.when(full, "near_saturation").when(tracked | inferred, "deep_expansion").otherwise("seed_scan")
    basis = F.when(full, "tracked_exhaustion").when(tracked, "tracked_rounds").otherwise("active_coverage")
    return r.select("country", level.alias("level"), basis.alias("basis"), "density", "groups", "exhausted", "rounds")


def rechunked(chunks: DataFrame, docs: DataFrame, size: int = 1200) -> DataFrame:
    """chunks (doc_id, content_hash, pos, chunk, origin) after docs (doc_id, text) came: those of unchanged documents are kept,
    changed and new ones are cut anew, those of documents that are gone go. Only texts whose hash is not known are cut.
    """
    now = docs.where("text IS NOT NULL").select("doc_id", "text", F.sha2("text", 256).alias("content_hash"))
    known = chunks.select("doc_id", "content_hash").distinct()
    kept = chunks.join(now.select("doc_id", "content_hash"), ["doc_id", "content_hash"], "left_semi").select("doc_id", "content_hash", "pos", "chunk", F.lit("kept").alias("origin"))
    new = now.join(known, ["doc_id", "content_hash"], "left_anti")
    cut = new.select("doc_id", "content_hash", F.posexplode(text_chunks(F.col("text"), size)).alias("pos", "chunk"))
    return kept.unionByName(cut.withColumn("origin", F.lit("new")))
