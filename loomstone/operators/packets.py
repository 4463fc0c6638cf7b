"""Packets: an entity with all rows of many child tables nested, out of one shuffle; and index rows made of packets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.names import search_lines
from loomstone.functions.text import maps_link
from loomstone.operators.network import map_ready


@dataclass(frozen=True)
class Child:
    """A child table: its rows, their order within a packet, and whether a packet must have one.

    A packet holds all rows of a child. With most it holds that many, the first ones, and overflow() has the others. With each,
    columns of the rows, it holds the first row of every value of them (of no column: the first row), which is enough for a use
    that asks for the first row, for how many there are and for distinct values, however many rows share a key.
    """

    rows: DataFrame
    order: Sequence[Column] = ()
    most: int | None = None
    needed: bool = False
    each: Sequence[str] | None = None


def _tagged(parents: DataFrame, children: Mapping[str, Child], keys: Sequence[str]) -> DataFrame:
    """All rows of all tables with their keys, the number of their table, their values as a struct of their own, and their place in order.

    Of children with each also the place among the rows of the same value.
    """
    tables = {"parent": Child(parents)} | dict(children)
    kinds = {}
    parts = []
    for n, (name, child) in enumerate(tables.items()):
        values = [F.col(f"`{c}`") for c in child.rows.columns if c not in keys]
        same = [F.struct(*[F.col(f"`{c}`") for c in child.each]).alias(f"_v_{name}")] if child.each else []
        own = child.rows.select(*keys, F.lit(n).alias("_tag"), (F.struct(*values) if values else F.struct(F.lit(True).alias("present"))).alias(name), F.struct(*child.order, F.lit(0)).alias(f"_o_{name}") if child.order else F.struct(F.lit(0)).alias(f"_o_{name}"), F.lit(child.most).cast("int").alias("_most"), *same)
        kinds |= {c: own.schema[c].dataType for c in own.columns if c not in (*keys, "_tag", "_most")}
        parts.append((name, own))
    out = None
    for name, own in parts:
        for other, kind in kinds.items():
            if other not in (name, f"_o_{name}", f"_v_{name}"):
                own = own.withColumn(other, F.lit(None).cast(kind))
        own = own.select(*keys, "_tag", "_most", *kinds)
        out = own if out is None else out.unionByName(own)
    # one shuffle by the keys; ranks and packets are made where the rows then are, sorted and spilled as need be
    out = out.repartition(*keys).withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_tag").orderBy(*[f"_o_{name}" for name in tables])))
    same = [f"_v_{name}" for name, child in children.items() if child.each]
    return out.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, "_tag", *same).orderBy("_rank"))) if same else out


def _held(child: Child) -> Column:
    """Whether a packet holds this row of the child."""
    held = F.lit(True) if child.each is None else F.col("_nth" if child.each else "_rank") == 1
    return held if child.most is None else held & (F.col("_rank") <= child.most)


def packets(parents: DataFrame, children: Mapping[str, Child], keys: Sequence[str]) -> DataFrame:
    """keys, parent (a struct), and for each child an array of structs in its order and n_<name>, how many rows it has in all.

    All tables have the columns keys, which are not null; parents has a row per key. The tables go through one shuffle as a tagged union,
    however many they are; no table is joined. An array holds all rows of a child, or those that its Child says. A packet
    without a parent or without a row of a needed child is left out.
    """
    ranked = _tagged(parents, children, keys)
    out = [F.max(F.when(F.col("_tag") == 0, F.col("parent"))).alias("parent")]
    for n, (name, child) in enumerate(children.items(), 1):
        own = F.col("_tag") == n
        held = F.collect_list(F.when(own & _held(child), F.struct("_rank", name)))
        out += [F.transform(F.sort_array(held), _second(name)).alias(name), F.count_if(own).alias(f"n_{name}")]
    rows = ranked.groupBy(*keys).agg(*out).where(F.col("parent").isNotNull())
    for name, child in children.items():
        if child.needed:
            rows = rows.where(F.col(f"n_{name}") > 0)
    return rows


def _second(name: str):
    return lambda x: x[name]


def overflow(parents: DataFrame, children: Mapping[str, Child], keys: Sequence[str]) -> DataFrame:
    """keys, child, position, row (JSON) of the rows beyond most, which packets hold no more: a table to be written beside them."""
    ranked = _tagged(parents, children, keys).where(F.col("_rank") > F.col("_most")).where("_tag > 0")
    name = F.element_at(F.array(*map(F.lit, children)), F.col("_tag"))
    row = F.coalesce(*[F.to_json(c) for c in children])
    return ranked.select(*keys, name.alias("child"), F.col("_rank").alias("position"), row.alias("row"))


#: What an index row needs of each child, and which values; the first row of a child counts.
NEEDS = {
    "parent": ("name", "country", "city", "city_id", "scene", "lat", "lon", "maps", "precision", "map_source", "coordinate_status"),
    "candidate": ("quality_status", "main_table_ready", "map_ready", "export_ready", "issues"), "assignment": ("status", "method"), "alias": ("alias",),
    "scene": ("annual_visits", "proxy_level"), "build": ("presence", "rat"), "conclusion": ("evidence_status", "value_class", "action", "solution"),
    "demand": ("busy_hour_gb",), "traffic": ("p10", "p50", "p90", "model", "active"), "complaint": ("pressure", "freshness"), "network": ("priority",),
    "evidence": ("url", "value"), "review": ("reason",),
}

#: The values of a child of which an index row needs each; of the others the first row and the number are enough.
EACH = {"alias": ("alias",), "evidence": ("url",)}


def index_rows(packed: DataFrame, keys: Sequence[str], public_network: bool = True, guard_years: bool = True) -> DataFrame:
    """The keys and 43 columns for lists, maps and search, from packets of the tables that NEEDS names.

    A year's visits that look like a year are none, and neither is a traffic of theirs (unless guard_years is false). A model's values count once it is active; its middle
    stands in for the estimate. Without evidence a place counts as one source; sources are its distinct addresses, sorted. Packets whose
    children have each as in EACH give the same rows as whole ones, except that an alias that repeats is in aliases once.
    """
    p = lambda c: F.col(f"parent.{c}")
    one = lambda t, c: F.get(F.col(t), F.lit(0))[c]
    visits = one("scene", "annual_visits")
    odd = F.coalesce(visits.between(1900, 2100) & (visits == F.floor(visits)), F.lit(False)) if guard_years else F.lit(False)
    safe = F.when(~odd, visits)
    active = F.coalesce(one("traffic", "active"), F.lit(False))
    aliases = F.transform("alias", lambda a: a["alias"])
    forms = F.array_distinct(F.array_compact(F.concat(F.array(p("name")), aliases)))
    urls = F.array_sort(F.array_distinct(F.array_compact(F.transform("evidence", lambda e: e["url"]))))
    ready = {c: F.coalesce(one("candidate", c), F.lit(False)) for c in ("main_table_ready", "map_ready", "export_ready")}
    pressure = one("complaint", "pressure")
    out = {
        "name": p("name"), "aliases": aliases, "_forms": forms, "country": p("country"), "city": p("city"), "city_id": p("city_id"), "city_assignment": F.get("assignment", F.lit(0)),
        "scene": p("scene"), "lat": p("lat"), "lon": p("lon"), "maps_link": F.coalesce(p("maps"), maps_link(p("name"), p("city"), p("country"))),
        "geocode_precision": p("precision"), "map_source": p("map_source"), "coordinate_status": p("coordinate_status"), "evidence_status": one("conclusion", "evidence_status"),
        "value_class": one("conclusion", "value_class"), "action": one("conclusion", "action"), "solution": one("conclusion", "solution"), "annual_visits": safe,
        "annual_visits_p10": F.when(active, one("traffic", "p10")), "annual_visits_p50": F.when(active, one("traffic", "p50")).otherwise(safe), "annual_visits_p90": F.when(active, one("traffic", "p90")),
        "traffic_model": F.when(active, one("traffic", "model")), "proxy_level": one("scene", "proxy_level"), "busy_hour_gb": F.when(~odd, one("demand", "busy_hour_gb")),
        "complaint_pressure": pressure, "network_priority": F.when(F.lit(public_network), one("network", "priority")), "network_freshness": one("complaint", "freshness"),
        "has_traffic_model": F.col("n_traffic") > 0, "traffic_model_active": active, "has_complaints": F.col("n_complaint") > 0, "network_public": F.lit(public_network),
        "indoor_presence": one("build", "presence"), "indoor_rat": one("build", "rat"), "quality_status": one("candidate", "quality_status"), **ready,
        "map_coordinate_ready": map_ready(p("lat"), p("lon"), p("coordinate_status")), "has_review_issue": F.col("n_review") > 0, "review_count": F.col("n_review"),
        "source_count": F.greatest(F.lit(1), F.col("n_evidence")), "source_urls": urls, "main_metric": F.coalesce(one("evidence", "value"), F.lit("")), "issues": one("candidate", "issues"),
    }
    rows = packed.select(*keys, *[c.alias(n) for n, c in out.items()])
    # the normal form needs Python, which takes no arrays' elements: a text of all names goes through it line by line
    lines = F.array_join(F.transform("_forms", lambda n: F.regexp_replace(n, r"\s+", " ")), "\n")
    return rows.withColumn("search_text", search_lines(lines)).drop("_forms")

