"""Pages: plain text, candidates for images, tiers of sources. JSON, dates and hashes of records."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entities that texts are full of, & last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def page_text(html: Column) -> Column:
    """What a page says: without scripts, styles, comments and tags, entities resolved, white space collapsed."""
    c = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)\s*>", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for sign, plain in ENTITIES:
        c = F.replace(c, F.lit(sign), F.lit(plain))
    return F.trim(F.regexp_replace(c, r"[\x20\x09-\x0D]+", " "))


def absolute(url: Column, link: Column) -> Column:
    """link as an address: as it is, under the page's scheme, its site, or its folder; without a fragment."""
    bare = F.regexp_replace(F.trim(link), "#.*$", "")
    site, scheme = F.regexp_extract(url, r"^([A-Za-z]+://[^/?#]*)", 1), F.regexp_extract(url, r"^([A-Za-z]+):", 1)
    folder = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"^([A-Za-z]+://.*/)", 1)
    folder = F.when(F.length(folder) > F.length(site), folder).otherwise(F.concat(site, F.lit("/")))
    return (
        F.when(bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), bare).when(bare.startswith("//"), F.concat(scheme, F.lit(":"), bare))
        .when(bare.startswith("/"), F.concat(site, bare)).when(bare != "", F.concat(folder, bare))
    )


def image_candidates(url: Column, html: Column) -> Column:
    """Structs (rank, address), each address once with its best rank: 0 what og:image says, 1 JSON-LD, 2 img tags; in this order."""
    found = [
        F.concat(
            F.regexp_extract_all(html, F.lit(r"""(?i)<meta[^>]+property=["']og:image["'][^>]*content=["']([^"']+)"""), 1),
            F.regexp_extract_all(html, F.lit(r"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]*property=["']og:image["']"""), 1),
        ),
        F.regexp_extract_all(html, F.lit(r'"image"\s*:\s*\[?\s*"([^"]+)"'), 1),
        F.regexp_extract_all(html, F.lit(r"""(?i)<img[^>]+src=["']([^"']+)"""), 1),
    ]

    def ranked(addresses: Column, rank: int) -> Column:
        return F.transform(addresses, lambda x: F.struct(F.lit(rank).alias("rank"), absolute(url, x).alias("address")))

    every = F.flatten(F.array(*[ranked(f, r) for r, f in enumerate(found)]))
    fine = F.filter(every, lambda x: F.coalesce(x["address"].rlike("^https?://"), F.lit(False)))
    addresses = F.array_distinct(F.transform(fine, lambda x: x["address"]))
    return F.transform(addresses, lambda a: F.struct(F.array_min(F.transform(F.filter(fine, lambda x: x["address"] == a), lambda x: x["rank"])).alias("rank"), a.alias("address")))


def source_tier(host: Column, tiers: Sequence[tuple[str, Sequence[str]]], other: str) -> Column:
    """The first tier one of whose tokens a host has as a part between dots, or ends with, if the token begins with a dot."""
    out = F.lit(other)
    for name, tokens in reversed(tiers):
        hit = F.lit(False)
        for t in tokens:
            hit = hit | (host.endswith(t) if t.startswith(".") else F.contains(F.concat(F.lit("."), host, F.lit(".")), F.lit(f".{t}.")))
        out = F.when(hit, name).otherwise(out)
    return out


def instant(raw: Column, fallback: Column) -> Column:
    """An ISO stamp as a timestamp; without a zone it is UTC (the session's zone); what is no stamp is fallback."""
    return F.coalesce(F.try_to_timestamp(F.trim(raw)), fallback)


def due(seen: Column, days: Column) -> Column:
    """The day after which something is stale; null days never are."""
    return F.date_add(seen, days.cast("int"))


def first_list(document: Column, paths: Sequence[str]) -> Column:
    """The first JSON array among paths of a JSON text that is not empty, as an array of JSON texts; empty if there is none."""
    read = [F.from_json(F.get_json_object(document, p), "array<string>") for p in paths]
    return F.coalesce(*[F.when(F.size(r) > 0, r) for r in read], F.array().cast("array<string>"))


def merged_json(base: Column, overlay: Column) -> Column:
    """The keys of two flat JSON objects, the overlay's values where both have one; keys in order. Broken JSON is an empty object."""
    read = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    b, o = read(base), read(overlay)
    kept = F.map_filter(b, lambda k, v: ~F.array_contains(F.map_keys(o), k))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, o)))))


def packet_issues(document: Column, required: Sequence[str], numbers: Sequence[str] = ()) -> Column:
    """What a JSON packet lacks: it does not parse, a required path is missing or empty, a number is none."""
    whole = F.from_json(document, "map<string,string>")
    text = lambda p: F.get_json_object(document, p)
    missing = [F.when(F.coalesce(F.trim(text(p)), F.lit("")) == "", F.lit(f"{p} missing")) for p in required]
    wrong = [F.when(text(p).isNotNull() & text(p).try_cast("double").isNull(), F.lit(f"{p} is no number")) for p in numbers]
    return F.when(whole.isNull(), F.array(F.lit("no object"))).otherwise(F.array_compact(F.array(*missing, *wrong)))


def schema_issues(document: Column, schema: Mapping) -> Column:
    """What a JSON text breaks of a JSON schema: an array of "path: what", in the schema's order; empty if it is valid.

    The schema may say type (one or several), enum (texts and null), minimum, maximum, minItems, required, properties
    and items, nested to any depth; other words are passed over. Keys beyond properties are allowed. A number without
    a fraction is an integer, however it is written. A null text and one that is no JSON have the one issue
    "$: no JSON". Of repeated keys nothing is known: such texts are no JSON. Everything stays in the JVM, and each
    element of an array is read once.
    """
    v = F.try_parse_json(document)
    none = F.array(F.lit("$: no JSON"))
    return F.when(v.isNull(), none).otherwise(_bound(v, lambda x: _breaks(x, schema, F.lit("$"))))


def _bound(v: Column, of: Callable[[Column], Column]) -> Column:
    """of(v), with v evaluated once; an empty array where v is null."""
    return F.flatten(F.transform(F.filter(F.array(v), lambda x: x.isNotNull()), of))


def _by(rule: Mapping, at: Column) -> Callable[[Column], Column]:
    return lambda v: _breaks(v, rule, at)


def _breaks(v: Column, rule: Mapping, at: Column) -> Column:
    """What a value breaks of a rule; at is its path."""
    kind, number = F.schema_of_variant(v), F.try_variant_get(v, "$", "double")
    numeric, many = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), kind.startswith("ARRAY")
    whole = kind.startswith("OBJECT")
    types = {
        "object": whole, "array": many, "string": kind == "STRING", "boolean": kind == "BOOLEAN", "null": kind == "VOID",
        "number": numeric, "integer": numeric & F.coalesce(number % 1 == 0, F.lit(False)),
    }
    empty = F.array().cast("array<string>")
    say = lambda bad, what: F.when(F.coalesce(bad, F.lit(False)), F.array(F.concat(at, F.lit(f": {what}")))).otherwise(empty)
    child = lambda key: F.try_variant_get(v, f"$['{key}']", "variant")
    out = [empty]
    if "type" in rule:
        wanted = [rule["type"]] if isinstance(rule["type"], str) else list(rule["type"])
        fits = types[wanted[0]]
        for t in wanted[1:]:
            fits = fits | types[t]
        out.append(say(~fits, "not " + " or ".join(wanted)))
    if "enum" in rule:
        texts = [x for x in rule["enum"] if x is not None]
        fits = types["string"] & F.try_variant_get(v, "$", "string").isin(*texts)
        out.append(say(~(fits | types["null"] if None in rule["enum"] else fits), "not one of " + ", ".join(texts)))
    if "minimum" in rule:
        out.append(say(numeric & (number < rule["minimum"]), f"below {rule['minimum']}"))
    if "maximum" in rule:
        out.append(say(numeric & (number > rule["maximum"]), f"above {rule['maximum']}"))
    elements = F.try_variant_get(v, "$", "array<variant>")
    if "minItems" in rule:
        out.append(say(many & (F.size(elements) < rule["minItems"]), f"fewer than {rule['minItems']} items"))
    out += [say(whole & child(k).isNull(), f"{k} missing") for k in rule.get("required", ())]
    for k, sub in rule.get("properties", {}).items():
        path = F.concat(at, F.lit(f".{k}"))
        out.append(F.when(whole, _bound(child(k), _by(sub, path))).otherwise(empty))
    if "items" in rule:
        each = lambda x, i: _breaks(x, rule["items"], F.concat(at, F.lit("["), i.cast("string"), F.lit("]")))
        out.append(F.when(many, F.flatten(F.transform(elements, each))).otherwise(empty))
    return F.concat(*out)


def record_key(*parts: Column) -> Column:
    """A key of a raw record: its parts trimmed and in lower case, null ones empty, joined by a bar."""
    return F.array_join(F.array(*[F.lower(F.trim(F.coalesce(p.cast("string"), F.lit("")))) for p in parts]), "|")


def record_hash(*parts: Column) -> Column:
    """SHA-256 of a record's parts as JSON, null ones as null."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts]), {"ignoreNullFields": "false"}), 256)
