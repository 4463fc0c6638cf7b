"""Packets against a nested schema: odd values by hand, random ones against a plain recursive reading."""

import json
import random

from pyspark.sql import functions as F

from loomstone.functions import web

SCHEMA = {
    "type": "object",
    "required": ["entity", "evidence"],
    "properties": {
        "entity": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}, "state": {"enum": ["ok", "open", None]}, "lat": {"type": ["number", "null"], "minimum": -90, "maximum": 90}}},
        "evidence": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string"}}}}},
        "flag": {"type": "boolean"},
    },
}


def expected(v, rule, at="$"):
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    fits = {
        "object": isinstance(v, dict), "array": isinstance(v, list), "string": isinstance(v, str), "boolean": isinstance(v, bool),
        "null": v is None, "number": number, "integer": number and v == int(v),
    }
    out = []
    if "type" in rule:
        types = [rule["type"]] if isinstance(rule["type"], str) else rule["type"]
        out += [] if any(fits[t] for t in types) else [f"{at}: not {' or '.join(types)}"]
    if "enum" in rule and not ((v is None or isinstance(v, str)) and v in rule["enum"]):
        out.append(f"{at}: not one of {', '.join(x for x in rule['enum'] if x is not None)}")
    if number and v < rule.get("minimum", v):
        out.append(f"{at}: below {rule['minimum']}")
    if number and v > rule.get("maximum", v):
        out.append(f"{at}: above {rule['maximum']}")
    if fits["array"] and len(v) < rule.get("minItems", 0):
        out.append(f"{at}: fewer than {rule['minItems']} items")
    if fits["object"]:
        out += [f"{at}: {k} missing" for k in rule.get("required", ()) if k not in v]
        for k, sub in rule.get("properties", {}).items():
            out += expected(v[k], sub, f"{at}.{k}") if k in v else []
    if fits["array"] and "items" in rule:
        for i, x in enumerate(v):
            out += expected(x, rule["items"], f"{at}[{i}]")
    return out


def issues(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, p string")
    return [r["x"] for r in df.select("i", web.schema_issues(F.col("p"), SCHEMA).alias("x")).orderBy("i").collect()]


def test_odd_packets(spark):
    good = '{"entity":{"name":"x","state":null,"lat":90},"evidence":[{"n":1.0,"tags":[]}],"more":{}}'
    got = issues(spark, [good, None, "", "{", "[]", "null", '"text"', '{"entity":{"name":null},"evidence":[]}', '{"entity":[],"evidence":[1,{"n":1.5,"tags":["a",2]}]}'])
    assert got[0] == [] and got[1] == got[2] == got[3] == ["$: no JSON"]
    assert got[4] == got[5] == got[6] == ["$: not object"]
    assert got[7] == ["$.entity.name: not string", "$.evidence: fewer than 1 items"]
    assert got[8] == ["$.entity: not object", "$.evidence[0]: not object", "$.evidence[1].n: not integer", "$.evidence[1].tags[1]: not string"]


def test_random_packets_as_a_plain_reading_has_them(spark):
    rng = random.Random(5)
    leaf = lambda: rng.choice([None, True, False, 0, 7, -91, 90.5, 2.0, 1e30, "", "ok", "open", "é\"'", [], {}])

    def some(rule):
        if rng.random() < 0.05:
            return leaf()
        if rule.get("type") == "object":
            keys = {k: some(sub) for k, sub in rule["properties"].items() if rng.random() < 0.95}
            return keys | ({"other": leaf()} if rng.random() < 0.2 else {})
        if rule.get("type") == "array":
            return [some(rule["items"]) for _ in range(rng.randrange(4))]
        return {"string": "x", "integer": 3, "boolean": True}.get(str(rule.get("type"))) if rng.random() < 0.9 else leaf()

    packets = [some(SCHEMA) for _ in range(400)]
    got = issues(spark, [json.dumps(p, ensure_ascii=False) for p in packets])
    want = [expected(p, SCHEMA) for p in packets]
    assert got == want and sum(map(bool, want)) > 100 and sum(not w for w in want) > 20
