"""Schemas as expressions: every keyword, paths, refusals and limits."""

import json

import pytest
from pyspark.sql import functions as F

from pathweave.functions import json_schema as js

SCHEMA = {
    "$schema": "draft", "$id": "x", "title": "A graph", "type": "object", "required": ["manifest", "nodes"], "additionalProperties": False,
    "properties": {"manifest": {"$ref": "#/$defs/manifest"}, "nodes": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/node"}}, "edges": {"type": "array", "maxItems": 2, "items": {"type": ["object", "null"]}}},
    "$defs": {
        "manifest": {"type": "object", "properties": {"made": {"type": "string", "format": "date-time", "minLength": 3}, "inputs": {"type": "object", "additionalProperties": {"type": "string"}}, "n": {"type": "integer", "minimum": 1, "maximum": 9}}},
        "at": {"type": "array", "minItems": 2, "maxItems": 2, "items": [{"type": "number", "minimum": -112.2}, {"type": "number", "maximum": 33.5}]},
        "node": {
            "type": "object", "required": ["id", "kind"], "additionalProperties": False,
            "properties": {"id": {"type": "string", "pattern": "^node:[a-z]+$"}, "kind": {"const": "node"}, "type": {"enum": ["door", "crossing", 3, None, True]}, "at": {"$ref": "#/$defs/at"}, "m": {"type": "number", "exclusiveMinimum": 0}, "signal": {"type": ["boolean", "null"]}},
            "allOf": [{"if": {"required": ["type"], "properties": {"type": {"const": "crossing"}}}, "then": {"required": ["signal"]}}],
        },
    },
}

NODE = {"id": "node:a", "kind": "node"}
CASES = [
    ({}, []),
    ({"nodes": 3}, ["nodes: 3 isn't of type array"]),
    ({"nodes": []}, ["nodes: 0 items are fewer than 1"]),
    ({"more": 1, "also": 2}, ["<root>: unexpected also, more"]),
    ({"manifest": None}, ["manifest: null isn't of type object"]),
    ({"manifest": {"made": "ab", "n": 0, "inputs": {"x": 7}}}, ['manifest.made: "ab" is shorter than 3', "manifest.n: 0 is less than 1"]),
    ({"manifest": {"n": 10}}, ["manifest.n: 10 is more than 9"]),
    ({"manifest": {"n": 2.5}}, ["manifest.n: 2.5 isn't of type integer"]),
    ({"manifest": {"n": True}}, ["manifest.n: true isn't of type integer"]),
    ({"edges": [{}, None, 5]}, ["edges: 3 items are more than 2", "edges[2]: 5 isn't of type object or null"]),
    ({"nodes": [NODE, {"id": "n", "kind": "edge"}]}, ['nodes[1].id: "n" doesn\'t match ^node:[a-z]+$', 'nodes[1].kind: "edge" isn\'t "node"']),
    ({"nodes": [{}]}, ["nodes[0]: id is missing", "nodes[0]: kind is missing"]),
    ({"nodes": ["text"]}, ['nodes[0]: "text" isn\'t of type object']),
    ({"nodes": [NODE | {"type": "x"}]}, ['nodes[0].type: "x" isn\'t one of ["door", "crossing", 3, null, true]']),
    ({"nodes": [NODE | {"type": t} for t in ("door", 3, 3.0, None, True)]}, []),
    ({"nodes": [NODE | {"type": "3"}, NODE | {"type": False}]}, ['nodes[0].type: "3" isn\'t one of ["door", "crossing", 3, null, true]', 'nodes[1].type: false isn\'t one of ["door", "crossing", 3, null, true]']),
    ({"nodes": [NODE | {"type": "crossing"}]}, ["nodes[0]: signal is missing"]),
    ({"nodes": [NODE | {"type": "crossing", "signal": None}]}, []),
    ({"nodes": [NODE | {"at": [-112.3, 33.6]}]}, ["nodes[0].at[0]: -112.3 is less than -112.2", "nodes[0].at[1]: 33.6 is more than 33.5"]),
    ({"nodes": [NODE | {"at": [1]}]}, ["nodes[0].at: 1 items are fewer than 2"]),
    ({"nodes": [NODE | {"at": [1, 2, 3]}]}, ["nodes[0].at: 3 items are more than 2"]),
    ({"nodes": [NODE | {"m": 0}, NODE | {"m": 1e-9}]}, ["nodes[0].m: 0 is not more than 0"]),
    ({"nodes": [NODE | {"more": 1}]}, ["nodes[0]: unexpected more"]),
]


def documents(spark, changes):
    rows = [(i, json.dumps({"manifest": {}, "nodes": [NODE]} | c)) for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, "file long, text string").select("file", F.parse_json("text").alias("doc"))


def test_every_keyword(spark):
    d = documents(spark, [c for c, _ in CASES])
    whole = {r.file: sorted(r.f) for r in d.select("file", js.faults(SCHEMA, F.col("doc"), F.lit("")).alias("f")).collect()}
    by_row = {}
    for r in js.document_faults(d, SCHEMA).collect():
        by_row.setdefault(r.file, []).append(r.fault)
    for i, (_, want) in enumerate(CASES):
        assert whole[i] == sorted(want), i
        assert sorted(by_row.get(i, [])) == sorted(want), i


def test_other_documents(spark):
    d = spark.createDataFrame([(1, "[1]"), (2, "null"), (3, "7")], "file long, text string").select("file", F.parse_json("text").alias("doc"))
    assert sorted(r.fault for r in js.document_faults(d, SCHEMA).collect()) == ["<root>: 7 isn't of type object", "<root>: [1] isn't of type object", "<root>: null isn't of type object"]


def test_the_first_faults_are_kept(spark):
    d = documents(spark, [{"nodes": [{"id": f"x{i}", "kind": "node"} for i in range(300)]}, {}])
    found = js.document_faults(d, SCHEMA).collect()
    assert [r.at for r in sorted(found, key=lambda r: r.at)] == list(range(100)) and {r.file for r in found} == {0}
    assert js.document_faults(d, SCHEMA, most=None).count() == 300


@pytest.mark.parametrize("schema", [{"minimun": 1}, {"properties": {"a": {"oneOf": []}}}, {"items": {"$ref": "other.json#/x"}}, {"type": "text"}, {"const": [1]}, {"$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}, "$ref": "#/$defs/a"}, {"if": {"maxLength": 3}}])
def test_what_is_not_known_is_refused(spark, schema):
    with pytest.raises(js.Refused):
        js.faults(schema, F.col("doc"), F.lit(""))
