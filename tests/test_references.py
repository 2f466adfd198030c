"""References in descriptions: shared, nested, cyclic, and into other files."""

import json
import time

import pytest

from weftline.plans.matching import properties
from weftline.sources.spec import References, outline, parse_specs


def described(schemas, ref="#/components/schemas/S0"):
    body = {"content": {"j": {"schema": {"$ref": ref}}}}
    return {"openapi": "3.0.0", "info": {"title": "t"}, "paths": {"/x": {"post": {"requestBody": body, "responses": {}}}}, "components": {"schemas": schemas}}


def nested(levels):
    """Schemas of which each names the next one twice."""
    at = lambda k: {"$ref": f"#/components/schemas/S{k}"}
    schemas = {f"S{k}": {"properties": {f"a{k}": at(k + 1), f"b{k}": at(k + 1)}} for k in range(levels)}
    return described(schemas | {f"S{levels}": {"properties": {"last": {"type": "string"}}}})


def body_of(document, files=None):
    return json.loads(json.loads(outline(json.dumps(document), files))["paths"][0]["post"]["requestBody"])


def test_nested_levels_take_linear_time_and_space():
    sizes = {}
    for levels in (30, 60, 120):
        began = time.perf_counter()
        text = outline(json.dumps(nested(levels)))
        assert time.perf_counter() - began < 1
        sizes[levels] = len(text)
        assert set(properties([json.loads(text)["paths"][0]["post"]["requestBody"]])) == {"last", *(f"{x}{k}" for x in "ab" for k in range(levels))}
    assert sizes[120] - sizes[60] < 2.5 * (sizes[60] - sizes[30])


def test_a_large_part_says_the_same_as_its_expansion():
    document = nested(18)
    bundle = body_of(document)
    follow = lambda node: bundle["$defs"][node["$ref"].rpartition("/")[2]] if "$ref" in node else node
    for path in ("aaaaaaaaaaaaaaaaaa", "abababababababbaba"):
        node = follow(bundle["content"]["j"]["schema"])
        for k, side in enumerate(path):
            node = follow(node["properties"][f"{side}{k}"])
        assert node == {"properties": {"last": {"type": "string"}}}
    assert "$defs" not in json.dumps(body_of(nested(5)))


def test_cycles_and_chains():
    ref = lambda name: {"$ref": f"#/components/schemas/{name}"}
    loop = {"S0": ref("A"), "A": {"properties": {"self": ref("A"), "b": ref("B")}}, "B": {"properties": {"a": ref("A")}}}
    found = body_of(described(loop))["content"]["j"]["schema"]["properties"]
    assert found["self"]["properties"]["self"] == ref("A") and set(properties([json.dumps(found)])) >= {"self", "a"}
    with pytest.raises(ValueError, match="points to itself"):
        body_of(described({"S0": ref("S1"), "S1": ref("S0")}))
    many = {f"S{k}": {"properties": {f"p{j}": ref(f"S{j}") for j in range(12)}} for k in range(12)}  # each refers to all
    began = time.perf_counter()
    assert len(body_of(described(many))["$defs"]) == 12 and time.perf_counter() - began < 2


def test_other_files_are_resolved_or_refused_by_name(spark):
    document = described({}, "parts/ticket.yml#/Ticket")
    files = {"parts/ticket.yml": "Ticket: {properties: {id: {type: string}, owner: {$ref: '../people.json#/Person'}, next: {$ref: '#/Ticket'}}}", "people.json": '{"Person": {"properties": {"e~m/ail": {"$ref": "#/Text"}}}, "Text": {"type": "string"}}'}
    found = body_of(document, files)["content"]["j"]["schema"]["properties"]
    assert found["owner"]["properties"]["e~m/ail"] == {"type": "string"} and found["next"] == {"$ref": "#/Ticket"}
    with pytest.raises(ValueError, match="parts/ticket.yml"):
        outline(json.dumps(document))
    rows = spark.createDataFrame([("a", "u", json.dumps(document), files)], "id string, base_url string, text string, files map<string,string>")
    assert '"e~m/ail"' in parse_specs(rows).first().endpoints[0].requestBody


def test_pointers_with_escapes_and_lists():
    document = {"a/b": {"c~d": [{"x": 1}, {"y": 2}]}}
    assert References(document).target(("", "/a~1b/c~0d/1")) == ("", {"y": 2})
