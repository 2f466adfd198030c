"""Proposals of which endpoints and fields of two services belong together.

Matchers are pluggable: a language model behind a function from prompt to JSON text, or the built-in one,
which compares names and is the same every time. Proposals never decide results of the queries.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.paths import blanked, label
from weftline.operators.endpoints import OPERATIONS


class Matcher(Protocol):
    def endpoints(self, a: list[str], b: list[str]) -> dict[str, dict[str, dict[str, str]]]: ...

    def fields(self, source: list[dict], target: list[dict]) -> dict[str, str]: ...


def joined(ordinal: Column, text: Column, separator: str) -> Column:
    """An aggregate: texts in the order of their ordinals, one after the other."""
    lines = F.sort_array(F.collect_list(F.struct(ordinal.alias("ordinal"), text.alias("text"))))
    return F.array_join(F.transform(lines, lambda x: x["text"]), separator)


def prompt_lines(endpoints: DataFrame) -> str:
    """Labels of a service's selected endpoints in catalog order, a line each."""
    lines = joined(F.col("ordinal"), label(F.col("identifier"), F.col("description")), "\n")
    return endpoints.agg(lines.alias("lines")).first().lines


ENDPOINT_PROMPT = """Two services offer these endpoints.

Service api1:
{a}

Service api2:
{b}

Group endpoints that handle the same kind of record. Answer with one JSON object: for each kind an object with
the keys api1 and api2, each with the keys {operations}; give an endpoint as "METHOD PATH" as listed, or "" if
there is none. Use listed endpoints only. A side needs one of getAll and getOne and one of create and update."""

FIELD_PROMPT = """Records are copied from one service to another.

Operations of the source:
{source}

Operations of the target:
{target}

Answer with one JSON object that gives for each property of a source record the property of a target record that
means the same; leave out properties without a counterpart."""


class ModelMatcher:
    """A language model as a matcher; ask takes a prompt and returns JSON text, perhaps empty."""

    def __init__(self, ask: Callable[[str], str | None]):
        self.ask = ask

    def endpoints(self, a: list[str], b: list[str]) -> dict:
        prompt = ENDPOINT_PROMPT.format(a="\n".join(a), b="\n".join(b), operations=", ".join(OPERATIONS))
        return json.loads(self.ask(prompt) or "{}")

    def fields(self, source: list[dict], target: list[dict]) -> dict:
        show = lambda ops: ", ".join(json.dumps(o) for o in ops)
        return json.loads(self.ask(FIELD_PROMPT.format(source=show(source), target=show(target))) or "{}")


class TextModelMatcher(ModelMatcher):
    """A model that continues text instead of answering in JSON mode: the first JSON object in what it writes counts, none as {}."""

    def __init__(self, continue_text: Callable[[str], str | None]):
        super().__init__(lambda prompt: self.first_object(continue_text(prompt + "\n\nJSON:") or ""))

    @staticmethod
    def first_object(text: str) -> str | None:
        decoder, at = json.JSONDecoder(), text.find("{")
        while at >= 0:
            try:
                return json.dumps(decoder.raw_decode(text, at)[0])
            except json.JSONDecodeError:
                at = text.find("{", at + 1)
        return None


def pairs_by_name(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_identifier, b_identifier): the same method and path but for placeholder names; else, of those with
    the same method and last fixed word but for a plural s, the closest by edit distance."""
    last = lambda c: F.regexp_replace(F.lower(F.regexp_extract(c, r"([A-Za-z0-9_.-]+)(?:/\{[^}]+\})?$", 1)), "s$", "")
    side = lambda df, s: df.select(
        F.col("identifier").alias(f"{s}_identifier"), blanked(F.col("identifier")).alias(f"{s}_blank"), F.substring_index("identifier", " ", 1).alias("method"),
        last(F.col("identifier")).alias("word"), F.regexp_count("identifier", F.lit(r"\}$")).alias("one"),
    )
    met = side(a, "a").join(side(b, "b"), ["method", "word", "one"])
    best = F.min_by("b_identifier", F.struct(F.levenshtein("a_blank", "b_blank"), "b_identifier")).alias("b_identifier")
    return met.groupBy("a_identifier").agg(best)


def properties(bodies: list) -> list[str]:
    """Names of properties that these JSON schemas, parsed or as texts, declare."""
    found: dict[str, None] = {}

    def walk(node) -> None:
        if isinstance(node, dict):
            if isinstance(node.get("properties"), dict):
                found.update(dict.fromkeys(node["properties"]))
            for x in node.values():
                walk(x)
        elif isinstance(node, list):
            for x in node:
                walk(x)

    for body in bodies:
        if body:
            walk(json.loads(body) if isinstance(body, str) else body)
    return list(found)


#: Names that often mean the same.
SYNONYMS = [{"name", "title", "subject"}, {"body", "description", "text", "content"}, {"closed", "done", "resolved"}]


class NameMatcher:
    """Deterministic: endpoints by path words, fields by equal or synonymous names."""

    @staticmethod
    def operation(identifier: str) -> str | None:
        method, _, path = identifier.partition(" ")
        one = path.endswith("}")
        return {"GET": "getOne" if one else "getAll", "POST": "create", "PUT": "update", "PATCH": "update", "DELETE": "delete"}.get(method)

    @staticmethod
    def entity(identifier: str) -> str:
        words = [w for w in identifier.partition(" ")[2].split("/") if w and not w.startswith("{")]
        return words[-1].lower().removesuffix("s") if words else ""

    def endpoints(self, a: list[str], b: list[str]) -> dict:
        out: dict = {}
        for side, labels in (("api1", a), ("api2", b)):
            for identifier in (x.partition(" - ")[0] for x in labels):
                if op := self.operation(identifier):
                    kind = out.setdefault(self.entity(identifier), {s: dict.fromkeys(OPERATIONS, "") for s in ("api1", "api2")})
                    kind[side][op] = kind[side][op] or identifier
        return {k: v for k, v in out.items() if all(any(v[s].values()) for s in ("api1", "api2"))}

    def fields(self, source: list[dict], target: list[dict]) -> dict:
        names = [properties([x.get(k) or "" for x in ops for k in ("requestBody", "responseSchema")]) for ops in (source, target)]
        out = {}
        for name in names[0]:
            same = {name.lower()}.union(*(s for s in SYNONYMS if name.lower() in s))
            exact = [t for t in names[1] if t.lower() == name.lower()]
            if found := exact or [t for t in names[1] if t.lower() in same]:
                out[name] = found[0]
        return out
