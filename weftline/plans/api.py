"""The engine's calls: register descriptions, propose and add mappings, plan and apply sync rounds."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from weftline import schemas
from weftline.functions.paths import label
from weftline.operators.endpoints import OPERATIONS, resolve, selected
from weftline.operators.graph import graph as graph_of
from weftline.operators.sync import useful
from weftline.plans.matching import Matcher, NameMatcher
from weftline.plans.values import dictionary_of
from weftline.sources import rest
from weftline.sources.catalog import Catalog
from weftline.sources.rest import paging_of
from weftline.sources.spec import parse_specs


def register_spec(catalog: Catalog, text: str, base_url: str, files: dict[str, str] | None = None) -> str:
    """Parse a description, land its text and append it to the catalog; its new id. files: texts that it refers to, by relative path."""
    if not text or not base_url:
        raise ValueError("a description and a base url are needed")
    api_id = str(uuid.uuid4())
    landed = catalog.spark.createDataFrame([(api_id, base_url, text, files or {})], "id string, base_url string, text string, files map<string,string>")
    landed.write.parquet(f"{catalog.root}/specs/{api_id}")
    catalog.append("apis", parse_specs(landed))
    return api_id


def _labels(catalog: Catalog, api_id: str, identifiers: list[str]) -> list[str]:
    chosen = catalog.spark.createDataFrame([(x,) for x in identifiers], "identifier string")
    rows = selected(catalog.endpoints().where(F.col("api_id") == api_id), chosen)
    return [r.label for r in rows.orderBy("ordinal").select(label(F.col("identifier"), F.col("description")).alias("label")).collect()]


def propose_mappings(catalog: Catalog, a: str, selection_a: list[str], b: str, selection_b: list[str], matcher: Matcher | None = None, only_useful: bool = True) -> dict:
    """Categories with the endpoints of both sides, from the selected endpoints.

    Whatever the matcher says, an endpoint that its side's selection lacks becomes '', and, unless the caller wants
    them, categories of which a side cannot both be read and written are left out.
    """
    proposed = (matcher or NameMatcher()).endpoints(_labels(catalog, a, selection_a), _labels(catalog, b, selection_b))
    rows = [(k, side, op, ops.get(op) or "") for k, sides in proposed.items() for side in ("api1", "api2") for ops in (sides.get(side) or {},) for op in OPERATIONS]
    said = catalog.spark.createDataFrame(rows, "category string, side string, operation string, identifier string")
    offered = catalog.spark.createDataFrame([("api1", x) for x in selection_a] + [("api2", x) for x in selection_b], "side string, identifier string")
    of = lambda api, side: catalog.endpoints().where(F.col("api_id") == api).select(F.lit(side).alias("side"), "identifier")
    known = of(a, "api1").unionByName(of(b, "api2"))
    offered = offered.join(known, ["side", "identifier"], "left_semi").distinct().withColumn("found", F.lit(True))
    there = said.join(offered, ["side", "identifier"], "left").withColumn("identifier", F.when(F.col("found"), F.col("identifier")).otherwise(""))
    sides = there.groupBy("category", "side").pivot("operation", list(OPERATIONS)).agg(F.first("identifier"))
    sides = sides.withColumn("is_useful", useful(*[F.col(c) for c in ("getAll", "getOne", "create", "update")]))
    kept: dict = {}
    for r in sides.collect():  # a proposal is a short answer to one request
        kept.setdefault(r.category, {})[r.side] = ({op: r[op] for op in OPERATIONS}, r.is_useful)
    return {k: {side: kept[k][side][0] for side in ("api1", "api2")} for k in proposed if not only_useful or all(is_useful for _, is_useful in kept[k].values())}


def encoded(operation: str, endpoint: Row) -> dict:
    """An endpoint as matchers see it: its operation, description and parsed bodies, those it has."""
    body = lambda text: json.loads(text) if text else None
    found = {"endpoint": operation, "description": endpoint.description, "requestBody": body(endpoint.requestBody), "responseSchema": body(endpoint.responseSchema)}
    return {k: v for k, v in found.items() if v is not None}


def propose_fields(catalog: Catalog, sides: dict[str, str], scan: Callable = rest.scan) -> list[dict[str, str]]:
    """Field dictionaries of both directions, from the items that two services list now.

    sides: two api ids with the identifier of the endpoint that lists their items. Fields are told by their values.
    """
    wanted = catalog.spark.createDataFrame([(i, api, "getAll", identifier) for i, (api, identifier) in enumerate(sides.items())], "side int, api_id string, operation string, identifier string")
    found = resolve(wanted, catalog.endpoints().where(F.col("api_id").isin(*sides))).join(catalog.apis().select(F.col("id").alias("api_id"), "baseUrl"), "api_id")
    listed = {r.side: (r.baseUrl, r.endpoint) for r in found.collect()}  # two rows
    if unknown := [identifier for i, identifier in enumerate(sides.values()) if i not in listed or listed[i][1] is None]:
        raise KeyError(f"no endpoint {unknown[0]}")
    items = [scan(catalog.spark, base + e.path, e.method, **paging_of(e)) for base, e in (listed[0], listed[1])]
    there = dictionary_of(*items)
    return [there, {b: a for a, b in there.items()}]


def add_mapping(catalog: Catalog, name: str, sides: dict[str, dict[str, str]], matcher: Matcher | None = None, fields: list[dict[str, str]] | None = None) -> str:
    """sides: two api ids with their operations' identifiers. Unknown identifiers become none. fields: both dictionaries, if they are known."""
    matcher = matcher or NameMatcher()
    spark = catalog.spark
    slots = [(i, api, op, ops.get(op) or "") for i, (api, ops) in enumerate(sides.items()) for op in OPERATIONS]
    wanted = spark.createDataFrame(slots, "side int, api_id string, operation string, identifier string")
    found = resolve(wanted, catalog.endpoints().where(F.col("api_id").isin(*sides))).select("side", "operation", "endpoint")
    found = {(r.side, r.operation): r.endpoint for r in found.collect()}  # ten endpoints at most
    encode = lambda i: [encoded(op, found[i, op]) for op in OPERATIONS if found[i, op]]
    fields = fields or [matcher.fields(encode(i), encode(1 - i)) for i in (0, 1)]
    parts = [(api, *(found[i, op] for op in OPERATIONS), fields[i]) for i, api in enumerate(sides)]
    mapping_id = str(uuid.uuid4())
    catalog.append("mappings", spark.createDataFrame([(mapping_id, name, parts)], schemas.MAPPINGS))
    return mapping_id


def graph(catalog: Catalog) -> tuple[DataFrame, DataFrame]:
    return graph_of(catalog.apis(), catalog.mappings())
