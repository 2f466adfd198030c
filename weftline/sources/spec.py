"""OpenAPI descriptions (YAML or JSON) to catalog rows.

Only parsing and the resolution of references leave the JVM: an Arrow function turns a text into canonical
JSON in which references are replaced by what they point to, in the text or in files given beside it. A reference
within itself stays a reference; one into a file that is not at hand, and a text that is no description, fail the job
by name (parameters that only refer to such a file are left out). The rest is column expressions.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.endpoints import VERBS, default_name, described, path_parameters, unpivot_verbs

OPERATION = "struct<operationId:string,summary:string,description:string,parameters:array<struct<ref:string,`in`:string,required:boolean,name:string,description:string>>,requestBody:string,responses:string>"
DOCUMENT = f"struct<title:string,paths:array<struct<path:string,{','.join(f'`{v}`:{OPERATION}' for v in VERBS)}>>>"


#: Nodes of a part that is written out without references.
EXPANDED = 20_000

#: Query parameters by which services are asked for a page, in lower case, and the header of keys.
PAGE_NAMES = ("page", "page_number", "pagenumber", "pageno")
OFFSET_NAMES = ("offset", "skip", "startat", "start_index")
CURSOR_NAMES = ("cursor", "page_token", "pagetoken", "after", "starting_after", "next_token", "continuation_token")
SIZE_NAMES = ("per_page", "page_size", "pagesize", "limit", "max_results", "maxresults")
KEY_HEADER = "idempotency-key"
PARAMETERS = "array<struct<ref:string,`in`:string,required:boolean,name:string,description:string>>"


def paging(parameters: Column) -> Column:
    """How an operation's collection is paged, by its query parameters; null if they name no page."""

    def named(names: tuple[str, ...]) -> Column:
        of_these = F.filter(parameters, lambda p: F.coalesce((p["in"] == "query") & F.lower(p["name"]).isin(*names), F.lit(False)))
        return F.get(of_these, F.lit(0))["name"]

    size = named(SIZE_NAMES)
    found = [(kind, named(names)) for kind, names in (("cursor", CURSOR_NAMES), ("page", PAGE_NAMES), ("offset", OFFSET_NAMES))]
    return F.coalesce(*[F.when(name.isNotNull(), F.struct(F.lit(kind).alias("kind"), name.alias("page"), size.alias("size"))) for kind, name in found])


def honours_keys(parameters: Column) -> Column:
    return F.exists(parameters, lambda p: F.coalesce((p["in"] == "header") & (F.lower(p["name"]) == KEY_HEADER), F.lit(False)))


class TooLarge(Exception):
    """An expansion that would repeat shared parts too often."""


def parsed(text: str) -> Any:
    import yaml

    return json.loads(text) if text.lstrip().startswith("{") else yaml.load(text, Loader=yaml.BaseLoader)


class References:
    """A description and the files beside it as a graph of references.

    A reference is resolved once. A part is expanded in place as long as that takes EXPANDED nodes at most; a reference within
    itself stays one. A larger part, which schemas that share schemas double at each level, keeps its references:
    what they point to stands once under $defs beside it, so that it takes as much room as what it can reach.
    """

    def __init__(self, document: Any, files: dict[str, str] | None = None):
        self.documents = {"": document}
        self.files = files or {}
        self.found: dict[tuple[str, str], tuple[str, Any]] = {}

    def _place(self, ref: str, file: str) -> tuple[str, str]:
        """(file, pointer) of a reference in a file."""
        target, _, pointer = ref.partition("#")
        return (posixpath.normpath(posixpath.join(posixpath.dirname(file), target)) if target else file), pointer

    def target(self, place: tuple[str, str]) -> tuple[str, Any]:
        """(file, node) of a place; of a node that is itself a reference, what that points to in the end."""
        seen: list[tuple[str, str]] = []
        while place not in self.found:
            if place in seen:
                raise ValueError(f"reference {place[1] or place[0]} points to itself")
            seen.append(place)
            file, pointer = place
            if file not in self.documents:
                if file not in self.files:
                    raise ValueError(f"the description refers to {file}, which is not at hand")
                self.documents[file] = parsed(self.files[file])
            node = self.documents[file]
            for step in [p for p in pointer.split("/")[1:]] if pointer else []:
                step = step.replace("~1", "/").replace("~0", "~")
                node = node[int(step)] if isinstance(node, list) else node[step]
            further = self._ref(node, file)
            if further is None:
                self.found[place] = file, node
            else:
                place = further
        for other in seen:
            self.found[other] = self.found[place]
        return self.found[place]

    def _ref(self, node: Any, file: str) -> tuple[str, str] | None:
        ref = node.get("$ref") if isinstance(node, dict) else None
        return self._place(ref, file) if isinstance(ref, str) else None

    def expanded(self, node: Any, file: str = "") -> Any:
        left = EXPANDED

        def walk(node: Any, file: str, within: tuple) -> Any:
            nonlocal left
            left -= 1
            if left < 0:
                raise TooLarge
            if isinstance(node, list):
                return [walk(x, file, within) for x in node]
            if not isinstance(node, dict):
                return node
            place = self._ref(node, file)
            if place is not None and place not in within:
                there, target = self.target(place)
                return walk(target, there, (*within, place))
            return {k: walk(v, file, within) for k, v in node.items()}

        return walk(node, file, ())

    def bundled(self, node: dict, file: str = "") -> dict:
        """The part with its references, and each that it can reach once under $defs."""
        names: dict[tuple[str, str], str] = {}
        waiting: list[tuple[str, str]] = []

        def name_of(place: tuple[str, str]) -> str:
            if place not in names:
                last = place[1].rpartition("/")[2] or posixpath.basename(place[0])
                taken = set(names.values())
                names[place] = next(n for n in (last, *(f"{last}-{k}" for k in range(2, len(taken) + 3))) if n not in taken)
                waiting.append(place)
            return names[place]

        def walk(node: Any, file: str) -> Any:
            if isinstance(node, list):
                return [walk(x, file) for x in node]
            if not isinstance(node, dict):
                return node
            place = self._ref(node, file)
            return {"$ref": f"#/$defs/{name_of(place)}"} if place is not None else {k: walk(v, file) for k, v in node.items()}

        out, defs = walk(node, file), {}
        while waiting:
            place = waiting.pop()
            there, target = self.target(place)
            defs[names[place]] = walk(target, there)
        return out | {"$defs": defs}

    def resolved(self, node: Any) -> Any:
        try:
            return self.expanded(node)
        except TooLarge:
            return self.bundled(node)


def outline(text: str, files: dict[str, str] | None = None) -> str:
    """The parts of a description that the catalog takes, as JSON of DOCUMENT's shape."""
    document = parsed(text)
    references = References(document, files)

    def body(value: Any) -> str:
        return json.dumps(references.resolved(value), ensure_ascii=False, separators=(",", ":"))

    def parameter(p: Any) -> dict:
        place = references._ref(p, "")
        if place is not None and (place[0] == "" or place[0] in references.files):
            p = references.target(place)[1]
        return {"ref": p.get("$ref"), "in": p.get("in"), "required": p.get("required") in (True, "true"), "name": p.get("name"), "description": p.get("description")}

    def operation(op: dict) -> dict:
        asked = {"requestBody": body(op["requestBody"])} if "requestBody" in op else {}
        answers = {"responses": body(op["responses"])} if "responses" in op else {}
        return {k: op.get(k) for k in ("operationId", "summary", "description")} | {"parameters": [parameter(p) for p in op.get("parameters") or []]} | asked | answers

    def item(value: Any) -> Any:
        place = references._ref(value, "")
        return value if place is None else references.target(place)[1]

    paths = [{"path": p} | {v: operation(own[v]) for v in VERBS if own.get(v) is not None} for p, found in (document.get("paths") or {}).items() if isinstance(own := item(found), dict)]
    return json.dumps({"title": document["info"]["title"], "paths": paths}, ensure_ascii=False)


def parse_specs(texts: DataFrame) -> DataFrame:
    """texts (id, base_url, text) as rows of the apis table. A column ``files`` holds the files beside a text that it refers to, by relative path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            beside = [dict(f or []) for f in batch.column(3).to_pylist()]
            found = pa.array([outline(t, f) for t, f in zip(batch.column(2).to_pylist(), beside, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["id", "base_url", "json"])

    files = F.col("files") if "files" in texts.columns else F.create_map().cast("map<string,string>")
    documents = texts.select("id", "base_url", "text", files.alias("files")).mapInArrow(run, "id string, base_url string, json string")
    documents = documents.select("id", "base_url", F.from_json("json", DOCUMENT).alias("d"))
    paths = documents.select("id", F.posexplode("d.paths").alias("path_ordinal", "p")).select("id", "path_ordinal", "p.*")
    rows = unpivot_verbs(paths, {v: F.col(v) for v in VERBS}, ["id", "path_ordinal", "path"])
    op = F.col("operation")
    parameters = F.coalesce(op["parameters"], F.array().cast(PARAMETERS))
    endpoint = F.struct(
        default_name(op["operationId"]).alias("name"),
        described(op["summary"], op["description"]).alias("description"),
        "path",
        "method",
        path_parameters(parameters).alias("parameters"),
        F.coalesce(op["requestBody"], F.lit("")).alias("requestBody"),
        op["responses"].alias("responseSchema"),
        paging(parameters).alias("paging"),
        honours_keys(parameters).alias("honoursKeys"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("path_ordinal", "verb_ordinal", endpoint.alias("endpoint"))))
    found = rows.groupBy("id").agg(F.transform(ordered, lambda x: x["endpoint"]).alias("endpoints"))
    return documents.join(found, "id", "left").select(
        "id",
        F.col("d.title").alias("name"),
        F.col("base_url").alias("baseUrl"),
        F.lit("").alias("accessToken"),
        F.array().cast("array<struct<name:string,value:string>>").alias("parameterSubstitutions"),
        F.coalesce("endpoints", F.array().cast(found.schema["endpoints"].dataType)).alias("endpoints"),
        F.array().cast("array<struct<name:string,description:string,fields:array<struct<name:string,description:string>>>>").alias("schemas"),
    )


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """Files of descriptions as (id, text), the file's place as id."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("id"), F.col("value").alias("text"))
