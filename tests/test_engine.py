"""Catalog, descriptions, matching, connector and rounds, against an in-process service."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from weftline import schemas
from weftline.functions.records import record
from weftline.operators import keyed
from weftline.operators.endpoints import resolve
from weftline.operators.graph import options
from weftline.plans.api import add_mapping, graph, propose_mappings, register_spec
from weftline.plans.matching import ModelMatcher, NameMatcher, TextModelMatcher, pairs_by_name, prompt_lines
from weftline.sources import rest
from weftline.sources.catalog import Catalog, read_json
from weftline.sources.spec import outline, parse_specs, read_specs
from weftline.streaming.rounds import id_pairs, run_round, run_stream

TICKETS = """
openapi: 3.0.0
info: {title: Tickets}
paths:
  /tickets:
    parameters: [{name: shared, in: path, required: true}]
    post:
      operationId: addTicket
      description: Adds one
      requestBody: {content: {application/json: {schema: {$ref: '#/components/schemas/Ticket'}}}}
      responses: {200: {description: ok}}
    get: {operationId: allTickets, summary: '', description: All of them, responses: {200: {content: {application/json: {schema: {$ref: '#/components/schemas/Ticket'}}}}}}
    options: {operationId: none}
  /tickets/{id}:
    put:
      parameters:
        - {name: id, in: path, required: true, description: the id}
        - {name: page, in: query, required: true}
        - {name: opt, in: path}
        - {$ref: '#/components/parameters/External'}
        - {$ref: 'other.yml#/x'}
      requestBody: {content: {application/json: {schema: {$ref: '#/components/schemas/Ticket'}}}}
      responses: {}
components:
  parameters: {External: {name: tenant, in: path, required: true}}
  schemas:
    Ticket: {type: object, properties: {id: {type: string}, name: {type: string}, body: {type: string}, parent: {$ref: '#/components/schemas/Ticket'}}}
"""

ISSUES = json.dumps(
    {
        "openapi": "3.0.0",
        "info": {"title": "Issues"},
        "paths": {
            "/issues": {
                "get": {"responses": {"200": {"content": {"j": {"schema": {"properties": {"id": {}, "title": {}, "description": {}}}}}}}},
                "post": {"requestBody": {"content": {"j": {"schema": {"properties": {"title": {}, "description": {}}}}}}, "responses": {}},
            },
            "/issues/{id}": {"put": {"parameters": [{"name": "id", "in": "path", "required": True}], "responses": {}}},
        },
    }
)


class Service(BaseHTTPRequestHandler):
    data: dict[str, list] = {}
    keys: list = []

    def log_message(self, *_):
        pass

    def answer(self, value, status=200):
        self.send_response(status)
        self.end_headers()
        self.wfile.write(json.dumps(value).encode())

    def body(self):
        Service.keys.append(self.headers.get("idempotency-key"))
        return json.loads(self.rfile.read(int(self.headers["content-length"])))

    def do_GET(self):
        rows = Service.data.get(self.path.strip("/"))
        self.answer(rows if rows is not None else {"error": 1}, 200 if rows is not None else 500)

    def do_POST(self):
        rows = Service.data[self.path.strip("/")]
        row = {"id": f"{self.path.strip('/')[0]}{len(rows) + 1}"} | self.body()
        rows.append(row)
        self.answer(row)

    def do_PUT(self):
        name, at = self.path.strip("/").split("/")
        rows, body = Service.data[name], self.body()
        known = any(r["id"] == at for r in rows)
        rows[:] = [body if r["id"] == at else r for r in rows]
        self.answer(rows, 200 if known else 404)


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_description_to_rows(spark, tmp_path):
    texts = spark.createDataFrame([("t", "http://t", TICKETS), ("i", "http://i", ISSUES)], "id string, base_url string, text string")
    rows = {r.id: r for r in parse_specs(texts).collect()}
    t = rows["t"].endpoints
    assert [(e.method, e.path, e.name, e.description) for e in t] == [("get", "/tickets", "allTickets", "All of them"), ("post", "/tickets", "addTicket", "Adds one"), ("put", "/tickets/{id}", "", None)]
    assert [[(p.name, p.description) for p in e.parameters] for e in t] == [[], [], [("id", "the id"), ("tenant", None)]]
    assert t[0].requestBody == "" and "Ticket" in t[1].requestBody and '"name"' in t[1].requestBody
    assert (rows["t"].name, rows["t"].baseUrl, rows["t"].accessToken, rows["t"].schemas) == ("Tickets", "http://t", "", [])
    assert len(rows["i"].endpoints) == 3
    with pytest.raises(KeyError):
        outline("{}")
    (tmp_path / "a.yml").write_text(TICKETS)
    assert read_specs(spark, str(tmp_path)).count() == 1


def test_catalog_versions_and_lookups(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    assert catalog.apis().collect() == [] and catalog.mappings().collect() == []
    api = register_spec(catalog, TICKETS, "http://t")
    before = catalog.apis()
    register_spec(catalog, ISSUES, "http://i")
    assert before.count() == 1 and catalog.apis().count() == 2
    assert catalog.api(api).first().name == "Tickets" and catalog.api("none").first() is None
    assert [r.identifier for r in catalog.endpoint_identifiers(api).orderBy("ordinal").collect()] == ["GET /tickets", "POST /tickets", "PUT /tickets/{id}"]
    slots = spark.createDataFrame([(api, "getAll", "GET /tickets"), (api, "getOne", ""), (api, "update", "GET /nope")], "api_id string, operation string, identifier string")
    found = {r.operation: r.endpoint for r in resolve(slots, catalog.endpoints()).collect()}
    assert found["getAll"].name == "allTickets" and found["getOne"] is None and found["update"] is None
    assert prompt_lines(catalog.endpoints().where(F.col("api_id") == api)).split("\n")[2] == "PUT /tickets/{id} - undefined"
    (tmp_path / "m.json").write_text('[{"id": "m", "name": "n", "parts": []}]')
    assert read_json(spark, str(tmp_path / "m.json"), "mappings").first().name == "n"
    assert options(catalog.apis()).count() == 3
    with pytest.raises(ValueError):
        register_spec(catalog, "", "x")


def test_keyed_tables(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 2), (2, None, 1)], "k int, v string, ordinal int")
    assert {(r.k, r.v) for r in keyed.first_match(df, ["k"]).collect()} == {(1, "b"), (2, None)}
    one = df.where("v = 'a' or v is null")
    change = spark.createDataFrame([(1, None, 9), (3, "new", 9)], df.schema)
    assert {tuple(r) for r in keyed.replace_by_key(one, change, ["k"]).collect()} == {(1, None, 9), (2, None, 1)}
    assert {tuple(r) for r in keyed.upsert(one, change, ["k"]).collect()} == {(1, None, 9), (2, None, 1), (3, "new", 9)}
    assert {(r.k, r.v) for r in keyed.latest(df, ["k"], "ordinal").collect()} == {(1, "a"), (2, None)}
    assert {(r.k, r.x) for r in keyed.with_default(one, spark.createDataFrame([(1, 7)], "k int, x int"), ["k"], {"x": 0}).collect()} == {(1, 7), (2, 0)}


def test_matchers(spark):
    asked = []
    model = ModelMatcher(lambda prompt: asked.append(prompt))
    assert model.endpoints(["GET /a - x"], ["GET /b - y"]) == {} and "GET /a - x" in asked[0]
    assert model.fields([{"operation": "getAll"}], []) == {} and "getAll" in asked[1]
    text = TextModelMatcher(lambda prompt: 'Sure {not json}: {"name": "title"} {"b": 1}')
    assert text.fields([], []) == {"name": "title"} and TextModelMatcher(lambda prompt: "no").fields([], []) == {}
    side = lambda *x: spark.createDataFrame([(i,) for i in x], "identifier string")
    pairs = pairs_by_name(side("GET /repos/{owner}/issues", "GET /repos/{owner}/issues/{i-d}"), side("GET /repos/{o}/issues", "GET /x/issue", "GET /repos/{o}/issues/{n}"))
    assert dict(pairs.collect()) == {"GET /repos/{owner}/issues": "GET /repos/{o}/issues", "GET /repos/{owner}/issues/{i-d}": "GET /repos/{o}/issues/{n}"}


def test_rounds(spark, tmp_path, url):
    Service.data = {"tickets": [{"id": "t1", "name": "N1", "body": "B1"}], "issues": []}
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    a, b = register_spec(catalog, TICKETS, url), register_spec(catalog, ISSUES, url)
    ops = lambda kind: {"getAll": f"GET /{kind}", "create": f"POST /{kind}", "update": f"PUT /{kind}/{{id}}"}
    proposed = propose_mappings(catalog, a, list(ops("tickets").values()), b, list(ops("issues").values()))
    assert proposed == {}  # tickets and issues share no word
    dictionaries = {"name": "title", "body": "description"}
    assert NameMatcher().fields([{"requestBody": json.dumps({"properties": dict.fromkeys(dictionaries)})}], [{"requestBody": json.dumps({"properties": dict.fromkeys(dictionaries.values())})}]) == dictionaries
    mapping = add_mapping(catalog, "issue", {a: ops("tickets"), b: ops("issues")})
    vertices, edges = graph(catalog)
    assert vertices.count() == 2 and [tuple(r) for r in edges.collect()] == [(mapping, a, b, "issue")]

    assert run_round(catalog) == {mapping: [1, 1]}
    assert Service.data["issues"] == [{"id": "i1", "title": "N1", "description": "B1"}]
    assert Service.data["tickets"] == [{"id": "t1", "name": "N1", "body": "B1"}]
    assert [(r.a_id, r.b_id) for r in id_pairs(catalog, mapping).collect()] == [('"t1"', '"i1"')]

    Service.data["issues"][0]["title"] = "X"  # the first side wins
    assert run_round(catalog) == {mapping: [1, 1]}
    assert Service.data["issues"][0]["title"] == "N1" and len(Service.data["issues"]) == 1

    Service.data["tickets"][0]["name"] = "Y"
    reports = []
    query = run_stream(catalog, str(tmp_path / "checkpoint"), available_now=True, on_round=lambda n, r: reports.append(r))
    query.awaitTermination(120)
    assert reports and reports[0] == {mapping: [1, 1]}
    assert Service.data["issues"][0]["title"] == Service.data["tickets"][0]["name"] == "Y"
    assert catalog.read("id_map").count() == 1 and all(Service.keys)

    Service.data.pop("issues")  # a service that fails ends its mapping's round only
    assert run_round(catalog)[mapping].startswith("PythonException")


def test_connector_refuses_unfilled_paths(spark, url, tmp_path):
    asked = spark.createDataFrame([(0, "1", f"{url}/x/{{id}}", "put", "{}", "k")], "ordinal long, source_id string, url string, method string, body string, key string")
    answer = rest.write(asked, str(tmp_path / "answers")).first()
    assert answer.error.startswith("unfilled") and answer.failed
    Service.data = {"things": [{"id": 1}, {"id": "1", "n": None}]}
    got = rest.scan(spark, f"{url}/things")
    assert got.schema["item"].dataType.simpleString() == "map<string,variant>" and got.count() == 2
    assert spark.range(1).select(record(F.lit("[]"))).first()[0] is None
    assert schemas.ID_MAP.startswith("mapping_id")
