"""What a sync round writes when calls fail, ids are missing, repeat or need escaping, and services honour keys."""

import json
import os
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F
from test_engine import ISSUES, TICKETS

from weftline.functions.records import record
from weftline.operators.endpoints import chosen, selection
from weftline.plans.api import add_mapping, encoded, propose_mappings, register_spec
from weftline.sources import catalog as catalogs
from weftline.sources import rest
from weftline.sources.catalog import Catalog
from weftline.streaming.rounds import id_pairs, repeats, run_round


class Service(BaseHTTPRequestHandler):
    """Lists by path; a POST or PUT whose key was answered before is answered the same and not done again."""

    data: dict[str, list] = {}
    answered: dict[str, dict] = {}
    fail: set = set()
    methods: list = []
    lock = threading.Lock()

    def log_message(self, *_):
        pass

    def answer(self, value, status=200):
        self.send_response(status)
        self.end_headers()
        self.wfile.write(json.dumps(value).encode())

    def do_GET(self):
        path, _, query = self.path.partition("?")
        rows = Service.data.get(path.strip("/"), [])
        Service.methods.append((self.command, path))
        if query:
            page = int(query.partition("=")[2])
            rows = rows[2 * (page - 1) : 2 * page]
        self.answer(rows)

    do_REPORT = do_GET

    def do_POST(self):
        Service.methods.append((self.command, urllib.parse.unquote(self.path)))
        body = json.loads(self.rfile.read(int(self.headers["content-length"])))
        key = self.headers["idempotency-key"]
        with Service.lock:
            if any(v in Service.fail for v in body.values()):
                return self.answer({"error": "no"}, 500)
            if key not in Service.answered:
                name, _, at = self.path.strip("/").partition("/")
                rows = Service.data[name]
                if self.command == "POST":
                    body = {"id": f"{name[0]}{len(rows) + 1}"} | body
                    rows.append(body)
                else:
                    rows[:] = [body if r["id"] == at else r for r in rows]
                Service.answered[key] = body
        self.answer(Service.answered[key])

    do_PUT = do_POST


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


@pytest.fixture
def linked(spark, tmp_path, url):
    Service.data, Service.answered, Service.fail, Service.methods = {"tickets": [], "issues": []}, {}, set(), []
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    a, b = register_spec(catalog, TICKETS, url), register_spec(catalog, ISSUES, url)
    ops = lambda kind: {"getAll": f"GET /{kind}", "create": f"POST /{kind}", "update": f"PUT /{kind}/{{id}}"}
    return catalog, add_mapping(catalog, "issue", {a: ops("tickets"), b: ops("issues")})


def ticket(i, name=None):
    return {"id": f"t{i}", "name": name or f"N{i}", "body": "B"}


def test_a_failed_call_loses_no_id_of_the_others(linked):
    catalog, mapping = linked
    Service.data["tickets"] = [ticket(i) for i in range(1, 6)]
    Service.fail = {"N3"}
    assert run_round(catalog)[mapping].startswith("SyncError: 1 calls failed")
    assert len(os.listdir(f"{catalog.root}/work")) == 1  # the failed pass can be looked at
    assert len(Service.data["issues"]) == 4 and id_pairs(catalog, mapping).count() == 4
    Service.fail = set()
    assert run_round(catalog) == {mapping: [5, 5]} and len(os.listdir(f"{catalog.root}/work")) == 1
    assert sorted(r["title"] for r in Service.data["issues"]) == ["N1", "N2", "N3", "N4", "N5"] and len(Service.data["tickets"]) == 5
    assert len({r.b_id for r in id_pairs(catalog, mapping).collect()}) == 5


def test_services_that_honour_keys_take_every_change(linked):
    catalog, mapping = linked
    Service.data["tickets"] = [ticket(1)]
    for title in ("X", "Y", "Z"):
        Service.data["tickets"][0]["name"] = title
        assert run_round(catalog) == {mapping: [1, 1]}
        assert [r["title"] for r in Service.data["issues"]] == [title]


def test_items_without_an_id_are_each_created(linked):
    catalog, mapping = linked
    Service.data["tickets"] = [{"name": "first", "body": ""}, {"name": "second", "body": ""}]
    run_round(catalog)
    assert sorted(r["title"] for r in Service.data["issues"]) == ["first", "second"]
    assert all(k for k in Service.answered) and id_pairs(catalog, mapping).where("a_id is null").count() == 0


def test_items_that_repeat_an_id_are_created_once_and_then_updated(linked):
    catalog, mapping = linked
    Service.data["tickets"] = [ticket(1, "early"), ticket(2), ticket(1, "between"), ticket(1, "late")]
    report = run_round(catalog)[mapping]
    assert report[0] == 3 and sorted(r["title"] for r in Service.data["issues"]) == ["N2", "late"]
    assert id_pairs(catalog, mapping).count() == 2


def test_repeats_keep_items_without_an_id(spark):
    rows = [(0, '{"id": 1}'), (1, "{}"), (2, '{"id": 1.0}'), (3, "{}"), (4, '{"id": "1"}'), (5, '{"id": 1}')]
    items = spark.createDataFrame(rows, "ordinal long, j string").select("ordinal", record(F.col("j")).alias("item"))
    first, later = repeats(items)
    assert sorted(r.ordinal for r in first.collect()) == [0, 1, 3, 4] and [r.ordinal for r in later.collect()] == [5]


def test_ids_with_quotes_and_other_methods(linked, spark, url):
    catalog, mapping = linked
    odd = 'a"b\\c é'
    Service.data["issues"] = [{"id": "i1", "title": "old"}]
    catalog.append("id_map", spark.createDataFrame([(mapping, json.dumps(odd, ensure_ascii=False), '"i1"', 1)], "mapping_id string, a_id string, b_id string, seq long"))
    Service.data["tickets"] = [{"id": odd, "name": "new", "body": ""}]
    assert run_round(catalog)[mapping][0] == 1 and Service.data["issues"][0]["title"] == "new"
    assert ("PUT", f"/tickets/{odd}") in Service.methods
    assert rest.scan(spark, f"{url}/tickets", "report").count() == 1 and Service.methods[-1][0] == "REPORT"


def test_pages_are_partitions(spark, url):
    Service.data["many"] = [{"id": i} for i in range(5)]
    rows = rest.scan(spark, f"{url}/many", page_parameter="page", pages=3)
    assert rows.rdd.getNumPartitions() == 3
    assert [r.ordinal for r in rows.orderBy("ordinal").collect()] == [0, 1, 1 << 32, (1 << 32) + 1, 2 << 32]


def test_the_id_map_is_a_log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalogs, "COMPACT_AFTER", 3)
    catalog = Catalog(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame(list(x), "mapping_id string, a_id string, b_id string, seq long")
    for k in range(6):
        catalog.append("id_map", rows(("m", "a", f"b{k}", catalog.next_number("id_map")), ("7", f"a{k}", "b", k)))
        assert {(r.a_id, r.b_id) for r in id_pairs(catalog, "m").collect()} == {("a", f"b{k}")}
        assert id_pairs(catalog, "7").count() == k + 1
        assert len(catalog.current("id_map")) <= 3
    assert any(p.endswith("-whole") for p in catalog._pointers("id_map"))
    before, parts = sorted(catalog.read("id_map").collect()), catalog.current("id_map")
    catalog.vacuum("id_map")
    assert sorted(catalog.read("id_map").collect()) == before and catalog._pointers("id_map") == parts
    assert sorted(os.listdir(tmp_path / "id_map" / "versions")) == [f"version={p}" for p in parts]


def test_proposals_name_known_endpoints_and_useful_pairs(linked, spark):
    catalog, _ = linked
    a, b = (catalog.apis().where(F.col("name") == n).first().id for n in ("Tickets", "Issues"))
    side = lambda kind, **more: {"getAll": f"GET /{kind}", "create": f"POST /{kind}", "update": f"PUT /{kind}/{{id}}", "getOne": "", "delete": f"DELETE /{kind}"} | more

    class Said:
        def endpoints(self, *_):
            return {"thing": {"api1": side("tickets"), "api2": side("issues")}, "half": {"api1": side("tickets"), "api2": {"getAll": "GET /issues"}}}

    every = [["GET /tickets", "POST /tickets", "PUT /tickets/{id}", "DELETE /tickets"], ["GET /issues", "POST /issues"]]
    got = propose_mappings(catalog, a, every[0], b, every[1], Said())
    assert set(got) == {"thing"} and got["thing"]["api1"] == side("tickets", delete="")
    assert got["thing"]["api2"] == side("issues", update="", delete="")
    assert set(propose_mappings(catalog, a, every[0], b, every[1], Said(), only_useful=False)) == {"thing", "half"}


def test_encoded_endpoints_hold_parsed_bodies(linked):
    catalog, _ = linked
    post = catalog.endpoints().where("identifier = 'POST /issues'").first()
    assert encoded("create", post) == {"endpoint": "create", "requestBody": {"content": {"j": {"schema": {"properties": {"title": {}, "description": {}}}}}}, "responseSchema": {}}


def test_selections(spark):
    names = F.array(F.lit("a"), F.lit("b"), F.lit("a"))
    row = spark.range(1).select(chosen(selection(names, True)).alias("on"), chosen(selection(names, False)).alias("off")).first()
    assert row.on == ["a", "b"] and row.off == []
