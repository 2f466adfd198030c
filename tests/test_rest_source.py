"""Paging, point reads, patience, snapshots as a stream, and the log of writes."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F
from service import Service, description

from weftline.plans.api import add_mapping, propose_fields, register_spec
from weftline.sources import http, rest
from weftline.sources.answer_log import AnswerLog, answers_of, begun_of
from weftline.sources.catalog import Catalog
from weftline.sources.spec import parse_specs
from weftline.sources.rest import paging_of
from weftline.streaming.rounds import run_round, snapshot_stream


@pytest.fixture
def service():
    made = Service()
    yield made
    made.server.shutdown()


def ids(rows):
    return [json.loads(r.i) for r in rows.orderBy("ordinal").select(F.to_json(F.try_element_at("item", F.lit("id"))).alias("i")).collect()]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 16])
@pytest.mark.parametrize(
    ("style", "options"),
    [
        ("page", {"paging": "page", "page_parameter": "page"}),
        ("page", {"paging": "page", "page_parameter": "page", "size_parameter": "per_page", "page_size": 3}),
        ("clamped", {"paging": "page", "page_parameter": "page"}),
        ("last", {"paging": "page", "page_parameter": "page"}),
        ("total", {"paging": "page", "page_parameter": "page"}),
        ("offset", {"paging": "offset", "page_parameter": "offset", "size_parameter": "per_page", "page_size": 5}),
        ("offset", {"paging": "offset", "page_parameter": "offset"}),
        ("cursor", {"paging": "cursor", "page_parameter": "cursor"}),
        ("next", {}),
        ("whole", {}),
        ("whole", {"paging": "page", "page_parameter": "page"}),
    ],
)
def test_all_pages_are_read(service, style, options, n):
    service.data, service.style = {"many": [{"id": i} for i in range(n)]}, {"many": style}
    reader = rest.CollectionReader({"url": f"{service.url}/many", **{k: str(v) for k, v in options.items()}})
    rows = [row for p in reader.partitions() for row in reader.read(p)]
    assert [json.loads(r[1])["id"] for r in sorted(rows)] == list(range(n)) and len({r[0] for r in rows}) == n


def test_pages_are_found_by_few_calls_and_are_partitions(spark, service):
    service.data, service.style = {"many": [{"id": i} for i in range(200)]}, {"many": "page"}
    rows = rest.scan(spark, f"{service.url}/many", paging="page", page_parameter="page")
    assert rows.rdd.getNumPartitions() == 100 and len(service.calls) < 20
    assert ids(rows) == list(range(200))


def test_pages_that_lead_in_a_circle_are_refused(service):
    service.data, service.style = {"many": [{"id": i} for i in range(9)]}, {"many": "circle"}
    reader = rest.CollectionReader({"url": f"{service.url}/many?page=1"})
    with pytest.raises(ValueError, match="circle"):
        list(reader.read(reader.partitions()[0]))


def test_descriptions_declare_paging_and_keys(spark):
    kinds = {"a": ("page", "per_page"), "b": ("limit", "offset"), "c": ("cursor", "page"), "d": ("sort",)}
    texts = spark.createDataFrame([(k, "u", description("x", query, keys=k == "a")) for k, query in kinds.items()], "id string, base_url string, text string")
    found = {r.id: r.endpoints for r in parse_specs(texts).collect()}
    assert {k: e[0].paging and tuple(e[0].paging) for k, e in found.items()} == {"a": ("page", "page", "per_page"), "b": ("offset", "offset", "limit"), "c": ("cursor", "cursor", None), "d": None}
    assert [e[1].honoursKeys for e in found.values()].count(True) == 1 and found["a"][1].honoursKeys
    assert paging_of(found["a"][0]) == {"paging": "page", "page_parameter": "page", "size_parameter": "per_page"} and paging_of(found["d"][0]) == {}


class Same:
    def fields(self, *_):
        return {"name": "name"}


def mapped(spark, tmp_path, service, first, second, one=False):
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    a, b = register_spec(catalog, description("tickets", first), service.url), register_spec(catalog, description("issues", second, one=one), service.url)
    ops = lambda kind: {"getAll": f"GET /{kind}", "create": f"POST /{kind}", "update": f"PUT /{kind}/{{id}}"}
    return catalog, add_mapping(catalog, "m", {a: ops("tickets"), b: ops("issues") | ({"getOne": "GET /issues/{id}"} if one else {})}, Same())


def test_rounds_read_paged_services_without_options(spark, tmp_path, service):
    service.data, service.style = {"tickets": [{"id": f"t{i}", "name": f"N{i}"} for i in range(5)], "issues": []}, {"tickets": "page", "issues": "cursor"}
    catalog, mapping = mapped(spark, tmp_path, service, ("page",), ("cursor",))
    assert run_round(catalog) == {mapping: [5, 5]} and len(service.data["issues"]) == 5
    assert run_round(catalog) == {mapping: [5, 5]} and len(service.data["issues"]) == len(service.data["tickets"]) == 5


def test_an_item_that_cannot_be_had_keeps_no_other_from_being_sent(spark, tmp_path, service):
    service.data = {"tickets": [{"id": f"t{i}", "name": f"N{i}"} for i in range(3)], "issues": []}
    catalog, mapping = mapped(spark, tmp_path, service, (), (), one=True)
    assert run_round(catalog) == {mapping: [3, 3]}
    for row in service.data["tickets"]:
        row["name"] += " new"
    service.data["tickets"].append({"id": "t9", "name": "N9"})
    service.broken = {"i2"}
    assert run_round(catalog)[mapping].startswith("SyncError: 1 calls failed, among them: HTTPError")
    assert sorted(r["name"] for r in service.data["issues"]) == sorted(["N0 new", "N1", "N2 new", "N9"])
    service.broken = set()
    assert run_round(catalog) == {mapping: [4, 4]} and "N1 new" in [r["name"] for r in service.data["issues"]]


def test_point_reads_ask_for_the_ids_of_the_filter(spark, service):
    service.data, service.broken = {"things": [{"id": f"a/{i}"} for i in range(50)]}, {"bad"}
    got = rest.point_reads(spark, f"{service.url}/things/{{id}}", ["a/3", "a/7", "none", "bad"], concurrency=2)
    assert {r.id: (r.error or "")[:14] for r in got.collect()} == {"a/3": "", "a/7": "", "bad": "HTTPError: HTT"}
    assert len([c for c in service.calls if c[1].startswith("/things/")]) == 4
    reader = rest.ItemReader({"url": "u"})
    other = rest.EqualTo(("error",), "x")
    assert list(reader.pushFilters([rest.In(("id",), ("1", "2", None)), other, rest.EqualTo(("id",), "2")])) == [other]
    assert [p.value for p in reader.partitions()] == [["2"]]
    with pytest.raises(ValueError, match="filter on id"):
        rest.ItemReader({"url": "u"}).partitions()


def test_a_busy_service_is_waited_for(service):
    service.data, service.busy = {"things": [{"id": 1}]}, ["1", "0"]
    began = time.monotonic()
    assert http.call(f"{service.url}/things").body == [{"id": 1}] and time.monotonic() - began >= 1
    assert http.wait_of("3", 0) == 3 and http.wait_of("soon", 2) == 2 and http.wait_of(None, 9) == http.LONGEST_WAIT
    assert http.wait_of("Wed, 21 Oct 2015 07:28:00 GMT", 0) == 0


def test_answers_are_logged_and_a_repeated_task_sends_the_rest(spark, tmp_path, service, monkeypatch):
    service.data = {"things": []}
    rows = [(i, f'"{i}"', f"{service.url}/things", "post", json.dumps({"n": i}), f"k{i}") for i in range(10)]
    requests = spark.createDataFrame(rows, "ordinal long, source_id string, url string, method string, body string, key string")
    folder = str(tmp_path / "log")
    assert rest.write(requests, folder, chunk=3).where("error is null and not failed").count() == 10
    assert begun_of(spark, folder).count() == 10 and AnswerLog(folder).summary() == {"answered": 10, "failed": 0, "earlier": 0, "error": None}
    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})()))
    again = str(tmp_path / "again")
    batch = requests.toArrow().combine_chunks().to_batches()[0]
    first = rest.RequestWriter({"answers": again, "job": "j", "chunk": "4"})
    first.write(iter([batch.slice(0, 6)]))  # as an attempt that got that far
    told = rest.RequestWriter({"answers": again, "job": "j", "chunk": "4"}).write(iter([batch]))
    assert (told.answered, told.earlier, told.failed) == (10, 6, 0)
    assert len([c for c in service.calls if c[0] == "POST"]) == 20 and answers_of(spark, again).count() == 10


def test_a_snapshot_is_neither_skipped_nor_repeated(spark, tmp_path, service):
    """A batch that fails runs again with the rows it saw; numbers of snapshots go on after a stop."""
    service.data, service.style = {"many": [{"id": i} for i in range(6)]}, {"many": "page"}
    options = {"url": f"{service.url}/many", "paging": "page", "page_parameter": "page", "snapshots": str(tmp_path / "snapshots")}
    spark.dataSource.register(rest.RestCollection)
    seen = []

    def run(batches, fail=()):
        def each(batch, number):
            rows = sorted(json.loads(r.item_json)["id"] for r in batch.collect())
            seen.append((number, rows))
            if number in fail:
                raise ValueError("stopped")
            if number + 1 >= batches:
                done.append(number)

        done = []
        stream = spark.readStream.format("rest_collection").options(**options).load()
        query = stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="300 milliseconds").start()
        end = time.time() + 90
        while time.time() < end and not done and query.isActive:
            time.sleep(0.1)
        query.stop()

    run(2)
    before = len(seen)
    assert [n for n, _ in seen[:2]] == [0, 1] and all(rows == list(range(6)) for _, rows in seen)
    failing = seen[-1][0] + 1
    run(failing + 1, fail=(failing,))
    service.data["many"].append({"id": 99})  # between the failure and the restart
    run(failing + 2)
    repeated = [rows for n, rows in seen[before:] if n == failing]
    assert len(repeated) >= 2 and all(rows == list(range(6)) for rows in repeated)
    assert [99 in rows for n, rows in seen if n == failing + 1] and all(99 in rows for n, rows in seen if n == failing + 1)
    numbers = [n for n, _ in seen]
    assert sorted(set(numbers)) == list(range(max(numbers) + 1))
    assert len(os.listdir(tmp_path / "snapshots")) <= 3  # committed ones are gone


def test_rounds_as_a_stream_of_snapshots(spark, tmp_path, service):
    service.data, service.style = {"tickets": [{"id": "t1", "name": "A"}], "issues": []}, {"tickets": "page"}
    catalog, mapping = mapped(spark, tmp_path, service, ("page",), ())
    reports = []
    query = snapshot_stream(catalog, mapping, str(tmp_path / "stream"), seconds=1, on_round=lambda n, r: reports.append((n, r)))
    end = time.time() + 120
    while time.time() < end and len(reports) < 2 and query.isActive:
        time.sleep(0.2)
    query.stop()
    assert [n for n, _ in reports[:2]] == [0, 1] and reports[0][1] == reports[1][1] == [1, 1]
    assert [r["name"] for r in service.data["issues"]] == ["A"]


def test_fields_are_proposed_from_what_the_services_list(spark, tmp_path, service):
    service.data = {"tickets": [{"id": f"t{i}", "name": f"title {i}", "done": i % 2 == 0} for i in range(40)], "issues": [{"id": f"i{i}", "headline": f"title {i}", "closed": i % 2 == 0} for i in range(5, 40)]}
    service.style = {"tickets": "page"}
    catalog, _ = mapped(spark, tmp_path, service, ("page",), ())
    a, b = (catalog.apis().where(F.col("name") == n).first().id for n in ("tickets", "issues"))
    there, back = propose_fields(catalog, {a: "GET /tickets", b: "GET /issues"})
    assert there["name"] == "headline" and there["done"] == "closed" and back["headline"] == "name"
    with pytest.raises(KeyError, match="GET /none"):
        propose_fields(catalog, {a: "GET /tickets", b: "GET /none"})
    ops = lambda kind: {"getAll": f"GET /{kind}", "create": f"POST /{kind}", "update": f"PUT /{kind}/{{id}}"}
    mapping = add_mapping(catalog, "by values", {a: ops("tickets"), b: ops("issues")}, fields=[there, back])
    assert catalog.mappings().where(F.col("id") == mapping).first().parts[0].fieldMapping["name"] == "headline"


def test_ordinals_that_repeat_are_refused(spark, tmp_path, service):
    service.data = {"tickets": [{"id": "t1"}, {"id": "t2"}], "issues": []}
    catalog, mapping = mapped(spark, tmp_path, service, (), ())
    same = lambda spark, url, method="GET": rest.scan(spark, url, method).withColumn("ordinal", F.lit(0).cast("long"))
    assert "ordinal 0" in run_round(catalog, scan=same)[mapping] and service.data["issues"] == []
