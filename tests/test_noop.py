"""Updates that change nothing: found by digests, not sent if the caller wants that."""

import pytest
from pyspark.sql import functions as F
from service import Service, description

from weftline.functions.records import canonical, record
from weftline.plans.api import add_mapping, register_spec
from weftline.sources.catalog import Catalog
from weftline.streaming.rounds import run_round


@pytest.fixture
def service():
    made = Service()
    yield made
    made.server.shutdown()


class Same:
    def fields(self, *_):
        return {"name": "name"}


def mapped(spark, tmp_path, service):
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    a, b = register_spec(catalog, description("tickets"), service.url), register_spec(catalog, description("issues"), service.url)
    ops = lambda kind: {"getAll": f"GET /{kind}", "create": f"POST /{kind}", "update": f"PUT /{kind}/{{id}}"}
    return catalog, add_mapping(catalog, "m", {a: ops("tickets"), b: ops("issues")}, Same())


def puts(service):
    found = [c for c in service.calls if c[0] == "PUT"]
    service.calls.clear()
    return found


def test_an_unchanged_round_sends_no_update(spark, tmp_path, service):
    service.data = {"tickets": [{"id": f"t{i}", "name": f"N{i}", "n": i} for i in range(4)], "issues": []}
    catalog, mapping = mapped(spark, tmp_path, service)
    assert run_round(catalog, skip_unchanged=True) == {mapping: [4, 0]} and len(puts(service)) == 0
    assert run_round(catalog, skip_unchanged=True) == {mapping: [0, 0]} and puts(service) == []
    service.data["tickets"][2]["name"] = "new"
    assert run_round(catalog, skip_unchanged=True) == {mapping: [1, 0]} and len(puts(service)) == 1
    service.data["issues"][1]["name"] = "edited"  # the first side wins
    assert run_round(catalog, skip_unchanged=True) == {mapping: [1, 0]}
    assert run_round(catalog) == {mapping: [4, 4]}  # off by default
    last = sorted((r.n_updated, r.n_unchanged) for r in catalog.read("passes").collect())
    assert last == [(0, 0), (0, 4), (0, 4), (0, 4), (0, 4), (0, 4), (1, 3), (1, 3), (4, 0), (4, 0)]


def test_a_service_that_changes_what_it_stores_comes_to_rest(spark, tmp_path, service):
    """Names are cut when they are stored: payload and base differ for ever, and yet nothing changes any more."""
    service.data = {"tickets": [{"id": "t1", "name": "a long name"}], "issues": []}
    whole = service.put

    def cut(handler, body):
        whole(handler, body | ({"name": body["name"][:4]} if "/issues" in handler.path else {}))

    service.put = cut
    catalog, mapping = mapped(spark, tmp_path, service)
    one_way = lambda: [report[0] for report in run_round(catalog, skip_unchanged=True).values()]
    sent = []
    for _ in range(4):
        service.data["tickets"][0]["name"] = "a long name"  # as its owner wants it
        sent += one_way()
    assert sent[0] == 1 and sent[-1] == 0 and service.data["issues"][0]["name"] == "a lo"
    service.data["issues"][0]["name"] = "else"
    service.data["tickets"][0]["name"] = "a long name"
    assert one_way() == [1] and service.data["issues"][0]["name"] == "a lo"


def test_canonical_texts(spark):
    text = lambda j: spark.range(1).select(canonical(record(F.lit(j)))).first()[0]
    assert text('{"a": 1, "b": {"y": 2, "x": 1}}') == text('{"b": {"x": 1, "y": 2}, "a": 1.0}')
    assert len({text(j) for j in ('{"a": 1}', '{"a": "1"}', '{"a": null}', "{}", '{"a": "null"}', '{"b": 1}')}) == 6
