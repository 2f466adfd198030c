"""A driver that dies between a request and its commit: the next round finishes what it left."""

import json
import os
import urllib.request

import pytest
from service import Service, description

from weftline.plans.api import add_mapping, register_spec
from weftline.sources.answer_log import AnswerLog
from weftline.sources.catalog import Catalog
from weftline.streaming import runs
from weftline.streaming.rounds import id_pairs, run_round
from weftline.streaming.runs import Run, in_doubt, settle, vacuum


class Killed(BaseException):
    pass


@pytest.fixture
def service():
    made = Service()
    yield made
    made.server.shutdown()


def synced(spark, tmp_path, service, keys, n=5):
    """Tickets to be created as issues."""
    service.data = {"tickets": [{"id": f"t{i}", "name": f"N{i}"} for i in range(1, n + 1)], "issues": []}
    service.honours = keys
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    a, b = (register_spec(catalog, description(k, keys=keys), service.url) for k in ("tickets", "issues"))
    ops = lambda kind: {"getAll": f"GET /{kind}", "create": f"POST /{kind}", "update": f"PUT /{kind}/{{id}}"}

    class Same:
        def fields(self, *_):
            return {"name": "name"}

    return catalog, add_mapping(catalog, "m", {a: ops("tickets"), b: ops("issues")}, Same())


def killed_at(monkeypatch, point, service=None):
    """Lets the next pass die: before anything is sent, when some is, or when all is but no id is committed."""
    if point == "planned":
        monkeypatch.setattr(Run, "_send", lambda self, requests, step: die())
    elif point == "answered":
        monkeypatch.setattr(Run, "commit", lambda self, step, created=1: die())
    else:
        whole = runs.rest.write

        def some(requests, log):
            whole(requests.where("source_id in ('\"t1\"', '\"t2\"')"), log)
            # one more was sent by a task that died before it could note the answer
            lost = requests.where("source_id = '\"t3\"'").first()
            AnswerLog(log, "lost").begin([lost.ordinal])
            ask = urllib.request.Request(lost.url, lost.body.encode(), {"content-type": "application/json", "idempotency-key": lost.key}, method="POST")
            urllib.request.urlopen(ask).read()
            die()

        monkeypatch.setattr(runs.rest, "write", some)


def die():
    raise Killed


@pytest.mark.parametrize("point", ["planned", "some sent", "answered"])
def test_a_service_that_honours_keys_gets_no_duplicate(spark, tmp_path, service, monkeypatch, point):
    catalog, mapping = synced(spark, tmp_path, service, keys=True)
    with monkeypatch.context() as patched:
        killed_at(patched, point)
        with pytest.raises(Killed):
            run_round(catalog)
    assert len(os.listdir(f"{catalog.root}/work")) == 1 and id_pairs(catalog, mapping).count() == 0
    report = run_round(catalog)
    (recovered,) = report["recovered"].values()
    assert recovered["mapping"] == mapping and recovered["failed"] == 0 and recovered["in_doubt"] == 0
    assert recovered["applied"] == {"planned": 5, "some sent": 3, "answered": 0}[point]
    assert report[mapping] == [5, 5] and os.listdir(f"{catalog.root}/work") == []
    assert sorted(r["name"] for r in service.data["issues"]) == [f"N{i}" for i in range(1, 6)] and len(service.data["tickets"]) == 5
    assert id_pairs(catalog, mapping).count() == 5 and in_doubt(catalog).count() == 0
    assert "recovered" not in run_round(catalog)


def test_what_a_service_without_keys_did_is_not_guessed(spark, tmp_path, service, monkeypatch):
    catalog, mapping = synced(spark, tmp_path, service, keys=False)
    with monkeypatch.context() as patched:
        killed_at(patched, "some sent")
        with pytest.raises(Killed):
            run_round(catalog)
    report = run_round(catalog)
    (recovered,) = report["recovered"].values()
    assert (recovered["applied"], recovered["in_doubt"]) == (2, 1)  # two were never begun
    assert sorted(r["name"] for r in service.data["issues"]) == [f"N{i}" for i in range(1, 6)]  # none twice
    (doubt,) = in_doubt(catalog, mapping).collect()
    assert doubt.source_id == '"t3"' and json.loads(doubt.body) == {"name": "N3"} and doubt.url.endswith("/issues")
    assert report[mapping][0] == 4  # t3 waits; on the way back its copy is unknown and becomes a sixth ticket
    made = next(r["id"] for r in service.data["issues"] if r["name"] == "N3")
    settle(catalog, mapping, doubt.key, json.dumps(made))
    assert in_doubt(catalog, mapping).count() == 0
    assert run_round(catalog)[mapping][0] == len(service.data["tickets"])
    assert sorted({r["name"] for r in service.data["issues"]}) == [f"N{i}" for i in range(1, 6)]
    with pytest.raises(KeyError):
        settle(catalog, mapping, doubt.key, None)


def test_a_create_that_was_not_done_may_be_done_after_all(spark, tmp_path, service, monkeypatch):
    catalog, mapping = synced(spark, tmp_path, service, keys=False, n=3)
    with monkeypatch.context() as patched:
        killed_at(patched, "some sent")
        with pytest.raises(Killed):
            run_round(catalog)
    service.data["issues"] = [r for r in service.data["issues"] if r["name"] != "N3"]  # the call never arrived
    assert run_round(catalog)[mapping][0] == 2
    settle(catalog, mapping, in_doubt(catalog).first().key, None)
    assert run_round(catalog)[mapping] == [3, 3] and sorted(r["name"] for r in service.data["issues"]) == ["N1", "N2", "N3"]


def test_recovery_that_dies_is_taken_up_again(spark, tmp_path, service, monkeypatch):
    catalog, mapping = synced(spark, tmp_path, service, keys=True)
    for point in ("some sent", "planned", "answered"):
        with monkeypatch.context() as patched:
            killed_at(patched, point)
            with pytest.raises(Killed):
                run_round(catalog)
    assert run_round(catalog)[mapping] == [5, 5]
    assert len(service.data["issues"]) == 5 and id_pairs(catalog, mapping).count() == 5


def test_ids_are_committed_once(spark, tmp_path, service):
    catalog = Catalog(spark, str(tmp_path))
    rows = lambda x: spark.createDataFrame([("m", x, "b", 1)], "mapping_id string, a_id string, b_id string, seq long")
    catalog.append("id_map", rows("a"), tag="run-first")
    catalog.append("id_map", rows("other"), tag="run-first")
    assert [r.a_id for r in catalog.read("id_map").collect()] == ["a"] and catalog.has("id_map", "run-first")


def test_passes_are_counted_and_failed_runs_are_vacuumed(spark, tmp_path, service):
    catalog, mapping = synced(spark, tmp_path, service, keys=True)
    service.broken = {"N3"}
    assert run_round(catalog)[mapping].startswith("SyncError: 1 calls failed")
    service.broken = set()
    assert run_round(catalog) == {mapping: [5, 5]}
    passes = sorted((r.reverse, r.n_read, r.n_created, r.n_updated, r.n_failed) for r in catalog.read("passes").collect())
    assert passes == [(False, 5, 1, 4, 0), (False, 5, 5, 0, 1), (True, 5, 0, 5, 0)]
    assert len(os.listdir(f"{catalog.root}/work")) == 1 and vacuum(catalog) == 1 and os.listdir(f"{catalog.root}/work") == []
