"""Endpoints by structure, fields by values, and the assignment under both."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions.records import record
from weftline.plans.assignment import assign
from weftline.plans.structure import StructureMatcher, alike, matched
from weftline.plans.values import compared, dictionary_of, profiled


@pytest.mark.parametrize("shape", [(1, 1), (3, 3), (2, 5), (5, 2), (6, 6)])
def test_assignments_are_optimal(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(30):
        scores = np.round(rng.random(shape), 2) * (rng.random(shape) < 0.8)
        found = assign(scores)
        assert len({r for r, _ in found}) == len(found) == len({c for _, c in found})
        small, large = min(shape), max(shape)
        wide = scores if shape[0] <= shape[1] else scores.T
        best = max(sum(wide[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        assert abs(sum(scores[r, c] for r, c in found) - best) < 1e-9
    assert assign(np.zeros((2, 3))) == []


FIRST = ["GET /projects/{id}/tickets", "POST /projects/{id}/tickets", "GET /projects/{id}/tickets/{t}", "PUT /projects/{id}/tickets/{t}", "GET /projects/{id}/labels", "DELETE /projects/{id}/labels/{l}", "GET /users", "GET /users/{u}/keys"]
SECOND = ["GET /repos/{o}/{r}/tickets", "POST /repos/{o}/{r}/tickets", "GET /repos/{o}/{r}/tickets/{n}", "PATCH /repos/{o}/{r}/tickets/{n}", "GET /repos/{o}/{r}/label", "DELETE /repos/{o}/{r}/label/{name}", "GET /user/{name}/keys", "GET /status"]


def side(spark, identifiers):
    return spark.createDataFrame([(i,) for i in identifiers], "identifier string")


def test_endpoints_are_paired_by_structure(spark):
    got = {(r.a, r.b) for r in matched(side(spark, FIRST), side(spark, SECOND)).collect()}
    assert got >= set(zip(FIRST[:6], SECOND[:6], strict=True)) | {(FIRST[7], SECOND[6])}
    assert len({a for a, _ in got}) == len(got) == len({b for _, b in got}) and not any(b == "GET /status" for _, b in got)


def test_likeness_finds_every_pair_that_is_alike_enough(spark):
    """Pairs that share only light words are left out before they meet; none of LEAST or more is lost."""
    loose = {(r.a, r.b): round(r.likeness, 9) for r in alike(side(spark, FIRST), side(spark, SECOND), least=0.001).collect()}
    for least in (0.1, 0.2, 0.5):
        got = {(r.a, r.b): round(r.likeness, 9) for r in alike(side(spark, FIRST), side(spark, SECOND), least=least).collect()}
        # likeness counts verbs that only stand for each other less, which the limit does not
        assert got.items() <= loose.items() and all(k in got for k, v in loose.items() if v >= least)


def test_proposals_by_structure(spark):
    label = lambda ids: [f"{i} - undefined" for i in ids]
    found = StructureMatcher(spark).endpoints(label(FIRST), label(SECOND))
    assert found["projects/{id}/tickets"] == {
        "api1": {"getAll": FIRST[0], "getOne": FIRST[2], "create": FIRST[1], "update": FIRST[3], "delete": ""},
        "api2": {"getAll": SECOND[0], "getOne": SECOND[2], "create": SECOND[1], "update": SECOND[3], "delete": ""},
    }
    assert StructureMatcher(spark).endpoints([], label(SECOND)) == {}


def items(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "j string").select(record(F.col("j")).alias("item"))


def test_fields_are_told_by_their_values(spark):
    rows = [f'{{"key": {i}, "headline": "title {i * 37 % 101}", "state": "{["open", "done"][i % 2]}", "flag": {str(i % 3 == 0).lower()}, "n": {i * i}, "gone": null}}' for i in range(200)]
    copy = [f'{{"x": "title {i * 37 % 101}", "y": {i}, "z": {str(i % 3 == 0).lower()}, "v": "{["open", "done"][i % 2]}", "w": {i * i}.0}}' for i in range(30, 200)]
    assert dictionary_of(items(spark, rows), items(spark, copy)) == {"headline": "x", "key": "y", "flag": "z", "state": "v", "n": "w"}
    profile = {r.field: r for r in profiled(items(spark, rows)).collect()}
    assert set(profile) == {"key", "headline", "state", "flag", "n"} and profile["flag"].boolean == 1 and profile["state"].n_distinct == 2 and profile["n"].number == 1
    overlap = {(r.a, r.b): r.overlap for r in compared(profiled(items(spark, rows)), profiled(items(spark, copy))).collect()}
    assert abs(overlap["key", "y"] - 170 / 200) < 0.2 and overlap["key", "x"] == 0


def test_collections_without_items_have_no_dictionary(spark):
    assert dictionary_of(items(spark, []), items(spark, ['{"a": 1}'])) == {}
