"""The id map's bucketed base and the log since it."""

import os
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions.records import record
from weftline.operators.sync import directed, keyed_items, linked_items, lookup_keys, plan_pass
from weftline.sources import id_map as id_maps
from weftline.sources.catalog import Catalog
from weftline.sources.id_map import IdMap
from weftline.streaming.rounds import id_pairs

PAIRS = "mapping_id string, a_id string, b_id string, seq long"


def items(spark, keys):
    rows = [(i, "{}" if k is None else f'{{"id": {k}, "name": "n{k}"}}') for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "ordinal long, j string").select("ordinal", record(F.col("j")).alias("item"))


def append(catalog, rows, seq):
    catalog.append("id_map", catalog.spark.createDataFrame([("m", a, b, seq + k) for k, (a, b) in enumerate(rows)] + [("other", "1", "x", seq)], PAIRS))


@pytest.mark.parametrize("reverse", [False, True])
def test_layers_link_as_the_log_does(spark, tmp_path, reverse):
    draw = random.Random(4)
    catalog = Catalog(spark, str(tmp_path))
    ids = IdMap(catalog, "m")
    assert ids.layers(reverse) is None
    source = items(spark, [*range(30), None, None, 3])
    for step in range(4):
        # a_ids move to other b_ids, b_ids are shared, some links are none
        append(catalog, [(str(draw.randrange(30)), draw.choice([str(draw.randrange(30)), str(draw.randrange(30)), "0", None])) for _ in range(15)], 100 * step)
        if step == 1:
            ids.compact()
        if step < 1:
            continue
        layers = ids.layers(reverse)
        log = directed(id_pairs(catalog, "m"), reverse)
        links = lambda how: sorted((r.ordinal, r.target_id or "") for r in linked_items(keyed_items(source), how).select("ordinal", "target_id").collect())  # noqa: B023, E731
        assert links(layers) == links(log)
        keys = lambda how: {r.target_id for r in lookup_keys(source, how).collect()}  # noqa: B023, E731
        assert keys(layers) == keys(log)


def exchanges_over(plan: str, leaf: str) -> int:
    """Exchanges on the way from the plan's top to the scan of ``leaf``."""
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if leaf in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    found, level = 0, depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            level = depth(line)
            if "Join" in line:
                return found
            found += "Exchange" in line
    return found


def test_a_pass_does_not_move_the_base(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    append(catalog, [(str(k), str(k + 1000)) for k in range(500)], 0)
    ids = IdMap(catalog, "m")
    ids.compact()
    source, target = items(spark, range(600)), items(spark, range(1000, 1400))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_pass(source, target, ids.layers(False), F.create_map(F.lit("name"), F.lit("name")))
        text = plan._jdf.queryExecution().executedPlan().toString()
        rows = plan.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert text.count("Bucketed: true") == 1 and exchanges_over(text, "Bucketed: true") == 0
    assert sum(r.action == "update" for r in rows) == 500 and sum(r.has_base for r in rows) == 400


def test_rounds_make_bases_and_drop_old_ones(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(id_maps, "BASE_AFTER", 2)
    catalog = Catalog(spark, str(tmp_path))
    ids = IdMap(catalog, "m")
    for step in range(7):
        append(catalog, [(str(step), str(10 + step))], step)
        ids.refresh()
    assert len(os.listdir(ids.root)) == 1 and ids._base() == "0000000005"
    assert {(r.a_id, r.b_id) for r in ids.pairs().collect()} == {(str(k), str(10 + k)) for k in range(7)}
    linked = linked_items(keyed_items(items(spark, range(8))), ids.layers(False)).where("target_id is not null")
    assert linked.count() == 7
    ids.compact()
    ids.compact()  # nothing new: nothing is written
    assert os.listdir(ids.root) == ["0000000006"] and ids.layers(True).delta.count() == 0
