import os
import threading
from types import SimpleNamespace

import pyarrow as pa
import pytest

from weftline.llm import scratch
from weftline.llm.scratch import Scratch, released, shared_root


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: folder), sparkContext=SimpleNamespace(master=master))


def test_a_cluster_must_name_a_shared_folder():
    for master in ("local", "local[8]", "local[*]"):
        assert shared_root(session(master)) == "/tmp/checkpoints"
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            shared_root(session(master))
        assert shared_root(session(master, "hdfs://x/y/")) == "hdfs://x/y"


def test_folders_opened_within_are_closed(spark, tmp_path):
    outer = Scratch(spark, "outer", str(tmp_path))
    kept = outer.put(spark.range(3), "t")
    with released():
        inner = Scratch(spark, "inner", str(tmp_path))
        assert inner.put(spark.range(2), "t").count() == 2
    assert not os.path.exists(inner.root) and kept.count() == 3
    outer.close()
    assert not os.path.exists(outer.root)


def test_batches_are_small_while_a_table_is_written(spark, tmp_path):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    scratch = Scratch(spark, "batches", str(tmp_path))
    rows = scratch.put(spark.range(5000, numPartitions=1).mapInArrow(run, "n long"), "t").collect()
    assert sum(r.n for r in rows) == 5000 and max(r.n for r in rows) <= 1024
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_threads_leave_the_session_its_own_batch_size(spark):
    before = spark.conf.get(scratch.BATCH_CONF)
    barrier, seen = threading.Barrier(4), []

    def work(rows):
        with scratch.small_batches(spark, rows):
            barrier.wait()
            seen.append(int(spark.conf.get(scratch.BATCH_CONF)))
            barrier.wait()

    threads = [threading.Thread(target=work, args=(512,)) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert seen == [512] * 4 and spark.conf.get(scratch.BATCH_CONF) == before and not scratch._held
