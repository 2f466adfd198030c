import zlib
from collections import Counter

import numpy as np
import pytest
from rows import SCHEMA, document

from weftline.llm.external_shuffle import BLOCK, ExternalShuffle, fisher_yates, preceding, sharded


def check(rows, docs, shards=16):
    """Every row once, slots without gaps, counts of shards at most one apart, digests of the texts."""
    text = lambda d: d.text or ""
    want = Counter((d.doc_id, len(text(d).encode()) + 1, zlib.crc32(text(d).encode())) for d in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots = {}
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(k, [])) for k in range(shards)]
    assert sum(counts) == len(docs) and max(counts) - min(counts) <= 1


@pytest.mark.parametrize("bucket_bytes", [1 << 25, 500])
def test_every_row_gets_one_slot(spark, tricky, tmp_path, bucket_bytes):
    tricky.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    first = sharded(docs, bucket_bytes=bucket_bytes).collect()
    check(first, docs.collect())
    assert sorted(sharded(docs, bucket_bytes=bucket_bytes).collect(), key=repr) == sorted(first, key=repr)
    other = sharded(docs, bucket_bytes=bucket_bytes, seed=1).collect()
    check(other, docs.collect())
    assert sorted(other, key=repr) != sorted(first, key=repr)


def test_empty_table_and_kept_columns(spark, empty, tricky):
    assert sharded(empty).collect() == []
    rows = ExternalShuffle(tricky, shards=3).shuffled().collect()
    assert sorted((tuple(r.row) for r in rows), key=repr) == sorted((tuple(r) for r in tricky.collect()), key=repr)


def test_repeated_rows_spread_over_buckets_and_shards(spark, tmp_path):
    docs = [document(7, "the same")] * 400 + [document(None, None)] * 400 + [document(i, f"text {i}") for i in range(400)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/docs")
    shuffle = ExternalShuffle(spark.read.parquet(f"{tmp_path}/docs"))
    counts = [r.n for r in shuffle.offsets.collect()]
    assert len(counts) == shuffle.n_buckets == 16 and max(counts) < 2 * 1200 / 16
    rows = shuffle.shuffled().collect()
    per_shard = Counter(r.shard for r in rows if r.row.doc_id == 7)
    assert len(per_shard) == 16 and max(per_shard.values()) < 60  # 25 on average


def test_prefix_sums_over_blocks(spark):
    n = 2 * BLOCK + 10
    counts = [(b, b % 7) for b in range(n) if b % 3]
    found = {r.bucket: r.begin for r in preceding(spark.createDataFrame(counts, "bucket long, n long")).collect()}
    before = 0
    for b, k in counts:
        assert found[b] == before
        before += k


def test_orders_are_uniform():
    seen = Counter(tuple(fisher_yates(3, np.random.default_rng([5, k]))) for k in range(6000))
    assert len(seen) == 6 and all(850 < n < 1150 for n in seen.values())
    assert fisher_yates(0, np.random.default_rng(1)).tolist() == [] and sorted(fisher_yates(100, np.random.default_rng(1))) == list(range(100))


def test_documents_move_uniformly(spark, tmp_path):
    """Neighbours in the input are no neighbours after it, and shards are as mixed as chance has it."""
    spark.createDataFrame([document(i, "x") for i in range(1600)], SCHEMA).write.parquet(f"{tmp_path}/docs")
    rows = sharded(spark.read.parquet(f"{tmp_path}/docs")).collect()
    shard = {r.doc_id: r.shard for r in rows}
    same = sum(shard[i] == shard[i + 1] for i in range(1599))
    assert 60 < same < 145  # 100 on average, deviation 9.7
    in_first = sum(shard[i] < 8 for i in range(800))
    assert 350 < in_first < 450


def test_an_input_that_changes_between_passes_is_refused(spark, tmp_path):
    spark.createDataFrame([document(i, "x") for i in range(50)], SCHEMA).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    shuffle = ExternalShuffle(docs)
    shuffle.docs = docs.where("doc_id <> 3")
    with pytest.raises(Exception, match="changed between passes|other than counted"):
        shuffle.shuffled().collect()
