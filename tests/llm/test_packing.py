import random
from collections import defaultdict

from pyspark.sql import functions as F
from rows import SCHEMA, document
from tokenizers import Tokenizer

from weftline.llm.packing import pack, packed
from weftline.llm.tokenizing import word_bpe_path


def brute(sizes, sources, clusters, capacity):
    bins, out = [], []
    for item, (size, s, c) in enumerate(zip(sizes, sources, clusters)):
        piece = 0
        while size > capacity:
            out.append((item, piece, len(bins), 0, capacity))
            bins.append([0, {None, *sources}, set()])
            size, piece = size - capacity, piece + 1
        fit = [(b[0], i) for i, b in enumerate(bins) if b[0] >= size and s not in b[1] and c not in b[2]]
        i = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append([capacity, set(), set()])
        out.append((item, piece, i, capacity - bins[i][0], size))
        bins[i] = [bins[i][0] - size, bins[i][1] | {s}, bins[i][2] | {c}]
    return out


def test_pack_matches_brute_force():
    rng = random.Random(2)
    sizes = sorted((rng.randrange(1, 140) for _ in range(400)), reverse=True)
    sources = [rng.choice(["hot"] * 3 + list("abcdefg")) for _ in sizes]
    clusters = [rng.choice([1, 1, 2, *range(3, 300)]) for _ in sizes]
    assert pack(sizes, sources, clusters, 100) == brute(sizes, sources, clusters, 100)


def check(docs, capacity):
    rows = packed(docs, capacity=capacity, shard_rows=8).collect()
    bins, pieces = defaultdict(list), defaultdict(int)
    for r in rows:
        bins[r.bin_id].append(r)
        pieces[r.doc_id] += r.n_tokens
    for content in bins.values():
        content.sort(key=lambda r: r.bin_start)
        assert sum(r.n_tokens for r in content) <= capacity
        assert all(a.bin_start + a.n_tokens == b.bin_start for a, b in zip(content, content[1:]))
        assert len({r.source for r in content}) == len({r.cluster for r in content}) == len(content)
    library, want = Tokenizer.from_file(word_bpe_path()), defaultdict(int)
    for r in docs.collect():
        want[r.doc_id] += len(library.encode(r.text or "", add_special_tokens=False).ids) + 1
    assert pieces == want


def test_whole_documents_without_conflicts(spark, tricky):
    check(tricky, 64)
    rng = random.Random(4)
    check(spark.createDataFrame([document(i, "w " * rng.randrange(60), rng.choice("aaabcd")) for i in range(60)], SCHEMA), 64)


def test_clusters_of_a_column_are_kept_apart(spark):
    rows = [document(i, f"text {i}", f"s{i}") for i in range(12)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("near.copy", F.when(F.col("doc_id") < 9, F.col("doc_id") % 3))
    out = packed(docs, cluster="near.copy").collect()
    bins = defaultdict(list)
    for r in out:
        bins[r.bin_id].append(r.doc_id)
    assert sorted(len({i % 3 for i in ids if i < 9}) for ids in bins.values()) == [3, 3, 3] and all(len([i for i in ids if i < 9]) == 3 for ids in bins.values())
    assert len(next(ids for ids in bins.values() if 11 in ids)) > 3  # rows without a cluster conflict with none


def test_empty_table(empty):
    assert packed(empty).collect() == []
