import random
import re

import numpy as np
import xxhash
from rows import SCHEMA, document

from weftline.llm.components import connected_components
from weftline.llm.scratch import Scratch
from weftline.llm.simhash import fingerprint, keep_one, near, simhash_dedup


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint_matches_brute_force():
    for text in ("", "One", "A B c", "A B c d", "Été   x\x0by\x0cz Q " * 9, "word " * 300):
        assert fingerprint(text.encode()) == brute_fingerprint(text)


def test_bit_sliced_distances_match_brute_force():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(7))) & (1 << 64) - 1 for b in base * 5]
    i, j = near(np.array(fps[:77], np.uint64), np.array(fps, np.uint64))
    want = {(a, b) for a in range(77) for b in range(len(fps)) if (fps[a] ^ fps[b]).bit_count() <= 4}
    assert set(zip(i.tolist(), j.tolist())) == want


def check(docs, **options):
    rows = docs.collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    least = {}
    roots = brute_components(fps)
    for r, root in zip(rows, roots):
        if r.doc_id is not None:
            least[root] = min(least.get(root, r.doc_id), r.doc_id)
    want = sorted(((r.doc_id, f"{fp:016x}", least.get(root)) for r, fp, root in zip(rows, fps, roots)), key=repr)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash_dedup(docs, **options).collect()), key=repr)
    assert got == want
    return rows, roots


def test_tricky_rows_and_kept_rows(tricky):
    rows, roots = check(tricky)
    kept = keep_one(tricky)
    assert kept.columns == tricky.columns
    ids = [r.doc_id for r in kept.collect()]
    least = {}
    for r, root in zip(rows, roots):
        if r.doc_id is not None:
            least[root] = min(least.get(root, r.doc_id), r.doc_id)
    assert sorted(map(repr, ids)) == sorted(repr(least.get(root)) for root in set(roots))


def test_large_groups_are_tiled_without_losing_links(spark):
    base = [f"w{i}" for i in range(400)]
    docs = [document(i, " ".join(base[:k] + [f"edit{i}"] + base[k + 1 :])) for i, k in enumerate(range(0, 400, 4))]
    check(spark.createDataFrame(docs, SCHEMA), tile=8)


def test_empty_table(empty):
    assert simhash_dedup(empty).collect() == [] and keep_one(empty).collect() == []


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "u long, v long")
    got = dict(connected_components(edges, Scratch(spark, "test")).collect())
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_column_names_with_dots(tricky):
    dotted = tricky.withColumnRenamed("kept", "a.b").withColumnRenamed("row", "row.`x")
    kept = keep_one(dotted)
    assert kept.columns == dotted.columns and kept.count() == keep_one(tricky).count()
