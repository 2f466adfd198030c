import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from rows import SCHEMA, document

from weftline.llm.subword import FACTOR, GRAMS, SCALE, SubwordSoftmax
from weftline.llm.toxicity import MAX_BYTES, toxicity, training_rows


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        bag = rng.choices(words, k=40)
        if bad := rng.random() < 0.3:
            for _ in range(3):
                bag[rng.randrange(40)] = rng.choice(["numbskull", "blockhead", "dimwit"])
        rows.append(document(i, " ".join(bag)))
        labels.append((i, 1, int(bad)))
    return words, rows, labels


def test_held_out_accuracy_and_misspellings():
    words, rows, labels = corpus()
    model = SubwordSoftmax(2).fit([r[1].encode() for r in rows[:320]], [t for *_, t in labels[:320]], epochs=30)
    right = [(model.posterior(r[1].encode())[1] >= 0.5) == t for r, (*_, t) in zip(rows[320:], labels[320:])]
    assert sum(right) >= 0.9 * len(right)
    plain = " ".join(words[:40])
    unseen = plain + " numbskulls blokhead dimwitt"
    assert model.posterior(unseen.encode())[1] > model.posterior(plain.encode())[1] + 0.2


def test_scores_every_row_and_learns_from_the_other_folds_only(spark, tricky):
    labels = [(r.doc_id, 1, i % 2) for i, r in enumerate(tricky.collect())] + [(4, 1, None)]
    schema = "doc_id long, quality int, toxic int"
    rows = toxicity(tricky, spark.createDataFrame(labels, schema)).collect()
    assert len(rows) == tricky.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0
    assert all(r.held_out == held(r.doc_id) for r in rows) and any(r.held_out for r in rows)
    turned = [(i, q, 1 - t if held(i) and t is not None else t) for i, q, t in labels]
    again = toxicity(tricky, spark.createDataFrame(turned, schema)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_no_labels_and_empty_table(spark, tricky, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity(tricky, none).collect()} == {0.5}
    assert toxicity(empty, none).collect() == []


def naive_buckets(word, buckets):
    """The n-grams of a word, ends marked, and the word itself, hashed one by one."""
    mask, text = (1 << 64) - 1, f"<{word.decode().lower()}>"
    factor = int(FACTOR)
    hashes = [sum(ord(c) * pow(factor, i + 1, 1 << 64) for i, c in enumerate(text)) & mask]
    for n in GRAMS:
        for at in range(len(text) - n + 1):
            h = n
            for c in text[at : at + n]:
                h = (h * factor + ord(c)) & mask
            hashes.append(h)
    return [(((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 & mask) >> 33) % buckets for h in hashes]


def naive_mean(model, text, table):
    words = text.lower().split()
    return SCALE * np.mean([np.mean([table[b] for b in naive_buckets(w, model.buckets)], axis=0) for w in words], axis=0)


def naive_p(model, text, table, weights, bias):
    x = naive_mean(model, text, table) @ weights + bias if text.split() else bias
    e = np.exp(x - x.max())
    return e / e.sum()


def test_scores_and_a_training_step_match_a_naive_form():
    texts = [b"Ab abc ab", b"one two  three", "\u00c9t\u00e9 x".encode(), b"zz"]
    labels = [0, 1, 1, 0]
    make = lambda: SubwordSoftmax(2, dim=4, buckets=64)
    model, start = make().fit(texts, labels, epochs=1, batch=4, rate=0.1), make()
    # one step of all four texts: gradients by central differences of the log loss, added texts by text
    table, weights, bias = (x.astype(np.float64) for x in (start.table, start.weights, start.bias))
    bias = np.log((np.bincount(labels, minlength=2) + 1) / 6)
    loss = lambda: -np.mean([np.log(naive_p(start, t, table, weights, bias)[y]) for t, y in zip(texts, labels)])
    for parameter, got in ((table, model.table), (weights, model.weights), (bias, model.bias)):
        g = np.zeros_like(parameter)
        for at in np.ndindex(parameter.shape):
            was = parameter[at]
            parameter[at] = was + 1e-5
            up = loss()
            parameter[at] = was - 1e-5
            g[at] = (up - loss()) / 2e-5
            parameter[at] = was
        g[abs(g) < 1e-9] = 0
        want = parameter - 0.1 * g / np.sqrt(g * g + 4 * np.mean(g[g != 0] ** 2))
        assert abs(want - got).max() < 2e-3
    for text in [*texts, b"", b"unseen wordz ab"]:
        assert abs(naive_p(model, text, model.table.astype(float), model.weights.astype(float), model.bias.astype(float)) - model.posterior(text)).max() < 1e-4


def test_long_texts_are_scored_but_not_learned_from(spark):
    docs = spark.createDataFrame([document(1, "short"), document(2, "long " * 9000)], SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    rows = training_rows(docs, labels, F.col("toxic"), 10)
    assert [bytes(r.text) for r in rows] == [b"short"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="driver tables are not here")
def test_recall_of_the_held_out_fold_by_length_of_text():
    rows = duckdb.sql("SELECT d.doc_id, coalesce(d.text, ''), l.toxic FROM '/root/testdata/sf0.1/documents.parquet' d JOIN '/root/testdata/sf0.1/labels.parquet' l USING (doc_id) ORDER BY hash(doc_id)").fetchall()
    rows = [(zlib.crc32(str(i).encode()) % 5 == 0, t.encode(), y) for i, t, y in rows]
    learned = [(t, y) for held, t, y in rows if not held and len(t) <= MAX_BYTES]
    model = SubwordSoftmax(2).fit([t for t, _ in learned], [y for _, y in learned])
    texts, toxic = [t for held, t, _ in rows if held], np.array([y == 1 for held, _, y in rows if held])
    found = model.scorer()(texts)[:, 1] >= 0.5
    size = np.array([len(t) for t in texts])
    recall = lambda within: found[within & toxic].mean()
    assert recall(size >= 0) >= 0.72 and toxic[found].mean() >= 0.75
    assert recall(size < 4096) >= 0.72 and recall((size >= 4096) & (size < 32768)) >= 0.55
