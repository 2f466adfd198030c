import random

import numpy as np
import pytest
from rows import SCHEMA, document
from tokenizers import Tokenizer

from weftline.llm import mixing
from weftline.llm.mixing import DOMAINS, GRID, Mixture, gridded, labelled_domains
from weftline.llm.tokenizing import word_bpe_path


def themed(spark, n=240):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        k = 0 if i % 10 < 6 else 1 if i % 10 < 9 else 2
        rows.append(document(i, " ".join(f"{'abc'[k]}{rng.randrange(40)}theme{k}" for _ in range(rng.randrange(5, 80)))))
        labels.append((i, k))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, domain int")


def brute(p, n, wanted, rounds=20000):
    """Plain projected gradient on the same least squares, in steps of one over the greatest curvature."""
    w, r = n / n.sum(), np.ones(len(n))
    step = 1 / np.linalg.eigvalsh((p * w[:, None]).T @ p)[-1]
    for _ in range(rounds):
        r = np.maximum(0, r - step * (p @ (p.T @ (w * r) - wanted)))
    return np.linalg.norm(p.T @ (w * r) - wanted)


def test_totals_meet_the_targets(spark):
    docs, labelled = themed(spark)
    mixture = Mixture(docs, labelled, [0.2, 0.3, 0.5], rows=True)
    rows = mixture.rates().toPandas()
    p, n = rows[["p0", "p1", "p2"]].to_numpy(), rows.n_tokens.to_numpy(float)
    loss = np.linalg.norm(p.T @ (n / n.sum() * rows.rate) - np.array([0.2, 0.3, 0.5]))
    assert loss <= brute(p, n, np.array([0.2, 0.3, 0.5])) + 1e-3 and (rows.rate >= 0).all()
    assert p.argmax(axis=1).tolist() == [0 if i % 10 < 6 else 1 if i % 10 < 9 else 2 for i in rows.doc_id]
    assert abs(rows.copies.sum() - rows.rate.sum()) < 6 * len(rows) ** 0.5
    mixed = mixture.mixed()
    assert mixed.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {r.doc_id: r.copies for r in rows.itertuples() if r.copies}


def test_tricky_rows_and_empty_table(spark, tricky, empty):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (9, None, 1), (10, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = Mixture(tricky, labelled_domains(labels), list(DOMAINS.values())).rates().collect()
    assert len(rows) == tricky.count() and all(r.rate >= 0 for r in rows)
    none = Mixture(empty, labelled_domains(labels), list(DOMAINS.values()), rows=True)
    assert none.rates().collect() == [] and none.mixed().collect() == []


def test_tokens_are_those_of_the_tokenizer(spark):
    texts = ["plain words here", "no" * 400, "水清い川" * 50, "café, déjà-vu!"]
    docs = spark.createDataFrame([document(i, t) for i, t in enumerate(texts)], SCHEMA)
    labelled = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, domain int")
    got = {r.doc_id: r.n_tokens for r in Mixture(docs, labelled, [0.5, 0.5]).rates().collect()}
    library = Tokenizer.from_file(word_bpe_path())
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert got[2] > 50


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_driver_tables_meet_their_targets(spark, sf):
    """At sf0.01 hardly any document lacks toxic words, so that plain steps need tens of thousands of rounds."""
    read = lambda name: spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")
    mixture = Mixture(read("documents"), labelled_domains(read("labels")), list(DOMAINS.values()))
    rows = mixture.rates().toPandas()
    p, n, wanted = rows[["p0", "p1", "p2"]].to_numpy(), rows.n_tokens.to_numpy(float), np.array(list(DOMAINS.values()))
    left = np.linalg.norm(p.T @ (n / n.sum() * rows.rate) - wanted)
    assert mixture.converged and abs(left - mixture.residual) < 1e-6
    assert left <= brute(p, n, wanted) + 1e-3 and (rows.rate >= 0).all()


def test_out_of_reach_targets_settle_and_steps_that_do_not_are_told(spark, monkeypatch):
    docs, labelled = themed(spark)
    only = Mixture(docs.where("doc_id % 10 < 9"), labelled, [0.0, 0.0, 1.0])  # no document of the wanted domain
    assert only.converged and only.residual > 0.1
    rows = only.rates().toPandas()
    assert only.residual <= brute(rows[["p0", "p1", "p2"]].to_numpy(), rows.n_tokens.to_numpy(float), np.array([0, 0, 1.0])) + 1e-3
    monkeypatch.setattr(mixing, "STEPS", 1)
    with pytest.raises(ArithmeticError):
        Mixture(docs, labelled, [0.2, 0.3, 0.5])
    assert not Mixture(docs, labelled, [0.2, 0.3, 0.5], allow_unconverged=True).converged


def test_posteriors_on_the_grid_add_up_to_one():
    p = np.random.default_rng(3).dirichlet([0.2] * 5, 1000)
    on = gridded(p)
    assert (on >= 0).all() and (on.sum(axis=1) == 1).all() and abs(on - p).max() <= 2.5 / GRID and (on * GRID % 1 == 0).all()


def test_column_names_with_dots(spark):
    docs, labelled = themed(spark, 40)
    dotted = docs.withColumnRenamed("kept", "a.b").withColumnRenamed("row", "row.`x")
    assert Mixture(dotted, labelled, [0.2, 0.3, 0.5], rows=True).mixed().columns == dotted.columns
