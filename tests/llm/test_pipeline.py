import corpus_pipeline as pipeline
from rows import SCHEMA, document


def prose(seed, words=90):
    return " ".join(f"w{(seed * 7919 + i * 104729) % 99991}" for i in range(words))


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    rows = [document(i, prose(i), f"s{i % 4}") for i in range(60)]
    rows += [document(100 + i, prose(i).replace(" ", "  "), "s9") for i in range(10)]  # exact copies
    near = prose(3, 2000)
    rows += [document(200, near), document(201, near + " tail")]
    rows += [document(300, "too short"), document(301, None), document(302, "la la la " * 60)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 60, 2)] + [(i, 0, 0) for i in range(1, 60, 8)] + [(3, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in pipeline.STAGES] == ["quality_rules", "exact_copies", "near_copies", "mixing", "packing"]
    seen = []
    for name, stage in pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        seen.append({r.doc_id for r in docs.collect()})
    assert seen[0] == {*range(60), *range(100, 110), 200, 201}
    assert seen[1] == {*range(60), 200, 201}
    assert seen[2] == {*range(60), 200}

    out = pipeline.run(spark, str(tmp_path)).collect()
    assert out and {r.doc_id for r in out} <= seen[2]


LABELS = "doc_id long, quality int, toxic int, kept int"


def written(spark, tmp_path, rows, labels):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_empty_table(spark, tmp_path):
    out = pipeline.run(spark, written(spark, tmp_path, [], []))
    assert out.collect() == [] and "doc_id" in out.columns


def test_without_labels_null_and_repeated_identifiers_and_clashing_names(spark, tmp_path):
    """No label: every domain is equally likely, and all rates that fit keep what is there; rows of one id are rows like others."""
    rows = [document(i, prose(i), f"s{i}", None) for i in range(12)]
    rows += [document(None, prose(50), None), document(None, prose(51)), document(5, prose(52)), document(5, prose(5))]  # the last is a copy
    sf_dir = written(spark, tmp_path, rows, [])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")], name
    kept = docs.collect()
    assert len(kept) == 15 and sum(r.doc_id is None for r in kept) == 2 and sum(r.doc_id == 5 for r in kept) == 2
    out = pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in out} <= {r.doc_id for r in kept}
