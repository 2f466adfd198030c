import re
from collections import Counter

from corpus_pipeline import quality_rules
from rows import SCHEMA, document

from weftline.llm.line_frequency import clean, line_frequency
from weftline.llm.queries import op1_line_frequency


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(tri)
    covered = {i + k for i, g in enumerate(tri) if count[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts_match_brute_force(tricky):
    rows = line_frequency(tricky).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows), key=repr)
    assert got == sorted(((r.doc_id, *brute(r.text)) for r in tricky.collect()), key=repr)
    assert all(not r.kept for r in rows if r.base_failed)


def prose(seed, words=60):
    return " ".join(f"w{(seed * 7919 + i * 104729) % 99991}" for i in range(words))


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    menu, footer = "Home | About | Contact", " ".join(f"foot{i}" for i in range(35))
    rows = [document(i, f"{menu}\n{prose(i)}", "a") for i in range(30)]
    rows += [document(100 + i, f"{prose(500 + i, 30)}\n{footer}", "b") for i in range(30)]
    rows += [document(200 + i, prose(7777), "c") for i in range(40)]  # copies count as one document
    rows += [document(300 + i, prose(900 + i), "c") for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {r.doc_id: r.kept for r in line_frequency(docs).collect()}
    assert all(kept[i] for i in range(30)) and not any(kept[100 + i] for i in range(30))
    assert all(kept[i] for i in [*range(200, 240), *range(300, 320)])
    out = {r.doc_id: r for r in clean(docs).collect()}
    assert set(out) == {i for i, k in kept.items() if k}
    assert out[3].text == prose(3) and out[3].n_chars == len(prose(3)) and out[200].text == prose(7777)


def test_empty_table(empty):
    assert line_frequency(empty).collect() == []
    assert clean(empty).collect() == [] and clean(empty).columns == empty.columns


def test_long_lines_and_large_hosts_keep_no_boilerplate(spark):
    legal = " ".join(f"legal{i}" for i in range(60))
    rows = [document(i, f"{prose(i, 90)}\n{legal}", "a") for i in range(30)]
    rows += [document(1000 + i, prose(1000 + i) + ("\nshare this page" if i < 40 else ""), "b") for i in range(600)]  # 40 of 600: under a tenth, over the root
    docs = spark.createDataFrame(rows, SCHEMA)
    for limits in ({}, {"host_keys": 1}, {"broadcast_keys": 1}):
        out = {r.doc_id: r.text for r in clean(docs, **limits).collect()}
        assert out == {i: prose(i, 90) for i in range(30)} | {1000 + i: prose(1000 + i) for i in range(600)}


def test_pipeline_cleans_long_lines(spark):
    legal = " ".join(f"legal{i}" for i in range(60))
    docs = spark.createDataFrame([document(i, f"{prose(i, 90)}\n{legal}", "a") for i in range(30)], SCHEMA)
    assert {r.text for r in quality_rules(spark, docs, "").collect()} == {prose(i, 90) for i in range(30)}


def test_column_names_with_dots(spark):
    docs = spark.createDataFrame([document(i, prose(i)) for i in range(3)], SCHEMA).withColumnRenamed("kept", "a.b").withColumnRenamed("row", "row.`x")
    out = clean(docs)
    assert out.columns == docs.columns and out.count() == 3


def test_long_boilerplate_is_removed_by_the_query(spark, tmp_path):
    """A footer of 60 words on 30 pages of a host makes two thirds of their words."""
    footer = " ".join(f"foot{i}" for i in range(60))
    spark.createDataFrame([document(i, f"{prose(i, 30)}\n{footer}", "a") for i in range(30)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    rows = op1_line_frequency(spark, str(tmp_path)).collect()
    assert {(r.removed_words, r.kept, r.base_failed) for r in rows} == {(60, False, False)}
