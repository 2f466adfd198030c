import random
import re

import pytest
from rows import SCHEMA, document

from weftline.llm import license_scan
from weftline.llm.license_scan import LENGTHS, TEMPLATES, collision, scan


def shingles(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(text, template):
    """The best containment over windows of the template's length, and the first word of the first such place."""
    parts, own = set(shingles(template)), shingles(text)
    length = next(n for n in LENGTHS if len([x for x in re.split(r"[\W_]+", template) if x]) <= 3 * n // 4 + 1)
    best = (0.0, 0)
    for start in range(0, max(1, len(own)), length // 4):
        window = own[start : start + length - 4]
        share = len(parts & set(window)) / len(parts)
        if share:
            best = max(best, (share, -next(start + i for i, x in enumerate(window) if x in parts)))
    return best[0], -best[1]


def expected(rows, templates):
    found = {(d[0], name): brute(d[1], t) for d in rows for name, t in templates.items()}
    return {(*key, *value) for key, value in found.items() if value[0] >= 0.8}


def results(frame):
    return {(r.doc_id, r.license, r.containment, r.first_word) for r in frame.collect()}


def noise_of(seed):
    rng = random.Random(seed)
    return lambda n: " ".join(f"v{rng.randrange(900)}" for _ in range(n))


def test_notices_are_found_and_clean_texts_are_not(spark, monkeypatch):
    noise = noise_of(6)
    rows = []
    for i, (name, text) in enumerate(TEMPLATES.items()):
        for j, n in enumerate((0, 3, 17, 333)):
            rows.append(document(10 * i + j, f"{noise(n)} {text.upper() if j == 1 else text}\n{noise(n)}"))
        rows.append(document(10 * i + 5, noise(40) + " " + " ".join(text.split()[: len(text.split()) // 2]) + " " + noise(40)))
        rows.append(document(10 * i + 6, noise(120)))
    words = TEMPLATES["MIT-grant"].split()
    words[20] = "XX"
    rows.append(document(900, noise(50) + " " + " ".join(words)))
    docs = spark.createDataFrame(rows, SCHEMA)
    want = expected(rows, TEMPLATES)
    got = results(scan(docs))
    assert got == want and (900, "MIT-grant") in {x[:2] for x in got}
    assert len(got) >= 4 * len(TEMPLATES)
    monkeypatch.setattr(license_scan, "IN_LIST", 0)  # shingles joined instead of searched
    assert results(scan(docs)) == want


def test_whole_licenses_from_a_table(spark):
    noise = noise_of(9)
    law = {name: " ".join(f"{name}{k * 7919 % 99991}" for k in range(n)) for name, n in (("long", 1500), ("longest", 5600), ("other", 700))}
    edited = law["long"].split()
    for at in range(40, 1500, 60):
        edited[at] = "XX"
    half = " ".join(law["longest"].split()[:2800])
    rows = [document(1, noise(700) + " " + law["long"] + " " + noise(80)), document(2, " ".join(edited)), document(3, law["longest"] + "\n" + law["other"]), document(4, half + noise(2000)), document(5, noise(3000))]
    table = spark.createDataFrame([(*x, 1) for x in law.items()], "license string, text string, extra int")
    got = results(scan(spark.createDataFrame(rows, SCHEMA), table))
    assert got == expected(rows, law) and {x[:2] for x in got} == {(1, "long"), (2, "long"), (3, "longest"), (3, "other")}


def test_settings_guarantee_collisions(spark):
    for length in LENGTHS:
        for words in range(max(5, 3 * (length // 2) // 4 + 2), 3 * length // 4 + 2, max(1, length // 32)):
            assert length == 8 or words > 3 * length // 8 + 1
            assert collision(words - 4, length) > 0.9999 - 1e-4
    with pytest.raises(ValueError):
        scan(spark.createDataFrame([document(1, "x")], SCHEMA), {"same": "la " * 800})


def test_tricky_rows_and_empty_table(tricky, empty):
    assert scan(tricky).collect() == [] and scan(empty).collect() == []
    own = {"end": "long long long long long"}
    assert [(r.doc_id, r.containment, r.first_word) for r in scan(tricky, own).collect()] == [(7, 1.0, 0)]


def test_short_templates_are_refused(tricky):
    with pytest.raises(ValueError):
        scan(tricky, {"x": "All rights reserved."})


def test_short_notices_are_found_whole(spark):
    texts = ["All rights reserved.", "some words, ALL  RIGHTS\nreserved! and all rights reserved", "all rights are reserved", "All rights", "x Released under the MIT License. All rights reserved."]
    docs = spark.createDataFrame([document(i, t) for i, t in enumerate(texts)], SCHEMA)
    got = {(r.doc_id, r.license, r.containment, r.first_word) for r in scan(docs).collect()}
    name = "All-rights-reserved"
    assert got == {(0, name, 1.0, 0), (1, name, 1.0, 2), (4, name, 1.0, 6), (4, "MIT", 1.0, 1)}
    assert [(r.doc_id, r.license) for r in scan(docs, {"own": "no such words in any text"}, short={"x": "are reserved"}).collect()] == [(2, "x")]
    with pytest.raises(ValueError):
        scan(docs, short={"x": "..."})


def test_rows_without_an_id_are_one(spark):
    texts = [(None, "Released under the MIT License."), (None, "x y z released under the MIT license"), (3, None)]
    docs = spark.createDataFrame([document(i, t) for i, t in texts], SCHEMA)
    assert results(scan(docs)) == {(None, "MIT", 1.0, 0)}


def test_templates_beyond_the_broadcast_bound_are_joined(spark, monkeypatch):
    noise = noise_of(9)
    docs = spark.createDataFrame([document(1, f"{noise(50)} {TEMPLATES['MIT-grant']} {noise(20)}"), document(2, f"{TEMPLATES['MIT']} {noise(9)}"), document(3, noise(80))], SCHEMA)
    want = results(scan(docs))
    monkeypatch.setattr(license_scan, "MAX_BAND_ROWS", 0)
    assert results(scan(docs)) == want and {w[0] for w in want} == {1, 2}
