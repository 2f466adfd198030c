import random

from rows import SCHEMA, document

from weftline.llm.near_copies import NearCopies, compare, keep_one, shingle_set


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_similar_documents_are_caught_and_others_stay(spark):
    rng = random.Random(11)
    rows, copies, others = [], set(), set()
    for i in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        for k, changed in ((1, 4), (2, 5), (3, 20)):  # Jaccard of about 0.88, 0.85 and 0.5
            other = list(words)
            for at in range(10, 10 + 12 * changed, 12):
                other[at] = f"x{k}"
            a, b = shingles(" ".join(words)), shingles(" ".join(other))
            (copies if 5 * len(a & b) >= 4 * len(a | b) else others).add(10 * i + k)
            rows.append(document(10 * i + k, " ".join(other)))
        rows.append(document(10 * i, " ".join(words)))
    assert len(copies) == 80 and len(others) == 40
    docs = spark.createDataFrame(rows, SCHEMA)
    want = {10 * i for i in range(40)} | others
    for options in ({}, {"tile": 1}):
        kept = keep_one(docs, **options)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_tricky_rows_and_empty_table(tricky, empty):
    kept = {r.doc_id for r in keep_one(tricky).collect()}
    assert {1, 7, 9, 11} - {1} <= kept and 2 not in kept
    assert keep_one(empty).collect() == []


def test_column_names_with_dots(tricky):
    dotted = tricky.withColumnRenamed("kept", "a.b").withColumnRenamed("row", "row.`x")
    assert keep_one(dotted).columns == dotted.columns


def test_groups_match_brute_force():
    """Links of a group of short and long texts at all similarities, both within a group and across two sides."""
    rng = random.Random(12)
    texts = []
    for _ in range(25):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 9, 30, 200]))]
        for _ in range(6):
            other = list(words)
            for _ in range(rng.randrange(4)):
                other[rng.randrange(len(other))] = f"x{rng.randrange(9)}"
            texts.append(" ".join(other))
    texts = sorted(set(texts))
    sets, sides = [shingles(t) for t in texts], [rng.randrange(2) for _ in texts]
    for crossed in (False, True):
        root = list(range(len(texts)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        linked = 0
        for i in range(len(texts)):
            for j in range(i):
                if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and (not crossed or sides[i] != sides[j]):
                    a, b = find(i), find(j)
                    root[max(a, b)], linked = min(a, b), linked + 1
        got = dict(compare(list(range(len(texts))), [shingle_set(t.encode()) for t in texts], sides, crossed))
        assert linked > 10 and [got.get(i, i) for i in range(len(texts))] == [find(i) for i in range(len(texts))]


def test_known_roots_are_not_compared_again_and_stay_apart_from_others():
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words + [f"x{k}"]) for k in range(6)] + [" ".join(f"y{i}" for i in range(90))]
    sets = [shingle_set(t.encode()) for t in texts]
    for roots in ([0, 0, 0, 3, 3, 3, 6], [0, 1, 0, 1, 0, 1, 6], [5] * 6 + [6]):
        links = compare(list(range(7)), sets, [0] * 7, False, roots)
        assert len(links) == len(set(roots[:6])) - 1 and all(6 not in x for x in links)


class Counted(NearCopies):
    """Keeps the units of each round."""

    def _compared(self, units, texts, name):
        self.units = {**getattr(self, "units", {}), name: units}
        return super()._compared(units, texts, name)


def test_copies_of_one_page_move_a_few_times_and_classes_match_brute_force(spark):
    """A large group of near copies, chains that leave it step by step, and pages that share bands with it but no link."""
    rng = random.Random(13)
    page = [f"w{rng.randrange(900)}" for _ in range(120)]

    def changed(words, n):
        out = list(words)
        for _ in range(n):
            out[rng.randrange(len(out))] = f"x{rng.randrange(99999)}"
        return out

    texts = [" ".join(changed(page, rng.choice([1, 1, 2]))) for _ in range(240)]
    drift = page
    for _ in range(20):
        drift = changed(drift, 2)
        texts.append(" ".join(drift))
    for _ in range(20):
        texts.append(" ".join(changed(page, rng.choice([5, 6, 7, 8]))))
    texts = sorted(set(texts))
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    docs = spark.createDataFrame([document(i, t) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    tile = 12
    found = Counted(docs, tile=tile)
    got = {r.doc_id: r.component_id for r in found.fps.join(found.classes, "fp").collect()}
    assert got == {i: find(i) for i in range(len(texts))} and len(set(got.values())) > 2
    assert set(found.units) == {"within", "few", "all"}
    moves = {name: units.count() for name, units in found.units.items()}
    members = moves["within"]
    before = 0  # each text once for each sub-group of its group
    for r in found.units["within"].groupBy("band", "bucket").count().collect():
        before += r["count"] * -(-r["count"] // tile)
    assert moves["few"] < members and 3 * sum(moves.values()) < before
