import hashlib
import os
import random
import re
import zlib

import pytest
from oracle import compare

from weftline.llm import oracles, queries
from weftline.llm.prefix_trie import PIECE, prefix_trie

SF = "/root/testdata/sf0.001"

SCHEMA = "conv_id long, turn long, role string, text string, node int, parent int, depth int, saved int, base int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], SCHEMA)


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(t[2], t[3]) for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaf = lambda n: not any(m[: len(n)] == n and len(m) == len(n) + 1 for m in members)
        words = lambda n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(built[c]) == len(node)))
        out.append(
            (min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children), sum(map(leaf, below)), sum((len(members[n]) - 1) * words(n) for n in below), hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=repr)


def found(spark, rows):
    got = prefix_trie(table(spark, rows))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for _, t in got.dtypes} == {"bigint", "string"}
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_random_conversations_match_brute_force(spark):
    draw = random.Random(3)
    rows = []
    for conv in draw.sample(range(-40, 200), 120):
        n = draw.choice([1, 1, 2, 3, 5, 9])
        rows += [(conv, t, draw.choice(["user", "assistant"]), draw.choice(["a b", "a  b", "c", "long text with words"])) for t in range(n)]
    assert found(spark, rows) == brute(rows)


def test_copies_across_families_and_deep_chains(spark):
    """One conversation copied into many families, deeper than several rounds reach; ends of a node in several pieces."""
    deep = [("user" if t % 2 else "assistant", f"turn {t} says {t % 7}") for t in range(40)]
    rows = []
    for conv in [*range(0, 400, 7), PIECE + 40, 3 * PIECE + 3]:
        rows += [(conv, t, *deep[t]) for t in range(40 - conv % 3)]
    assert found(spark, rows) == brute(rows)


def test_nulls_empty_texts_ties_and_repeats(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", ""), (1, 1, "user", None), (1, 1, "assistant", "tie"), (1, 5, "user", "x y z"), (1, 5, "user", "x y z"),
        (0, 0, "user", "base one"), (0, 1, "assistant", "base two"), (0, 2, "user", "base three"), (0, 3, "user", "last"),
        (None, 0, "user", "nobody's"), (45, 0, "user", "no base"), (46, 0, "user", "no base"), (47, 0, "user", "no base"), (48, 0, "user", "no base"),
        (19, 0, "user", "w " * 50000), (-3, 0, "user", "negative"), (-20, 0, "user", "its base"),
    ]
    assert found(spark, rows) == brute(rows)


def test_role_and_text_do_not_run_into_each_other(spark):
    rows = [(100, t, *x) for t, x in enumerate([("user", "a"), ("u", "ser:a"), ("", "x")])] + [(200, t, *x) for t, x in enumerate([("use", "ra"), ("u", "ser:a"), ("", "x")])]
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert prefix_trie(table(spark, []).limit(0)).collect() == []
    assert found(spark, [(7, 0, "user", "x")]) == brute([(7, 0, "user", "x")])


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_query_matches_its_sql(spark):
    compare(spark, queries.op12_prefix_trie, oracles.PREFIX_TRIE, SF)
