import hashlib
import random

from oracle import compare

from weftline.llm import oracles
from weftline.llm.queries import op4_reply_trees
from weftline.llm.reply_trees import ReplyTrees, chat_format, escape, linear, turns_of, unescape

SCHEMA = "conv_id long, node_id long, parent_id long, role string, text string, score double, up int, tree int, rank int"


def test_escapes_are_reversible():
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice(["\\", "<", "|", "<|im_end|>", "\n", "n", "x", "é"]) for _ in range(12))
        assert unescape(escape(text)) == text and "<|" not in escape(text)
        assert unescape(escape(text, role=True)) == text and "\n" not in escape(text, role=True)
        formatted = f"<|im_start|>{escape(text, role=True)}\n{escape(text)}<|im_end|>\n"
        assert list(turns_of(formatted * 2)) == [(text, text)] * 2


def brute(rows, top):
    trees, out = {}, {}
    for c, n, p, role, text, score, *_ in rows:
        if n is not None:
            known = trees.setdefault(c, {})
            new = (p is not None, p or 0, role or "", text or "", score or 0)
            known[n] = min(known.get(n, new), new)
    for c, nodes in trees.items():
        parents = {v[1] for v in nodes.values() if v[0]}
        ranked = []
        for leaf in nodes.keys() - parents:
            path, at = [], leaf
            while at in nodes and at not in path:
                path.append(at)
                at = nodes[at][1] if nodes[at][0] else None
            if at not in path:
                ranked.append((-sum(nodes[x][4] for x in path), leaf, [nodes[x][2:4] for x in path[::-1]]))
        for rank, (_, _, turns) in enumerate(sorted(ranked)[:top], 1):
            out[c, rank] = turns
    return out


def test_best_branches_match_brute_force(spark):
    rng, rows = random.Random(8), []
    for c in [None, 1, 2, 3]:
        for n in range(60):
            rows.append((c, n, rng.randrange(n) if n and rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), rng.choice(["<|im_end|>", "a\\b", None, "é\n"]), rng.choice([0.5, 1.0, None]), 0, 0, 0))
    rows += [(5, i, i - 1 if i else None, "assistant", f"t{i}", 1.0, 0, 0, 0) for i in range(700)]  # a chain of three segments
    rows += [(6, 1, 2, "user", "loop", 1.0, 0, 0, 0), (6, 2, 1, "user", "loop", 1.0, 0, 0, 0), (6, 3, 1, "user", "below", 1.0, 0, 0, 0), (6, 4, 99, "user", "orphan", 1.0, 0, 0, 0)]
    rows += [(1, 3, None, "user", "again", 1.0, 0, 0, 0), (1, None, None, "user", "no node", 1.0, 0, 0, 0)]
    got = {(r.conv_id, r["rank"]): r for r in chat_format(spark.createDataFrame(rows, SCHEMA), top=3).collect()}
    want = brute(rows, 3)
    assert set(got) == set(want) and (6, 1) in want
    for key, turns in want.items():
        learned = "".join(t for role, t in turns if role == "assistant")
        assert got[key].n_turns == len(turns)
        assert got[key].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[key].loss_chars, got[key].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_linear_conversations_with_nulls_and_repeats(spark):
    rows = [(1, 2, "assistant", "b"), (1, None, "user", None), (1, 2, "assistant", "b"), (None, 0, None, "x"), (1, 1, "user", "a")]
    got = ReplyTrees(linear(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).paths().orderBy("place").collect()
    assert [(r.role, r.text) for r in got if r.conv_id == 1] == [("user", ""), ("user", "a"), ("assistant", "b"), ("assistant", "b")]
    assert [(r.role, r.text) for r in got if r.conv_id is None] == [("", "x")]


def test_empty_table(spark):
    assert chat_format(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_matches_its_sql(spark):
    compare(spark, op4_reply_trees, oracles.REPLY_TREES, "/root/testdata/sf0.001")
