"""The prefix trie of conversations, merged family by family.

Conversations are rebuilt from their family's base: conversation c takes the first h turns of conversation
c - c % FAMILY (h: crc32 of c's decimal digits mod 4) and goes on with its own turns after its first h. Each distinct
sequence of first d rebuilt turns is a node; equal sequences of different conversations are one node.

A turn is reduced where it is read to a digest of role and text (128 bits) and its number of words, so that no text
is shuffled. Base and other conversations are cogrouped by base id; a task rebuilds one family of FAMILY ids at
most at a time, builds its trie, adds leaves and savings up within it, and emits one row per family node. A node's
name is the digest of its parent's name and its last turn, the same in every family.

Only these combined rows are shuffled, by name. A node that a single family has keeps what the family found:
all its subtree lies in that family. Nodes of several families form the top of the trie. Their children are counted
by parent, with what single families hang below them, pre-aggregated where they lie; then leaves and savings climb to
all ancestors in log2(depth) rounds, each of which doubles the reach. Ends of a node are written as ascending
texts of PIECE identifiers at most by many tasks; a digest over them reads a node's pieces in order, one at a time.

A family is one group: its turns take some 40 bytes each there, whatever their texts. The root and other hot
nodes are one row a family, combined before they are shuffled; looking up a parent that many nodes share is
a join that Spark splits.

Defined results: rows without a conv_id belong to no conversation and are left out; a null turn comes before
all others, ties are ordered by role and then by digest; a null role or text is empty; repeated rows are
repeated turns; bases of negative identifiers are multiples of FAMILY below them. A conversation that is left without a
turn is a member of the root alone and ends there. An empty table has no node. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch
from weftline.llm.text import whole

FAMILY = 20
#: Turns of the base that a conversation takes: its hash modulo this.
HEADS = 4
PIECE = 4096

NODE = {
    "node": pa.binary(), "parent": pa.binary(), "depth": pa.int64(), "conv_id": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(),
    "words": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved": pa.int64(), "ends": pa.list_(pa.int64()),
}
NODE_SCHEMA = "node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, words long, n_children long, n_leaves long, saved long, ends array<long>"
ROOT = hashlib.blake2b(b"root", digest_size=16).digest()


def heads(conv_id: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % HEADS


def turns_of(conversations: DataFrame) -> DataFrame:
    """(base, conv_id, turn, role, digest, words) of every turn."""
    role, text = whole(F.col("role")), whole(F.col("text"))
    digest = F.substring(F.unhex(F.sha2(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256)), 1, 16)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    conv = F.col("conv_id").cast("long")
    return conversations.where("conv_id is not null").select(
        (conv - F.pmod(conv, F.lit(FAMILY))).alias("base"), conv.alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), words.alias("words")
    )


def _ordered(turns: pa.Table) -> dict[int, list[tuple[bytes, int]]]:
    """Each conversation's turns (digest, words) in order."""
    found: dict[int, list] = {}
    for conv, turn, role, digest, words in zip(*(turns[c].to_pylist() for c in ("conv_id", "turn", "role", "digest", "words")), strict=True):
        found.setdefault(conv, []).append((turn is not None, turn or 0, role, digest, words))
    return {conv: [row[3:] for row in sorted(rows)] for conv, rows in found.items()}


def family_nodes(base: int, own: dict[int, list[tuple[bytes, int]]]) -> pa.Table:
    """The nodes of a family's trie; own: each of its conversations' turns."""
    names, parents, words, depths, firsts, members, ends = [ROOT], [-1], [0], [0], [min(own)], [0], [[]]
    children: dict[tuple[int, bytes], int] = {}
    first = own.get(base, [])
    for conv in sorted(own):
        h, at = heads(conv), 0
        members[0] += 1
        for digest, n in first[:h] + own[conv][h:]:
            found = children.setdefault((at, digest), len(names))
            if found == len(names):
                names.append(hashlib.blake2b(names[at] + digest, digest_size=16).digest())
                parents.append(at)
                words.append(n)
                depths.append(depths[at] + 1)
                firsts.append(conv)
                members.append(0)
                ends.append([])
            members[found] += 1
            at = found
        ends[at].append(conv)
    n_children, leaves = [0] * len(names), [0] * len(names)
    saved = [(m - 1) * w for m, w in zip(members, words, strict=True)]
    for i in range(len(names) - 1, -1, -1):  # children come after their parents
        leaves[i] = leaves[i] or 1
        if i:
            n_children[parents[i]] += 1
            leaves[parents[i]] += leaves[i]
            saved[parents[i]] += saved[i]
    parent_of = lambda values: [None, *(values[p] for p in parents[1:])]
    columns = [names, parent_of(names), depths, firsts, parent_of(firsts), members, words, n_children, leaves, saved, ends]
    return pa.table([pa.array(c, t) for c, t in zip(columns, NODE.values(), strict=True)], list(NODE))


def _digests(pieces: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, piece, text): the texts of a node in order, with commas between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name == node:
                    state.update(b"," + text.encode())
                    continue
                if state:
                    done.append((node, state.hexdigest()))
                node, state = name, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], ["node", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["node", "ends_sha256"])

    rows = pieces.repartition("node").sortWithinPartitions("node", "piece")
    return rows.select("node", "text").mapInArrow(run, "node binary, ends_sha256 string")


class PrefixTrie:
    def __init__(self, conversations: DataFrame, scratch: Scratch | None = None):
        self.scratch = scratch or Scratch(conversations.sparkSession, "prefix-trie")
        turns = self.scratch.put(turns_of(conversations), "turns")
        self.families = self.scratch.put(self._families(turns), "families")
        self.merged = self.scratch.put(self._merged(), "merged")
        self.top = self._top()

    @staticmethod
    def _families(turns: DataFrame) -> DataFrame:
        def build(key: tuple, base: pa.Table, others: pa.Table) -> pa.Table:
            return family_nodes(key[0].as_py(), _ordered(base) | _ordered(others))

        bases, others = turns.where("conv_id = base"), turns.where("conv_id <> base")
        return bases.groupBy("base").cogroup(others.groupBy("base")).applyInArrow(build, NODE_SCHEMA)

    def _merged(self) -> DataFrame:
        """One row per node of the whole trie; ``families``: how many families have it."""
        ends = self.families.where(F.size("ends") > 0).select("node", F.explode("ends").alias("conv"))
        # at most PIECE identifiers fall into a piece, however many conversations end at the node
        pieces = ends.groupBy("node", F.floor(F.col("conv") / PIECE).alias("piece")).agg(F.sort_array(F.collect_list("conv")).alias("convs"))
        ended = _digests(pieces.select("node", "piece", F.array_join(F.col("convs").cast("array<string>"), ",").alias("text")))
        rest = [c for c in self.families.columns if c not in ("node", "ends")]
        kinds = dict(self.families.dtypes)
        rows = self.families.select("node", *rest, F.lit(None).cast("string").alias("ends_sha256"))
        rows = rows.unionByName(ended.select("node", *[F.lit(None).cast(kinds[c]).alias(c) for c in rest], "ends_sha256"))
        alike = [F.max(c).alias(c) for c in ("parent", "depth", "words", "ends_sha256")]  # families agree on these
        own = [F.max(c).alias(c) for c in ("parent_conv_id", "n_children", "n_leaves", "saved")]  # of use where one family has the node
        found = rows.groupBy("node").agg(F.count("depth").alias("families"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), *alike, *own)
        return found.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))

    def _top(self) -> DataFrame:
        """The nodes of several families, with children, leaves and savings of the whole trie."""
        alone = lambda c: F.sum(F.when(F.col("families") == 1, F.col(c)).otherwise(0)).alias(f"{c}_below")
        below = self.merged.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("children"), alone("n_leaves"), alone("saved"))
        shared = self.merged.where("families > 1")
        top = shared.join(below.withColumnRenamed("parent", "node"), "node", "left").withColumns(
            {
                "n_children": F.coalesce("children", F.lit(0)).cast("long"),
                "n_leaves": F.when(F.col("children").isNull(), 1).otherwise(F.col("n_leaves_below")).cast("long"),
                "saved": ((F.col("n_convs") - 1) * F.col("words") + F.coalesce("saved_below", F.lit(0))).cast("long"),
            }
        )
        top = self.scratch.put(top.select(*self.merged.columns), "top")
        deepest = top.agg(F.max("depth")).first()[0] or 0
        # up: the ancestor 2^k above; sums of what lies less than 2^k below
        state = top.select("node", F.col("parent").alias("up"), F.col("n_leaves").alias("leaves"), "saved")
        for k in range(deepest.bit_length()):
            gains = state.where("up is not null").groupBy("up").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")).withColumnRenamed("up", "node")
            above = state.where("up is not null").select(F.col("node").alias("up"), F.col("up").alias("far"))
            state = state.join(above, "up", "left").join(gains, "node", "left").select(
                "node", F.col("far").alias("up"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")
            )
            state = self.scratch.put(state, f"climb-{k}")
            if k:
                self.scratch.drop(f"climb-{k - 1}")
        sums = state.select("node", F.col("leaves").alias("n_leaves"), "saved")
        return self.scratch.put(top.drop("n_leaves", "saved").join(sums, "node").select(*self.merged.columns), "summed")

    def nodes(self) -> DataFrame:
        """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
        every = self.merged.where("families = 1").unionByName(self.top)
        parents = self.top.select(F.col("node").alias("parent"), F.col("conv_id").alias("top_conv_id"))
        # a parent in several families may have a lesser member outside this node's family
        every = every.join(parents, "parent", "left").withColumn("parent_conv_id", F.coalesce("top_conv_id", "parent_conv_id"))
        return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")


def prefix_trie(conversations: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    return PrefixTrie(conversations, scratch).nodes()
