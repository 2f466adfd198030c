"""Reply trees to conversations: paths, branch ranks and a reversible chat template.

Messages (conv_id, node_id, parent_id, role, text, score) form trees. Self-joins that double their reach
each round (a node to its 2^k-th ancestor) give every node its depth and the score of its path, in
log2(depth) rounds, and then list the nodes of chosen root-to-leaf paths. Leaves of a tree are ranked by
their path's score, ties by node_id; the best ``top`` of them become one conversation each.

A turn is written <|im_start|>role, line feed, text, <|im_end|>, line feed. In a text a backslash is
doubled and <| becomes <\\|, and in a role a line feed becomes \\n too, so that no text can look like
a control string and every text is read back exactly. The loss mask is the spans, in code points, of
assistant texts. A conversation is rows (segments) of at most SEGMENT_TURNS turns, which different tasks
write; a digest over a conversation reads its segments in order, one at a time.

Defined results: a null text or role is empty; a null score is 0; a parent that is missing makes a node
a root; nodes on a parent cycle, or below one, are on no path and are left out; of rows that repeat a
node_id in a tree the one with the least (parent, role, text) stays; null conv_id is a tree of its own,
null node_id is no message. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch

START, END = "<|im_start|>", "<|im_end|>\n"
SEGMENT_TURNS = 256
LEARNED_ROLE = "assistant"


def escape(text: str, role: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return text.replace("\n", "\\n") if role else text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted segment."""
    at = 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        stop = formatted.index(END, line + 1)
        yield unescape(formatted[at + len(START) : line]), unescape(formatted[line + 1 : stop])
        at = stop + len(END)


def linear(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as trees of one branch: each turn replies to the one before."""
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", F.xxhash64("text"), "text")
    place = F.row_number().over(order).cast("long")
    nodes = conversations.select("conv_id", "role", "text", place.alias("node_id"))
    return nodes.select("conv_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


class ReplyTrees:
    def __init__(self, messages: DataFrame, scratch: Scratch | None = None):
        self.scratch = scratch or Scratch(messages.sparkSession, "reply-trees")
        columns = {"role": "string", "text": "string"}
        rows = messages.where("node_id is not null").select(
            F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("tree"),
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("node_id").cast("long").alias("node"),
            F.col("parent_id").cast("long").alias("parent"),
            *[F.coalesce(F.col(c).cast(t), F.lit("")).alias(c) for c, t in columns.items()],
            F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
        )
        first = F.min(F.struct("parent", "role", "text", "score", "conv_id")).alias("x")
        self.messages = self.scratch.put(rows.groupBy("tree", "node").agg(first).select("tree", "node", "x.*"), "messages")
        self._climb()

    def _climb(self) -> None:
        """jumps[k]: (tree, node, up), up the 2^k-th ancestor; reached: (tree, node, depth, total) of every node below a root.

        A round takes only nodes that have not met their root, so that long branches cost the short ones nothing.
        """
        known = self.messages.select("tree", F.col("node").alias("parent"))
        real = self.messages.select("tree", "node", "parent", "score").join(known.withColumn("there", F.lit(True)), ["tree", "parent"], "left")
        state = real.select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.col("score").alias("total"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth"))
        state = self.scratch.put(state, "climb-0")
        self.reached, active = state.where("up is null"), state.where("up is not null")
        self.jumps, before, left = [], None, active.count()
        while left and left != before:  # what no longer shrinks climbs in circles
            self.jumps.append(active)
            above = active.unionByName(self.reached)
            above = above.select("tree", F.col("node").alias("up"), F.col("up").alias("far"), F.col("total").alias("more"), F.col("depth").alias("further"))
            state = active.join(above, ["tree", "up"], "left").select(
                "tree", "node", F.col("far").alias("up"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"), (F.col("depth") + F.coalesce("further", F.lit(0))).alias("depth")
            )
            state = self.scratch.put(state, f"climb-{len(self.jumps)}")
            self.reached, active = self.reached.unionByName(state.where("up is null")), state.where("up is not null")
            before, left = left, active.count()

    def leaves(self, top: int = 1) -> DataFrame:
        """(tree, leaf, depth, total, rank) of the best branches of each tree."""
        parents = self.messages.select("tree", F.col("parent").alias("node")).where("node is not null")
        tips = self.reached.join(parents, ["tree", "node"], "left_anti")
        # row_number up to a limit is cut to the best rows of each task before the shuffle
        ranked = tips.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("total"), "node"))).where(F.col("rank") <= top)
        return ranked.select("tree", F.col("node").alias("leaf"), "depth", "total", "rank")

    def paths(self, top: int = 1) -> DataFrame:
        """(conv_id, tree, rank, place, role, text): the messages of the chosen paths, place from the root."""
        path = self.scratch.put(self.leaves(top), "leaves").select("tree", "rank", F.col("depth").alias("place"), F.col("leaf").alias("node"))
        for k, jump in enumerate(self.jumps):
            higher = path.join(jump.select("tree", "node", "up"), ["tree", "node"])
            path = path.unionByName(higher.select("tree", "rank", (F.col("place") - 2**k).alias("place"), F.col("up").alias("node")))
            path = self.scratch.put(path, f"path-{k}")
        return path.join(self.messages, ["tree", "node"]).select("conv_id", "tree", "rank", "place", "role", "text")

    def formatted(self, top: int = 1) -> DataFrame:
        """Segments: conv_id, tree, rank, segment, turns, formatted, spans."""

        def segment(key: list, turns: list[tuple[str, str]]) -> pa.RecordBatch:
            parts, spans, at = [], [], 0
            for role, text in turns:
                head, body = f"{START}{escape(role, role=True)}\n", escape(text)
                if role == LEARNED_ROLE:
                    spans.append({"begin": at + len(head), "end": at + len(head) + len(body)})
                parts += [head, body, END]
                at += len(head) + len(body) + len(END)
            row = [*key, len(turns), "".join(parts), spans]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        names = ["conv_id", "tree", "rank", "segment", "turns", "formatted", "spans"]
        types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, turns = None, []
            for batch in batches:
                for *own, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if own != key:
                        if turns:
                            yield segment(key, turns)
                        key, turns = own, []
                    turns.append((role, text))
            if turns:
                yield segment(key, turns)

        # a long conversation's segments are written by different tasks
        rows = self.paths(top).withColumn("segment", F.floor(F.col("place") / SEGMENT_TURNS).cast("int"))
        rows = rows.repartition("tree", "rank", "segment").sortWithinPartitions("tree", "rank", "segment", "place")
        schema = "conv_id long, tree string, rank int, segment int, turns int, formatted string, spans array<struct<begin:bigint,end:bigint>>"
        return rows.select("conv_id", "tree", "rank", "segment", "role", "text").mapInArrow(run, schema)


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation, from its segments: turns and learned text, as counts and digests."""
    names = ["conv_id", "rank", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def row() -> pa.RecordBatch:
            n, turns, loss_chars, loss, chars = state
            values = [key[0], key[2], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        for batch in batches:
            for conv_id, tree, rank, formatted, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv_id, tree, rank) != key:
                    if state:
                        yield row()
                    key, state = (conv_id, tree, rank), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in turns_of(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for span in spans:
                    learned = unescape(formatted[span["begin"] : span["end"]])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(formatted)
        if state:
            yield row()

    rows = segments.repartition("tree", "rank").sortWithinPartitions("tree", "rank", "segment")
    schema = "conv_id long, rank int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.select("conv_id", "tree", "rank", "formatted", "spans").mapInArrow(run, schema)


def chat_format(messages: DataFrame, top: int = 1, scratch: Scratch | None = None) -> DataFrame:
    """Format the best branches of each tree, write them, and return what reading them back gives."""
    trees = ReplyTrees(messages, scratch)
    return read_back(trees.scratch.put(trees.formatted(top), "formatted"))
