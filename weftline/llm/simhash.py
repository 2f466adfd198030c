"""Near duplicates by 64-bit SimHash fingerprints, compared bit-sliced.

Fingerprints (pandas-free Arrow batches in tasks): each word shingle's XXH64 votes on 64 bits.
Candidates: the 64 bits are cut in ``blocks`` fields; two fingerprints that differ in at most ``radius``
bits agree on at least blocks - radius fields, so that every pair within the radius meets under some
choice of that many fields. blocks grows with the number of distinct fingerprints, which keeps the
groups that meet small; the links found are the same for any number.
Comparison: within a group the fingerprints are stored as 64 vertical bit planes, 64 fingerprints a
word. A query adds the planes that differ into carry-save counters, all distances of a word at once, and
words whose distances all exceed the radius are abandoned. Any pair found within the radius is a link,
so that small groups are compared together in one pass.
Groups of over TILE fingerprints are dealt to pairs of sub-groups, each pair a unit of its own: no task
holds more than two sub-groups, and all links are found.
A task returns for each group the links of a spanning forest, at most one per fingerprint, never all
pairs; connected components over those links are the same as over all.

Defined results: a null or wordless text has fingerprint zero and links like any other. Fewer words
than a shingle: the whole sequence is the one shingle. Rows that repeat a doc_id are separate rows with
equal fingerprints. A null doc_id never is a component_id unless all of its component are null.
An empty table gives no rows. Extra columns are ignored, or kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.bloom import with_likely
from weftline.llm.components import connected_components
from weftline.llm.scratch import Scratch
from weftline.llm.text import row_of, whole

SHINGLE = 4
RADIUS = 4
SEED = 42
TILE = 8192
CHUNK = 1024
#: Rows that may meet under one choice of fields on average, before more fields are used.
GROUP = 256
#: Parts into which the members of a component are dealt when they get its name.
SALTS = 16
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Of a UTF-8 text; bytes.lower() and bytes.split() touch A-Z and ASCII white space only."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    stops = ends[shingle - 1 :].tolist() if len(words) >= shingle else [len(joined)]
    votes = np.zeros(64, np.int64)
    hashed = xxhash.xxh64_intdigest
    for at in range(0, n, 65536):
        h = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536], strict=True)], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint as a signed long; the hash tells apart rows that repeat a doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "text_hash", "fp"])

    return keyed(docs).select("doc_id", "text_hash", F.encode("text", "UTF-8").alias("text")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def keyed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text_hash, text)"""
    text = whole(F.col("text"))
    return docs.select(row_of(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes [64, words]: bit i of word w of plane b is bit b of fingerprint 64 w + i."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def near(queries: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of queries[i] and fps[j] that differ in at most radius bits."""
    planes = planes_of(fps)
    n_words = planes.shape[1]
    width = (radius + 1).bit_length()
    q, w = (x.ravel() for x in np.meshgrid(np.arange(len(queries)), np.arange(n_words), indexing="ij"))
    start = (1 << width) - 1 - radius  # counters start so that the carry out of the last means "over the radius"
    counters = [np.full(len(q), ALL if start >> k & 1 else 0, np.uint64) for k in range(width)]
    over = np.zeros(len(q), np.uint64)
    for b in range(64):
        carry = planes[b][w] ^ (np.uint64(0) - (queries >> np.uint64(b) & np.uint64(1)))[q]
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if b % 8 == 7:
            alive = over != ALL
            if np.count_nonzero(alive) < 0.7 * len(alive):
                q, w, over = q[alive], w[alive], over[alive]
                counters = [c[alive] for c in counters]
                if not len(q):
                    break
    hit = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, bit = np.nonzero(hit)
    j = w[at] * 64 + bit
    real = j < len(fps)
    return q[at][real], j[real]


class Forest:
    """Union-find over positions, fed with arrays of pairs."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Lower roots win; rounds of array-wide hooking and pointer jumping until all pairs agree."""
        while len(a):
            a, b = self.up[a], self.up[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(jumped := self.up[self.up], self.up):
                self.up = jumped


def compare(fps: np.ndarray, side: np.ndarray, crossed: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of one group. crossed: only the two sides are compared."""
    forest = Forest(len(fps))
    if crossed:
        left, right = np.nonzero(side == side.min())[0], np.nonzero(side != side.min())[0]
        jobs = [(left[i : i + CHUNK], right[j : j + CHUNK]) for i in range(0, len(left), CHUNK) for j in range(0, len(right), CHUNK)]
    else:
        cuts = [np.arange(i, min(i + CHUNK, len(fps))) for i in range(0, len(fps), CHUNK)]
        jobs = [(x, y) for i, x in enumerate(cuts) for y in cuts[i:]]
    for x, y in jobs:
        i, j = near(fps[x], fps[y], radius)
        forest.add(x[i], y[j])
    child = np.nonzero(forest.up != np.arange(len(fps)))[0]
    return fps[child], fps[forest.up[child]]


def _links(radius: int):
    """mapInArrow over rows (choice, field, s, t, side, fp), sorted by all but fp."""

    def flush(groups: list) -> pa.RecordBatch | None:
        """Small groups together: a pair found across groups is a link all the same."""
        fps = np.unique(np.concatenate([g for g, _, _ in groups])) if len(groups) > 1 else groups[0][0]
        side, crossed = (groups[0][1], groups[0][2]) if len(groups) == 1 else (None, False)
        u, v = compare(fps, side, crossed, radius)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"]) if len(u) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, size = [], 0  # whole groups that wait to be compared
        key, parts = None, []  # the group that is being read

        def closed():
            fps, side = (np.concatenate(x) for x in zip(*parts, strict=True))
            return fps.view(np.uint64), side, key[2] != key[3]

        def take(group):
            nonlocal ready, size
            if len(group[0]) < 2:
                return
            if group[2] or len(group[0]) > CHUNK // 2:
                yield flush([group])
                return
            ready.append(group)
            size += len(group[0])
            if size >= CHUNK:
                yield flush(ready)
                ready, size = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(k).to_numpy() for k in range(4)]
            side, fps = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            change = np.zeros(len(fps), bool)
            change[0] = True
            for k in keys:
                change[1:] |= k[1:] != k[:-1]
            cuts = [*np.nonzero(change)[0].tolist(), len(fps)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = tuple(int(k[a]) for k in keys)
                if own != key and parts:
                    yield from (x for x in take(closed()) if x)
                    parts = []
                key = own
                parts.append((fps[a:b], side[a:b]))
        if parts:
            yield from (x for x in take(closed()) if x)
        if ready and (last := flush(ready)):
            yield last

    return run


def field_masks(n: int, radius: int) -> list[int]:
    """Masks of the chosen fields: enough fields that n spread fingerprints meet in groups of GROUP or less."""
    blocks = radius + 1
    while blocks < 2 * radius and n / 2 ** (64 * (blocks - radius) // blocks) > GROUP:
        blocks += 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    fields = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(fields, blocks - radius)]
    assert len(masks) == comb(blocks, radius)
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame, n: int, scratch: Scratch, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(u, v): links among the distinct fingerprints of nodes whose components are those of all links."""
    masks = field_masks(n, radius)
    choice = F.explode(F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("field")) for k, m in enumerate(masks)]))
    met = nodes.select("fp", choice.alias("x")).select("fp", "x.choice", "x.field")
    large = met.groupBy("choice", "field").count().where(F.col("count") > tile)
    large = scratch.put(large.select("choice", "field", F.ceil(F.col("count") / tile).cast("int").alias("cuts")), "large")
    if large.isEmpty():
        dealt = met.select("choice", "field", F.lit(0).alias("s"), F.lit(0).alias("t"), F.lit(0).alias("side"), "fp")
    else:
        cut = met.join(large, ["choice", "field"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
        cut = cut.withColumn("side", F.pmod(F.xxhash64("fp", "choice"), F.col("cuts")).cast("int"))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        dealt = cut.select("choice", "field", F.least("side", "other").alias("s"), F.greatest("side", "other").alias("t"), "side", "fp")
    dealt = dealt.repartition("choice", "field", "s", "t").sortWithinPartitions("choice", "field", "s", "t")
    return dealt.mapInArrow(_links(radius), "u long, v long")


class Components:
    """Classes of fingerprints: the components of their links, each named by its least doc_id."""

    def _classify(self, nodes: DataFrame, found: DataFrame) -> None:
        """Sets classes from nodes (fp, least) and links. What links nothing is not joined; a root of many is dealt to SALTS parts."""
        linked = nodes.join(connected_components(found, self.scratch).withColumnRenamed("node", "fp"), "fp", "left")
        linked = self.scratch.put(linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")), "rooted")
        least = linked.where("root is not null").groupBy("root").agg(F.min("least").alias("component_id"))
        least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        alone = linked.where("root is null").select("fp", F.col("least").alias("component_id"))
        self.classes = alone.unionByName(linked.where("root is not null").join(least, ["root", "salt"]).select("fp", "component_id"))


class SimHash(Components):
    """Fingerprints of a table, their links and components."""

    def __init__(self, docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE, scratch: Scratch | None = None):
        self.scratch = scratch or Scratch(docs.sparkSession, "simhash")
        self.fps = self.scratch.put(fingerprints(docs, shingle), "fingerprints")
        nodes = self.scratch.put(self.fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
        self._classify(nodes, links(nodes, nodes.count(), self.scratch, radius, tile))

    def report(self) -> DataFrame:
        """One row per document: doc_id, fingerprint, component_id."""
        return self.fps.join(self.classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, **options) -> DataFrame:
    return SimHash(docs, **options).report()


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The row of each component with the smallest doc_id, with the columns of docs.

    Of rows that repeat that doc_id with the same text one stays. Rows that surely stay are not shuffled.
    """
    return keep_one_of(SimHash(docs, **options), docs)


def keep_one_of(found: Components, docs: DataFrame) -> DataFrame:
    """keep_one by components that are at hand."""
    key = ["doc_id", "text_hash"]
    verdict = found.fps.join(found.classes, "fp").select(*key, F.col("doc_id").eqNullSafe(F.col("component_id")).alias("stays"))
    verdict = verdict.groupBy(*key).agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n")).where("not stays or n > 1")
    verdict = found.scratch.put(verdict, "verdict").withColumnsRenamed({k: f"verdict_{k}" for k in key})
    rows = with_likely(keyed(docs).drop("text"), verdict.withColumnsRenamed({f"verdict_{k}": k for k in key}), verdict.count(), key)
    near = rows.where("likely").join(verdict, (F.col("doc_id").eqNullSafe(F.col("verdict_doc_id"))) & (F.col("text_hash") == F.col("verdict_text_hash")), "left")
    once = rows.where("not likely").select("row").unionByName(near.where("stays is null").select("row"))
    repeated = near.where("stays").groupBy(*key).agg(F.first("row").alias("row")).select("row")
    return once.unionByName(repeated).select("row.*")
