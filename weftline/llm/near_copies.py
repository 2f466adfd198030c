"""Near copies of the pipeline: SimHash near-dedup of documents whose sets of five-word shingles have a Jaccard similarity
of 0.8 or more.

Fingerprints of such pairs differ in 10 of 64 bits on average and in up to 20, too many for the choices of fields by
which simhash.py finds its candidates. Candidates are therefore brought together by MinHash signatures of BANDS bands of
ROWS rows (Arrow batches in tasks, one row per distinct text): a pair at similarity s shares a band with probability
1 - (1 - s^ROWS)^BANDS, 0.9996 at 0.8, more above. Bands whose groups have the same members are compared once.
Comparison: within a group the texts' fingerprints are compared bit-sliced, as in simhash.py, and pairs over RADIUS bits
are abandoned; a pair of similarity 0.8 has less than four chances in a million to be among them.
Verification: what is left is compared by exact shingle sets unless it is linked already; only pairs of at least LEAST
similarity are links. Groups of over TILE texts, or of over TILE_BYTES of text, are dealt to pairs of sub-groups, each a
unit of its own, so that no task holds more than two sub-groups and no pair is left out. A task returns a spanning forest
of the verified links. Components over those links are the classes of which one document stays.

Defined results: words as in simhash.py; fewer words than a shingle are one shingle; a null or wordless text has the
empty shingle and is like any other such text. Rows that repeat a text are one node. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.bloom import with_likely
from weftline.llm.components import connected_components
from weftline.llm.scratch import Scratch
from weftline.llm.simhash import Components, Forest, keep_one_of, keyed, near

SHINGLE = 5
#: Least similarity of a link, as a fraction, so that the comparison is exact.
LEAST = (4, 5)
BANDS, ROWS = 20, 5
#: Bits in which fingerprints of a pair that is worth an exact look differ at most. Of five shingles and four of them, the
#: worst case, they differ in 12 on average, with a deviation of 3.1.
RADIUS = 26
SEED = 42
TILE = 512
TILE_BYTES = 4 << 20
#: Texts of a component that are compared for it before all its texts are.
REPRESENTATIVES = 4
#: Shingles that are permuted at once.
CHUNK = 8192
#: What names a group of candidates, and a unit of comparison within it.
GROUP = ["band", "bucket"]
UNIT = [*GROUP, "s", "t"]
_RNG = np.random.default_rng(7)
_FACTORS = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a UTF-8 text's shingles."""
    words = text.lower().split()
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist() or [0]
    stops = ends[shingle - 1 :].tolist() if len(words) >= shingle else [len(joined)]
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.array([hashed(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64))


def fingerprint_of(shingles: np.ndarray) -> int:
    """SimHash of distinct shingles: a bit is 1 if over half of them set it."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 65536):
        votes += np.unpackbits(shingles[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(shingles), bitorder="little").view("<u8")[0])


def buckets(shingles: np.ndarray) -> list[int]:
    """One signed long per band: the hash of its rows' least permuted shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), CHUNK):
        mixed = shingles[None, at : at + CHUNK] * _FACTORS + _SHIFTS
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=1))
    return [xxhash.xxh64_intdigest(least[k : k + ROWS].tobytes(), k) - (1 << 63) for k in range(0, BANDS * ROWS, ROWS)]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [buckets(shingle_set(t.as_py())) for t in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int64()))], ["doc_id", "text_hash", "bytes", "buckets"])


def compare(nodes: list[int], sets: list[np.ndarray], sides: list[int], crossed: bool, roots: list[int] | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs that are similar enough. crossed: only the two sides are compared. roots: nodes
    with the same root are linked already; the links are between one node of each root."""
    sizes = np.array([len(s) for s in sets])
    fps = np.array([fingerprint_of(s) for s in sets], np.uint64)
    forest = Forest(len(sets))
    if roots is not None:
        _, at, which = np.unique(np.array(roots), return_index=True, return_inverse=True)
        forest.up = at[which]
    known = forest.up.copy()
    left, right = near(fps, fps, RADIUS)
    side = np.array(sides)
    # sizes alone bound the similarity
    worth = (left < right) & (LEAST[1] * np.minimum(sizes[left], sizes[right]) >= LEAST[0] * np.maximum(sizes[left], sizes[right]))
    worth &= known[left] != known[right]
    if crossed:
        worth &= side[left] != side[right]
    left, right = left[worth], right[worth]
    order = np.lexsort((right, left))
    left, right = left[order], right[order]
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(flat.max()) + 1, bool)
    first, at = np.unique(left, return_index=True)
    for i, rest in zip(first.tolist(), np.split(right, at[1:]) if len(at) else [], strict=True):
        rest = rest[forest.up[rest] != forest.up[i]]
        if not len(rest):
            continue
        mark[own := flat[cuts[i] : cuts[i + 1]]] = True
        both = np.array([np.count_nonzero(mark[flat[cuts[j] : cuts[j + 1]]]) for j in rest])
        mark[own] = False
        hit = rest[LEAST[1] * both >= LEAST[0] * (sizes[rest] + sizes[i] - both)]
        forest.add(np.full(len(hit), i), hit)
    return [(nodes[k], nodes[up]) for k, up in enumerate(forest.up.tolist()) if up != k and known[k] == k]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (band, bucket, s, t, side, node, root, text), sorted by the first four."""
    key, nodes, sides, roots, sets = None, [], [], [], []

    def closed() -> Iterator[pa.RecordBatch]:
        if len(nodes) > 1 and (found := compare(nodes, sets, sides, key[2] != key[3], roots)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["u", "v"])

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[:7]]
        for *own, side, node, root, text in zip(*columns, batch.column(7), strict=True):
            if own != key:
                yield from closed()
                key, nodes, sides, roots, sets = own, [], [], [], []
            nodes.append(node)
            sides.append(side)
            roots.append(root)
            sets.append(shingle_set(text.as_py()))
    yield from closed()


def _parts(tile: int, tile_bytes: int) -> Column:
    """Sub-groups of n texts of size bytes."""
    return F.least(F.greatest(F.ceil(F.col("n") / tile), F.ceil(F.col("size") / tile_bytes)), F.col("n")).cast("int")


def _part(*dealt_by: str, of: str) -> Column:
    return F.pmod(F.xxhash64(*dealt_by), F.col(of)).cast("int")


def _open_groups(large: DataFrame, stars: DataFrame) -> DataFrame:
    """Members of oversize groups with their roots, of groups in which more than one root is left."""
    rooted = large.join(stars.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = rooted.groupBy(*GROUP).agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select(*GROUP)
    return rooted.join(several, GROUP, "left_semi")


def _representatives(large: DataFrame, tile: int, tile_bytes: int) -> DataFrame:
    """Units of a few members of each component of a group. They bring components together early; _across leaves out none."""
    picked = [F.min(F.struct(F.xxhash64(F.lit(k), "node").alias("rank"), "node", "bytes")) for k in range(REPRESENTATIVES)]
    chosen = large.groupBy(*GROUP, "root").agg(F.array(*picked).alias("picked"))
    # one pick may be the least under several hashes
    chosen = chosen.select(*GROUP, "root", F.explode(F.array_distinct(F.transform("picked", lambda p: F.struct(p.node.alias("node"), p.bytes.alias("bytes"))))).alias("p"))
    chosen = chosen.select(*GROUP, "root", "p.node", "p.bytes")
    cuts = chosen.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("size")).select(*GROUP, _parts(tile, tile_bytes).alias("cuts"))
    dealt = chosen.join(cuts, GROUP).withColumn("s", _part("node", of="cuts"))
    return dealt.select(*GROUP, "s", F.col("s").alias("t"), F.col("s").alias("side"), "node", "root")


def _across(large: DataFrame, tile: int, tile_bytes: int) -> DataFrame:
    """Units of all pairs of a group's sub-groups that are not of one component."""
    sums = [F.sum("n").alias("n"), F.sum("size").alias("size")]
    counted = large.groupBy(*GROUP, "root").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("size"))
    # own: the root of a component that has sub-groups of its own; null: small components, which share sub-groups
    counted = counted.withColumn("own", F.when(_parts(tile, tile_bytes) > 1, F.col("root")))
    spans = counted.groupBy(*GROUP, "own").agg(*sums).select(*GROUP, "own", _parts(tile, tile_bytes).alias("parts"))
    before = Window.partitionBy(*GROUP).orderBy("own").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("at", F.coalesce(F.sum("parts").over(before), F.lit(0)).cast("int"))
    other = spans.select(*GROUP, F.col("at").alias("other_at"), F.col("parts").alias("other_parts"))
    pairs = spans.join(other, GROUP).where("at <> other_at or own is null").withColumnRenamed("own", "span")
    pairs = pairs.withColumnsRenamed({"band": "pair_band", "bucket": "pair_bucket"})
    rooted = large.join(counted.where("own is not null").select(*GROUP, "root", "own"), [*GROUP, "root"], "left")
    dealt = rooted.join(pairs, (F.col("band") == F.col("pair_band")) & (F.col("bucket") == F.col("pair_bucket")) & F.col("own").eqNullSafe(F.col("span")))
    dealt = dealt.withColumn("side", F.col("at") + _part("node", of="parts"))
    dealt = dealt.withColumn("other", F.explode(F.sequence("other_at", F.col("other_at") + F.col("other_parts") - 1)))
    return dealt.select(*GROUP, F.least("side", "other").alias("s"), F.greatest("side", "other").alias("t"), "side", "node", "root")


class NearCopies(Components):
    """Of a table: ``fps`` (doc_id, text_hash, fp), fp being the text's hash, and ``classes`` (fp, component_id)."""

    def __init__(self, docs: DataFrame, tile: int = TILE, tile_bytes: int = TILE_BYTES, scratch: Scratch | None = None):
        self.scratch = scratch or Scratch(docs.sparkSession, "near-copies")
        texts = keyed(docs).select("doc_id", "text_hash", F.encode("text", "UTF-8").alias("text"))
        rows = texts.select("doc_id", "text_hash", F.octet_length("text").cast("long").alias("bytes"), "text")
        signed = self.scratch.put(rows.mapInArrow(_signatures, "doc_id long, text_hash long, bytes long, buckets array<long>"), "signatures")
        self.fps = signed.select("doc_id", "text_hash", F.col("text_hash").alias("fp"))
        nodes = self.scratch.put(self.fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
        self._classify(nodes, self._links(signed, texts, tile, tile_bytes))

    def _links(self, signed: DataFrame, texts: DataFrame, tile: int, tile_bytes: int) -> DataFrame:
        single = signed.groupBy("text_hash").agg(F.first("bytes").alias("bytes"), F.first("buckets").alias("buckets"))
        met = single.select(F.col("text_hash").alias("node"), "bytes", F.posexplode("buckets").alias("band", "bucket"))
        met = self.scratch.put(met, "met")
        spread = lambda seed: F.xxhash64(F.lit(seed), "node")
        marks = [F.sum(spread(1).cast("decimal(20,0)")).alias("added"), F.expr("bit_xor(xxhash64(2, node))").alias("xored")]
        groups = met.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("size"), *marks).where("n > 1")
        groups = groups.groupBy("n", "size", "added", "xored").agg(F.min(F.struct("band", "bucket")).alias("at"))
        groups = groups.select("at.band", "at.bucket", _parts(tile, tile_bytes).alias("cuts"))
        groups = self.scratch.put(groups, "groups")
        members = self.scratch.put(met.join(groups, GROUP).select(*GROUP, "cuts", "node", "bytes"), "members")
        dealt = members.select(*GROUP, _part("node", "band", of="cuts").alias("s"), "node", F.col("node").alias("root"))
        found = self._compared(dealt.withColumn("t", F.col("s")).withColumn("side", F.col("s")), texts, "within")
        large = members.where("cuts > 1").drop("cuts")
        for name, units in (("few", _representatives), ("all", _across)):
            if large.isEmpty():
                break
            # stars, so that what is known costs the next components one round
            found = connected_components(found, self.scratch, f"stars-{name}").select(F.col("node").alias("u"), F.col("root").alias("v"))
            found = self.scratch.put(found, f"known-{name}")
            large = self.scratch.put(_open_groups(large.drop("root"), found), f"open-{name}")
            found = found.unionByName(self._compared(self.scratch.put(units(large, tile, tile_bytes), f"units-{name}"), texts, name))
        return found

    def _compared(self, units: DataFrame, texts: DataFrame, name: str) -> DataFrame:
        """Links (u, v) of units (band, bucket, s, t, side, node, root)."""
        wanted = self.scratch.put(units.select(F.col("node").alias("text_hash")).distinct(), f"wanted-{name}")
        likely = with_likely(texts.select("text_hash", "text"), wanted, wanted.count(), ["text_hash"]).where("likely").drop("likely")
        likely = likely.join(wanted, "text_hash", "left_semi").groupBy("text_hash").agg(F.first("text").alias("text"))
        moved = units.join(likely.withColumnRenamed("text_hash", "node"), "node")
        moved = moved.repartition(*UNIT).sortWithinPartitions(*UNIT).select(*UNIT, "side", "node", "root", "text")
        return self.scratch.put(moved.mapInArrow(_verified, "u long, v long"), f"links-{name}")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The row of each class with the smallest doc_id, with the columns of docs, as simhash.keep_one does."""
    return keep_one_of(NearCopies(docs, **options), docs)
