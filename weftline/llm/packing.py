"""Conflict-constrained best-fit packing of documents into bins of fixed token capacity.

Bins are ordered by what room they have left and carry a bitmap of the sources and one of the duplicate
clusters they hold. Documents come longest first; the search starts at the tightest bin with room and
goes on to its successors until one is compatible: it holds neither the document's source nor its
cluster. If none is, a bin is opened. A document longer than a bin fills bins of its own; its rest is
packed like any other.

Documents are dealt by hash to shards of about SHARD_ROWS rows, packed apart, so that a source or a
cluster that holds a third of all rows is spread over all shards like everything else, and a task holds
one shard's lengths and bitmaps, not texts. Bits are numbered per shard, for the sources it holds and
the clusters of which it holds two rows or more: bitmaps are exact.

Lengths are token counts of the public tokenizer plus one end id. Documents with the same words in the
same order are one cluster, or those with one value of a column that the caller names, such as
components of near copies; a null there is a cluster of its own row.

Defined results: a null or empty text has the end id alone and is packed; a null source is a source of
its own; rows that repeat a document are packed each, in different bins. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch
from weftline.llm.text import named, whole
from weftline.llm.tokenizing import SharedTokenizer, word_bpe_path
from weftline.llm.wordtable import sliced

CAPACITY = 2048
SHARD_ROWS = 4096


def pack(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(item, piece, bin, start, size) of items given longest first."""
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources))}
    shared = [c for c, n in Counter(clusters).items() if n > 1]
    cluster_bit = {c: 1 << i for i, c in enumerate(shared)}
    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    in_sources: dict[int, int] = {}
    in_clusters: dict[int, int] = {}
    out, opened = [], 0
    for item, (size, source, cluster) in enumerate(zip(sizes, sources, clusters, strict=True)):
        piece = 0
        while size > capacity:
            out.append((item, piece, opened, 0, capacity))
            size, piece, opened = size - capacity, piece + 1, opened + 1
        s, c = source_bit[source], cluster_bit.get(cluster, 0)
        at = bisect_left(room, (size, -1))
        while at < len(room) and (in_sources[room[at][1]] & s or in_clusters[room[at][1]] & c):
            at += 1
        if at < len(room):
            left, bin_ = room.pop(at)
        else:
            left, bin_ = capacity, opened
            in_sources[bin_] = in_clusters[bin_] = 0
            opened += 1
        out.append((item, piece, bin_, capacity - left, size))
        in_sources[bin_] |= s
        in_clusters[bin_] |= c
        if left > size:
            insort(room, (left - size, bin_))
    return out


def measured(docs: DataFrame, tokenizer_path: str | None = None, cluster: str | None = None) -> DataFrame:
    """(doc_id, source, cluster, n_tokens), cluster being a digest"""
    shared = SharedTokenizer(docs.sparkSession, tokenizer_path or word_bpe_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shared.tokenizer().counter()
        for batch in sliced(batches):
            texts = batch.column(2).to_pylist()
            n = pa.array(count(texts)[0] + 1, pa.int64())
            same = (b" ".join(t.split()) if c is None else c.encode() for t, c in zip(texts, batch.column(3).to_pylist(), strict=True))
            found = pa.array([xxhash.xxh3_128_digest(x) for x in same], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found, n], ["doc_id", "source", "cluster", "n_tokens"])

    given = F.coalesce(F.concat(F.lit("="), named(cluster).cast("string")), F.concat(F.lit("row "), F.monotonically_increasing_id())) if cluster else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.encode(whole(F.col("text")), "UTF-8").alias("text"), given.alias("given"))
    return rows.mapInArrow(run, "doc_id long, source string, cluster binary, n_tokens long")


def packed(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, tokenizer_path: str | None = None, scratch: Scratch | None = None, cluster: str | None = None) -> DataFrame:
    """One row per document, or per piece of a long one: doc_id, piece, bin_id, bin_start, n_tokens, doc_start, source, cluster."""
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    items = scratch.put(measured(docs, tokenizer_path, cluster).withColumn("tag", F.monotonically_increasing_id()), "items")
    n_shards = max(1, -(-items.count() // shard_rows))
    items = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "tag"), F.lit(n_shards)))

    def run(shard: pa.Table) -> pa.Table:
        # longest first; a null identifier after all others
        rows = sorted(shard.to_pylist(), key=lambda r: (-r["n_tokens"], r["doc_id"] is None, r["doc_id"] or 0, r["tag"]))
        found = pack([r["n_tokens"] for r in rows], [r["source"] for r in rows], [r["cluster"] for r in rows], capacity)
        out = [(r["doc_id"], piece, (r["shard"] << 32) + bin_, start, size, piece * capacity, r["source"], r["cluster"].hex()) for item, piece, bin_, start, size in found for r in (rows[item],)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types.values(), strict=True)], list(types))

    types = {"doc_id": pa.int64(), "piece": pa.int32(), "bin_id": pa.int64(), "bin_start": pa.int32(), "n_tokens": pa.int32(), "doc_start": pa.int64(), "source": pa.string(), "cluster": pa.string()}
    schema = "doc_id long, piece int, bin_id long, bin_start int, n_tokens int, doc_start long, source string, cluster string"
    return items.groupBy("shard").applyInArrow(run, schema)
