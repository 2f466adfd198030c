"""Sharding by a two-pass external shuffle: uniform buckets, then Fisher-Yates within each.

First pass: each row goes to one of many buckets by a hash of the seed, its doc_id and its place in the
input, so that neither a repeated key nor repeated texts fill a bucket. There are as many buckets as keep
each within BUCKET_BYTES of text on average, and PER_TASK for each shuffle partition at least; the bytes
on disk are Spark's shuffle files. Second pass: a bucket is put into the order of its rows' places, which no
arrival order disturbs, shuffled by Fisher-Yates with a generator seeded by seed and bucket, and written.

Buckets follow each other in one global order; how many rows precede a bucket is a prefix sum of counts,
added up by blocks of buckets. Shard s of S holds the places from ceil(s * n / S) on, so that counts of rows
differ by one at most (the law ``rows``), and a row's slot is its place within its shard. Uniform buckets and
uniform orders within them make every order of the whole table equally likely, up to the hash.

Shards are written as Parquet folders shard=0, shard=1, ... by Spark's commit protocol: the row as one
struct, whatever columns it has, and its slot. A task that is lost is repeated with the same rows in the same order.

The input is read three times (bytes, doc_id alone, rows) and must give the same rows in the same
partitions each time, as a table of files does: what follows from a shuffle is to be written down first. A
bucket whose rows are not as many as were counted raises. Same files, read settings, seed and number of
buckets give the same shards.

Defined results: a null text has no bytes; null and repeated doc_ids, ties and repeated rows are rows like
others, each in one slot. Fewer rows than shards leave shards without rows. An empty table gives no rows.
Columns of any name are kept inside ``row``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch
from weftline.llm.text import row_of, whole

SHARDS = 16
SEED = 20240607
#: Bytes of text of a bucket on average at most; a task holds one bucket in memory, twice while it is reordered.
BUCKET_BYTES = 32 << 20
#: Buckets for each shuffle partition at least, so that hashed buckets load the tasks evenly.
PER_TASK = 4
#: Buckets of a block in the prefix sum.
BLOCK = 4096


def fisher_yates(n: int, generator: np.random.Generator) -> np.ndarray:
    """A uniform order of n places: from the last place down, each swaps with one that is not after it."""
    order = list(range(n))
    partners = generator.integers(0, np.arange(1, n + 1)).tolist() if n else []
    for i in range(n - 1, 0, -1):
        j = partners[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def preceding(counts: DataFrame) -> DataFrame:
    """(bucket, n, begin): begin is how many rows the buckets before hold. Blocks are added up first, then buckets within each."""
    blocked = counts.withColumn("block", F.floor(F.col("bucket") / BLOCK))
    blocks = blocked.groupBy("block").agg(F.sum("n").alias("block_n"))
    before = W.rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("block_n").over(before.orderBy("block")), F.lit(0)).alias("block_begin"))
    within = F.coalesce(F.sum("n").over(W.partitionBy("block").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return blocked.withColumn("within", within).join(blocks, "block").select("bucket", "n", (F.col("block_begin") + F.col("within")).alias("begin"))


class ExternalShuffle:
    def __init__(self, docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, scratch: Scratch | None = None):
        spark = docs.sparkSession
        self.docs, self.shards, self.seed = docs, shards, seed
        self.scratch = scratch or Scratch(spark, "external-shuffle")
        held = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(whole(F.col("text")))).alias("bytes")).first()
        self.n_rows = held.n
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.n_buckets = max(1, min(held.n, max(-(-(held.bytes or 0) // bucket_bytes), PER_TASK * tasks)))
        counts = self._scattered(docs.select("doc_id")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
        self.offsets = self.scratch.put(preceding(self.scratch.put(counts, "counts")), "offsets")

    def _scattered(self, rows: DataFrame, *keep: Column) -> DataFrame:
        """(keep..., place, bucket) of every row."""
        placed = rows.select(*keep, "doc_id", F.monotonically_increasing_id().alias("place"))
        bucket = F.pmod(F.xxhash64(F.lit(self.seed), "doc_id", "place"), F.lit(self.n_buckets)).alias("bucket")
        return placed.select(*[c for c in placed.columns if c != "doc_id"], bucket)

    def shuffled(self) -> DataFrame:
        """(row, shard, slot) of every row."""
        seed, shards, total = self.seed, self.shards, self.n_rows

        def deal(key: tuple, rows: pa.Table, counted: pa.Table) -> pa.Table:
            n = rows.num_rows
            if counted.num_rows != 1 or counted["n"][0].as_py() != n:
                raise ValueError(f"bucket {key[0].as_py()} has {n} rows, other than counted: the input changed between passes")
            order = np.argsort(rows["place"].to_numpy(), kind="stable")
            order = order[fisher_yates(n, np.random.default_rng([seed, key[0].as_py()]))]
            place = counted["begin"][0].as_py() + np.arange(n, dtype=np.int64)
            shard = place * shards // total
            slot = place - -(-shard * total // shards)
            return pa.table({"row": rows["row"].take(pa.array(order)), "shard": pa.array(shard, pa.int32()), "slot": pa.array(slot, pa.int64())})

        rows = self._scattered(self.docs, row_of(self.docs).alias("row"))
        kind = rows.schema["row"].dataType.simpleString()
        return rows.groupBy("bucket").cogroup(self.offsets.groupBy("bucket")).applyInArrow(deal, f"row {kind}, shard int, slot long")

    def write(self, path: str) -> DataFrame:
        """The shards, written under path and read back: (row, slot, shard)."""
        rows = self.shuffled()
        rows.write.partitionBy("shard").parquet(path)
        return self.docs.sparkSession.read.schema(rows.schema).parquet(path)


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """Per document, read back from its shard: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: no law ``key``)."""
    shuffle = ExternalShuffle(docs, shards, seed, bucket_bytes, scratch)
    text = whole(F.col("row.text"))
    return shuffle.write(shuffle.scratch.path("shards")).select(
        F.col("row.doc_id").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
