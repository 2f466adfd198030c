"""Delta-maintained token totals by source, language and tokenizer version.

A batch of changes (insert, revise, delete of a document under a tokenizer version) is turned into signed
deltas: minus what the ledger has of the document, plus what the change says. Deltas are added up before
the shuffle and written with the batch; totals are the sum of the deltas of all committed batches, as
addition needs no order. A batch is committed by a marker written last: a batch that was committed is
not applied again, and one that broke off leaves folders that no reader sees and its retry overwrites.

The ledger is a log of the latest state per entry (doc_id, copy, version), in ``buckets`` folders by hash of
doc_id and copy: a batch reads only the buckets of the documents it names, so that a small batch costs a
small read. Markers are empty files with the batch's number as name, one listing for all. After
COMPACT_AFTER batches the ledger is compacted to one base of the entries that are in, and the deltas to
one table of totals; a base takes effect by a marker of its own, and what it replaces stays readable until
``vacuum``.

Defined results: insert of a known document is a revision, revision of an unknown one an insert, delete
of an unknown one nothing. Of changes to one entry in a batch the one with the greatest seq counts, of
equal ones the greatest (op, n_tokens, source, lang). Null source or lang is a group of its own; a null
count is 0 tokens, and a document without a token is a document; rows with null doc_id or version address
nothing and are left out; ``copy``, 0 where a batch has no such column, tells apart rows that repeat a doc_id.
Batches are applied in the order of their numbers; a lower number than the last committed is refused.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch
from weftline.llm.text import whole
from weftline.llm.tokenizing import SharedTokenizer, word_bpe_path
from weftline.llm.wordtable import sliced

LEDGER = "doc_id long, copy long, version string, alive boolean, source string, lang string, n_tokens long, batch long"
DELTA = "source string, lang string, version string, n_docs long, n_tokens long"
BUCKETS = 64
#: Files that a batch writes to a bucket at most.
PARTS = 8
COMPACT_AFTER = 16
KEY = ["doc_id", "copy", "version"]


class TokenRollup:
    """buckets: so many that one's share of the ledger suits PARTS tasks; fixed for a root."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, compact_after: int = COMPACT_AFTER):
        self.spark, self.root, self.buckets, self.compact_after = spark, root, buckets, compact_after

    def _path(self, kind: str, batch: int, whole: bool = False) -> str:
        """The folder of a batch, or of the base that stands for all up to it."""
        return f"{self.root}/{kind}/part={batch:012d}{'-base' if whole else ''}"

    def _hadoop(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _marked(self, kind: str) -> list[int]:
        """The numbers of a kind's markers: one short file name each, in one listing."""
        path, fs = self._hadoop(f"{self.root}/{kind}")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []

    def _mark(self, kind: str, batch: int) -> None:
        path, fs = self._hadoop(f"{self.root}/{kind}/{batch:012d}")
        fs.create(path, True).close()

    def committed(self) -> list[int]:
        return self._marked("commits")

    def _tables(self, kind: str) -> list[str]:
        """The folders that make up the ledger or the deltas: the last base and the batches after it."""
        base = max(self._marked("bases"), default=None)
        later = [self._path(kind, b) for b in self.committed() if base is None or b > base]
        return later if base is None else [self._path(kind, base, whole=True), *later]

    def _ledger(self, buckets: list[int] | None = None) -> DataFrame:
        """The ledger's rows; of some buckets, only their folders are read."""
        tables = self._tables("ledger")
        if not tables:
            return self.spark.createDataFrame([], LEDGER)
        rows = self.spark.read.schema(LEDGER + ", part string, bucket int").option("basePath", f"{self.root}/ledger").parquet(*tables)
        return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).drop("part", "bucket")

    def _put_ledger(self, rows: DataFrame, path: str) -> None:
        columns = [c.split()[0] for c in LEDGER.split(", ")]
        bucket = F.pmod(F.xxhash64("doc_id", "copy"), F.lit(self.buckets)).cast("int")
        part = F.pmod(F.xxhash64("copy", "doc_id", "version"), F.lit(PARTS))
        rows = rows.select(*columns, bucket.alias("bucket"), part.alias("part")).repartition("bucket", "part").drop("part")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(path)

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply changes (doc_id, op, source, lang, version, n_tokens, seq[, copy]); False if the batch was committed before."""
        done = self.committed()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]} was committed")
        copy = F.coalesce(F.col("copy").cast("long"), F.lit(0)) if "copy" in changes.columns else F.lit(0).cast("long")
        rows = changes.where("doc_id is not null and version is not null").select(
            F.col("doc_id").cast("long").alias("doc_id"),
            copy.alias("copy"),
            "version",
            F.struct("seq", "op", F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"), "source", "lang").alias("x"),
        )
        now = rows.groupBy(*KEY).agg(F.max("x").alias("x"))
        now = now.select(*KEY, (F.col("x.op") != "delete").alias("alive"), "x.source", "x.lang", "x.n_tokens", F.lit(batch).cast("long").alias("batch"))
        # written first and read back: the changes are computed once; without its marker the batch is not seen
        self._put_ledger(now, self._path("ledger", batch))
        now = self.spark.read.schema(LEDGER + ", bucket int").parquet(self._path("ledger", batch))
        named = [r.bucket for r in now.select("bucket").distinct().collect()]  # BUCKETS numbers at most
        ledger = self._ledger(named if len(named) < self.buckets else None).join(now.select(*KEY), KEY, "left_semi")
        last = ledger.groupBy(*KEY).agg(F.max(F.struct("batch", "alive", "source", "lang", "n_tokens")).alias("was"))
        both = now.join(last, KEY, "left").where("alive or was.alive")
        now_side = F.struct("source", "lang", F.lit(1).alias("sign"), "n_tokens")
        was_side = F.struct(F.col("was.source").alias("source"), F.col("was.lang").alias("lang"), F.lit(-1).alias("sign"), F.col("was.n_tokens").alias("n_tokens"))
        sides = F.array_compact(F.array(F.when(F.col("alive"), now_side), F.when(F.col("was.alive"), was_side)))
        signed = both.select("version", F.explode(sides).alias("d")).select("version", "d.*")
        delta = signed.groupBy("source", "lang", "version").agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        delta.write.mode("overwrite").parquet(self._path("delta", batch))
        self._mark("commits", batch)
        if len(self._tables("delta")) > self.compact_after:
            self.compact()
        return True

    def _latest(self) -> DataFrame:
        last = self._ledger().groupBy(*KEY).agg(F.max(F.struct("batch", "alive", "source", "lang", "n_tokens")).alias("x"))
        return last.select(*KEY, "x.*").where("alive")

    def compact(self) -> None:
        """One base of the entries that are in and one of the totals, in place of all committed batches."""
        batch = self.committed()[-1]
        self._put_ledger(self._latest(), self._path("ledger", batch, whole=True))
        self.totals().write.mode("overwrite").parquet(self._path("delta", batch, whole=True))
        self._mark("bases", batch)

    def vacuum(self) -> None:
        """Deletes tables that the last base replaced; to be called when no reader is at them."""
        base = max(self._marked("bases"), default=-1)
        for kind in ("ledger", "delta"):
            for batch in [b for b in self.committed() if b <= base]:
                path, fs = self._hadoop(self._path(kind, batch))
                fs.delete(path, True)
            for older in [b for b in self._marked("bases") if b < base]:
                path, fs = self._hadoop(self._path(kind, older, whole=True))
                fs.delete(path, True)

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens of what is in, by the deltas."""
        tables = self._tables("delta")
        rows = self.spark.read.schema(DELTA).parquet(*tables) if tables else self.spark.createDataFrame([], DELTA)
        sums = rows.groupBy("source", "lang", "version").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def recounted(self) -> DataFrame:
        """The same from the ledger alone, to audit the deltas."""
        return self._latest().groupBy("source", "lang", "version").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def counted(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, source, lang, n_words, n_tokens) with the public tokenizer, of whole texts."""
    shared = SharedTokenizer(docs.sparkSession, tokenizer_path or word_bpe_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shared.tokenizer().counter()
        for batch in sliced(batches):
            n_tokens, n_words = count(batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n_words), pa.array(n_tokens)], ["doc_id", "source", "lang", "n_words", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.encode(whole(F.col("text")), "UTF-8").alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, lang string, n_words long, n_tokens long")


def rollup_of(docs: DataFrame, version: str = "word_bpe_49k", tokenizer_path: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Totals of every row of a table: documents come in twice, under a version ``words`` and, provisionally with
    their words as count, under the tokenizer's; a second batch deletes the first and revises the second to the
    tokenizer's counts. It is sent twice, as after a lost answer. Rows without a doc_id, and rows that repeat
    one, are entries of their own, told apart by the row's number in the written table of counts."""
    scratch = scratch or Scratch(docs.sparkSession, "token-rollup")
    rollup = TokenRollup(docs.sparkSession, scratch.path("rollup"))
    counts = scratch.put(counted(docs, tokenizer_path).withColumn("copy", F.monotonically_increasing_id()), "counts")
    counts = counts.withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))

    def batch(words_op: str, tokens_op: str, count: str) -> DataFrame:
        entry = lambda op, name, n: F.struct(F.lit(op).alias("op"), F.lit(name).alias("version"), F.col(n).alias("n_tokens"))
        both = F.explode(F.array(entry(words_op, "words", "n_words"), entry(tokens_op, version, count))).alias("e")
        return counts.select("doc_id", "copy", "source", "lang", F.lit(0).alias("seq"), both).select("doc_id", "copy", "source", "lang", "seq", "e.*")

    rollup.commit(1, batch("insert", "insert", "n_words"))
    revised = batch("delete", "revise", "n_tokens")
    rollup.commit(2, revised)
    rollup.commit(2, revised)
    return rollup.totals()
