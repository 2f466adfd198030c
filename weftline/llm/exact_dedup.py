"""Exact duplicates by a log-structured merge index of text digests.

Documents arrive in memtables: equal stretches of rows in the order of the input, MEMTABLES of them or more, so that none
holds over MEMTABLE_ROWS, whatever the input's partitions. Each memtable that has rows is flushed as a run: one row per digest with its smallest
identifier and its rows, sorted by digest, with a Bloom filter beside it. The digests of a new run are asked
of the filters of all older runs; those that no filter may hold are new, the others are looked up in the
runs by digest. When a level has FANOUT runs, compaction merges them into one sorted run of the next level
and keeps the smallest identifier of each digest. Runs are never merged for the sake of a look-up: what
several runs hold is known from the hits, and only those digests are gathered from the runs. A text that
hits another one's digest is verified byte for byte.

Everything is DataFrame functions. Only digests are shuffled, never whole texts: verification asks of
each shared digest whether the least and the greatest text under it are the same bytes, and both are
pre-aggregated where the texts are read, so a group of copies of any size sends one row per task.
A blocked Bloom filter of the shared digests, of at most 64 MiB, is broadcast, so that only texts with a
likely hit are verified; a false hit costs time, never a result. It is a third full at 200 million shared
digests; with many more of them more texts are verified than need be.

Defined results: a null text is an empty one. Of equal texts the row with the smallest doc_id stays; a
null doc_id counts as greater than all others; of rows that repeat a doc_id and a text one stays.
An empty table gives no rows. Extra columns are ignored by ``report`` and kept by ``keep_first``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weftline.llm.bloom import asked, blocks_for, filter_of, with_likely
from weftline.llm.external_shuffle import preceding
from weftline.llm.scratch import Scratch
from weftline.llm.text import row_of, squeezed

MEMTABLES = 7
MEMTABLE_ROWS = 500_000_000
FANOUT = 3


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


@dataclass
class Run:
    """digests: (digest, first, n), first being struct(no_id, doc_id, tag); blocks: their filter."""

    digests: DataFrame
    blocks: DataFrame
    n_blocks: int


class DigestIndex:
    """Runs under root/level=L/run=R, the filter of each under root/filter/run=R."""

    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT):
        self.spark, self.root, self.fanout = spark, root, fanout
        self.levels: dict[int, list[Run]] = {}
        self.hits: list[DataFrame] = []
        self.written = 0

    @property
    def runs(self) -> list[Run]:
        return [run for level in sorted(self.levels) for run in self.levels[level]]

    def _put(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{path}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{path}")

    def _write(self, df: DataFrame, level: int) -> Run:
        k = self.written = self.written + 1
        told = Observation()
        digests = self._put(df.sortWithinPartitions("digest").observe(told, F.count(F.lit(1)).alias("n")), f"level={level}/run={k}")
        n_blocks = blocks_for(told.get.get("n") or 0)
        return Run(digests, self._put(filter_of(digests, n_blocks, ["digest"]), f"filter/run={k}"), n_blocks)

    def flush(self, entries: DataFrame) -> None:
        """Write a memtable's entries (digest, doc_id, tag) as a run, note what older runs hold of it, and compact a level that is full."""
        order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag")
        run = self._write(entries.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")), 0)
        if self.runs:
            self.hits.append(self._put(self.held(run.digests.select("digest")), f"hits/run={self.written}"))
        self.levels.setdefault(0, []).append(run)
        level = 0
        while len(self.levels.get(level, [])) >= self.fanout:
            full = reduce(DataFrame.unionByName, [r.digests for r in self.levels.pop(level)])
            merged = full.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
            level += 1
            self.levels.setdefault(level, []).append(self._write(merged, level))

    def may_hold(self, digests: DataFrame) -> list[DataFrame]:
        """For each run the digests that its filter cannot rule out."""
        return [asked(digests, run.blocks, run.n_blocks, ["digest"]).where("likely").select("digest") for run in self.runs]

    def held(self, digests: DataFrame) -> DataFrame:
        """Those of digests, each once, that a run holds: first by the filters, then by look-up of what they let through."""
        found = [likely.join(run.digests.select("digest"), "digest") for likely, run in zip(self.may_hold(digests), self.runs, strict=True)]
        return reduce(DataFrame.unionByName, found).distinct()

    def shared(self, scratch: Scratch) -> DataFrame:
        """(digest, first, n) of the digests of two rows or more, from all runs."""
        repeated = [run.digests.where("n > 1").select("digest") for run in self.runs]
        names = scratch.put(reduce(DataFrame.unionByName, [*repeated, *self.hits]).distinct(), "shared-names")
        rows = with_likely(reduce(DataFrame.unionByName, [run.digests for run in self.runs]), names, names.count(), ["digest"]).where("likely").drop("likely")
        return rows.join(names, "digest", "left_semi").groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n"))


def memtable_cuts(entries: DataFrame, memtables: int) -> list[int]:
    """The first tag of each memtable: stretches of equal numbers of rows in the order of tags.

    A tag is an input partition and a row's number in it, from 0 without a gap; how many rows lie before a partition is
    a prefix sum. As many numbers come to the driver as there are memtables.
    """
    counts = entries.groupBy(F.shiftright("tag", 33).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    rows = entries.count()  # of Parquet footers
    if not rows:
        return []
    m = max(memtables, -(-rows // MEMTABLE_ROWS))
    # memtable k begins at row k * rows / m; those that begin in a partition are a range of k
    starts = lambda at: f"cast(({at} * {m} + {rows - 1}) div {rows} as long)"
    placed = preceding(counts).withColumns({"low": F.expr(starts("begin")), "high": F.expr(f"{starts('(begin + n)')} - 1")}).where("low <= high")
    cuts = placed.select("bucket", "begin", F.explode(F.sequence("low", "high")).alias("k"))
    return sorted({r.tag for r in cuts.selectExpr(f"shiftleft(bucket, 33) + (k * {rows}) div {m} - begin AS tag").collect()})


class ExactDedup:
    """The index over a table of documents, and what follows from it.

    ``digest`` may be a weaker function of the normalised text: texts that only share a digest are told
    apart by verification and grouped by their bytes.
    """

    def __init__(self, docs: DataFrame, memtables: int = MEMTABLES, digest=sha256, scratch: Scratch | None = None):
        self.docs, self.digest = docs, digest
        self.scratch = scratch or Scratch(docs.sparkSession, "exact-dedup")
        entries = docs.select(
            "doc_id",
            digest(squeezed(F.col("text"))).alias("digest"),
            sha256(squeezed(F.col("text"))).alias("sha"),
            F.monotonically_increasing_id().alias("tag"),
        )
        self.entries = self.scratch.put(entries, "entries")
        self.index = DigestIndex(docs.sparkSession, self.scratch.path("index"))
        cuts = memtable_cuts(self.entries, memtables) or [0]
        for begin, end in zip(cuts, [*cuts[1:], None], strict=True):
            # tags ascend within a file: files and row groups of other memtables are skipped by their statistics
            mine = F.col("tag") >= begin
            self.index.flush(self.entries.where(mine if end is None else mine & (F.col("tag") < end)))
        self.shared = self.scratch.put(self.index.shared(self.scratch), "shared")
        self.n_shared = self.shared.count()
        self.collided = self._verify()

    def _probed(self) -> DataFrame:
        """Documents as (row, doc_id, norm, digest, likely): likely ones may share their digest."""
        rows = self.docs.select(row_of(self.docs).alias("row"), "doc_id", squeezed(F.col("text")).alias("norm"))
        return with_likely(rows.withColumn("digest", self.digest(F.col("norm"))), self.shared, self.n_shared, ["digest"])

    def _verify(self) -> DataFrame:
        """Digests whose texts differ."""
        seen = self._probed().where("likely").groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
        collided = self.scratch.put(seen.where("low <> high").select("digest"), "collided")
        self.n_collided = collided.count()
        return collided

    def report(self) -> DataFrame:
        """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
        first = F.coalesce(F.col("first"), F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag"))
        entries = self.entries
        if self.n_collided:
            entries = entries.join(self.collided, "digest", "left_anti")
        found = entries.join(self.shared, "digest", "left").select(
            "doc_id",
            first["doc_id"].alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            (first["tag"] == F.col("tag")).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
        if self.n_collided:
            rows, first_of = self._by_bytes()
            found = found.unionByName(
                rows.join(first_of, ["digest", "norm"]).select(
                    "doc_id",
                    F.col("first.doc_id").alias("keep_id"),
                    F.col("n").alias("group_size"),
                    (F.col("first.tag") == F.col("tag")).alias("kept"),
                    F.lower(F.hex(sha256(F.col("norm")))).alias("text_sha256"),
                )
            )
        return found

    def keep_first(self) -> DataFrame:
        """The rows that stay, with the columns of docs. Of likely copies one row per digest and task is shuffled."""
        probed = self._probed()
        if self.n_collided:
            probed = probed.join(self.collided, "digest", "left_anti")
        alone = probed.where("not likely").select("row")
        # the row of the least identifier under each digest, found where the rows are read before one a task is shuffled
        order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")
        firsts = probed.where("likely").groupBy("digest").agg(F.min_by(F.col("row"), order).alias("row")).select("row")
        kept = alone.unionByName(firsts)
        if self.n_collided:
            rows, first_of = self._by_bytes()
            kept = kept.unionByName(rows.join(first_of, ["digest", "norm"]).where("first.tag = tag").select("row"))
        return kept.select("row.*")

    def _by_bytes(self) -> tuple[DataFrame, DataFrame]:
        """Documents under a digest that differing texts share, and the first of each of those texts."""
        if not hasattr(self, "_bytes"):
            rows = self._probed().where("likely").join(self.collided, "digest", "left_semi")
            rows = self.scratch.put(rows.select("row", "doc_id", "digest", "norm", F.monotonically_increasing_id().alias("tag")), "by_bytes")
            first_of = rows.groupBy("digest", "norm").agg(
                F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag")).alias("first"), F.count(F.lit(1)).alias("n")
            )
            self._bytes = rows, first_of
        return self._bytes


def exact_dedup(docs: DataFrame, memtables: int = MEMTABLES) -> DataFrame:
    return ExactDedup(docs, memtables).report()
