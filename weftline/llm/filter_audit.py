"""An audit of how document filters overlap: what each removes, in every order they may be applied in.

Five filters look at a whole text: A, fewer than 100 words; B, distinct words under 80 % of them; C, letters A to Z
over 10 % of its code points; D, one of ``#$%&*|``; E, the text of a row with a smaller doc_id again. Which of
them a document fails is a mask of five bits, and all that any order of the filters does follows from how many
documents have each mask: of 120 orders no more than a count vector of 32 masks is needed.

E is found by fingerprints. Rows whose fingerprint (xxhash, 64 bits) comes once cannot be copies and are told by a Bloom
filter of the repeated ones, so that their texts are not moved. The others are routed: partitioned by
fingerprint, where chains keep for each fingerprint the full texts under it and the smallest identifier of each text.
An identifier that is not its text's smallest is emitted as soon as that is known. Chains also work where rows
are read, in buffers of BUFFER_BYTES: the copies that a task sees leave it as one row a text, and once more where
those rows are read again, so that a group of copies of any size is routed as some rows a task.

Counts are combined by part (a row's lang) with combineByKey into vectors of all documents, good ones and toxic ones
per mask, which are merged before and after the shuffle; each vector is then written out as the 600 steps of the 120 orders.

The input is read twice (fingerprints, then texts); both readings may differ in order.

Defined results: a null text is empty; a null lang is the part of the empty string; a null doc_id is greater than
all others; rows that repeat a doc_id and a text are no copies of a smaller one; each row of documents counts, also
those that repeat a doc_id. Labels count as 1 if any row of their doc_id has 1. An empty table has no part and gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from typing import Any

import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.bloom import with_likely
from weftline.llm.scratch import Scratch
from weftline.llm.text import whole

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
COPY = 1 << FILTERS.index("E")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
MARKS = b"#$%&*|"
#: Bytes of texts that a task's chains hold before they are let go, and of a partition of routed texts on average at most.
BUFFER_BYTES = 16 << 20
ROUTE_BYTES = 32 << 20
#: Rows of an Arrow batch that are Python objects at once.
SLICE = 256


def text_mask(text: str) -> int:
    """Which of A to D a text fails, as bits."""
    raw = text.encode()
    words = raw.split()  # at ASCII white space, which is what separates words
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    failed = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * capitals > 10 * len(text), len(raw.translate(None, MARKS)) < len(raw))
    return sum(1 << i for i, x in enumerate(failed) if x)


#: What is known of rows of one identifier and text: (doc_id, mask, part, n).
Emitted = tuple[Any, int, str, int]


class Chains:
    """Per fingerprint the texts under it, each with its smallest identifier and how many rows of each part have that."""

    def __init__(self):
        self.chains: dict[int, list[list]] = {}
        self.size = 0

    @staticmethod
    def _before(a: int | None, b: int | None) -> bool:
        return a is not None and (b is None or a < b)

    def add(self, fp: int, text: str, doc_id: int | None, mask: int, part: str, n: int) -> list[Emitted]:
        """Takes rows in; returns those that are known not to have the smallest identifier."""
        chain = self.chains.setdefault(fp, [])
        for entry in chain:
            if entry[0] == text:
                break
        else:
            chain.append([text, doc_id, mask, {part: n}])
            self.size += len(text) + 200
            return []
        least = entry[1]
        if doc_id == least:
            entry[3][part] = entry[3].get(part, 0) + n
            return []
        if self._before(least, doc_id):
            return [(doc_id, mask | COPY, part, n)]
        greater = [(least, mask | COPY, p, k) for p, k in entry[3].items()]
        entry[1], entry[3] = doc_id, {part: n}
        return greater

    def taken(self) -> Iterator[tuple]:
        """(fp, text, doc_id, mask, part, n) of the smallest identifiers; the chains are empty after it."""
        chains, self.chains, self.size = self.chains, {}, 0
        for fp, chain in chains.items():
            for text, doc_id, mask, parts in chain:
                for part, n in parts.items():
                    yield fp, text, doc_id, mask, part, n


def fingerprint(text: Column) -> Column:
    return F.xxhash64(text)


COLUMNS = {"fp": pa.int64(), "text": pa.string(), "doc_id": pa.int64(), "mask": pa.int32(), "part": pa.string(), "n": pa.int64()}
AUDITED = "fp long, text string, doc_id long, mask int, part string, n long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, COLUMNS.values(), strict=True)], list(COLUMNS))


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, part, text, fp, likely) as rows of AUDITED: with a text those that are to be routed, without one those that are settled."""
    chains = Chains()
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            out = []
            for doc_id, part, text, fp, likely in zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns), strict=True):
                mask = text_mask(text)
                known = chains.add(fp, text, doc_id, mask, part, 1) if likely else [(doc_id, mask, part, 1)]
                out += [(None, None, *row) for row in known]
                if chains.size > BUFFER_BYTES:
                    out += chains.taken()
            yield _batch(out)
    rest = list(chains.taken())
    for at in range(0, len(rest), SLICE):
        yield _batch(rest[at : at + SLICE])


def _combined(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Before rows are routed: (fp, (text, ...)) of what a task's chains hold, (None, emitted) of what they settle."""
    chains = Chains()
    for row in rows:
        yield from ((None, settled) for settled in chains.add(*row))
        if chains.size > BUFFER_BYTES:
            yield from ((fp, rest) for fp, *rest in chains.taken())
    yield from ((fp, rest) for fp, *rest in chains.taken())


def _settled(rows: Iterator[tuple]) -> Iterator[Emitted]:
    """All rows of a partition's fingerprints: those with a smallest identifier come last."""
    chains = Chains()
    for fp, row in rows:
        if fp is None:
            yield tuple(row)
        else:
            yield from chains.add(fp, *row)
    for _, _, *row in chains.taken():
        yield tuple(row)


class FilterAudit:
    """masks: (doc_id, mask, part, n) of all documents, the audit's own record; ``steps`` is its report.

    ``digest`` may be a weaker function of the text: texts that only share a fingerprint are told apart by their chains.
    """

    def __init__(self, docs: DataFrame, digest=fingerprint, scratch: Scratch | None = None):
        self.spark = docs.sparkSession
        self.scratch = scratch or Scratch(self.spark, "filter-audit")
        text = whole(F.col("text"))
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("lang")).alias("part"), text.alias("text"), digest(text).cast("long").alias("fp"))
        repeated = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("fp")
        repeated = self.scratch.put(repeated, "repeated")
        likely = with_likely(rows, repeated, repeated.count(), ["fp"]).select("doc_id", "part", "text", "fp", "likely")
        audited = self.scratch.put(likely.mapInArrow(_audit, AUDITED), "audited")
        self.routed = audited.where("text is not null")
        record = "doc_id long, mask int, part string, n long"
        chained = self.scratch.put(self.spark.createDataFrame(self._route(self.routed), record), "chained")
        self.masks = audited.where("text is null").select("doc_id", "mask", "part", "n").unionByName(chained)

    def _route(self, routed: DataFrame) -> RDD:
        held = routed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-held // ROUTE_BYTES))
        rows = routed.select(*COLUMNS).rdd.map(tuple).mapPartitions(_combined)
        # what is settled already goes nowhere in particular, by the hash of its identifier
        keyed = rows.map(lambda kv: (kv[0] if kv[0] is not None else (kv[1][0] or 0), kv))
        return keyed.partitionBy(tasks, lambda key: key % tasks).map(lambda kv: kv[1]).mapPartitions(_settled)

    def copies(self) -> DataFrame:
        """(doc_id) of the rows that fail E, a row of documents each."""
        copies = self.masks.where(F.col("mask").bitwiseAND(COPY) != 0)
        return copies.select("doc_id", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int")))).select("doc_id")

    def vectors(self, labels: DataFrame) -> RDD:
        """(part, counts): per mask all documents, then the good ones, then the toxic ones."""
        one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
        marks = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(one("quality"), one("toxic"))
        no = F.lit(False)
        named = self.masks.where("doc_id is not null").join(marks, "doc_id", "left").select("part", "mask", "n", F.coalesce("quality", no).alias("quality"), F.coalesce("toxic", no).alias("toxic"))
        nameless = self.masks.where("doc_id is null").select("part", "mask", "n", no.alias("quality"), no.alias("toxic"))
        rows = named.unionByName(nameless).rdd.map(lambda r: (r.part, (r.mask, r.n, r.quality, r.toxic)))
        return rows.combineByKey(lambda row: _counted([0] * (3 * MASKS), row), _counted, lambda a, b: [x + y for x, y in zip(a, b, strict=True)])

    def steps(self, labels: DataFrame) -> DataFrame:
        """Per part, order and step what the step's filter does."""
        counts = "kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
        return self.spark.createDataFrame(self.vectors(labels).flatMap(lambda kv: steps_of(*kv)), f"part string, filter_order string, step int, {counts}")


def _counted(counts: list[int], row: tuple) -> list[int]:
    mask, n, quality, toxic = row
    counts[mask] += n
    counts[MASKS + mask] += n if quality else 0
    counts[2 * MASKS + mask] += n if toxic else 0
    return counts


def steps_of(part: str, counts: list[int]) -> Iterator[tuple]:
    """The 120 orders' steps of a part, of its counts by mask."""
    docs, good, toxic = counts[:MASKS], counts[MASKS : 2 * MASKS], counts[2 * MASKS :]
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    n_orders = 120
    over = lambda of, test: sum(n for mask, n in enumerate(of) if n and test(mask))
    unique = {f: docs[bit[f]] for f in FILTERS}
    # of a mask's filters each comes first in an equal share of all orders
    shapley = {f: sum(n * (n_orders // mask.bit_count()) for mask, n in enumerate(docs) if mask & bit[f]) for f in FILTERS}
    for order in permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            here = lambda mask: mask & bit[f] and not mask & before  # noqa: B023, E731
            now = before | bit[f]
            kept, removed = over(docs, lambda mask: not mask & now), over(docs, here)  # noqa: B023
            redundant = over(docs, lambda mask: mask & bit[f] and mask & before)  # noqa: B023
            yield part, "".join(order), step, kept, removed, redundant, unique[f], over(good, here), over(toxic, here), shapley[f]
            before = now


def filter_audit(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    return FilterAudit(docs, scratch=scratch).steps(labels)
