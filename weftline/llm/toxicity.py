"""Toxicity scores of whole texts, from labelled rows.

The model (see subword.py) is fitted on the driver from at most ``max_rows`` labelled rows (8,000), those of the
least hashed doc_id; their identifiers are chosen from the labels alone and their texts are then fetched
with a broadcast of at most that many identifiers. Rows of over ``max_bytes`` of text (32 KiB) are not
learned from, so that the driver never holds more than 256 MB of texts. The parameters, about 2 MB
whatever the input's size, are broadcast; each whole text is scored where it is read, without a shuffle.

Rows of which crc32(doc_id as text) mod FOLDS is HELD_OUT are never learned from. Labels, lang, source
and doc_id are no inputs of a score.

Defined results: a null or wordless text scores what the bias gives. A null doc_id has no label and is
held out if crc32 of '' says so. Labels of a doc_id that disagree count as toxic; null ones are no
labels. With no labels every score is 0.5. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.subword import SubwordSoftmax
from weftline.llm.text import whole
from weftline.llm.wordtable import sliced

MAX_ROWS = 8000
MAX_BYTES = 32 << 10
FOLDS, HELD_OUT = 5, 0


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame, target: Column, max_rows: int, learned: Column | None = None, max_bytes: int = MAX_BYTES) -> list:
    """At most max_rows rows (text, label) of labelled documents for which ``learned`` holds, none of over max_bytes."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), target.alias("label")).where("doc_id is not null and label is not null")
    known = known.where(F.lit(True) if learned is None else learned).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(whole(F.col("text")), "UTF-8").alias("text")).where(F.octet_length("text") <= max_bytes)
    # at most max_rows identifiers are broadcast; the order makes the fit the same in every run
    rows = texts.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(max_rows)
    return rows.select("text", "label").collect()


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> SubwordSoftmax:
    rows = training_rows(docs, labels, (F.col("toxic") > 0).cast("int"), max_rows, fold(F.col("doc_id")) != HELD_OUT)
    return SubwordSoftmax(2).fit([bytes(r.text) for r in rows], [r.label for r in rows])


def score(docs: DataFrame, model: SubwordSoftmax) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model.state())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_all = SubwordSoftmax.of(shared.value).scorer()
        for batch in sliced(batches):
            scores = score_all(batch.column(2).to_pylist())[:, 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = (fold(F.col("doc_id")) == HELD_OUT).alias("held_out")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, F.encode(whole(F.col("text")), "UTF-8").alias("text"))
    return texts.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    return score(docs, fit(docs, labels, max_rows))
