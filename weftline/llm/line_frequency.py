"""Quality rules: lines that too many documents of a host share, and documents they deplete.

Lines are normalised (lower case, white space squeezed, trimmed) and hashed to 128 bits. Per host
(``source``) the distinct documents that hold a line are counted: rows of a host with equal text count
as one document, so that copies of a page do not make its lines boilerplate. Lines of every length are
counted. A line is removed if over MIN_DOCUMENTS documents hold it and over the square root of the
host's documents, a limit that a large host's boilerplate cannot hide below. A document is depleted, and
rejected, if removed lines held over DEPLETED of its words. Base rules reject short and repetitive documents.

All of it is DataFrame functions. Lines are counted from one row per host and distinct text, which
pre-aggregation makes before the shuffle; the counts are pre-aggregated too, so that a line that every
document has sends one row a task. Few removable lines travel as one short array per host. Over
BROADCAST_KEYS of them, or HOST_KEYS of one host, lines are joined with them by host and key, salted, and
each text gets the array of its own removable lines; the result is the same.

Defined results: a null text has no words and fails the base rules; a null source is the empty host;
lines without a word are never counted nor removed; rows that repeat a document are judged alike.
An empty table gives no rows. Extra columns are ignored by ``report`` and kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch
from weftline.llm.text import SPACE, bind, row_of, whole

MIN_DOCUMENTS = 10
DEPLETED = 0.5
MIN_WORDS = 50
REPEAT_PERCENT = 50
#: Keys and hosts, of some 50 bytes each, that are broadcast at most.
BROADCAST_KEYS = 200_000
#: Removable lines of one host that are searched as an array at most.
HOST_KEYS = 512
#: Parts into which a line's documents are dealt when lines are joined.
SALTS = 16
SYMBOLS = "#*$%&|<>"


def line_words(line: Column) -> Column:
    return F.size(F.array_remove(F.split(line, SPACE + "+"), ""))


def line_key(line: Column) -> Column:
    """128 bits of the normalised line."""
    norm = F.lower(F.trim(F.regexp_replace(line, SPACE + "+", " ")))
    return bind(norm, lambda n: F.struct(F.xxhash64(n).alias("a"), F.xxhash64(F.lit(7), n).alias("b")))


def _lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _host(docs: DataFrame) -> Column:
    return F.coalesce(docs["source"].cast("string"), F.lit(""))


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")]


def removable(
    docs: DataFrame,
    scratch: Scratch,
    min_documents: int = MIN_DOCUMENTS,
    broadcast_keys: int = BROADCAST_KEYS,
    host_keys: int = HOST_KEYS,
) -> DataFrame:
    """(host, bad): the keys of each host's removable lines; if they are many, (host, t1, t2, bad): those of each text."""
    text = whole(F.col("text"))
    keys = F.array_distinct(F.transform(_lines(F.col("text")), line_key))
    texts = docs.select(_host(docs).alias("host"), text.alias("text")).select("host", *_text_key(F.col("text")), keys.alias("keys"))
    texts = texts.groupBy("host", "t1", "t2").agg(F.first("keys").alias("keys"))
    # the null key stands for the document itself, and so counts the host's documents
    marks = F.concat(F.col("keys"), F.array(F.lit(None).cast("struct<a:bigint,b:bigint>")))
    counts = texts.select("host", F.explode(marks).alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
    counts = scratch.put(counts.where(F.col("key").isNull() | (F.col("n") > min_documents)), "line-counts")
    hosts = counts.where("key is null").select("host", F.col("n").alias("host_documents"))
    # few keys are left of a host at this point, and one row a host: a hot host is a skewed join that Spark splits
    bad = counts.where("key is not null").join(hosts, "host").where("n * n > host_documents").select("host", "key")
    bad = scratch.put(bad, "removable")
    total, most = bad.groupBy("host").agg((F.count(F.lit(1)) + 1).alias("n")).agg(F.sum("n"), F.max("n")).first()
    if (total or 0) <= broadcast_keys and (most or 0) <= host_keys:
        return F.broadcast(bad.groupBy("host").agg(F.collect_list("key").alias("bad")))
    found = texts.select("host", "t1", "t2", F.explode("keys").alias("key"))
    if total <= broadcast_keys:
        found = found.join(F.broadcast(bad), ["host", "key"])
    else:
        salted = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = found.withColumn("salt", F.pmod("t2", F.lit(SALTS)).cast("int")).join(salted, ["host", "key", "salt"])
    return scratch.put(found.groupBy("host", "t1", "t2").agg(F.collect_list("key").alias("bad")), "removable-by-text")


def repeat_words(trigrams: Column) -> Column:
    """Words in windows whose hash comes twice or more: sorted windows show the repeats, and their places,
    sorted again, the words they cover. Linear but for the sorts, also for long texts."""

    def places(pairs: Column) -> Column:
        near = lambda p, k: (F.get(pairs, k + 1)["h"] == p["h"]) | ((k > 0) & (F.get(pairs, F.greatest(k - 1, F.lit(0)))["h"] == p["h"]))
        return F.sort_array(F.transform(F.filter(pairs, lambda p, k: F.coalesce(near(p, k), F.lit(False))), lambda p: p["i"]))

    pairs = F.sort_array(F.transform(trigrams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("words"))
    step = lambda acc, i: F.struct(i.alias("last"), (acc["words"] + F.least(F.lit(3), i - acc["last"])).alias("words"))
    return F.aggregate(bind(pairs, places), start, step, lambda acc: acc["words"])


def measured(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """docs as (row, text, lines, bad, ...) with the base counts, removed_words and the verdicts."""
    rows = docs.select(row_of(docs).alias("row"), _host(docs).alias("host"), whole(F.col("text")).alias("text"))
    if "t1" in bad.columns:
        rows = rows.select("*", *_text_key(F.col("text"))).join(bad, ["host", "t1", "t2"], "left")
    else:
        rows = rows.join(bad, "host", "left")
    rows = rows.withColumn("w", F.array_remove(F.split("text", SPACE + "+"), ""))
    rows = rows.withColumn("lines", F.split("text", "\n"))
    rows = rows.withColumn("g", F.transform(F.expr("slice(w, 1, greatest(size(w) - 2, 0))"), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))))
    with_word = rows.select("*", F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("full"))
    rows = with_word.select(
        "row",
        "lines",
        "bad",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("g")) < F.size("g"), repeat_words(F.col("g"))).otherwise(0).cast("long").alias("n_repeat_words"),
        F.when(F.col("bad").isNull(), 0)
        .otherwise(F.aggregate(F.filter("full", lambda x: is_bad(x)), F.lit(0), lambda n, x: n + line_words(x)))
        .cast("long")
        .alias("removed_words"),
    )
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", base)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") <= DEPLETED * F.col("n_words")))


def is_bad(line: Column) -> Column:
    return F.array_contains(F.col("bad"), line_key(line))


def line_frequency(docs: DataFrame, scratch: Scratch | None = None, **limits) -> DataFrame:
    """One row per document: doc_id, counts, base_failed, kept, removed_words."""
    bad = removable(docs, scratch or Scratch(docs.sparkSession, "line-frequency"), **limits)
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"]
    return measured(docs, bad).select("row.doc_id", *columns)


def clean(docs: DataFrame, scratch: Scratch | None = None, **limits) -> DataFrame:
    """The kept documents without their removed lines, with the columns of docs; n_chars follows the text."""
    bad = removable(docs, scratch or Scratch(docs.sparkSession, "line-frequency"), **limits)
    rest = F.array_join(F.filter("lines", lambda x: ~(x.rlike(r"[^\x20\x09-\x0D]") & is_bad(x))), "\n")
    text = F.when(F.col("removed_words") > 0, rest).otherwise(F.col("row.text"))
    # an outer explode, filtered after it: a plain filter would be pushed down and measure each text twice
    out = measured(docs, bad).select("row", F.explode_outer(F.when(F.col("kept"), F.array(text))).alias("rest")).where("rest is not null")
    values = {"text": F.col("rest"), "n_chars": F.length("rest").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    fields = {c: F.col("row").getField(c) for c in docs.columns}
    return out.select(*[(values[c] if values.get(c) is not None else fields[c]).alias(c) for c in docs.columns])
