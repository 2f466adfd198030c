"""Which fields of two collections hold the same, told by their values and not by their names.

A field is profiled where its values are read: how many there are, of which kinds, how long, and a MinHash of the set
of them. Each value is hashed once and falls into one of BINS bins, of which the least hash is kept; so a field is BINS
rows of fixed size, combined before they are shuffled, then one. Two fields are alike as their
value sets overlap, as far as kinds and lengths agree; fields without a common value, as counters or texts
that each side writes its own way, are compared by kind, length and how many values are distinct, which counts less. What is
left is one-to-one assignment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.records import key_of
from weftline.plans.assignment import one_to_one

#: Bins of the MinHash; an overlap is told to about 1 / sqrt(BINS).
BINS = 64
#: The score from which on fields are assigned, and what fields without a common value can reach at most.
ASSIGNED, BY_SHAPE = 0.2, 0.3
KINDS = ("BOOLEAN", "STRING", "NUMBER", "OTHER")


def profiled(items: DataFrame) -> DataFrame:
    """(field, n, n_distinct, mean_length, boolean, string, number, other, sketch) of items (item map<string,variant>).

    n: values that are there and not null; the four kinds are shares of them; n_distinct is an estimate.
    """
    values = items.select(F.explode("item").alias("field", "value")).where(~F.is_variant_null("value"))
    kind = F.schema_of_variant("value")
    kind = F.when(kind == "BOOLEAN", "BOOLEAN").when(kind == "STRING", "STRING").when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|INT|FLOAT|SMALLINT|TINYINT)"), "NUMBER").otherwise("OTHER")
    told = values.select("field", kind.alias("kind"), key_of(F.col("value")).alias("key")).select("field", "kind", F.length("key").alias("length"), F.xxhash64("key").alias("h"))
    bins = told.groupBy("field", F.pmod("h", F.lit(BINS)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h", 0.02).alias("n_distinct"), F.sum("length").alias("length"), F.min("h").alias("least"), *[F.count_if(F.col("kind") == k).alias(k.lower()) for k in KINDS]
    )
    n = F.sum("n")
    return bins.groupBy("field").agg(
        n.alias("n"),
        F.sum("n_distinct").alias("n_distinct"),
        (F.sum("length") / n).alias("mean_length"),
        *[(F.sum(k.lower()) / n).alias(k.lower()) for k in KINDS],
        F.map_from_entries(F.collect_list(F.struct("bin", "least"))).alias("sketch"),
    )


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, overlap, score) of each two fields of two profiles: as many rows as one has fields times the other's."""
    side = lambda df, s: df.select(F.lit(0).alias("one"), F.col("field").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in df.columns if c != "field"])
    pairs = side(a, "a").join(side(b, "b"), "one")  # fields of two services, tens of each
    same = F.size(F.map_filter("a_sketch", lambda k, least: least == F.try_element_at("b_sketch", k)))
    overlap = same / F.size(F.array_union(F.map_keys("a_sketch"), F.map_keys("b_sketch")))
    ratio = lambda c: F.least(F.col(f"a_{c}"), F.col(f"b_{c}")) / F.greatest(F.col(f"a_{c}"), F.col(f"b_{c}"), F.lit(1e-9))
    kinds = sum((F.least(F.col(f"a_{k.lower()}"), F.col(f"b_{k.lower()}")) for k in KINDS), F.lit(0.0))
    distinct = lambda s: F.col(f"{s}_n_distinct") / F.col(f"{s}_n")
    shape = kinds * ratio("mean_length") * (1 - F.abs(F.least(distinct("a"), F.lit(1.0)) - F.least(distinct("b"), F.lit(1.0))))
    return pairs.select("one", "a", "b", overlap.alias("overlap"), (kinds * (overlap + (1 - overlap) * BY_SHAPE * shape)).alias("score"))


def matched_fields(source: DataFrame, target: DataFrame) -> DataFrame:
    """(a, b, score): fields of source items with their counterparts among those of target items (item map<string,variant>)."""
    return one_to_one(compared(profiled(source), profiled(target)).drop("overlap"), "one", ASSIGNED)


def dictionary_of(source: DataFrame, target: DataFrame) -> dict[str, str]:
    """A field dictionary from the items that two services list."""
    return {r.a: r.b for r in matched_fields(source, target).orderBy("a").collect()}  # fields of one service
