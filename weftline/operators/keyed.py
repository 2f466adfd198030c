"""Keyed tables on an unordered engine: first match, replacement, upsert, defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_match(df: DataFrame, keys: list[str], order: str = "ordinal") -> DataFrame:
    """The row of least ``order`` for each key, with the columns of df."""
    rest = [c for c in df.columns if c not in keys]
    least = F.min_by(F.struct(*rest), F.col(order)).alias("found")
    return df.groupBy(*keys).agg(least).select(*keys, *[F.col(f"found.`{c}`").alias(c) for c in rest]).select(*df.columns)


def replace_by_key(df: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """df with the rows that changes has under the same key in their place; other changes are ignored."""
    new = F.struct(*[c for c in df.columns if c not in keys]).alias("new")
    joined = df.join(changes.select(*keys, new), keys, "left")
    return joined.select(*[c if c in keys else F.when(F.col("new").isNotNull(), F.col(f"new.`{c}`")).otherwise(F.col(c)).alias(c) for c in df.columns])


def upsert(df: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """df with the rows of changes inserted, or in place of those with the same key."""
    rest = [c for c in df.columns if c not in keys]
    old = df.select(*keys, F.struct(*rest).alias("old"))
    new = changes.select(*keys, F.struct(*rest).alias("new"))
    row = F.coalesce("new", "old")
    return old.join(new, keys, "full").select(*keys, *[row[c].alias(c) for c in rest]).select(*df.columns)


def append(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows)


def latest(log: DataFrame, keys: list[str], sequence: str = "seq") -> DataFrame:
    """The last row of each key of an append-only log."""
    rest = [c for c in log.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.col(sequence)).alias("found")
    return log.groupBy(*keys).agg(last).select(*keys, *[F.col(f"found.`{c}`").alias(c) for c in rest]).select(*log.columns)


def upsert_log(log: DataFrame, changes: DataFrame, keys: list[str], sequence: str = "seq") -> DataFrame:
    """The table that a log and later changes, both with their sequence numbers, amount to."""
    return latest(append(log, changes), keys, sequence)


def as_dictionary(df: DataFrame, keys: list[str], name: str, value: str, order: str) -> DataFrame:
    """(keys, dictionary): one map per key of name to value, of the rows in ``order``; of a name the last row counts."""
    last = latest(df.where(F.col(name).isNotNull()).select(*keys, name, value, order), [*keys, name], order)
    entries = F.sort_array(F.collect_list(F.struct(order, name, value)))
    pairs = F.transform(entries, lambda e: F.struct(e[name].alias("key"), e[value].alias("value")))
    return last.groupBy(*keys).agg(F.map_from_entries(pairs).alias("dictionary"))


def with_default(df: DataFrame, other: DataFrame, keys: list[str], defaults: dict) -> DataFrame:
    """df with other's columns of the same key, the defaults where there is none."""
    joined = df.join(other, keys, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})
