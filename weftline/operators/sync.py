"""One directed sync pass as one plan: source, left join id map, left join target, overlay, action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.records import digest, key_of, linked, overlay, property_of, without_id
from weftline.operators.keyed import first_match

CREATE, UPDATE = "create", "update"


def _links(id_map: DataFrame, unique: bool) -> DataFrame:
    """(source_id, target_id) of this direction's links; of a source id the first one."""
    links = id_map.select("ordinal", "source_id", "target_id").where("source_id is not null")
    links = links if unique else first_match(links, ["source_id"])
    return links.where(linked(F.col("target_id"))).select("source_id", "target_id")


def _or_none(key: Column) -> Column:
    """A join key in which rows without one are spread by their ordinal and match nothing: keys are JSON texts, never this."""
    return F.coalesce(key, F.concat(F.lit("none "), F.col("ordinal")))


def keyed_items(source: DataFrame) -> DataFrame:
    """(ordinal, source_id, item)"""
    return source.select("ordinal", key_of(property_of(F.col("item"), "id")).alias("source_id"), "item")


def linked_items(items: DataFrame, id_map, unique: bool = False) -> DataFrame:
    """items (ordinal, source_id, ...) with the target_id that their link names. id_map: (ordinal, source_id, target_id), or what links items itself."""
    if not isinstance(id_map, DataFrame):
        return id_map.link(items)
    links = _links(id_map, unique).withColumnRenamed("source_id", "linked_id")
    return items.join(links, _or_none(F.col("source_id")) == F.col("linked_id"), "left").drop("linked_id")


def lookup_keys(source: DataFrame, id_map, unique: bool = False) -> DataFrame:
    """(target_id): the target's keys of the items that are linked, each once: what to ask a target for."""
    if not isinstance(id_map, DataFrame):
        return id_map.link(keyed_items(source).select("ordinal", "source_id")).where("target_id is not null").select("target_id").distinct()
    return keyed_items(source).select("source_id").join(_links(id_map, unique), "source_id").select("target_id").distinct()


def plan_pass(source: DataFrame, target: DataFrame, id_map, dictionary: Column, unique: bool = False, digests: bool = False) -> DataFrame:
    """(ordinal, source_id, target_id, has_base, action, payload) of every item of source; with ``digests`` also payload_digest and base_digest.

    source, target: (ordinal, item), target also with target_id if its rows were asked for by key; id_map: (ordinal, source_id, target_id) keys of this direction, or its layers.
    dictionary: map of source to target properties. An item whose link names no row of target is still an
    update, on an empty base. An item without an id joins nothing and is created. unique: source ids of the
    id map and keys of the target do not repeat, so that their first rows need not be sought.
    """
    target_key = F.col("target_id") if "target_id" in target.columns else key_of(property_of(F.col("item"), "id"))
    rows = target.select("ordinal", target_key.alias("target_id"), F.col("item").alias("base")).where("target_id is not null")
    rows = (rows if unique else first_match(rows, ["target_id"])).select(F.col("target_id").alias("base_id"), "base")
    joined = linked_items(keyed_items(source), id_map, unique).join(rows, _or_none(F.col("target_id")) == F.col("base_id"), "left")
    mapped = overlay(F.col("base"), F.col("item"), dictionary)
    update = F.col("target_id").isNotNull()
    compared = [digest(mapped).alias("payload_digest"), digest(F.col("base")).alias("base_digest")] if digests else []
    return joined.select(
        "ordinal",
        "source_id",
        "target_id",
        F.col("base").isNotNull().alias("has_base"),
        F.when(update, UPDATE).otherwise(CREATE).alias("action"),
        F.when(update, mapped).otherwise(without_id(mapped)).alias("payload"),
        *compared,
    )


def with_noop(plan: DataFrame, sent: DataFrame | None = None) -> DataFrame:
    """A plan with digests and a column is_noop: updates that would change nothing.

    An update is one if its payload is its base already; or if sent, the last (target_id, payload_digest, base_digest) of each
    target, has the same payload sent to the same base: what the service made of it then is what it shows now.
    """
    update = F.col("action") == UPDATE
    same = F.coalesce(F.col("payload_digest") == F.col("base_digest"), F.lit(False))
    if sent is None:
        return plan.withColumn("is_noop", update & same)
    last = sent.select(F.col("target_id").alias("sent_id"), F.struct(F.col("payload_digest").alias("p"), F.col("base_digest").alias("b")).alias("last"))
    joined = plan.join(last, _or_none(F.col("target_id")) == F.col("sent_id"), "left")
    again = (F.col("last.p") == F.col("payload_digest")) & (F.col("last.b") == F.col("base_digest"))
    return joined.withColumn("is_noop", update & (same | F.coalesce(again, F.lit(False)))).drop("sent_id", "last")


def unmapped(source: DataFrame, id_map: DataFrame) -> DataFrame:
    """The items (ordinal, source_id, item) that no link names."""
    return keyed_items(source).join(_links(id_map, False), "source_id", "left_anti")


def directed(id_map: DataFrame, reverse: bool) -> DataFrame:
    """Pairs (a_id, b_id) as (source_id, target_id) of a pass from a to b, or from b to a."""
    a, b = ("b_id", "a_id") if reverse else ("a_id", "b_id")
    return id_map.select("ordinal", F.col(a).alias("source_id"), F.col(b).alias("target_id"))


def eligible(source_get_all: Column, target_create: Column, target_update: Column) -> Column:
    return source_get_all.isNotNull() & target_create.isNotNull() & target_update.isNotNull()


def useful(get_all: Column, get_one: Column, create: Column, update: Column) -> Column:
    """A side of a mapping that can be read and written."""
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    return (filled(get_all) | filled(get_one)) & (filled(create) | filled(update))


def action_counts(plan: DataFrame) -> DataFrame:
    """Rows per action, and those of them that update a row that vanished."""
    vanished = F.count_if((F.col("action") == UPDATE) & ~F.col("has_base"))
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("n_items"), vanished.alias("n_vanished"))
