"""Schemaless records: map<string, variant> columns, their keys and the overlay of one on another.

A missing property is an absent map key, a JSON null is a variant null; the two are kept apart.
Sessions that overlay records need spark.sql.mapKeyDedupPolicy=LAST_WIN only for ``renamed``, which avoids
it by keeping the last entry of each target itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECORD = "map<string,variant>"
#: Keys that a target identifier may have and still count as none.
NO_ID = ("0", '""', "false")


def record(text: Column) -> Column:
    """A JSON object as a record; null if it isn't one."""
    return F.from_json(text, RECORD)


def property_of(item: Column, name: str) -> Column:
    return F.try_element_at(item, F.lit(name))


def properties_of(item: Column, kinds: dict[str, str]) -> Column:
    """A struct of typed properties, null where missing; item is computed once, however many are named."""
    typed = lambda x: F.struct(*[F.try_variant_get(property_of(x, name), "$", kind).alias(name) for name, kind in kinds.items()])
    return F.get(F.transform(F.array(item), typed), F.lit(0))


def key_of(value: Column) -> Column:
    """A variant as a join key. 1, 1.0 and 1e0 are one key, 1 and "1" are two; null and missing have none."""
    number = F.try_variant_get(value, "$", "double")
    whole = (F.schema_of_variant(value) == "DOUBLE") & (number == F.floor(number)) & (F.abs(number) < 1e18)
    key = F.when(whole, number.cast("bigint").cast("string")).otherwise(F.to_json(value))
    return F.when(value.isNotNull() & ~F.is_variant_null(value), key)


def linked(key: Column) -> Column:
    """Whether a target key stands for a link: null, 0, "" and false do not."""
    return key.isNotNull() & ~key.isin(*NO_ID)


def usable(dictionary: Column) -> Column:
    """Entries (source property, target property) that are applied: none from ``id``, none to nothing."""
    return F.filter(F.map_entries(dictionary), lambda e: (e["key"] != "id") & F.coalesce(~e["value"].isin("", "null", "undefined"), F.lit(False)))


def overlay(base: Column, item: Column, dictionary: Column) -> Column:
    """base with the dictionary's target properties replaced by the item's.

    A target whose last entry names a property that the item lacks is removed; a JSON null is written.
    """

    def put(entries: Column) -> Column:
        last = lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["value"] == e["value"])
        written = F.transform(F.filter(entries, last), lambda e: F.struct(e["value"].alias("key"), F.try_element_at(item, e["key"]).alias("value")))
        kept = F.map_filter(F.coalesce(base, F.from_json(F.lit("{}"), RECORD)), lambda k, v: ~F.exists(entries, lambda e: e["value"] == k))
        return F.map_concat(kept, F.map_from_entries(F.filter(written, lambda e: e["value"].isNotNull())))

    # the entries are bound, so that they are made once a row and not once a property
    return F.get(F.transform(F.array(usable(dictionary)), put), F.lit(0))


def without_id(item: Column) -> Column:
    return F.map_filter(item, lambda k, v: k != "id")


def canonical(item: Column) -> Column:
    """A text that two records share exactly when they hold the same: properties in order, each as its key_of or null."""
    entries = F.transform(F.map_entries(item), lambda e: F.struct(e["key"].alias("key"), F.coalesce(key_of(e["value"]), F.lit("null")).alias("value")))
    return F.to_json(F.array_sort(entries))


def digest(item: Column) -> Column:
    return F.sha2(canonical(item), 256)
