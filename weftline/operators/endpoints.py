"""Endpoint rows of API descriptions, selections and mappings of operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.paths import identifier
from weftline.operators.keyed import first_match

#: The verbs that become endpoints, and the operations of a mapping, in order.
VERBS = ("get", "post", "put", "patch", "delete")
OPERATIONS = ("getAll", "getOne", "create", "update", "delete")


def unpivot_verbs(df: DataFrame, verbs: dict[str, Column], keep: list[str]) -> DataFrame:
    """One row (keep, method, verb_ordinal, operation) for each verb that is there, in the verbs' order."""
    entries = F.array(*[F.struct(F.lit(v).alias("method"), F.lit(i).alias("verb_ordinal"), c.alias("operation")) for i, (v, c) in enumerate(verbs.items())])
    return df.select(*keep, F.explode(F.filter(entries, lambda e: e["operation"].isNotNull())).alias("e")).select(*keep, "e.method", "e.verb_ordinal", "e.operation")


def path_parameters(parameters: Column) -> Column:
    """Name and description of required path parameters; references are dropped. Fields: ref, in, required, name, description."""
    wanted = F.filter(parameters, lambda p: p["ref"].isNull() & F.coalesce(p["required"], F.lit(False)) & F.coalesce(p["in"] == "path", F.lit(False)))
    return F.transform(wanted, lambda p: F.struct(p["name"].alias("name"), p["description"].alias("description")))


def default_name(name: Column) -> Column:
    return F.coalesce(name, F.lit(""))


def described(summary: Column, description: Column) -> Column:
    """The summary, unless it is missing or empty."""
    return F.coalesce(F.nullif(summary, F.lit("")), description)


def with_identifier(endpoints: DataFrame) -> DataFrame:
    return endpoints.withColumn("identifier", identifier(F.col("method"), F.col("path")))


def selected(endpoints: DataFrame, selection: DataFrame) -> DataFrame:
    """The endpoints whose identifier is in selection; ``ordinal`` keeps the catalog's order."""
    return endpoints.join(selection.select("identifier"), "identifier", "left_semi")


def selection(identifiers: Column, selected: bool) -> Column:
    """A selection in which all of an array of identifiers are on, or off."""
    return F.map_from_arrays(F.array_distinct(identifiers), F.transform(F.array_distinct(identifiers), lambda _: F.lit(selected)))


def chosen(selection: Column) -> Column:
    """The identifiers that are on in a selection."""
    return F.map_keys(F.map_filter(selection, lambda _, on: F.coalesce(on, F.lit(False))))


def resolve(slots: DataFrame, endpoints: DataFrame) -> DataFrame:
    """slots (..., api_id, operation, identifier) with the first endpoint of that identifier; none if '' or unknown."""
    first = first_match(endpoints, ["api_id", "identifier"]).select("api_id", "identifier", F.struct("name", "description", "path", "method", "parameters", "requestBody", "responseSchema", "paging", "honoursKeys").alias("endpoint"))
    wanted = slots.withColumn("identifier", F.nullif("identifier", F.lit("")))
    return wanted.join(first, ["api_id", "identifier"], "left")
