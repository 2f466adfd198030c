"""The services and mappings as a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def graph(apis: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges)"""
    vertices = apis.select("id", "name")
    edges = mappings.select("id", F.get("parts", F.lit(0))["api"].alias("src"), F.get("parts", F.lit(1))["api"].alias("dst"), F.col("name").alias("label"))
    return vertices, edges


def options(df: DataFrame) -> DataFrame:
    """(name, value) choices with a blank one in front."""
    blank = df.sparkSession.createDataFrame([(0, "", None)], "ordinal int, name string, value string")
    return blank.unionByName(df.select(F.lit(1).alias("ordinal"), "name", F.col("id").cast("string").alias("value")))


def sides(mappings: DataFrame, apis: DataFrame) -> DataFrame:
    """(id, name, side, api, api_name, baseUrl): each mapping's parts with their services; a part of an unknown service is left out."""
    parts = mappings.select("id", "name", F.posexplode("parts").alias("side", "part")).select("id", "name", "side", F.col("part.api").alias("api"))
    known = apis.select(F.col("id").alias("api"), F.col("name").alias("api_name"), "baseUrl")
    return parts.join(known, "api").select("id", "name", "side", "api", "api_name", "baseUrl")
