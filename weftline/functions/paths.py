"""Endpoint identifiers, labels and path templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def identifier(method: Column, path: Column) -> Column:
    return F.concat(F.upper(method), F.lit(" "), path)


def label(ident: Column, description: Column) -> Column:
    """For prompts; a missing description shows as the word undefined."""
    return F.concat(ident, F.lit(" - "), F.coalesce(description, F.lit("undefined")))


def fill(path: Column, names: Column, values: Column) -> Column:
    """path with the first {name} of each name replaced by its value, in order; a missing value reads undefined.

    names is an array, values a map. Values are put in literally.
    """

    def put(text: Column, name: Column) -> Column:
        mark = F.concat(F.lit("{"), name, F.lit("}"))
        at = F.call_function("locate", mark, text)
        value = F.coalesce(F.try_element_at(values, name), F.lit("undefined"))
        return F.when(at > 0, F.overlay(text, value, at, F.length(mark))).otherwise(text)

    return F.aggregate(names, path, put)


def blanked(ident: Column) -> Column:
    """The identifier with the names of its placeholders left out, whatever characters they hold."""
    return F.regexp_replace(ident, r"\{[^}]+\}", "{}")


def url(base: Column, path: Column) -> Column:
    return F.concat(base, path)
