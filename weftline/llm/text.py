"""Column expressions on whole texts that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words: space and U+0009 to U+000D, nothing else.
SPACE = r"[\x20\x09-\x0D]"


def whole(text: Column) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def squeezed(text: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(whole(text), SPACE + "+", " ")


def bind(value: Column, body) -> Column:
    """body(value) with value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def row_of(docs: DataFrame) -> Column:
    """All columns of docs as one struct, whatever characters their names hold."""
    return F.struct(*[named(c) for c in docs.columns])


def named(column: str) -> Column:
    """The column of this very name; dots do not reach into it."""
    return F.col("`" + column.replace("`", "``") + "`")
