"""Column helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words: blank, tab, line feed, vertical tab, form feed, return.
BLANKS = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once per row even where
    the body uses it inside a higher-order function."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, none for a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def others(df: DataFrame, *made: str) -> list[str]:
    """Columns of ``df`` that a result keeps beside the columns it makes; a
    column of the same name, whatever its case, gives way to the made one."""
    taken = {name.lower() for name in made}
    return [name for name in df.columns if name.lower() not in taken]


def boxed(df: DataFrame, *made: str) -> Column:
    """The kept columns as one struct, so that no working column can clash."""
    keep = others(df, *made)
    fields = [df[f"`{name}`"] for name in keep] or [F.lit(0).alias("_none")]
    return F.struct(*fields)


def unboxed(df: DataFrame, box: str, *made: str) -> list[Column]:
    """The columns of a struct that :func:`boxed` made."""
    names = [f.name for f in df.schema[box].dataType.fields]
    return [F.col(box)[name].alias(name) for name in others_of(names, made) if name != "_none"]


def others_of(names: list[str], made: tuple[str, ...]) -> list[str]:
    taken = {name.lower() for name in made}
    return [name for name in names if name.lower() not in taken]
