"""A bounded screen of keys, so that a join with few of the rows moves few rows.

The screen is a bit set over hashed keys, of fixed size whatever the number of
keys, broadcast as the bytes that have a bit set.  A row whose bit is unset
certainly has no partner and need not be moved; the others are joined as usual.
With very many keys the screen lets all rows through, and the join is an
ordinary one.  The bytes stay out of the plan, whose text the driver keeps for
every query that has run and makes anew with each stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a screen: it has an eighth of that in rows, at most.
BITS = 1 << 20


def _place(*key: str) -> tuple[Column, Column]:
    """The byte and the bit of a key."""
    slot = F.pmod(F.xxhash64(F.lit(31), *key), F.lit(BITS))
    return F.floor(slot / 8).cast("int"), F.pow(F.lit(2), slot % 8).cast("int")


def screen(keys: DataFrame, *key: str) -> DataFrame:
    """The screen of ``keys``, for :func:`screened`."""
    at, bit = _place(*key)
    found = keys.select(at.alias("_at"), bit.alias("_bit"))
    return found.groupBy("_at").agg(F.bit_or("_bit").alias("_bits"))


def screened(rows: DataFrame, mask: DataFrame, *key: str, out: bool = False) -> DataFrame:
    """``rows`` that may have a partner among the keys of ``mask``; with ``out``
    those that have none."""
    at, bit = _place(*key)
    met = (F.col("_at") == at) & (F.col("_bits").bitwiseAND(bit) != 0)
    return rows.join(F.broadcast(mask), met, "left_anti" if out else "left_semi")
