"""Reproducible samples.

Every choice is a function of the row id and a seed, so a recomputed task
(after an executor is lost) picks the same rows again.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginspark.workspace import Workspace

# Upper bound of the (stratum, bucket) counts that one draw looks at.
MAX_BUCKETS = 1 << 20
# More draws than this are joined by a shuffle.
MAX_BROADCAST_DRAWS = 1 << 20


def md5_key(seed: int, id_col: str = "id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def md5_number(seed: int, id_col: str = "id") -> Column:
    """The first 32 bits of the key as a number."""
    return F.conv(F.substring(md5_key(seed, id_col), 1, 8), 16, 10).cast("bigint")


def counted(seed: int, kind: str, *numbers: Column) -> Column:
    """A 52-bit number for each tuple of counters; any engine with md5 can follow."""
    text = F.concat_ws(":", F.lit(f"{seed}:{kind}"), *[c.cast("string") for c in numbers])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def start_vector(n: int, seed: int) -> np.ndarray:
    """``n`` numbers in [0, 1) by the same rule."""
    keys = (hashlib.md5(f"{seed}:start:{j}".encode()).hexdigest() for j in range(n))
    return np.array([int(key[:13], 16) / 2**52 for key in keys])


def bernoulli(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Keep each row with probability ``fraction``; a map-side filter."""
    if fraction >= 1.0:
        return df
    if fraction <= 0.0:
        raise ValueError("fraction must be positive")
    # 13 hex digits are the 52 bits that a double tells apart.
    limit = format(math.ceil(fraction * 2**52), "013x")
    return df.where(F.substring(md5_key(seed), 1, 13) < limit)


def first_k(df: DataFrame, k: int, seed: int, rows: int | None = None) -> DataFrame:
    """The ``k`` rows that come first in a seeded order (top-k, no full sort).

    With ``rows``, the number of rows of ``df``, only those are looked at whose
    key is below a bound that some more than ``k`` rows pass, so that no
    partition hands over ``k`` rows.  Should fewer pass, all are looked at."""
    if rows and rows > 4 * k + 200:
        share = (2 * k + 100) / rows
        near = bernoulli(df, share, seed)
        found = near.orderBy(md5_key(seed), "id").limit(k)
        if found.count() == k:
            return found
    return df.orderBy(md5_key(seed), "id").limit(k)


def quotas(counts: DataFrame, total: int, m: int) -> DataFrame:
    """Rows to draw per cluster, ``ceil(n * total / m)``, from ``(cid, n)``."""
    share = F.ceil(F.col("n") * F.lit(total) / F.lit(m))
    return counts.select("cid", "n", share.cast("bigint").alias("quota"))


def draw_with_replacement(
    rows: DataFrame,
    total: int,
    seed: int,
    stratum: str | None = None,
    workspace: Workspace | None = None,
) -> DataFrame:
    """Draw row ids uniformly with replacement and deal them random steps.

    Without ``stratum`` exactly ``total`` ids are drawn.  With it, each stratum
    gets its quota (see :func:`quotas`), so a few more than ``total`` may come.
    The result is ``(id, stratum, step)`` with dense 0-based steps; see
    :func:`with_rows`.

    Draw ``d`` of a stratum takes the row at position ``counted(seed, "draw",
    stratum, d) mod size``, rows being in the order of (bucket, id); the steps
    follow ``counted(seed, "step", stratum, d)``.

    Positions need no global sort: ids fall into hash buckets, one narrow scan
    counts the buckets, and only the ids of buckets that hold a drawn position
    are ranked.  Bucket counts (at most ``MAX_BUCKETS``) and draws are tables;
    nothing of them reaches the driver.
    """
    if total < 1:
        raise ValueError("draw at least one row")
    ws = workspace or Workspace(rows.sparkSession)
    kept = ["id", *([stratum] if stratum else [])]
    key = F.col(stratum).cast("int") if stratum else F.lit(0)
    narrow = rows.select(*kept, key.alias("_stratum"))
    m, strata = narrow.agg(F.count("*"), F.count_distinct("_stratum")).first()
    if m == 0:
        raise ValueError("nothing to draw from")
    keyed = narrow.withColumn(
        "_bucket", F.pmod(md5_number(seed), F.lit(bucket_count(m, strata))).cast("int")
    )

    counts = keyed.groupBy("_stratum", "_bucket").agg(F.count("*").alias("n"))
    counts = ws.save(counts, "buckets")
    before = Window.partitionBy("_stratum").orderBy("_bucket")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(before), F.lit(0))
    starts = counts.select("_stratum", first.alias("at"), "_bucket", first.alias("first"))

    quota = F.lit(total) if stratum is None else F.ceil(F.col("size") * total / F.lit(m))
    sizes = counts.groupBy("_stratum").agg(F.sum("n").alias("size"))
    draws = sizes.withColumn("d", F.explode(F.sequence(F.lit(0), quota.cast("int") - 1)))
    place = F.pmod(counted(seed, "draw", F.col("_stratum"), F.col("d")), F.col("size"))
    draws = draws.select("_stratum", place.alias("at"), "d")
    # The bucket of a draw is the last one that starts at or before its position.
    up_to = Window.partitionBy("_stratum").orderBy("at", F.col("d").isNotNull())
    up_to = up_to.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = starts.unionByName(draws, allowMissingColumns=True).select(
        "_stratum",
        "d",
        F.last("_bucket", True).over(up_to).alias("_bucket"),
        (F.col("at") - F.last("first", True).over(up_to)).alias("_offset"),
    )
    # As many rows as draws, which is a parameter whatever the size of the data.
    turn = Window.orderBy(
        counted(seed, "step", F.col("_stratum"), F.col("d")), "_stratum", "d"
    )
    drawn = found.where(F.col("d").isNotNull()).select(
        "_stratum",
        "_bucket",
        "_offset",
        (F.row_number().over(turn).cast("bigint") - 1).alias("step"),
    )
    drawn = ws.save(drawn, "positions")
    hit = drawn.select("_stratum", "_bucket").distinct()
    if total + strata <= MAX_BROADCAST_DRAWS:
        hit, drawn = F.broadcast(hit), F.broadcast(drawn)
    rank = Window.partitionBy("_stratum", "_bucket").orderBy("id")
    picked = (
        keyed.join(hit, ["_stratum", "_bucket"])
        .withColumn("_offset", F.row_number().over(rank).cast("bigint") - 1)
        .join(drawn, ["_stratum", "_bucket", "_offset"])
        .select(*kept, "step")
    )
    return ws.save(picked, "draws")


def bucket_count(m: int, strata: int) -> int:
    """Hash buckets of ``m`` rows: some 32 rows each, a bounded number in all."""
    return int(min(max(m // 32, 1), max(MAX_BUCKETS // strata, 1)))


def with_rows(points: DataFrame, draws: DataFrame, workspace: Workspace) -> DataFrame:
    """The drawn rows in full: one scan of ``points``.  The draws are a stored
    table, so their measured size decides how they are joined."""
    return workspace.save(points.join(draws, "id"), "drawn-rows")
