"""Row numbers and the assignment of rows to parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginspark.operators.sampling import md5_number
from marginspark.workspace import Workspace

# A group of at most this many rows may be numbered by one window task.
MAX_WINDOW_ROWS = 1_000_000


def largest_group(df: DataFrame, key: str) -> int:
    counts = df.groupBy(key).count()
    return counts.agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]


def _number_sorted(
    df: DataFrame, keys: list[str], order: list[str], name: str, ws: Workspace
) -> DataFrame:
    """0-based place of each row within its key, with no group in one task.

    Rows are range-partitioned by key and order together, so a hot key spreads
    over many partitions.  A key's rows in one partition are contiguous; one
    count per (key, partition) run gives the place of the run's first row.
    """
    ordered = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    pinned = ws.save(
        ordered.withColumn("_pos", F.monotonically_increasing_id()), "sorted"
    ).withColumn("_run", F.shiftright("_pos", 33))
    runs = pinned.groupBy(*keys, "_run").agg(
        F.min("_pos").alias("_first"), F.count("*").alias("_n")
    )
    before = (
        Window.partitionBy(*keys)
        .orderBy("_run")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # The window sees one row per run: at most the number of partitions per key.
    offsets = runs.select(
        *keys,
        "_run",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias(
            "_shift"
        ),
    )
    # A stored table has a measured size, by which Catalyst picks the join.
    offsets = ws.save(offsets, "offsets")
    same = pinned["_run"] == offsets["_run"]
    for key in keys:  # a null key is a key like any other
        same = same & pinned[key].eqNullSafe(offsets[key])
    place = (pinned["_pos"] + offsets["_shift"]).alias(name)
    return pinned.join(offsets, same).select(*[pinned[c] for c in df.columns], place)


def global_index(
    df: DataFrame, order: str = "id", name: str = "idx", workspace: Workspace | None = None
) -> DataFrame:
    """Dense 0-based index over all rows, by a distributed sort."""
    ws = workspace or Workspace(df.sparkSession)
    return _number_sorted(df, [], [order], name, ws)


def local_index(
    df: DataFrame,
    key: str,
    order: str = "id",
    name: str = "slot",
    workspace: Workspace | None = None,
    max_window_rows: int = MAX_WINDOW_ROWS,
) -> DataFrame:
    """Dense 0-based index within ``key``.  Groups that fit a task use a window;
    if any group is larger, all rows are numbered by a distributed sort."""
    df = df.drop(name)
    if max_window_rows and largest_group(df, key) <= max_window_rows:
        rank = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
        return df.withColumn(name, rank.cast("bigint"))
    ws = workspace or Workspace(df.sparkSession)
    return _number_sorted(df, [key], [order], name, ws)


def random_split(df: DataFrame, k: int, seed: int) -> DataFrame:
    """``part`` by a seeded hash of the id; no shuffle happens here."""
    part = F.pmod(md5_number(seed), F.lit(k)).cast("int")
    return df.withColumn("part", part)


def stratified_deal(
    df: DataFrame,
    key: str,
    k: int,
    rotate: bool = False,
    workspace: Workspace | None = None,
    max_window_rows: int = MAX_WINDOW_ROWS,
) -> DataFrame:
    """Deal each cluster's rows round-robin over ``k`` parts, so every part gets
    the same share of every cluster.  The deal starts at part 0 for each
    cluster; ``rotate`` starts it at the cluster's own number instead."""
    indexed = local_index(
        df, key, name="_i", workspace=workspace, max_window_rows=max_window_rows
    )
    start = F.col(key) if rotate else F.lit(0)
    part = F.pmod(F.col("_i") + start, F.lit(k)).cast("int")
    return indexed.withColumn("part", part).drop("_i")


def merge_deal(df: DataFrame, k: int, mode: str = "local_index") -> DataFrame:
    """New ``part`` numbers below ``k``.  ``local_index`` re-deals rows by their
    place in the old part; ``pairwise`` joins old parts p, p+k, p+2k, ..."""
    if mode not in ("local_index", "pairwise"):
        raise ValueError(f"unknown merge mode {mode!r}")
    source: Column = F.col("slot" if mode == "local_index" else "part")
    return df.withColumn("part", F.pmod(source, F.lit(k)).cast("int"))


def gather(df: DataFrame) -> DataFrame:
    """All rows into part 0."""
    return df.withColumn("part", F.lit(0))


def place(df: DataFrame, k: int) -> DataFrame:
    """Move row to partition ``part mod k``: one exchange that sends each part
    to exactly one task."""
    return df.repartitionById(k, "part")
