"""Delimited text with the label last -> labelled points."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginspark.workspace import Workspace

# Input splits, each a path and two numbers, that may travel with the tasks.
MAX_BROADCAST_SPLITS = 100_000


def parse_lines(lines: DataFrame, sep: str = ",", width: int | None = None) -> DataFrame:
    """Parse a ``value`` column into ``x``, ``y`` and a ``reason`` that is null
    for good rows.  Every field is a number, the last is the label (+1 or -1),
    and its slot in ``x`` becomes the constant bias 1.

    ``width`` is the number of fields per line; a line of any other length is
    bad.  All other columns of ``lines`` are kept.
    """
    fields = F.split(F.col("value"), re.escape(sep))
    parsed = lines.withColumn(
        "_nums", F.transform(fields, lambda f: F.trim(f).try_cast("double"))
    ).withColumn("_label", F.element_at("_nums", -1))
    bad_number = F.exists(
        "_nums", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    )
    reason = F.when(bad_number, "non-numeric field").when(
        ~F.col("_label").isin(1.0, -1.0), "label is not +1 or -1"
    )
    if width is not None:
        reason = F.when(F.size("_nums") != width, "wrong number of fields").otherwise(
            reason
        )
    features = F.slice("_nums", 1, F.greatest(F.size("_nums") - 1, F.lit(0)))
    return parsed.select(
        *[c for c in lines.columns],
        F.concat(features, F.array(F.lit(1.0))).alias("x"),
        F.col("_label").try_cast("int").alias("y"),
        reason.alias("reason"),
    )


def common_width(lines: DataFrame, sep: str = ",") -> int:
    """The most frequent number of fields per line."""
    widths = lines.groupBy(F.size(F.split("value", re.escape(sep))).alias("n")).count()
    return widths.orderBy(F.desc("count"), "n").first()["n"]


def read_points(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    width: int | None = None,
    workspace: Workspace | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Read text files into ``(points, rejected)``.

    The row id is the row's place among the good rows in file order.  It is
    found without a sort or a window over rows: good rows are numbered as they
    are stored, so those of one input split lie in a run without gaps, and a
    directory with a row per split says by how much its run has to be shifted.
    However long a split is, its ids are a projection, in as many tasks as the
    stored rows have.  The rows are stored once, which pins the numbers and
    spares later passes the text parsing; the ids are added as they are read,
    unless the directory is too long to travel with the tasks.
    """
    ws = workspace or Workspace(spark)
    mark = ws.mark()
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
    )
    if width is None:
        width = common_width(lines, sep)
    parsed = parse_lines(lines, sep, width)
    good = parsed.where("reason is null").select(
        "_file", "_start", F.monotonically_increasing_id().alias("_pos"), "x", "y"
    )
    good = ws.save(good, "good")
    rejected = ws.save(
        parsed.where("reason is not null").select(F.col("value").alias("line"), "reason"),
        "rejected",
    )
    directory = ws.save(_directory(good, ws), "directory")
    short = directory.count() <= MAX_BROADCAST_SPLITS
    points = good.join(F.broadcast(directory) if short else directory, ["_file", "_start"])
    points = points.select((F.col("_pos") + F.col("_shift")).alias("id"), "x", "y")
    if short:
        ws.release(mark, good, directory, rejected)
    else:
        points = ws.save(points, "points")
        ws.release(mark, points, rejected)
    return points, rejected


def _directory(good: DataFrame, ws: Workspace) -> DataFrame:
    """``(_file, _start, _shift)``: what turns ``_pos`` into the id, per split.

    Splits are sorted over tasks and added up within each; the totals of the
    tasks, one number for each, are added up on the driver."""
    splits = good.groupBy("_file", "_start").agg(
        F.min("_pos").alias("_first"), F.count("*").alias("_n")
    )
    ordered = splits.repartitionByRange("_file", "_start").sortWithinPartitions("_file", "_start")

    def add_up(batches):
        before = 0
        for batch in batches:
            n = batch["_n"].to_numpy()
            start = pa.array(before + np.cumsum(n) - n)
            before += int(n.sum())
            columns = [batch[k] for k in ("_file", "_start", "_run", "_first", "_n")]
            yield pa.RecordBatch.from_arrays(
                [*columns, start], ["_file", "_start", "_run", "_first", "_n", "_before"]
            )

    runs = ws.save(
        ordered.withColumn("_run", F.spark_partition_id()).mapInArrow(
            add_up, "_file string, _start long, _run int, _first long, _n long, _before long"
        ),
        "runs",
    )
    base, totals = 0, []
    for r in runs.groupBy("_run").agg(F.sum("_n").alias("n")).orderBy("_run").collect():
        totals.append((r["_run"], base))
        base += r["n"]
    bases = ws.spark.createDataFrame(totals, "_run int, _base long")
    shift = F.col("_base") + F.col("_before") - F.col("_first")
    return runs.join(F.broadcast(bases), "_run").select("_file", "_start", shift.alias("_shift"))


def dimensions(points: DataFrame) -> DataFrame:
    """Row count ``m`` and the smallest and largest vector length."""
    return points.agg(
        F.count("*").alias("m"),
        F.min(F.size("x")).cast("bigint").alias("n_min"),
        F.max(F.size("x")).cast("bigint").alias("n_max"),
    )


def check_points(points: DataFrame) -> tuple[int, int]:
    """``(m, n)``; raises when there are no rows, vectors differ in length or are
    not finite, a label is neither +1 nor -1 or an id is null."""
    good = F.coalesce(F.col("y").isin(1, -1), F.lit(False))
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    finite = F.coalesce(F.forall("x", number), F.lit(False))
    row = points.agg(
        F.count("*").alias("m"),
        F.min(F.size("x")).alias("low"),
        F.max(F.size("x")).alias("high"),
        F.count_if(~good).alias("bad"),
        F.count_if(~finite).alias("odd"),
        (F.count_if(F.col("id").isNull()) if "id" in points.columns else F.lit(0)).alias(
            "nameless"
        ),
    ).first()
    if not row["m"]:
        raise ValueError("no points")
    if row["low"] != row["high"]:
        raise ValueError(f"vector lengths differ: {row['low']} to {row['high']}")
    if row["bad"]:
        raise ValueError(f"{row['bad']} labels are neither +1 nor -1")
    if row["odd"]:
        raise ValueError(f"{row['odd']} vectors are not finite")
    if row["nameless"]:
        raise ValueError(f"{row['nameless']} rows have no id")
    return row["m"], row["high"]
