"""Removal of line runs that an earlier place of the corpus already has.

The lines that hold a word are numbered through the corpus in document order, so
the corpus is a sequence of line ids.  Its suffixes (cut at the end of their
document) are ranked by prefix doubling: level j ranks the suffixes by their
first 2^j lines, from the level j - 1 ranks of the two halves.  Suffixes whose
prefix occurs once leave, so levels shrink to what is repeated.  Equal ranks of
a level are the longest-common-prefix intervals of length 2^j of the suffix
array, and two overlapping ranks tell intervals of any length between.

A repeated run counts from ``min_words`` words.  Such runs are unions of least
windows: the fewest lines from a line on, or up to a line, that have
``min_words`` words.  A line of a maximal run lies in the window from the run's
start or in the one that ends at the line, and both lie in the run.  A least
window depends on its own lines only, so its copies are least windows too: they
are one interval, known by (length, rank of its head, rank of its tail), and
all but the interval's first are deleted.  So every maximal run stays where it
occurs first and goes everywhere else, and no level beyond log2(min_words) is
ever asked for.

Everything is a DataFrame operation: numbering goes through range partitions
and their sums, groups are counted by partial aggregates before any shuffle,
and what repeats often is joined to its group's one row, never to the other
members.

Defined results: a null text stays null; lines without words neither break a
run nor are deleted; repeated rows are copies of the first of them, in the order
of id (null first) and then of the stored rows; a text that is all copies
becomes empty; an empty table gives an empty result; columns of the input named
like result columns give way to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginspark.llm.columns import boxed, let, unboxed, words
from marginspark.llm.screens import screen, screened
from marginspark.workspace import Workspace

#: Words from which a repeated run is deleted.
MIN_WORDS = 50
MADE = ("n_lines", "n_removed_lines")
_WORD = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _sequence(stored: DataFrame, min_words: int) -> DataFrame:
    """(row, id, k, line, w): the k-th line with words of each row, its digest,
    and its words, counted up to ``min_words``."""
    spoken = F.filter(_lines(F.col("text")), lambda s: s.rlike(_WORD))
    lines = stored.select("row", "id", F.posexplode(spoken).alias("k", "s"))
    return lines.select(
        "row",
        "id",
        "k",
        F.unhex(F.md5("s")).alias("line"),
        F.least(F.size(words(F.col("s"))), F.lit(min_words)).alias("w"),
    )


def _bases(lines: DataFrame, ws: Workspace) -> DataFrame:
    """(row, base): the number of lines in all rows before, in the order of
    (id, row), by sums within range partitions and over the partitions."""
    rows = lines.groupBy("row").agg(F.first("id").alias("id"), F.count("*").alias("n"))
    ordered = rows.repartitionByRange(F.asc_nulls_first("id"), "row")
    ordered = ws.save(ordered.withColumn("part", F.spark_partition_id()), "ordered")
    sofar = (Window.unboundedPreceding, -1)
    own = Window.partitionBy("part").orderBy(F.asc_nulls_first("id"), "row").rowsBetween(*sofar)
    # The only window without a key sees one row per partition.
    parts = ordered.groupBy("part").agg(F.sum("n").alias("n"))
    shift = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*sofar)), F.lit(0))
    parts = ws.save(parts.select("part", shift.alias("shift")), "parts")
    inner = F.coalesce(F.sum("n").over(own), F.lit(0))
    placed = ordered.select("row", "part", inner.alias("inner")).join(parts, "part")
    return placed.select("row", (F.col("inner") + F.col("shift")).alias("base"))


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """``lines`` with the least windows ``from`` each line and ``upto`` it, as
    (k, length) or null.  Capped words grow by 1 to ``min_words`` a line, so
    the other end of a window is found within twice that many words."""
    within = Window.partitionBy("row")
    running = within.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("w").over(within)
    known = lines.withColumns({"upto": F.sum("w").over(running), "total": total})
    known = known.withColumn("before", F.col("upto") - F.col("w"))
    ahead = within.orderBy("before").rangeBetween(min_words, 2 * min_words - 1)
    behind = within.orderBy("upto").rangeBetween(1 - 2 * min_words, -min_words)
    found = known.withColumns(
        {"next": F.min("k").over(ahead), "count": F.count("*").over(within)}
    ).withColumn("last", F.max("k").over(behind))
    end = F.coalesce(
        "next", F.when(F.col("total") - F.col("before") >= min_words, F.col("count").cast("int"))
    )
    start = F.coalesce(
        F.col("last") + 1, F.when(F.col("upto") >= min_words, F.lit(0))
    )
    return found.select(
        "row", "k", "line",
        (F.col("count") - F.col("k")).cast("int").alias("left"),
        (end - F.col("k")).alias("ahead"),
        (F.col("k") + 1 - start).alias("behind"),
    )


def _ranked(rows: DataFrame, by: list[str], ws: Workspace, name: str) -> DataFrame:
    """``rows`` whose ``by`` is shared, with ``rank``, which follows the order
    of ``by``: sorted over all partitions, row numbers keep the order."""
    shared = rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")
    ranks = shared.orderBy(*by).select(*by, F.monotonically_increasing_id().alias("rank"))
    ranks = ws.save(ranks, name)
    return screened(rows, screen(ranks, *by), *by).join(ranks, by)


def _levels(lines: DataFrame, top: int, ws: Workspace) -> list[DataFrame]:
    """Level j holds (pos, left, rank) of the suffixes whose first 2^j lines
    occur more than once, up to level ``top``.  Level 0 keeps what else is known
    of its lines: all that follows concerns these alone."""
    first = _ranked(lines.drop("base"), ["line"], ws, "ranks0")
    levels = [ws.save(first.drop("line"), "level0")]
    for level in range(1, top + 1):
        half = 1 << (level - 1)
        now = levels[-1].select("pos", "left", "rank")
        tail = now.select((F.col("pos") - half).alias("pos"), F.col("rank").alias("tail"))
        pairs = now.where(F.col("left") >= 2 * half).withColumnRenamed("rank", "head")
        pairs = ws.save(pairs.join(tail, "pos"), f"pairs{level}")
        ranked = _ranked(pairs, ["head", "tail"], ws, f"ranks{level}")
        levels.append(ws.save(ranked.select("pos", "left", "rank"), f"level{level}"))
    return levels


def _copies(levels: list[DataFrame], ws: Workspace) -> DataFrame:
    """(pos, length) of the least windows that occur earlier.  Both ends of such
    a window are repeated lines."""
    lines = levels[0]
    starts = lines.select("pos", F.col("ahead").alias("length")).where("ahead is not null")
    ends = lines.where("behind is not null").select(
        (F.col("pos") + 1 - F.col("behind")).alias("pos"), F.col("behind").alias("length")
    )
    asked = starts.union(ends).where("length > 0")
    # A window asks in the level of the largest power of two within its length.
    level = sum(F.when(F.col("length") >= 1 << j, 1).otherwise(0) for j in range(1, len(levels)))
    asked = asked.withColumn("level", level if len(levels) > 1 else F.lit(0))
    size = F.expr("shiftleft(1, level)")
    ranks = [t.select(F.lit(j).alias("level"), "pos", "rank") for j, t in enumerate(levels)]
    known = ranks[0]
    for more in ranks[1:]:
        known = known.unionByName(more)
    windows = asked.withColumn("at", F.col("pos") + F.col("length") - size)
    for at, name in (("pos", "head"), ("at", "tail")):
        met = known.select("level", F.col("pos").alias(at), F.col("rank").alias(name))
        windows = windows.join(met, ["level", at])
    windows = windows.select("pos", "length", "head", "tail")
    windows = ws.save(windows, "windows")
    by = ["length", "head", "tail"]
    firsts = windows.groupBy(*by).agg(F.min("pos").alias("first"))
    return windows.join(ws.save(firsts, "firsts"), by).where("pos > first").select("pos", "length")


def _without(text: Column, gone: Column) -> Column:
    """The lines of a text but for those numbered in ``gone``, among the lines
    with words."""

    def cut(lines: Column) -> Column:
        spoken = F.filter(
            F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(_WORD)
        )
        lost = let(spoken, lambda at: F.transform(gone, lambda k: F.get(at, k)))
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    return let(_lines(text), cut)


def dedup_lines(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    id: str = "doc_id",
    text: str = "text",
    workspace: Workspace | None = None,
) -> DataFrame:
    """``docs`` with the copied runs cut out of ``text``, ``n_lines`` (of the
    text as it was) and ``n_removed_lines``."""
    ws = workspace or Workspace(docs.sparkSession)
    stored = ws.save(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            docs[f"`{id}`"].alias("id"),
            docs[f"`{text}`"].cast("string").alias("text"),
            boxed(docs, text, *MADE).alias("doc"),
        ),
        "rows",
    )
    # Numbers of rows are fixed by the stored table, those of lines by this one.
    lines = ws.save(_sequence(stored, min_words), "sequence")
    bases = ws.save(_bases(lines.select("row", "id"), ws), "bases")
    placed = _windows(lines, min_words).join(bases, "row")
    placed = ws.save(placed.withColumn("pos", F.col("base") + F.col("k")), "lines")
    top = placed.agg(F.max(F.greatest("ahead", "behind"))).first()[0] or 1
    levels = _levels(placed, int(top).bit_length() - 1, ws)
    copies = _copies(levels, ws)
    spans = copies.groupBy("pos").agg(F.max("length").alias("length"))
    lost = spans.select(
        F.explode(F.sequence("pos", F.col("pos") + F.col("length") - 1)).alias("pos")
    ).distinct()
    gone = lost.join(levels[0].select("pos", "row", "k"), "pos")
    gone = ws.save(gone.groupBy("row").agg(F.sort_array(F.collect_list("k")).alias("gone")), "gone")
    # Only texts that may have lost lines are moved to what they lost, which
    # grows with the input and so is never broadcast.
    touched = ws.save(screen(gone, "row"), "touched")
    kind = gone.schema["gone"].dataType
    known = (
        screened(stored, touched, "row")
        .join(gone.hint("merge"), "row", "left")
        .unionByName(screened(stored, touched, "row", out=True).withColumn("gone", F.lit(None).cast(kind)))
    )
    cut = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        _without(F.col("text"), F.col("gone"))
    )
    counted = lambda list: F.greatest(F.size(list), F.lit(0)).cast("long")
    return known.select(
        *unboxed(known, "doc", text, *MADE),
        cut.alias(text),
        F.coalesce(counted(_lines(F.col("text"))), F.lit(0)).alias("n_lines"),
        F.coalesce(counted(F.col("gone")), F.lit(0)).alias("n_removed_lines"),
    )
