"""Exact top-k inner products by histogram selection.

Queries of one length are taken in blocks of a fixed size, each block against
all candidates of that length in their own partitions; no candidate is moved.  For a block,

1. every task scores its candidates and counts them per query in ``BINS`` bins
   of the score range; counts are added over all tasks, and the bin that holds
   the k-th best score is found;
2. that bin is divided anew, and so on until a bin is one score wide: then the
   k-th best score is known exactly, and how many scores are above it;
3. the candidates at or above it are kept, and ties at it go to the smallest
   ids, of which each task sends no more than are still open.

A task sends, per query, only bins from the top down to its own k-th score,
since the global k-th cannot lie lower: at most k counts.  So what moves is
bounded by queries x k x tasks whatever the ties.

Scores are exact whatever the components: a block's largest possible score picks
doubles (below 2^53), 64-bit integers (below 2^62) or whole numbers of any length; a
round settles eight of its bits.

Defined results: a vector that is null, or holds a null or non-finite component
(or one that is not finite once scaled), takes no part; scores beyond 64 bits rank
by their true value and are given as the nearest 64-bit number; a query meets the candidates that have its number of components
(vectors without components score 0); repeated rows are candidates each, and of rows with one query id
the least vector asks; rows with the query's own id
are not candidates for it; null ids take no part; fewer candidates than k give
them all; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginspark.workspace import Workspace

#: Bins of a histogram; each round divides the range by it.
BINS = 256
#: Queries of a block, and candidates scored at once.
BLOCK = 2048
_ROWS = 512
_FOUND = "query_id long, id long, score long, long_score array<long>"
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
#: Bits of a part of a score that is longer than 64.
_PART_BITS = 62


def quantized(df: DataFrame, id: str, vector: str, scale: int) -> DataFrame:
    """(id, x): vectors as whole numbers ``floor(scale * x)``, good ones only.
    The numbers are doubles: from 2^53 on a double is whole by itself."""
    v = F.col(vector)
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    fine = F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(scaled(x)) < float("inf"))
    )
    good = df.where(df[id].isNotNull() & v.isNotNull() & fine)
    whole = F.transform(
        v,
        lambda x: F.when(
            F.abs(scaled(x)) < float(1 << 53), F.floor(scaled(x)).cast("double")
        ).otherwise(scaled(x)),
    )
    return good.select(df[id].cast("long").alias("id"), whole.alias("x"))


_whole = np.frompyfunc(int, 1, 1)


def _exact(x: np.ndarray, kind: np.dtype) -> np.ndarray:
    """Whole doubles as numbers of a kind whose products are exact."""
    return _whole(x).astype(object) if kind == object else x.astype(kind)


def _scores(queries: np.ndarray, x: np.ndarray) -> np.ndarray:
    score = queries @ _exact(x, queries.dtype).T
    return score if score.dtype == object else score.astype(np.int64)


def _kind(queries: np.ndarray, limit: float) -> tuple[np.ndarray, int]:
    """The queries in the kind of number that holds all their scores, and a
    bound of the scores."""
    reach = max((sum(int(abs(v)) for v in row) for row in queries.tolist()), default=0)
    reach = max(1, reach * int(limit))
    kind = np.float64 if reach < 1 << 53 else np.int64 if reach < 1 << 62 else object
    return _exact(queries, np.dtype(kind)), reach


def _parts(
    batches: Iterator[pa.RecordBatch], width: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the rows with ``width`` components, some at a time."""
    for batch in batches:
        for at in range(0, len(batch), _ROWS):
            part = batch.slice(at, _ROWS)
            x = part.column(1)
            sizes = np.asarray(x.value_lengths())
            flat = np.asarray(x.flatten(), np.float64)
            own = np.asarray(part.column(0))
            if (sizes == width).all():
                yield own, flat.reshape(len(own), width)
            else:
                good = sizes == width
                yield own[good], flat[np.repeat(good, sizes)].reshape(int(good.sum()), width)


def _histogram(ids, queries, low, size, k):
    """The task's counts (query, bin, n) of scores in each query's open range
    ``[low, low + BINS * size)``, from the top down to its own k-th."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(ids), BINS), np.int64)
        rows = np.arange(len(ids))
        for own, x in _parts(batches, queries.shape[1]):
            score = _scores(queries, x)
            place = (score - low[:, None]) // size
            inside = (place >= 0) & (place < BINS) & (ids[:, None] != own[None, :])
            cell = (rows[:, None] * BINS + place)[inside].astype(np.int64)
            total += np.bincount(cell, minlength=total.size).reshape(total.shape)
        above = total[:, ::-1].cumsum(1)[:, ::-1] - total
        q, b = np.nonzero((total > 0) & (above < k))
        columns = (q, b, total[q, b])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["q", "bin", "n"])

    return count


def _split(score: int, reach: int) -> list[int]:
    """Parts of a long score, the highest first: they sort as the scores do."""
    parts = []
    while reach:
        score, low = score >> _PART_BITS, score & ((1 << _PART_BITS) - 1)
        reach >>= _PART_BITS
        parts.append(low)
    return [score, *reversed(parts)]


def _select(ids, queries, kth, open_ties, k, reach):
    """The task's candidates above each query's k-th score, and of those at it
    the smallest ids, no more than are open."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), kth[:0])]
        held = 0

        def cut(found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            q, own, score = map(np.concatenate, zip(*found))
            level = np.unique(score, return_inverse=True)[1]
            order = np.lexsort((own, -level, q))
            q, own, score = q[order], own[order], score[order]
            first = np.arange(len(q)) - np.searchsorted(q, q) < k
            return q[first], own[first], score[first]

        for own, x in _parts(batches, queries.shape[1]):
            score = _scores(queries, x)
            for way in (score > kth[:, None], score == kth[:, None]):
                q, c = np.nonzero(way & (ids[:, None] != own[None, :]))
                best.append((q, own[c], score[q, c]))
                held += len(q)
            if held > 1 << 18:
                best = [cut(best)]
                held = 0
        q, own, score = cut(best)
        tied = (score == kth[q]).astype(bool)
        first = np.searchsorted(q * 2 + tied, q * 2 + 1)
        fits = ~tied | (np.arange(len(q)) - first < open_ties[q])
        q, own, score = q[fits], own[fits], score[fits]
        parts = [None] * len(q)
        if kth.dtype == object:
            parts = [_split(v, reach) for v in score]
            score = np.array([min(max(v, _LEAST), _MOST) for v in score], np.int64)
        arrays = [
            pa.array(ids[q]), pa.array(own), pa.array(score), pa.array(parts, pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(arrays, ["query_id", "id", "score", "long_score"])

    return pick


def _kth(candidates: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, reach: int):
    """Each query's k-th best score, and how many more at that score belong to
    the k.  With fewer than k candidates, the least score there is."""
    size = 1
    while BINS * size < 2 * reach + 1:
        size *= BINS
    low = np.full(len(ids), -reach, object if queries.dtype == object else np.int64)
    open_ = np.full(len(ids), k, np.int64)
    while True:
        counts = candidates.mapInArrow(
            _histogram(ids, queries, low, size, k), "q long, bin long, n long"
        )
        # Added over the tasks, then from the top down to the bin that holds the
        # k-th: at most k bins a query reach the driver, one block at a time.
        summed = counts.groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
        above = F.coalesce(F.sum("n").over(down), F.lit(0))
        rows = summed.withColumn("above", above).where(F.col("above") < k).collect()
        deepest: dict[int, tuple[int, int]] = {}
        for r in sorted(rows, key=lambda r: (r["q"], -r["bin"])):
            if r["above"] < open_[r["q"]]:
                deepest[r["q"]] = (r["bin"], r["above"])
        for q, (b, before) in deepest.items():
            low[q] += b * size
            open_[q] -= before
        if size == 1:
            return low, open_
        size //= BINS


def top_k(
    vectors: DataFrame,
    is_query,
    k: int = 5,
    id: str = "vec_id",
    vector: str = "embedding",
    scale: int = 256,
    block: int = BLOCK,
    workspace: Workspace | None = None,
) -> DataFrame:
    """(query_id, rank, id, score) of the k best candidates of each query;
    ``is_query`` is a condition on the column ``id``."""
    spark = vectors.sparkSession
    ws = workspace or Workspace(spark)
    candidates = ws.save(quantized(vectors, id, vector, scale), "candidates")
    asked = candidates.where(is_query(F.col("id")))
    asked = asked.groupBy("id").agg(F.min("x").alias("x")).withColumn("width", F.size("x"))
    asked = ws.save(asked, "queries")
    found, after, limits = None, None, {}
    widths = sorted(r["width"] for r in asked.select("width").distinct().collect())
    while widths:
        width = widths[0]
        rest = asked.where(F.col("width") == width)
        rest = rest if after is None else rest.where(F.col("id") > after)
        rows = rest.orderBy("id").limit(block).select("id", "x").collect()
        if not rows:
            widths, after = widths[1:], None
            continue
        after = rows[-1]["id"]
        ids = np.array([r["id"] for r in rows], np.int64)
        queries = np.array([r["x"] for r in rows], np.float64).reshape(len(ids), width)
        fitting = candidates.where(F.size("x") == width)
        if width not in limits:
            largest = F.max(F.array_max(F.transform("x", F.abs)))
            limits[width] = fitting.agg(largest).first()[0] or 0.0
        queries, reach = _kind(queries, limits[width])
        kth, ties = _kth(fitting, ids, queries, k, reach)
        near = fitting.mapInArrow(_select(ids, queries, kth, ties, k, reach), _FOUND)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("long_score"), "id")
        best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = ws.save(best, "best")
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], _FOUND + ", rank int")
    return found.select("query_id", "rank", F.col("id").alias(id), "score")
