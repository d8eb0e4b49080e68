"""Arrow helpers for tasks that read texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import AbstractContextManager

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from marginspark.workspace import arrow_batches

#: Characters of text that a task works on at once.
SLICE_CHARS = 2_000_000
#: Rows that go to a Python worker at once, where texts are long.
TEXT_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def size_for_texts(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """For an application over long texts: batches sized for texts rather than
    for numbers, on both sides of the exchange with Python, in all its jobs."""
    spark.conf.set(_ROWS, str(rows))


def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> AbstractContextManager[None]:
    """The same for the jobs that run inside only."""
    return arrow_batches(spark, rows)


def portions(
    batches: Iterable[pa.RecordBatch], text: str, chars: int = SLICE_CHARS
) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts together have about ``chars`` bytes (a longer
    text stands alone)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = column.cast(pa.large_string()).cast(pa.large_binary())
        ends = np.cumsum(np.diff(np.frombuffer(sizes.buffers()[1], np.int64)[
            sizes.offset : sizes.offset + len(sizes) + 1
        ])) if len(batch) else np.zeros(0, np.int64)
        at = 0
        while at < len(batch):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + chars, side="right")))
            yield batch.slice(at, to - at)
            at = to


def slices(
    batches: Iterable[pa.RecordBatch], text: str, chars: int = SLICE_CHARS
) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The same with the texts as strings, null as empty."""
    for part in portions(batches, text, chars):
        texts = part.column(part.schema.get_field_index(text)).to_pylist()
        yield part, [t or "" for t in texts]


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``flat[start : start + length]`` one after the other."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(lengths)
    shift = np.repeat(starts - (ends - lengths), lengths)
    return flat[np.arange(total) + shift]
