"""Sums of whole vectors by key, over partial sums of tasks.

A vector stays one array from the task that makes it to the sum: it is never
taken apart into rows.  The partial sums of the tasks meet in two rounds, so
that no task adds up more than about the root of their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginspark.functions import batches as B

# Numbers that a task holds before it passes its partial sums on.
CELLS = 1 << 22
# Tasks whose partial sums one task may add up.
FAN_IN = 32

#: Makes of a batch a function from rows (an index) to the sum of their vectors.
Prepare = Callable[[pa.RecordBatch], Callable[[np.ndarray], np.ndarray]]


def fold(key: str, prepare: Prepare, ordered: bool = False):
    """A ``mapInArrow`` function: one row ``(key, v)`` per key and task.

    Of rows in the order of the key (``ordered``) it holds one sum; otherwise it
    holds ``CELLS`` numbers and then passes its sums on, so a key may come twice.
    """

    def rows(totals: dict, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        for name, v in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name], kind), B.vectors(v[None, :])], [key, "v"]
            )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        kind = None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch[key].type
            coded = batch[key].dictionary_encode(null_encoding="encode")
            codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            add = prepare(batch)
            order = np.argsort(codes, kind="stable")
            ends = np.searchsorted(codes[order], np.arange(len(names) + 1))
            for i, name in enumerate(names):
                v = add(order[ends[i] : ends[i + 1]])
                totals[name] = totals[name] + v if name in totals else v
            if ordered:
                last = {names[codes[-1]]: totals.pop(names[codes[-1]])}
                yield from rows(totals, kind)
                totals = last
            elif len(totals) * len(v) > CELLS:
                yield from rows(totals, kind)
                totals = {}
        yield from rows(totals, kind)

    return run


def _added(batch: pa.RecordBatch):
    V = B.matrix(batch["v"])
    return lambda at: V[at].sum(axis=0)


def vectors_by(df: DataFrame, key: str, prepare: Prepare, tasks: int | None = None) -> DataFrame:
    """``(key, v)``: per key of ``df`` the sum of the vectors that ``prepare``
    makes of its rows.  ``tasks`` is the number of tasks that scan ``df``, where
    it is known; up to ``FAN_IN`` of them need one round only.  A null key is a
    key like any other; no rows give no row."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, v array<double>"
    partials = df.mapInArrow(fold(key, prepare), schema)
    if tasks is None or tasks > FAN_IN:
        buckets = FAN_IN if tasks is None else int(np.ceil(np.sqrt(tasks)))
        dealt = partials.withColumn("_bucket", F.spark_partition_id() % buckets)
        dealt = dealt.repartition(key, "_bucket").select(key, "v")
        partials = dealt.mapInArrow(fold(key, _added), schema)
    met = partials.repartition(key).sortWithinPartitions(key)
    return met.mapInArrow(fold(key, _added, ordered=True), schema)
