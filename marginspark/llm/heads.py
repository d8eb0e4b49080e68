"""The most frequent rows of a table of counts, bounded in number.

Joining them by broadcast leaves a shuffle in which no key is frequent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps per doubling of a count.
_STEPS = 8


def frequent(counts: DataFrame, count: str, size: int) -> DataFrame:
    """The rows of the highest counts, ``size`` at most: all above a threshold
    that a histogram of some hundred cells gives."""
    cell = F.floor(F.log2(F.col(count)) * _STEPS)
    histogram = counts.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect()
    least, held = None, 0
    for row in sorted(histogram, key=lambda r: -r["cell"]):
        held += row["n"]
        if held > size:
            break
        least = row["cell"]
    return counts.where(F.lit(False) if least is None else cell >= least)
