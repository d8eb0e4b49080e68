"""Digest columns of id payloads, for results that stand for whole sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def with_crc32(
    df: DataFrame, payload: str = "ids", length: str = "length", name: str = "ids_crc32"
) -> DataFrame:
    """Replace a payload of ids (little-endian, any fixed width) by the unsigned
    crc32 of the ids as little-endian unsigned 32-bit integers."""
    fields = [f for f in df.schema.fields if f.name != payload]
    schema = T.StructType([*fields, T.StructField(name, T.LongType())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for ids, n in zip(batch.column(payload), batch.column(length).to_pylist()):
                raw = ids.as_buffer()
                kind = np.dtype(f"<u{raw.size // n}" if n else "<u4")
                found.append(zlib.crc32(np.frombuffer(raw, kind).astype("<u4")))
            keep = [c for c in batch.schema.names if c != payload]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, keep), pa.array(found, pa.int64())], [*keep, name]
            )

    return df.mapInArrow(digest, schema)
