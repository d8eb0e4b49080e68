"""Packing of documents into training windows, online and in bounded space.

Each task reads its split once: it encodes the texts, cuts full windows off long
documents, and places what is left best-fit into a fixed number of open windows.
When a piece fits none of them, the fullest is topped up with the piece's head
and emitted, and the rest of the piece goes on.  At the end of a split the open
windows are left over; they are merged in rounds, ``FAN`` tasks' leftovers by
one task of the next round with the same packer, until one task holds the last
few, which it cuts together.  Only leftovers are ever shuffled: a bounded number
of windows per task.  No document, source or group of copies is a key.

Defined results: a null or empty text is the end id alone; a text longer than a
window takes as many windows as it needs; repeated rows are packed each on its
own; an empty table has no pieces; columns of the input named like result
columns give way to them.  The first table is written before it is read twice,
so a lost executor cannot mix two placements.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginspark.llm.batches import slices, text_batches
from marginspark.llm.columns import boxed, others_of
from marginspark.llm.subwords import encoder
from marginspark.workspace import Workspace

WINDOW = 2048
OPEN_WINDOWS = 64
#: Tasks whose leftovers one task of the next round merges.
FAN = 64
PIECE = ("start", "length", "ids", "doc_tokens", "sequence_id", "offset")
_END = 1


class Packer:
    """Open windows of one task.  An item is (tag, ids of the piece); ``emit``
    gets a sequence number and the pieces of a finished window, in order."""

    def __init__(self, window: int, slots: int, emit) -> None:
        self.window, self.emit, self.number = window, emit, 0
        self.room = np.full(slots, window, np.int64)
        self.held: list[list] = [[] for _ in range(slots)]

    def _close(self, slot: int) -> None:
        self.emit(self.number, self.held[slot], True)
        self.number += 1
        self.room[slot], self.held[slot] = self.window, []

    def _put(self, slot: int, tag, start: int, ids: np.ndarray) -> None:
        self.held[slot].append((tag, start, ids))
        self.room[slot] -= len(ids)
        if not self.room[slot]:
            self._close(slot)

    def add(self, tag, start: int, ids: np.ndarray) -> None:
        while len(ids) >= self.window:
            self.emit(self.number, [(tag, start, ids[: self.window])], True)
            self.number += 1
            start, ids = start + self.window, ids[self.window :]
        if not len(ids):
            return
        used = self.room < self.window
        fits = np.where(used & (self.room >= len(ids)), self.room, self.window + 1)
        slot = int(fits.argmin())
        if fits[slot] > self.window:
            free = np.flatnonzero(~used)
            if not len(free):
                fullest = int(self.room.argmin())
                head = int(self.room[fullest])
                self._put(fullest, tag, start, ids[:head])
                start, ids, free = start + head, ids[head:], [fullest]
            slot = int(free[0])
        self._put(slot, tag, start, ids)

    def leave(self) -> None:
        """Hand over the open windows as they are."""
        for slot in np.argsort(self.room, kind="stable"):
            if self.held[slot]:
                self.emit(self.number, self.held[slot], False)
                self.number += 1

    def finish(self) -> None:
        """Cut the open windows together: all but the last come out full."""
        rest = [p for s in np.argsort(self.room, kind="stable") for p in self.held[s]]
        last: list = []
        room = self.window
        for tag, start, ids in rest:
            while len(ids):
                part = ids[:room]
                last.append((tag, start, part))
                start, ids, room = start + len(part), ids[len(part) :], room - len(part)
                if not room:
                    self.emit(self.number, last, True)
                    self.number, last, room = self.number + 1, [], self.window
        if last:
            self.emit(self.number, last, True)


class _Rows:
    """Collects pieces as columns and hands them out as Arrow batches."""

    def __init__(self, schema: pa.Schema, width: int, base: int) -> None:
        self.schema, self.base = schema, base
        self.type = np.dtype(f"<u{width}")
        self.clear()

    def clear(self) -> None:
        self.columns: list[list] = [[] for _ in self.schema]
        self.size = 0

    def emit(self, number: int, pieces: list, closed: bool) -> None:
        offset = 0
        for (box, total), start, ids in pieces:
            row = (
                box, start, len(ids), ids.astype(self.type).tobytes(), total,
                self.base + number, offset, closed,
            )
            for column, value in zip(self.columns, row):
                column.append(value)
            offset += len(ids)
            self.size += len(ids)

    def batch(self) -> pa.RecordBatch:
        arrays = [pa.array(c, f.type) for c, f in zip(self.columns, self.schema)]
        self.clear()
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = _END,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    text: str = "text",
    workspace: Workspace | None = None,
) -> DataFrame:
    """One row per piece: the other columns of ``docs``, ``start`` (ids of the
    document before it), ``length``, ``ids`` (little-endian, ``id_width``
    bytes each), ``doc_tokens``, ``sequence_id``, ``offset`` in the sequence."""
    ws = workspace or Workspace(docs.sparkSession)
    boxes = docs.select(
        boxed(docs, text, *PIECE).alias("doc"), docs[f"`{text}`"].cast("string").alias("text")
    )
    box = T.StructField("doc", boxes.schema["doc"].dataType)
    rest = (
        "start long, length int, ids binary, doc_tokens long, sequence_id long,"
        " offset int, closed boolean"
    )
    schema = T.StructType([box, *T._parse_datatype_string(rest).fields])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        out: _Rows | None = None
        packer = None
        for part, texts in slices(batches, "text"):
            tags = part.column(0)
            if out is None:
                out = _Rows(
                    _arrow(tags.type), code.id_bytes, TaskContext.get().partitionId() << 32
                )
                packer = Packer(window, open_windows, out.emit)
            ids, sizes = code.encode(texts)
            ends = np.cumsum(sizes)
            for row, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist())):
                own = np.append(ids[end - size : end], end_id)
                packer.add((tags[row], size + 1), 0, own)
            if out.size:
                yield out.batch()
        if out is not None:
            packer.leave()
            yield out.batch()

    return _open(_merged(ws, boxes.mapInArrow(first, schema), window, open_windows))


def _arrow(box: pa.DataType) -> pa.Schema:
    kinds = (box, pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
    return pa.schema(list(zip(("doc", *PIECE, "closed"), kinds)))


def _round(step: int, last: bool, window: int, slots: int):
    """The work of one task of a later round on its share of the leftovers."""

    def again(table: pa.Table) -> pa.Table:
        base = (step << 56) | (table.column("_group")[0].as_py() << 32)
        order = [("sequence_id", "ascending"), ("offset", "ascending")]
        table = table.sort_by(order)
        tags, starts = table.column("doc"), table.column("start").to_pylist()
        totals = table.column("doc_tokens").to_pylist()
        payloads = [ids.as_buffer() for ids in table.column("ids")]
        width = payloads[0].size // table.column("length")[0].as_py()
        out = _Rows(_arrow(tags.type), width, base)
        packer = Packer(window, slots, out.emit)
        for row, (start, raw) in enumerate(zip(starts, payloads)):
            packer.add((tags[row], totals[row]), start, np.frombuffer(raw, out.type))
        (packer.finish if last else packer.leave)()
        return pa.Table.from_batches([out.batch()])

    return again


def _merged(
    ws: Workspace, pieces: DataFrame, window: int, slots: int
) -> DataFrame:
    """The leftovers of each round packed by the next, down to one task."""
    done, step = [], 0
    while True:
        step += 1
        with text_batches(ws.spark):
            stored = ws.save(pieces, f"pieces{step}")
        done.append(stored.where("closed"))
        left = stored.where("not closed")
        group = F.shiftright("sequence_id", 32).bitwiseAND((1 << 24) - 1)
        top = left.agg(F.max(group)).first()[0]
        if top is None:
            break
        keyed = left.withColumn("_group", F.floor(group / FAN).cast("int"))
        again = _round(step, top < FAN, window, slots)
        pieces = keyed.groupBy("_group").applyInArrow(again, stored.schema)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _open(pieces: DataFrame) -> DataFrame:
    names = [f.name for f in pieces.schema["doc"].dataType.fields if f.name != "_none"]
    keep = others_of(names, PIECE)
    return pieces.select(*[F.col("doc")[n].alias(n) for n in keep], *PIECE)
