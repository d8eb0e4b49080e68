"""SentencePiece encoding and decoding by a Unigram model.

Encoding finds, for each text, the pieces with the greatest sum of log scores.
The pieces stand in a double-array trie over their bytes; all places of a batch
of chunks walk it at the same time, and where no piece reaches over a place the
chunk falls apart.  The parts go through Viterbi's recursion side by side, place
by place.  A character that no piece covers is given as its bytes.  Since pieces
hold the whitespace marker at their start only, texts fall apart at blanks, and
each distinct chunk is encoded once while it is remembered.

Decoding puts the pieces' bytes together, markers as blanks, and takes away the
blank that encoding puts before a text; it gives the text back exactly, unless
the text holds the marker character itself.

The model is read from a SentencePiece file with the identity normalizer, scores
as they stand there.  Its trie is bounded by the vocabulary and broadcast.

Defined results: a null text has null ids and back, an empty text no ids; of
paths with equal scores the one whose last piece is longest is taken, as the
library does; texts of any length are encoded whole; repeated rows get equal
ids; an empty table gives an empty result; columns of the input named like the
result column give way to it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginspark.llm.batches import ragged, slices
from marginspark.llm.columns import boxed, others_of
from marginspark.llm.subwords import ChunkMemory

#: Fixed values of the file format: the marker, and kinds of pieces.
MARKER = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: What an uncovered character costs below the least score.
PENALTY = 10.0
#: Bytes of chunks that walk the trie together, but for a longer chunk.
PORTION = 1 << 18


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, raw[at : at + size]
        at += size


def read_model(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id."""
    pieces = []
    with open(path, "rb") as file:
        for number, value in _fields(file.read()):
            if number == 1:
                own = dict(_fields(value))
                score = struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0]
                pieces.append((own[1].decode(), score, own.get(3, NORMAL)))
            elif number == 3 and dict(_fields(value)).get(2):
                raise ValueError("only the identity normalizer is known")
    return pieces


class DoubleArray:
    """A trie in two arrays: the child of node ``s`` by byte ``c`` is
    ``base[s] + c`` if ``check`` names ``s`` there; ``value`` is the key's
    number or -1."""

    def __init__(self, keys: list[bytes], values: Sequence[int]) -> None:
        order = sorted(range(len(keys)), key=keys.__getitem__)
        keys, values = [keys[i] for i in order], [values[i] for i in order]
        size = 1 << 16
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.value = np.full(size, -1, np.int32)
        self.check[0] = 0
        # Single children fill holes from ``first``; several are placed from
        # ``wide`` on, which leaves crowded stretches behind.
        waiting, first, wide = [(0, 0, len(keys), 0)], 257, 257
        while waiting:
            node, low, high, depth = waiting.pop()
            if low < high and len(keys[low]) == depth:
                self.value[node] = values[low]
                low += 1
            children = []
            while low < high:
                byte, end = keys[low][depth], low + 1
                while end < high and keys[end][depth] == byte:
                    end += 1
                children.append((byte, low, end))
                low = end
            if not children:
                continue
            bytes_ = np.array([c[0] for c in children])
            while self.check[first] >= 0:
                first += 1
                if first + 512 >= len(self.check):
                    self._grow()
            if len(children) == 1:
                base = first - int(bytes_[0])
            else:
                base, tries = wide, 0
                while (self.check[base + bytes_] >= 0).any():
                    base, tries = base + 1, tries + 1
                    if base + 512 >= len(self.check):
                        self._grow()
                wide = base if tries > 16 else wide
            self.base[node] = base
            self.check[base + bytes_] = node
            waiting += [(base + b, lo, hi, depth + 1) for b, lo, hi in children]

    def _grow(self) -> None:
        size = len(self.check)
        self.base = np.concatenate([self.base, np.zeros(size, np.int32)])
        self.check = np.concatenate([self.check, np.full(size, -1, np.int32)])
        self.value = np.concatenate([self.value, np.full(size, -1, np.int32)])


class Model:
    """Trie, scores and bytes of the pieces of a file."""

    def __init__(self, pieces: list[tuple[str, float, int]]) -> None:
        plain = [i for i, (_, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)]
        self.trie = DoubleArray([pieces[i][0].encode() for i in plain], plain)
        self.scores = np.array([score for _, score, _ in pieces], np.float64)
        self.missing = self.scores[plain].min() - PENALTY
        self.byte_ids = np.full(256, -1, np.int32)
        spelled = []
        for i, (piece, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_ids[int(piece[3:5], 16)] = i
                spelled.append(bytes([int(piece[3:5], 16)]))
            elif kind == UNKNOWN:
                spelled.append(" ⁇ ".encode())
            else:
                spelled.append(b"" if kind == CONTROL else piece.replace(MARKER, " ").encode())
        if (self.byte_ids < 0).any():
            raise ValueError("the file has no byte pieces to fall back to")
        inner = [p for i in plain if MARKER in (p := pieces[i][0].lstrip(MARKER)) or "\n" in p]
        if inner:
            raise ValueError(f"pieces reach over white space: {inner[:3]}")
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spell_size = np.array([len(s) for s in spelled], np.int64)
        self.spell_start = np.cumsum(self.spell_size) - self.spell_size

    def viterbi(self, chunks: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in a row, and how many each has; some chunks at a
        time, since a text has many more matches than characters."""
        if not chunks:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        part = np.cumsum([len(c) for c in chunks]) // PORTION
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(chunks)]
        found = [self._viterbi(chunks[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        return tuple(np.concatenate(x) for x in zip(*found))

    def _viterbi(self, chunks: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        text = np.frombuffer(b"".join(chunks), np.uint8).astype(np.int32)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ends = np.cumsum(sizes)
        if not len(text):
            return np.zeros(0, np.int32), np.zeros(len(chunks), np.int64)
        start, end, piece = self._matches(text, np.repeat(ends, sizes))
        # Nothing reaches over a cut, so parts between cuts are independent.
        over = np.zeros(len(text) + 1, np.int64)
        np.add.at(over, start + 1, 1)
        np.add.at(over, end, -1)
        cut = np.cumsum(over) == 0
        cuts = np.flatnonzero(cut)
        part = cuts[np.searchsorted(cuts, start, side="right") - 1]
        score = np.where(piece < 0, self.missing, self.scores[piece])
        step = start - part
        order = np.lexsort((start, step))
        bounds = np.flatnonzero(np.diff(step[order], prepend=-1, append=-1))
        best = np.full(len(text) + 1, -np.inf)
        back = np.full(len(text) + 1, -1, np.int64)
        for a, b in zip(bounds[:-1], bounds[1:]):
            now = order[a:b]
            before = np.where(step[now] == 0, 0.0, best[start[now]])
            value, target = before + score[now], end[now]
            better = value > best[target]
            # The edges of one start end at different places, and no two parts
            # share a place but a cut, which is the end of one of them only.
            best[target[better]], back[target[better]] = value[better], now[better]
        chosen, at = [], cuts[cuts > 0]
        while len(at):
            edge = back[at]
            chosen.append(edge)
            at = start[edge]
            at = at[~cut[at]]
        path = np.concatenate(chosen)
        path = path[np.argsort(start[path], kind="stable")]
        counts = np.where(piece[path] < 0, end[path] - start[path], 1)
        ids = np.repeat(piece[path], counts)
        place = np.repeat(start[path] - (np.cumsum(counts) - counts), counts) + np.arange(len(ids))
        ids = np.where(ids < 0, self.byte_ids[text[np.where(ids < 0, place, 0)]], ids)
        total = np.concatenate([[0], np.cumsum(counts)])
        upto = total[np.searchsorted(start[path], ends)]
        return ids.astype(np.int32), np.diff(upto, prepend=0)

    def _matches(self, text: np.ndarray, limit: np.ndarray):
        """(start, end, piece) of all pieces at all characters, and piece -1 for
        each character that is no piece."""
        first = np.flatnonzero((text & 0xC0) != 0x80)
        after = np.minimum(np.append(first[1:], len(text)), limit[first])
        alone = np.zeros(len(text), bool)
        width = np.zeros(len(text), np.int64)
        width[first] = after - first
        start, node, at = first, np.zeros(len(first), np.int32), first
        found = []
        while len(start):
            inside = at < limit[start]
            start, node, at = start[inside], node[inside], at[inside]
            child = self.trie.base[node] + text[at]
            known = (self.trie.check[child] == node) & (child > 0)
            start, node, at = start[known], child[known], at[known] + 1
            value = self.trie.value[node]
            hit = value >= 0
            found.append((start[hit], at[hit], value[hit]))
            alone[start[hit & (at - start == width[start])]] = True
        rest = first[~alone[first]]
        found.append((rest, rest + width[rest], np.full(len(rest), -1, np.int32)))
        return tuple(np.concatenate(x) for x in zip(*found))

    def spell(self, ids: np.ndarray) -> bytes:
        return ragged(self.spelled, self.spell_start[ids], self.spell_size[ids]).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        raw = self.spell(ids)
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


class PieceEncoder(ChunkMemory):
    """Ids of texts by a model, each distinct chunk encoded once; a text has a
    blank put before it."""

    prefix = b" "
    fine = False

    def __init__(self, model: Model) -> None:
        self.model = model
        self._tables()

    @staticmethod
    def _raw(text: str) -> bytes:
        return text.replace(" ", MARKER).encode("utf-8", "surrogatepass")

    def _ids(self, texts: Sequence[str]) -> list[np.ndarray]:
        ids, sizes = self.model.viterbi([self._raw(" " + t) if t else b"" for t in texts])
        return np.split(ids, np.cumsum(sizes)[:-1])

    def _new_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.model.viterbi([self._raw(c) for c in chunks])


_encoders: dict[int, PieceEncoder] = {}


def encode(
    docs: DataFrame, model_path: str, text: str = "text", verify: bool = False
) -> DataFrame:
    """The columns of ``docs`` with ``ids``, and with ``same`` if ``verify``:
    whether decoding the ids gives the text back, tried where they are made."""
    made = ("ids", "same") if verify else ("ids",)
    model = docs.sparkSession.sparkContext.broadcast(Model(read_model(model_path)))
    boxes = docs.select(
        boxed(docs, *made).alias("doc"), docs[f"`{text}`"].cast("string").alias("text")
    )
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("same", T.BooleanType())]
    schema = T.StructType([boxes.schema["doc"], *fields[: len(made)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        coder = _encoders.setdefault(id(known), PieceEncoder(known))
        for part, texts in slices(batches, "text"):
            ids, sizes = coder.encode(texts)
            ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
            lists = pa.ListArray.from_arrays(
                pa.array(ends), pa.array(ids), mask=part.column(1).is_null()
            )
            arrays = [part.column(0), lists]
            if verify:
                runs = zip(texts, ends[:-1].tolist(), ends[1:].tolist())
                arrays.append(pa.array([known.decode(ids[a:b]) == t for t, a, b in runs]))
            yield pa.RecordBatch.from_arrays(arrays, ["doc", *made])

    return _opened(boxes.mapInArrow(run, schema), *made)


def decode(coded: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """The columns of ``coded`` with ``decoded``."""
    model = coded.sparkSession.sparkContext.broadcast(Model(read_model(model_path)))
    boxes = coded.select(
        boxed(coded, "decoded").alias("doc"), coded[f"`{ids}`"].cast("array<int>").alias("ids")
    )
    schema = T.StructType([boxes.schema["doc"], T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in batches:
            lists = batch.column(1)
            sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            flat = np.asarray(lists.flatten().fill_null(0))
            ends = np.cumsum(sizes)
            valid = lists.is_valid().to_pylist()
            texts = [
                known.decode(flat[e - n : e]) if ok else None
                for e, n, ok in zip(ends.tolist(), sizes.tolist(), valid)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], ["doc", "decoded"]
            )

    return _opened(boxes.mapInArrow(run, schema), "decoded")


def _opened(df: DataFrame, *made: str) -> DataFrame:
    names = [f.name for f in df.schema["doc"].dataType.fields if f.name != "_none"]
    return df.select(*[F.col("doc")[n].alias(n) for n in others_of(names, made)], *made)
