"""Fill-in-the-middle forms of texts, cut between units of whole characters.

A text is cut twice between its units (lines, by default) into prefix, middle
and suffix, and written in one of three forms: as it is, prefix and suffix
before the middle, or suffix first.

1. The characters of a slice of texts are mapped to classes by one table lookup
   and held in one wavelet matrix: bit planes of the classes, each with counts
   of its ones, sorted stably by bit from plane to plane.
2. The number of units that end before a place is a sum of ranks of the classes
   that end units, plus one for a text whose last unit is open.
3. The place of a cut is found by bisection on those ranks, for all texts of the
   slice in step; each step is a rank over whole arrays.

Defined results: a null text counts as empty; an empty text, and one that holds
a marker, stays plain; the draws depend on the id and the seed alone (a null id
is drawn as an empty string), so repeated ids are cut alike and a recomputed
task gives the same rows; extra columns stay, but for those named like result
columns; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginspark.llm.batches import slices
from marginspark.llm.columns import boxed, unboxed

#: Characters of text in one matrix, about.
_SLICE = 1_000_000
#: Classes of characters.
OTHER, BLANK, LINE, STOP = range(4)


@dataclass(frozen=True)
class Markers:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __iter__(self) -> Iterator[str]:
        return iter((self.prefix, self.suffix, self.middle))


@dataclass(frozen=True)
class Settings:
    """``rate`` of a hundred texts are transformed, ``spm`` of a hundred of these
    with the suffix first; ``ends`` are the classes of which each character ends
    a unit."""

    seed: int = 7
    rate: int = 100
    spm: int = 50
    ends: tuple[int, ...] = (LINE,)
    markers: Markers = Markers()


#: Class of each character of the table, others beyond it.
_CLASS = np.full(0x110000, OTHER, np.uint8)
_CLASS[[*b"\t\x0b\x0c\r "]] = BLANK
_CLASS[ord("\n")] = LINE
_CLASS[[*map(ord, ".!?")]] = STOP


class WaveletMatrix:
    """Ranks and places of symbols below ``2 ** planes`` in a sequence."""

    _BLOCK = 64

    def __init__(self, symbols: np.ndarray, planes: int = 2) -> None:
        self.size = len(symbols)
        self.planes: list[tuple[np.ndarray, np.ndarray, int]] = []
        for plane in reversed(range(planes)):
            bit = (symbols >> plane) & 1
            words = np.packbits(bit, bitorder="little")
            words = np.append(words, np.zeros(-len(words) % 8 + 8, np.uint8)).view(np.uint64)
            before = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            before = np.concatenate([np.zeros(1, np.int64), before[:-1]])
            zeros = self.size - int(bit.sum())
            self.planes.append((words, before, zeros))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    @staticmethod
    def _ones(plane: tuple[np.ndarray, np.ndarray, int], at: np.ndarray) -> np.ndarray:
        words, before, _ = plane
        word, bit = at // 64, (at % 64).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return before[word] + np.bitwise_count(words[word] & mask).astype(np.int64)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How many of ``symbol`` are before each place."""
        low, high = np.zeros_like(at), np.array(at)
        for k, plane in enumerate(self.planes):
            one = symbol >> (len(self.planes) - 1 - k) & 1
            low, high = (
                (x_ones + plane[2] if one else x - x_ones)
                for x, x_ones in ((low, self._ones(plane, low)), (high, self._ones(plane, high)))
            )
        return high - low


class Units:
    """Units of texts that lie one after the other in ``matrix``."""

    def __init__(self, chars: np.ndarray, sizes: np.ndarray, ends: Sequence[int]) -> None:
        classes = _CLASS[chars]
        self.matrix = WaveletMatrix(classes)
        self.ends = tuple(ends)
        self.to = np.cumsum(sizes)
        self.start = self.to - sizes
        self.before = self._closed(self.start)
        last = classes[np.maximum(self.to - 1, 0)] if len(classes) else np.zeros(len(sizes), np.uint8)
        self.open = (sizes > 0) & ~np.isin(last, self.ends)
        self.count = self._closed(self.to) - self.before + self.open

    def _closed(self, at: np.ndarray) -> np.ndarray:
        """Units of all texts that are closed by a character before each place."""
        return sum(self.matrix.rank(c, at) for c in self.ends)

    def cut(self, units: np.ndarray) -> np.ndarray:
        """Characters of each text's first ``units`` units."""
        low, high = self.start.copy(), self.to.copy()
        want = self.before + units
        # The least place with enough closed units before it; an open last unit
        # is never closed and ends with its text.
        while (low < high).any():
            mid = (low + high) // 2
            enough = self._closed(mid) >= want
            high = np.where(enough, mid, high)
            low = np.where(enough, low, np.minimum(mid + 1, high))
        return low - self.start


def draws(id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the seed and an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def compose(form: str, prefix: str, middle: str, suffix: str, markers: Markers = Markers()) -> str:
    p, s, m = markers
    if form == "plain":
        return prefix + middle + suffix
    return p + prefix + s + suffix + m + middle if form == "psm" else s + suffix + p + prefix + m + middle


def restore(output: str, form: str, markers: Markers = Markers()) -> str:
    """The text that an output was made from."""
    p, s, m = markers
    if form == "plain":
        return output
    rest, middle = output.split(m)
    if form == "psm":
        prefix, suffix = rest[len(p) :].split(s)
    else:
        suffix, prefix = rest[len(s) :].split(p)
    return prefix + middle + suffix


_MADE = {
    "n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(),
    "middle_chars": T.LongType(), "output": T.StringType(),
}


def transform(
    docs: DataFrame, id: str = "doc_id", text: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """The columns of ``docs`` but for the text, with ``n`` units, ``form``
    (plain, psm or spm), ``prefix_chars`` and ``middle_chars`` (null if plain)
    and ``output``."""
    boxes = docs.select(
        boxed(docs, text, *_MADE).alias("doc"),
        F.array(*draws(docs[f"`{id}`"], settings.seed)).alias("h"),
        docs[f"`{text}`"].cast("string").alias("text"),
    )
    schema = T.StructType([boxes.schema["doc"], *[T.StructField(*x) for x in _MADE.items()]])
    marks = settings.markers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text", _SLICE):
            chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            units = Units(chars, sizes, settings.ends)
            h = np.asarray(part.column(1).flatten()).reshape(len(texts), 4)
            first, second = (h[:, k] % (units.count + 1) for k in (0, 1))
            ends = [units.cut(f(first, second)).tolist() for f in (np.minimum, np.maximum)]
            rows = []
            for t, a, b, own in zip(texts, *ends, h.tolist()):
                if not t or any(m in t for m in marks) or own[2] % 100 >= settings.rate:
                    rows.append(("plain", None, None, t))
                    continue
                form = "spm" if own[3] % 100 < settings.spm else "psm"
                rows.append((form, a, b - a, compose(form, t[:a], t[a:b], t[b:], marks)))
            made = [pa.array(units.count)]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            made += [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([part.column(0), *made], ["doc", *_MADE])

    out = boxes.mapInArrow(run, schema)
    return out.select(*unboxed(out, "doc", text, *_MADE), *_MADE)


def with_digests(cut: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``output`` replaced by ``output_sha256`` and ``restored_sha256``, the
    latter of the text rebuilt from output and form."""
    keep = [f for f in cut.schema.fields if f.name != "output"]
    made = ("output_sha256", "restored_sha256")
    schema = T.StructType([*keep, *[T.StructField(n, T.StringType()) for n in made]])

    def digest(t: str) -> str:
        return hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, outputs in slices(batches, "output"):
            forms = part.column(part.schema.get_field_index("form")).to_pylist()
            found = [
                pa.array([digest(o) for o in outputs], pa.string()),
                pa.array([digest(restore(o, f, settings.markers)) for o, f in zip(outputs, forms)], pa.string()),
            ]
            kept = [part.column(part.schema.get_field_index(f.name)) for f in keep]
            yield pa.RecordBatch.from_arrays([*kept, *found], schema.names)

    return cut.mapInArrow(run, schema)
