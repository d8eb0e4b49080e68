"""Alignment of the ids of two tokenizers over the same bytes.

``A`` is a byte-level BPE file, whose text has a blank put before it; ``B`` is a
sentencepiece file, which puts that blank there itself.  Where a token of A and
a token of B end at the same byte, a group ends; the ids of both inside a group
are linked, each with each.

1. Ends are looked up by dictionaries from end to index, one for A and one for
   B.  The ends that both have, in order, slice both id lists into groups, and
   the links of a group are expanded from its slices.
2. No token of either file reaches over the chunks of :mod:`subwords`, so the
   groups of a text are those of its chunks, and a worker aligns each distinct
   chunk once, with a bounded memory.  The pieces of B are looked through for
   that when a worker opens the files; texts in which white space touches white
   space are aligned as a whole.
3. How many documents hold a linked pair of ids is counted over the stored
   links.  The ``HEAD`` pairs of most documents (a bounded table) are joined by
   broadcast, so the pairs that every document holds do not move; the others
   meet by a shuffle in which no pair is frequent any more.  An id's highest
   count is a table of as many rows as A has ids.

Defined results: a text that is null or empty, or whose bytes are not those of
both id lists (it holds the blank marker of B), has no tokens, groups or links;
strings of special tokens inside texts are plain text; each row has its own
result and counts as one document, so repeated rows and repeated or null ids
stay; an empty table gives an empty result; columns of the input named like
result columns give way.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginspark.llm.batches import ragged, slices, text_batches
from marginspark.llm.columns import boxed, unboxed
from marginspark.llm.heads import frequent
from marginspark.llm.subwords import ChunkMemory, Encoder, byte_letters
from marginspark.workspace import Workspace

#: Pairs whose counts are joined by broadcast.
HEAD = 65_536
#: Distinct groups that a worker remembers, about.
GROUPS = 400_000
#: Characters of text aligned at once.
_SLICE = 500_000
MARKER = "▁"
#: What no piece of B may have inside, for chunks to end there.
_OVER = re.compile(r"\S[ \n]|\n.|[0-9A-Za-z\u00c0-\u00ff][,.]", re.S)
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def shared_ends(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """(tokens of A, tokens of B) before each end that both lists of ends have."""
    index_a = dict(zip(a, range(1, len(a) + 1)))
    index_b = dict(zip(b, range(1, len(b) + 1)))
    return [(index_a[end], index_b[end]) for end in sorted(index_a.keys() & index_b.keys())]


class Pair:
    """Both tokenizers with the bytes of their ids."""

    def __init__(self, path_a: str, path_b: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.a, self.b = Encoder(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.tokenizer.encode_special_tokens = True
        letter = byte_letters()
        vocab = self.a.tokenizer.get_vocab(with_added_tokens=False)
        self.size_a = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.size_a[i] = len(token) if all(c in letter for c in token) else 0
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        spelled = [b"\0" if _BYTE.fullmatch(p) else p.replace(MARKER, " ").encode() for p in pieces]
        self.size_b = np.array([len(s) for s in spelled], np.int64)
        self.leads = np.array([p.startswith(MARKER) for p in pieces])
        self.blank = self.b.piece_to_id(MARKER)
        over = [p for p in pieces if _OVER.search(p.replace(MARKER, " "))]
        if over:
            raise ValueError(f"pieces of B reach over the ends of chunks: {over[:3]}")

    def ids_b(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks by B, and how many each has.  B puts a blank before
        what it is given: it stands for a chunk's own, or is dropped where a
        chunk starts with something else, beside which it stays by itself."""
        word = np.fromiter((c[:1] == " " and c[1:].isalpha() for c in chunks), bool, len(chunks))
        flat, sizes = [np.zeros(0, np.int64)], np.zeros(len(chunks), np.int64)
        if word.any():
            # Words in one call: each starts with the only blank that it has.
            ids = np.array(self.b.encode("".join(c for c, w in zip(chunks, word) if w)[1:]), np.int64)
            starts = np.flatnonzero(self.leads[ids])
            if len(starts) == word.sum():
                flat.append(ids)
                sizes[word] = np.diff(starts, append=len(ids))
            else:
                word[:] = False
        rest = np.flatnonzero(~word)
        # With a line feed before it, a chunk without a blank stands as in a text.
        own = [c[1:] if (c := chunks[i])[:1] == " " else "\n" + c for i in rest]
        for i, ids in zip(rest, self.b.encode(own, num_threads=1) if own else []):
            ids = (ids or [self.blank]) if chunks[i][:1] == " " else ids[2:]
            flat.append(ids)
            sizes[i] = len(ids)
        order = np.concatenate([np.flatnonzero(word), rest])
        starts = np.zeros(len(chunks), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return ragged(np.concatenate(flat).astype(np.int64), starts, sizes), sizes


_pairs: dict[tuple[str, str], Pair] = {}


def pair_of(path_a: str, path_b: str) -> Pair:
    """This worker's copy of two files; kept from task to task."""
    if (path_a, path_b) not in _pairs:
        _pairs[path_a, path_b] = Pair(path_a, path_b)
    return _pairs[path_a, path_b]


class Groups(ChunkMemory):
    """Texts as numbers of groups.  A number stands for the ids of A and of B of
    one group; 0 for a chunk whose bytes are not those of its ids."""

    prefix = b" "

    def __init__(self, pair: Pair) -> None:
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self._tables()
        self.number: dict[tuple, int] = {}
        self.sides: tuple[list[tuple], list[tuple]] = ([()], [()])
        self.texts = [""]
        self._arrays: list[tuple[np.ndarray, np.ndarray]] | None = None

    def _number(self, a: tuple, b: tuple) -> int:
        code = self.number.setdefault((a, b), len(self.sides[0]))
        if code == len(self.sides[0]):
            self.sides[0].append(a)
            self.sides[1].append(b)
            self.texts.append(f"{','.join(map(str, a))}|{','.join(map(str, b))}")
        return code

    def _aligned(self, chunks: list[str], a: np.ndarray, many_a, b: np.ndarray, many_b):
        """The groups of chunks laid one after the other, and how many each has."""
        sizes = np.fromiter((len(c.encode("utf-8", "surrogatepass")) for c in chunks), np.int64, len(chunks))
        for ids, of, size in ((a, many_a, self.pair.size_a), (b, many_b, self.pair.size_b)):
            own = np.add.reduceat(np.append(size[ids], 0), np.cumsum(of) - of) if len(of) else of
            bad = (own != sizes) | (of == 0)
            if bad.any():
                return self._one_by_one(chunks, a, many_a, b, many_b)
        ends_a, ends_b = np.cumsum(self.pair.size_a[a]), np.cumsum(self.pair.size_b[b])
        ends = shared_ends(ends_a.tolist(), ends_b.tolist())
        cuts = np.array([(0, 0), *ends], np.int64)
        (of_a, of_b), (at_a, at_b) = np.diff(cuts, axis=0).T, cuts[:-1].T
        codes = np.zeros(len(of_a), np.int64)
        # Groups of one id on each side, the most, by their distinct pairs.
        one = (of_a == 1) & (of_b == 1)
        pairs, own = np.unique(a[at_a[one]] << 32 | b[at_b[one]], return_inverse=True)
        found = [self._number((p >> 32,), (p & 0xFFFFFFFF,)) for p in pairs.tolist()]
        codes[one] = np.array(found, np.int64)[own] if found else 0
        left, right = a.tolist(), b.tolist()
        many = np.flatnonzero(~one)
        slices_ = zip(*(x[many].tolist() for x in (at_a, of_a, at_b, of_b)))
        codes[many] = [
            self._number(tuple(left[i : i + n]), tuple(right[j : j + m])) for i, n, j, m in slices_
        ]
        upto = np.searchsorted(ends_a[cuts[1:, 0] - 1], np.cumsum(sizes), side="right")
        return codes, np.diff(upto, prepend=0)

    def _one_by_one(self, chunks, a, many_a, b, many_b):
        if len(chunks) == 1:
            return np.zeros(1, np.int64), np.ones(1, np.int64)
        found = []
        for c, i, n, j, m in zip(
            chunks, np.cumsum(many_a) - many_a, many_a, np.cumsum(many_b) - many_b, many_b
        ):
            found.append(self._aligned([c], a[i : i + n], np.array([n]), b[j : j + m], np.array([m])))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _new_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        self._arrays = None
        a, many_a = self.pair.a._new_ids(chunks)
        return self._aligned(chunks, a.astype(np.int64), many_a, *self.pair.ids_b(chunks))

    def _ids(self, texts: Sequence[str]) -> list[np.ndarray]:
        self._arrays = None
        found = []
        for t in texts:
            a = self.pair.a._ids([" " + t])[0].astype(np.int64)
            b = np.array(self.pair.b.encode(t), np.int64)
            found.append(self._aligned([" " + t], a, np.array([len(a)]), b, np.array([len(b)]))[0])
        return found

    def __call__(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Group numbers of all texts in a row, and how many each has."""
        if len(self.sides[0]) > GROUPS:
            self.clear()
        codes, many = self.encode(["" if MARKER in t else t for t in texts])
        of = np.repeat(np.arange(len(texts)), many)
        lost = np.zeros(len(texts), bool)
        lost[of[codes == 0]] = True
        return codes[~lost[of]], np.where(lost, 0, many)

    def side(self, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, sizes) of all groups, of A or B."""
        if self._arrays is None:
            self._arrays = []
            for side in self.sides:
                sizes = np.fromiter(map(len, side), np.int64, len(side))
                flat = np.fromiter(chain.from_iterable(side), np.int64, int(sizes.sum()))
                self._arrays.append((flat, np.cumsum(sizes) - sizes, sizes))
        return self._arrays[which]


def expanded(a: np.ndarray, of_a: np.ndarray, b: np.ndarray, of_b: np.ndarray) -> np.ndarray:
    """The links of groups in order: each id of A with the slice of B of its
    group, as one number."""
    times = np.repeat(of_b, of_a)
    first = np.repeat(np.cumsum(of_b) - of_b, of_a)
    return np.repeat(a, times) << 32 | ragged(b, first, times)


_LINK = T.ArrayType(
    T.StructType([T.StructField(n, T.IntegerType()) for n in ("a", "b", "n")])
)
_GROUP = T.ArrayType(
    T.StructType([T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("a", "b")])
)


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values)


_SIZES = ("n_a", "n_b", "n_groups", "n_links")
_KINDS = {
    "groups": _GROUP, "links": _LINK, "groups_sha256": T.StringType(),
    **{n: T.LongType() for n in _SIZES},
}


def align(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    text: str = "text",
    made: Sequence[str] = ("groups", "links"),
) -> DataFrame:
    """The columns of ``docs`` but for the text, with those of ``made``:
    ``groups`` (the ids of A and of B of each group, in order), ``links`` (each
    distinct linked pair of ids, with its number of occurrences), their sizes
    ``n_a``, ``n_b`` (ids), ``n_groups``, ``n_links`` (occurrences), and
    ``groups_sha256`` of ``a1,a2|b1;a3|b2,b3``, empty without tokens."""
    boxes = docs.select(
        boxed(docs, text, *made).alias("doc"), docs[f"`{text}`"].cast("string").alias("text")
    )
    schema = T.StructType([boxes.schema["doc"], *[T.StructField(n, _KINDS[n]) for n in made]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Groups(pair_of(path_a, path_b))
        for part, texts in slices(batches, "text", _SLICE):
            found = _columns(known, texts, made)
            yield pa.RecordBatch.from_arrays([part.column(0), *map(found.get, made)], schema.names)

    aligned = boxes.mapInArrow(run, schema)
    return aligned.select(*unboxed(aligned, "doc", text, *made), *made)


def _columns(known: Groups, texts: list[str], made: Sequence[str]) -> dict[str, pa.Array]:
    codes, many = known(texts)
    flat, of = [], []
    for which in (0, 1):
        ids, starts, sizes = known.side(which)
        of.append(sizes[codes])
        flat.append(ragged(ids, starts[codes], of[-1]))
    row_of = np.repeat(np.arange(len(texts)), many)
    link = expanded(flat[0], of[0], flat[1], of[1])
    totals = {"n_a": of[0], "n_b": of[1], "n_groups": np.ones(len(codes)), "n_links": of[0] * of[1]}
    found = {
        n: pa.array(np.bincount(row_of, v, len(texts)).astype(np.int64)) for n, v in totals.items()
    }
    if "groups" in made:
        sides = [_lists(pa.array(x.astype(np.int32)), n) for x, n in zip(flat, of)]
        found["groups"] = _lists(pa.StructArray.from_arrays(sides, ["a", "b"]), many)
    if "groups_sha256" in made:
        ends = np.cumsum(many)
        own = [codes[e - n : e].tolist() for e, n in zip(ends, many)]
        joined = [";".join(map(known.texts.__getitem__, x)).encode() for x in own]
        found["groups_sha256"] = pa.array([hashlib.sha256(j).hexdigest() if j else "" for j in joined])
    if "links" in made:
        # Equal links of a text come together by sorting (text, link).
        row_of = np.repeat(row_of, of[0] * of[1])
        order = np.lexsort((link, row_of))
        link, row_of = link[order], row_of[order]
        first = np.flatnonzero(np.diff(link, prepend=-1) | np.diff(row_of, prepend=-1))
        times = np.diff(np.append(first, len(link)))
        link, row_of = link[first], row_of[first]
        fields = [pa.array(x.astype(np.int32)) for x in (link >> 32, link & 0xFFFFFFFF, times)]
        pairs = pa.StructArray.from_arrays(fields, ["a", "b", "n"])
        found["links"] = _lists(pairs, np.bincount(row_of, minlength=len(texts)))
    return found


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, n_docs): how many rows of ``links(row, links)`` hold each pair."""
    pair = links.select(F.explode("links").alias("l")).select("l.a", "l.b")
    return pair.groupBy("a", "b").agg(F.count("*").alias("n_docs"))


def link_scores(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    text: str = "text",
    head: int = HEAD,
    workspace: Workspace | None = None,
) -> DataFrame:
    """The columns of ``docs`` but for the text, with ``n_a``, ``n_b``,
    ``n_groups``, ``n_links``, ``groups_sha256`` (as :func:`align`), ``n_best``, the links whose count is the highest of their
    id of A, and ``count_sum``, the sum of the counts of all links."""
    ws = workspace or Workspace(docs.sparkSession)
    made = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")
    box = docs.select(
        boxed(docs, text, *made).alias("doc"),
        F.monotonically_increasing_id().alias("row"),
        docs[f"`{text}`"].alias("text"),
    )
    with text_batches(ws.spark):
        rows = ws.save(align(box, path_a, path_b, made=(*made[:5], "links")), "aligned")
    counts = pair_counts(rows)
    counts = ws.save(counts, "counts")
    highest = counts.groupBy("a").agg(F.max("n_docs").alias("highest"))
    # At most a row per id of A.
    known = counts.join(F.broadcast(highest), "a").select(
        "a", "b", "n_docs", (F.col("n_docs") == F.col("highest")).alias("best")
    )
    known = ws.save(known, "known")
    near = ws.save(frequent(known, "n_docs", head), "head")
    spread = rows.select("row", F.explode("links").alias("l")).select("row", "l.a", "l.b", "l.n")
    sums = [
        F.sum(F.when(F.col("best"), F.col("n").cast("long"))).alias("n_best"),
        F.sum(F.col("n") * F.col("n_docs")).alias("count_sum"),
    ]
    hit = spread.join(F.broadcast(near), ["a", "b"]).groupBy("row").agg(*sums)
    rest = spread.join(F.broadcast(near.select("a", "b")), ["a", "b"], "left_anti")
    far = known.join(F.broadcast(near.select("a", "b")), ["a", "b"], "left_anti")
    rest = rest.join(far, ["a", "b"]).groupBy("row").agg(*sums)
    scored = hit.unionByName(rest).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")
    )
    none = F.lit(0).cast("long")
    return rows.join(scored, "row", "left").select(
        *unboxed(rows, "doc", text, *made),
        *made[:5],
        F.coalesce("n_best", none).alias("n_best"),
        F.coalesce("count_sum", none).alias("count_sum"),
    )
