"""Token counts of texts without their ids: pieces counted once per pre-token.

1. A first scan finds the distinct pre-tokens of all texts with the number of
   documents that hold each; a task sends each of its pre-tokens once per
   portion.  Each distinct pre-token is cut into pieces once.
2. A second scan forms the pre-token frequencies of each document and joins
   them to the counts.  The ``HEAD`` pre-tokens met in most documents (a bounded
   table, whatever the input) travel with the task, so the words that every text
   has are joined where they are read; what is left is joined by a shuffle, in
   which no key can be frequent any more.
3. A document's count is the sum of frequency times pieces.

Both scans work on the distinct words (runs without ASCII white space) of some
texts at once.  Words of ASCII letters, with a comma or stop after them or not,
are cut as columns; of the others a worker remembers a bounded number.  They are
cut by the library's own normalizer and pre-tokenizer, or, if they have common
letters only, by the expression that the file gives for them.  That needs a
tokenizer for which white space separates pre-tokens and leaves no trace, as in
files of BPE with word ends; for other files a text is cut as a whole.

Defined results: a null text counts as empty, which has no tokens; special
tokens inside texts are found as the library does by default; each row has its
own result, so repeated rows and repeated or null ids stay; an empty table gives
an empty result; columns of the input named like result columns give way.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from string import ascii_letters

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginspark.llm.batches import portions, ragged, text_batches
from marginspark.llm.columns import boxed, unboxed
from marginspark.llm.heads import frequent
from marginspark.llm.subwords import byte_letters
from marginspark.workspace import Workspace

#: Tokens of a document beyond which it is over the limit.
LIMIT = 2048
#: Pre-tokens whose counts travel with the tasks.
HEAD = 65_536
#: Words that a worker remembers, their length in bytes, and bytes of words of a
#: portion of the first scan, distinct in each of its slices.
WORDS, WORD_BYTES = 200_000, 64
PORTION = 32 << 20
#: Pre-tokens up to this length are keys as they are, longer ones by a digest.
KEY_BYTES = 32
_SEPARATED = (("a b", ["a", "b"]), (" a\n\tb \x0b\x0c\r", ["a", "b"]))


class PreTokens:
    """A tokenizer file's pre-tokens and the pieces of each."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("added tokens that depend on their surroundings are not supported")
        #: Longest first, as the library prefers them.
        strings = sorted((t.content for t in added), key=len, reverse=True)
        self.added = frozenset(strings)
        self._cut = re.compile(f"({'|'.join(map(re.escape, strings))})") if strings else None
        self.words = not any(re.search(r"\s", s) for s in strings) and all(
            self.of(text) == [p for w in words for p in self.of(w)] for text, words in _SEPARATED
        )
        self._rule = self._own_rule(strings)
        self._memory: dict[bytes, list[str]] = {}

    def _own_rule(self, added: list[str]):
        """For files that lower a text and split it by a regular expression into
        byte-level pre-tokens: that expression, for words of common letters.
        They are the characters that the normalizer lowers one by one."""
        pre = json.loads(self.tokenizer.to_str())["pre_tokenizer"] or {}
        kinds = [(k["type"], k.get("behavior"), k.get("invert"), k.get("use_regex")) for k in pre.get("pretokenizers", [])]
        if kinds != [("Split", "Removed", True, None), ("ByteLevel", None, None, False)]:
            return None
        first = {s[0] for s in added}
        chars = [
            c for c in map(chr, [*range(0x21, 0x7F), *range(0xC0, 0x250)])
            if c not in first and (c.isascii() or c.isalpha())
            and self.tokenizer.normalizer.normalize_str(c) == c.lower()
        ]
        #: Words of ASCII letters, with one of these after them or not, need no
        #: expression: the letters are one pre-token, the sign another.
        self._signs = (b",", b".") if {*ascii_letters, ",", "."} <= {*chars} else ()
        self._common = re.compile(f"[{re.escape(''.join(chars))}]+")
        self._letters = {b: c for c, b in byte_letters().items()}
        return regex.compile(pre["pretokenizers"][0]["pattern"]["Regex"])

    def of(self, text: str) -> list[str]:
        """The pre-tokens of a text in order; an added token is one by itself."""
        normalizer, cutter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        found: list[str] = []
        for part in self._cut.split(text) if self._cut else [text]:
            if part in self.added:
                found.append(part)
            elif part:
                plain = normalizer.normalize_str(part) if normalizer else part
                found += [p for p, _ in cutter.pre_tokenize_str(plain)]
        return found

    def units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Parts of texts that are cut into pre-tokens by themselves: of each its
        text's place and its own place among the distinct ones, and these."""
        texts = pc.fill_null(texts, "")
        if self.words:
            parts = pc.ascii_split_whitespace(texts)
            rows, texts = pc.list_parent_indices(parts).to_numpy(), parts.flatten()
        else:
            rows = np.arange(len(texts))
        coded = texts.dictionary_encode()
        return rows.astype(np.int64), coded.indices.to_numpy().astype(np.int64), coded.dictionary

    def cut(self, units: pa.Array, distinct: bool = False) -> tuple[np.ndarray, pa.Array]:
        """The pre-tokens of units, each with its unit's place; an empty unit has
        none.  ``distinct`` gives each pre-token of a unit once."""
        size = pc.binary_length(units).to_numpy()
        at, found, plain = [], [], np.zeros(len(units), bool)
        if self._rule and self._signs:
            bare = pc.ascii_rtrim(units, b"".join(self._signs).decode())
            signs = size - pc.binary_length(bare).to_numpy()
            plain = pc.ascii_is_alpha(bare).to_numpy(zero_copy_only=False) & (signs <= 1)
            signed = plain & (signs == 1)
            at += [np.flatnonzero(plain), np.flatnonzero(signed)]
            found.append(pc.ascii_lower(bare.filter(pa.array(plain))))
            found.append(pc.utf8_slice_codeunits(units.filter(pa.array(signed)), -1))
        rest = np.flatnonzero(~plain & (size > 0))
        own = list(map(self.of_unit, units.take(pa.array(rest)).cast(pa.binary()).to_pylist()))
        own = [[*dict.fromkeys(ps)] for ps in own] if distinct else own
        at.append(np.repeat(rest, np.fromiter(map(len, own), np.int64, len(own))))
        found.append(pa.array([p for ps in own for p in ps], pa.string()))
        return np.concatenate(at), pa.concat_arrays(found)

    def of_unit(self, unit: bytes) -> list[str]:
        known = self._memory.get(unit)
        if known is None:
            known = self._of_unit(unit)
            if len(unit) <= WORD_BYTES:
                if len(self._memory) >= WORDS:
                    self._memory.clear()
                self._memory[unit] = known
        return known

    def _of_unit(self, unit: bytes) -> list[str]:
        word = unit.decode("utf-8", "surrogatepass")
        if not self._rule or not self._common.fullmatch(word):
            return self.of(word)
        word = word.lower()
        if word.isascii():
            return [word] if word.isalpha() else self._rule.findall(word)
        parts = self._rule.findall(word)
        return [p if p.isascii() else p.encode().decode("latin-1").translate(self._letters) for p in parts]

    def pieces(self, pretoken: str) -> int:
        if pretoken in self.added:
            return 1
        return len(self.tokenizer.model.tokenize(pretoken))


_known: dict[str, PreTokens] = {}


def pretokens(path: str) -> PreTokens:
    """This worker's copy of a file; kept from task to task."""
    if path not in _known:
        _known[path] = PreTokens(path)
    return _known[path]


def key_of(pretoken: str) -> bytes:
    """A key of bounded size."""
    raw = pretoken.encode("utf-8", "surrogatepass")
    return raw if len(raw) <= KEY_BYTES else b"\0" + xxhash.xxh3_128_digest(raw)


def keys_of(pretokens: pa.Array) -> pa.Array:
    keys = pretokens.cast(pa.binary())
    long = pc.greater(pc.binary_length(keys), KEY_BYTES)
    made = [key_of(p) for p in pretokens.filter(long).to_pylist()]
    return pc.replace_with_mask(keys, long, pa.array(made, pa.binary())) if made else keys


def _runs(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in order, and how often each is met."""
    numbers = np.sort(numbers)
    first = np.flatnonzero(np.diff(numbers, prepend=-1))
    return numbers[first], np.diff(np.append(first, len(numbers)))


def vocabulary(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(key, n_docs, pieces) of all distinct pre-tokens of the texts."""

    def summed(table: pa.Table, key: str) -> tuple[pa.Array, np.ndarray]:
        table = table.group_by(key, use_threads=False).aggregate([("n", "sum")])
        return table[key].combine_chunks(), table["n_sum"].to_numpy()

    def portion(held: list[pa.Table]) -> pa.RecordBatch:
        units, n = summed(pa.concat_tables(held), "unit")
        at, found = pretokens(path).cut(units, distinct=True)
        found, n = summed(pa.table({"pretoken": found, "n": n[at]}), "pretoken")
        arrays = [keys_of(found), found, pa.array(n, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["key", "pretoken", "n"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for part in portions(batches, "text"):
            row, unit, units = pretokens(path).units(part["text"])
            once, _ = _runs(row * len(units) + unit)
            n = np.bincount(once % max(1, len(units)), minlength=len(units))
            held.append(pa.table({"unit": units, "n": n}))
            if sum(t.nbytes for t in held) > PORTION:
                yield portion(held)
                held = []
        if held:
            yield portion(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pretokens(path).pieces(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(found, pa.int64())], ["key", "n_docs", "pieces"]
            )

    texts = docs.select(docs[f"`{text}`"].cast("string").alias("text"))
    met = texts.mapInArrow(scan, "key binary, pretoken string, n long")
    distinct = met.groupBy("key").agg(F.sum("n").alias("n_docs"), F.first("pretoken").alias("pretoken"))
    return distinct.select("key", "n_docs", "pretoken").mapInArrow(
        count, "key binary, n_docs long, pieces long"
    )


def _head(known: DataFrame, size: int) -> tuple[pa.Array, np.ndarray]:
    """Keys and pieces of the pre-tokens met in most documents: ``size`` rows at
    most."""
    rows = frequent(known, "n_docs", size).select("key", "pieces").toArrow().combine_chunks()
    return rows["key"].combine_chunks().cast(pa.binary()), rows["pieces"].to_numpy()


_TAIL = T.ArrayType(
    T.StructType([T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType())])
)


def _frequencies(
    docs: DataFrame, path: str, text: str, head: tuple[pa.Array, np.ndarray]
) -> DataFrame:
    """(doc, row, n_bytes, near, rest): ``near`` sums the pre-tokens of the head,
    ``rest`` has the frequencies of the others."""
    boxes = docs.select(
        boxed(docs, text, "n_bytes", "n_tokens", "over_limit").alias("doc"),
        F.monotonically_increasing_id().alias("row"),
        docs[f"`{text}`"].cast("string").alias("text"),
    )
    longs = [T.StructField(n, T.LongType()) for n in ("row", "n_bytes", "near")]
    schema = T.StructType([boxes.schema["doc"], *longs, T.StructField("rest", _TAIL)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, pieces = head
        for part in portions(batches, "text"):
            row, unit, units = pretokens(path).units(part["text"])
            at, found = pretokens(path).cut(units)
            keys = keys_of(found)
            place = pc.index_in(keys, common).fill_null(-1).to_numpy()
            near = place >= 0
            sure = np.bincount(at[near], pieces[place[near]], len(units))
            near_of = np.bincount(row, sure[unit], len(part)).astype(np.int64)
            # What the head lacks: the keys of each unit, then those of each text.
            rest = keys.filter(pa.array(~near)).dictionary_encode()
            at, key = at[~near], rest.indices.to_numpy().astype(np.int64)
            order = np.argsort(at, kind="stable")
            many = np.bincount(at, minlength=len(units))
            start = np.cumsum(many) - many
            key = ragged(key[order], start[unit], many[unit])
            pairs, n = _runs(np.repeat(row, many[unit]) * len(rest.dictionary) + key)
            of, key = np.divmod(pairs, max(1, len(rest.dictionary)))
            ends = np.append(0, np.cumsum(np.bincount(of, minlength=len(part))))
            keys = rest.dictionary.take(pa.array(key))
            pairs = pa.StructArray.from_arrays([keys, pa.array(n, pa.int64())], ["key", "n"])
            rest_of = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            sizes = pc.binary_length(pc.fill_null(part["text"], "")).cast(pa.int64())
            arrays = [*part.columns[:2], sizes, pa.array(near_of), rest_of]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "row", "n_bytes", "near", "rest"])

    return boxes.mapInArrow(scan, schema)


def count_tokens(
    docs: DataFrame,
    path: str,
    text: str = "text",
    limit: int = LIMIT,
    head: int = HEAD,
    workspace: Workspace | None = None,
) -> DataFrame:
    """The columns of ``docs`` but for the text, with ``n_bytes`` (UTF-8),
    ``n_tokens`` and ``over_limit``."""
    ws = workspace or Workspace(docs.sparkSession)
    with text_batches(ws.spark):
        known = ws.save(vocabulary(docs, path, text), "vocabulary")
        rows = ws.save(_frequencies(docs, path, text, _head(known, head)), "frequencies")
    rest = rows.select("row", F.explode("rest").alias("pair")).select("row", "pair.key", "pair.n")
    # Keys that are left are in a small share of the documents each.
    more = rest.join(known.select("key", "pieces"), "key").groupBy("row").agg(
        F.sum(F.col("n") * F.col("pieces")).alias("more")
    )
    total = F.col("near") + F.coalesce("more", F.lit(0))
    return rows.drop("rest").join(more, "row", "left").select(
        *unboxed(rows, "doc", text, "n_bytes", "n_tokens", "over_limit"),
        "n_bytes",
        total.alias("n_tokens"),
        (total > limit).alias("over_limit"),
    )
