"""Toxicity scores by logistic regression over hashed word n-grams.

Features of a text are its words, their stems, its bigrams and skip-bigrams (one
word left out), hashed into ``BUCKETS`` buckets; a bucket counts once per text.
The model is fitted by FTRL-proximal: every coordinate has its own rate, and the
L1 term keeps all weights at zero but the few that carry signal.  So the model
is a short list (bucket, weight) of bounded size, sent to all tasks, and scoring
is one pass over the texts without a shuffle.

Fitting reads at most ``max_rows`` labelled rows, chosen by a hash of the id, in
one task: the bound is a parameter, and online descent is sequential.

Defined results: null and empty texts have no feature and get the score of the
intercept; of repeated labels of an id the highest counts, of repeated rows of
an id the least text is learned; rows without label, or with a null one, are
not learned; without any label all scores are 0.5; repeated rows get equal
scores; an empty table gives an empty result; columns of the input named like
result columns give way to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginspark.llm.batches import slices, text_batches
from marginspark.llm.columns import boxed, others_of

BUCKETS = 1 << 20
MAX_ROWS = 16_000
EPOCHS = 3
THRESHOLD = 0.3
#: Letters of a stem.
STEM = 5
#: FTRL-proximal: rate, its offset, L1, L2.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 5.0, 1.0
#: Words that a task remembers.
_MEMORY = 200_000
_TRIM = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”’…¡¿"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)


class _Words(dict):
    """Blank-separated chunk to number; row by number, ``hashes`` has the hashes
    of its word and of its stem, zero for a chunk without a word."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes = np.zeros((1 << 14, 2), np.uint64)

    def __missing__(self, chunk: str) -> int:
        word = chunk.lower().strip(_TRIM)
        code = len(self)
        if code == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        digest = xxhash.xxh64_intdigest
        if word:
            stem = digest("^" + word[:STEM]) if len(word) > STEM else 0
            self.hashes[code] = digest(word) | 1, stem
        self[chunk] = code
        return code


class Features:
    def __init__(self) -> None:
        self.words = _Words()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The buckets of each text, with repeats."""
        if len(self.words) > _MEMORY:
            self.words = _Words()
        parts = [text.split() for text in texts]
        code = self.words.__getitem__
        codes = [np.fromiter(map(code, p), np.int64, len(p)) for p in parts]
        table = self.words.hashes
        out = []
        for own in codes:
            pair = table[own]
            word = pair[:, 0]
            spoken = word != 0
            word, stem = word[spoken], pair[spoken, 1]
            grams = [
                word * _A,
                stem[stem != 0] * _A,
                (word[:-1] * _A + word[1:]) * _B,
                (word[:-2] * _B + word[2:]) * _A,
            ]
            out.append((np.concatenate(grams) >> _SHIFT).astype(np.int64))
        return out


def ftrl(
    rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS
) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights that are not zero, from rows of distinct buckets, the
    last of them ``BUCKETS``; that is the intercept, which is not held back by
    L1 and comes back as bucket -1."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    l1 = np.full(BUCKETS + 1, L1)
    l1[-1] = 0.0

    def weights(i: np.ndarray) -> np.ndarray:
        over = np.maximum(np.abs(z[i]) - l1[i], 0.0)
        return -np.sign(z[i]) * over / ((BETA + np.sqrt(n[i])) / ALPHA + L2)

    for _ in range(epochs):
        for i, y in zip(rows, labels):
            w = weights(i)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            rise = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - rise * w
            n[i] += g * g
    every = weights(np.arange(BUCKETS + 1))
    at = np.flatnonzero(every)
    return np.where(at == BUCKETS, -1, at), every[at]


def _training_rows(
    docs: DataFrame, labels: DataFrame, learn: Column, max_rows: int, id: str, text: str
) -> DataFrame:
    """(text, toxic, at) of at most ``max_rows`` labelled rows."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(id).isNotNull() & learn)
    known = known.groupBy(id).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = min(1.0, 1.05 * max_rows / max(1, known.count()))
    at = F.xxhash64(F.lit(5), F.col(id))
    near = known.withColumn("at", at).where(
        F.pmod(at, F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))
    )
    chosen = near.orderBy(F.pmod("at", F.lit(1 << 40)), "at").limit(max_rows)
    # At most ``max_rows`` ids go to all tasks.
    texts = docs.select(F.col(id), docs[f"`{text}`"].cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), id)
    return found.groupBy(id).agg(
        F.min("text").alias("text"), F.first("toxic").alias("toxic"), F.first("at").alias("at")
    )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column | None = None,
    max_rows: int = MAX_ROWS,
    id: str = "doc_id",
    text: str = "text",
) -> list[tuple[int, float]]:
    """The model as (bucket, weight).  ``learn`` says which ids may be learned."""
    allowed = F.lit(True) if learn is None else learn
    rows = _training_rows(docs, labels, allowed, max_rows, id, text)
    one = rows.select("text", "toxic", "at").repartition(1).sortWithinPartitions("at", "text")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, found, marks = Features(), [], []
        for part, texts in slices(batches, "text"):
            found += [np.unique(f).astype(np.int32) for f in features(texts)]
            marks += part.column(1).to_pylist()
        if marks:
            at, w = ftrl(found, np.array(marks, float))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w)], ["bucket", "weight"])

    model = one.mapInArrow(train, "bucket long, weight double")
    with text_batches(docs.sparkSession):
        found = model.collect()  # BUCKETS + 1 at most
    return [(r["bucket"], r["weight"]) for r in found]


def scores(docs: DataFrame, model: list[tuple[int, float]], text: str = "text") -> DataFrame:
    """The columns of ``docs`` with ``score``, from 0 to 1."""
    at = np.array([b for b, _ in model], np.int64)
    w = np.array([v for _, v in model], np.float64)
    boxes = docs.select(
        boxed(docs, "score").alias("doc"), docs[f"`{text}`"].cast("string").alias("text")
    )
    schema = T.StructType([boxes.schema["doc"], T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(BUCKETS)
        dense[at[at >= 0]] = w[at >= 0]
        intercept = w[at < 0].sum()
        features = Features()
        for part, texts in slices(batches, "text"):
            sums = []
            for own in features(texts):
                met = np.unique(own[dense[own] != 0])
                sums.append(intercept + dense[met].sum())
            value = 1.0 / (1.0 + np.exp(-np.clip(np.array(sums, float), -35, 35)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(value)], ["doc", "score"])

    scored = boxes.mapInArrow(score, schema)
    names = [f.name for f in schema["doc"].dataType.fields if f.name != "_none"]
    keep = others_of(names, ("score",))
    return scored.select(*[F.col("doc")[n].alias(n) for n in keep], "score")


def held_out(id: str = "doc_id") -> Column:
    """Ids that no model learns from: a quarter by crc32."""
    text = F.coalesce(F.col(id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 4 == 2


def keep_civil(docs: DataFrame, model: list[tuple[int, float]]) -> DataFrame:
    """The rows that score below ``THRESHOLD``, with the columns of ``docs``; all
    rows where nothing could be learned."""
    if not model:
        return docs
    judged = scores(docs.select(F.struct("*").alias("_row"), "text"), model)
    return judged.where(F.col("score") < THRESHOLD).select("_row.*")
