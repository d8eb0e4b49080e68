"""A corpus from raw documents to packed training windows, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginspark.llm import line_dedup, near_copies as copies, packing, quality, simhash, toxicity
from marginspark.llm.batches import size_for_texts
from marginspark.llm.digests import with_crc32
from marginspark.llm.queries import table
from marginspark.workspace import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule go."""
    size_for_texts(spark)
    return quality.keep_good(docs)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go.  The model learns from the labelled
    documents of this stage's input; without any, all documents stay."""
    labels = table(spark, sf_dir, "labels")
    # Labels of documents that are gone must not use up the bound on rows.
    known = labels.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    model = toxicity.fit(docs, known, ~toxicity.held_out())
    return toxicity.keep_civil(docs, model)


def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copied line runs are cut out of the texts; all documents stay."""
    cut = line_dedup.dedup_lines(docs)
    columns = [F.col(f"`{name}`") for name in docs.columns]
    if "n_chars" in docs.columns:
        at = docs.columns.index("n_chars")
        columns[at] = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return cut.select(*columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: five words and a
    similarity of 0.8 or more, compared on the texts.  Fingerprints of
    :mod:`simhash` that 3 bits link, as in ``op3_simhash``, are compared first.
    Texts at that similarity may be some 10 of 64 bits apart; those meet by
    :mod:`near_copies`."""
    return copies.keep_one(docs, radius=simhash.RADIUS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, as pieces of windows."""
    size_for_texts(spark)
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.pack(docs.select("doc_id", "text"), tokenizer, end_id=1)
    return with_crc32(pieces)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", civil),
    ("line_dedup", line_runs),
    ("simhash_near_dedup", near_copies),
    ("packing", pack_windows),
]

#: The toxicity model and the tokenizer cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the tables between stages stay below the shared
    folder, as the result reads from them."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
