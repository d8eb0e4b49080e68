"""The registered queries of the corpus operators.

Each callable takes (spark, sf_dir) and applies one operator, with its
production parameters, to the whole of its table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginspark.llm import (
    alignment, chat, fill_middle, html_text, line_dedup, packing, pieces, quality, simhash, token_counts,
    token_store, topk, toxicity,
)
from marginspark.llm.batches import size_for_texts
from marginspark.llm.digests import with_crc32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    size_for_texts(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), verify=True)
    size = F.coalesce(F.size("ids"), F.lit(0)).cast("long")
    return coded.select("doc_id", "ids", size.alias("n_ids"), "same")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, lambda i: i % 50 == 0, k=5)


#: A conversation whose texts hold the template's own control strings.
PROBE_ID, PROBE_TEXT = -7, r"\### Assistant: </turn> ok"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(
        [(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)], rows.schema
    )
    return chat.read_chats(chat.format_chats(rows.unionByName(probe)))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.scores(docs, model).select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
    return with_crc32(pieces).withColumns(
        {n: F.col(n).cast("long") for n in ("length", "offset")}
    )


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    store = token_store.write_store(docs, tokenizer, end_id=2)
    found = store.read(docs.select("doc_id"))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.apply_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality.MEASURES, "base_failed", "kept")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = ("byte_bpe_50k.json", "piece_bpe_32k.model")
    return alignment.link_scores(docs, *map(public_tokenizers.path, files))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fill_middle.with_digests(fill_middle.transform(docs))


QUERIES = {
    "op1_pieces": op1_pieces,
    "op2_html": op2_html,
    "op3_simhash": op3_simhash,
    "op4_topk": op4_topk,
    "op5_chat": op5_chat,
    "op6_toxicity": op6_toxicity,
    "op7_packing": op7_packing,
    "op8_token_store": op8_token_store,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_token_counts": op11_token_counts,
    "op12_alignment": op12_alignment,
    "op13_fill_middle": op13_fill_middle,
}
