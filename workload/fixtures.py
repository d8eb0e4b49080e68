"""Labelled points made from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def weights(n: int) -> list[float]:
    """The fixed weight vector of the single-step queries."""
    return [float(j % 5 - 2) for j in range(n)]


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 features with the bias; the label is whether the order is finished."""
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.array(
            F.col("o_totalprice") / 500000,
            F.dayofyear("o_orderdate") / 366.0,
            digit / 5.0,
            F.lit(1.0),
        ).alias("x"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1).alias("y"),
    )


ORDERS_SQL = """
pts AS (
  SELECT o_orderkey AS id,
         [o_totalprice / 500000::double,
          dayofyear(o_orderdate)::double / 366::double,
          substr(o_orderpriority, 1, 1)::int / 5::double,
          1::double] AS x,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END AS y
  FROM orders)"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 features and the bias; even labels are positive."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.concat(
            F.col("embedding").cast("array<double>"), F.array(F.lit(1.0))
        ).alias("x"),
        F.when(F.col("label") % 2 == 0, 1).otherwise(-1).alias("y"),
    )


EMBEDDINGS_SQL = """
pts AS (
  SELECT vec_id AS id,
         list_append(embedding::double[], 1::double) AS x,
         CASE WHEN label % 2 = 0 THEN 1 ELSE -1 END AS y
  FROM embeddings)"""


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5 features with the bias and no row id: for order-free aggregates."""
    return table(spark, sf_dir, "lineitem").select(
        F.array(
            F.col("l_quantity") / 50,
            F.col("l_extendedprice") / 100000,
            F.col("l_discount"),
            F.col("l_tax"),
            F.lit(1.0),
        ).alias("x"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(-1).alias("y"),
    )


LINEITEM_SQL = """
pts AS (
  SELECT [l_quantity / 50::double, l_extendedprice / 100000::double,
          l_discount, l_tax, 1::double] AS x,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END AS y
  FROM lineitem)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: length, word count and toxicity against quality."""
    docs = table(spark, sf_dir, "documents")
    words = F.size(F.split("text", " "))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("doc_id").alias("id"),
        F.array(
            F.col("n_chars") / 10000.0,
            words / 2000.0,
            F.col("toxic").cast("double"),
            F.lit(1.0),
        ).alias("x"),
        (2 * F.col("quality") - 1).cast("int").alias("y"),
    )


DOCUMENTS_SQL = """
pts AS (
  SELECT d.doc_id AS id,
         [d.n_chars::double / 10000::double,
          len(string_split(d.text, ' '))::double / 2000::double,
          l.toxic::double, 1::double] AS x,
         2 * l.quality - 1 AS y
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as delimited text with the label last.  Pending orders carry
    label 0 and urgent ones that are open lack their label: bad lines."""
    status = F.col("o_orderstatus")
    label = F.when(status == "F", "1").when(status == "O", "-1").otherwise("0")
    label = F.when(
        (status == "O") & F.col("o_orderpriority").startswith("1"), "none"
    ).otherwise(label)
    return table(spark, sf_dir, "orders").select(
        F.concat_ws(
            ",",
            F.col("o_totalprice").cast("string"),
            F.dayofyear("o_orderdate").cast("string"),
            F.substring("o_orderpriority", 1, 1),
            label,
        ).alias("value")
    )


ORDER_LINES_SQL = """
raw AS (
  SELECT o_totalprice AS x0, dayofyear(o_orderdate)::double AS x1,
         substr(o_orderpriority, 1, 1)::double AS x2, 1::double AS x3,
         CASE WHEN o_orderstatus = 'O' AND o_orderpriority LIKE '1%' THEN 'none'
              WHEN o_orderstatus = 'F' THEN '1'
              WHEN o_orderstatus = 'O' THEN '-1' ELSE '0' END AS label
  FROM orders)"""


def synthetic_duals(points: DataFrame) -> DataFrame:
    """A fixed dual state per id, for the single-step queries."""
    return points.withColumns(
        {
            "zeta": F.pmod("id", F.lit(3)) / 10.0,
            "beta": F.pmod("id", F.lit(5)) / 20.0,
        }
    )


DUALS_SQL = """
duals AS (
  SELECT id, x, y, (id % 3) / 10::double AS zeta, (id % 5) / 20::double AS beta
  FROM pts)"""
