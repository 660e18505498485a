"""Tables and the corpus model over them.

A notebook is a source of ``documents``; a source of a notebook is a document,
selected and trashed by its id; chunks are windows of its words. The entity
graph is read from the order tables: suppliers are nodes, orders are chunks,
line items are mentions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(table: DataFrame) -> DataFrame:
    """A stored table dealt over all cores where its files make fewer tasks than there are; large tables stay as they lie."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, notebook_id, selected, trashed, raw_content_hash, language, text."""
    d = spread(load(spark, sf_dir, "documents"))
    return d.select(
        F.col("doc_id").alias("source_id"),
        F.col("source").alias("notebook_id"),
        (F.col("doc_id") % 7 != 0).alias("selected"),
        (F.col("doc_id") % 11 == 0).alias("trashed"),
        F.sha2("text", 256).alias("raw_content_hash"),
        F.col("lang").alias("language"),
        "text",
    )


def live(frame: DataFrame) -> DataFrame:
    """The scope of every search: not trashed, and selected."""
    return frame.where(~F.col("trashed") & F.col("selected"))


def entity_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, name, kind, canonical, notebook_id: suppliers, canonically of their nation."""
    s, n = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "nation")
    return s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).select(
        F.col("s_suppkey").alias("node_id"), F.col("s_name").alias("name"), F.col("n_name").alias("canonical"), F.col("n_regionkey").alias("kind")
    )


def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, chunk_id, mention_no: line items name a supplier in an order."""
    return load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("node_id"), F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("mention_no"))
