"""Retrieval metrics and the promotion gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.operators.lexical import EXACT

GATE_PP, GATE_MS, LEAST_SOURCES, LEAST_CHUNKS = 5.0, 500.0, 3, 50


def recall(retrieved: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """query_id, recall, hit over ranked (query_id, chunk_id, rank0) and gold (query_id, chunk_id); queries without hits count 0."""
    got = gold.distinct().join(retrieved.where(F.col("rank0") < k).select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return got.groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"), (F.count("hit") > 0).alias("hit"))


def p95(latencies: DataFrame, value: str, *by: str) -> DataFrame:
    """Nearest-rank 95th percentile."""
    return latencies.groupBy(*by).agg(F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"))


def gate(arms: DataFrame, corpus: DataFrame) -> DataFrame:
    """graph_recall, hybrid_recall, delta_pp, p95_ms, passed over (kind, graph, hybrid, ms): the graph has to win where it should.

    ``corpus`` (source_id, chunk_id) has to have LEAST_SOURCES and LEAST_CHUNKS; a smaller one passes nothing.
    """
    told = F.col("kind").isin("bridging", "rollup")
    m = arms.agg(F.coalesce(F.avg(F.when(told, F.col("graph"))), F.lit(0.0)).alias("graph_recall"), F.coalesce(F.avg(F.when(told, F.col("hybrid"))), F.lit(0.0)).alias("hybrid_recall"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY ms)").alias("p95_ms"), F.count(F.lit(1)).alias("sample_n"))
    m = m.withColumn("delta_pp", 100 * (F.col("graph_recall") - F.col("hybrid_recall")))
    # one row each
    m = m.crossJoin(F.broadcast(corpus.agg(F.count_distinct("source_id").alias("n_sources"), F.count_distinct("source_id", "chunk_id").alias("n_chunks"))))
    enough = (F.col("n_sources") >= LEAST_SOURCES) & (F.col("n_chunks") >= LEAST_CHUNKS)
    return m.select("graph_recall", "hybrid_recall", "delta_pp", "p95_ms", "sample_n", "n_sources", "n_chunks", (enough & (F.round("delta_pp", EXACT) >= GATE_PP) & (F.col("p95_ms") < GATE_MS)).alias("passed"))
