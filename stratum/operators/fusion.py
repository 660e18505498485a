"""Reciprocal-rank fusion of ranked lists, reranking, and hybrid search over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions.text import index_terms
from stratum.operators.lexical import EXACT

RANK_OFFSET, OVERFETCH, MOST = 60, 50, 500


def pool(k: int) -> int:
    """Candidates of each list for k results."""
    return min(max(k, OVERFETCH), MOST)


def rrf(lists: dict[str, DataFrame], k: int) -> DataFrame:
    """query_id, chunk_id, score, label, place of fused lists (query_id, chunk_id, rank0).

    The first rank of a list counts 1/60. Ties go to what is seen first in the
    lists' order dense, bm25, graph. A chunk of the graph and another list keeps
    the other's label.
    """
    ranked = [r.select("query_id", "chunk_id", "rank0", F.lit(i).alias("list")) for i, r in enumerate(lists[n] for n in ("dense", "bm25", "graph") if n in lists)]
    names = [n for n in ("dense", "bm25", "graph") if n in lists]
    has = lambda n: F.max(F.col("list") == names.index(n)) if n in names else F.lit(False)
    fused = reduce(DataFrame.unionByName, ranked).groupBy("query_id", "chunk_id").agg(F.sum(1 / (RANK_OFFSET + F.col("rank0"))).alias("raw"), has("dense").alias("d"), has("bm25").alias("b"), F.min(F.col("list") * 1_000_000 + F.col("rank0")).alias("seen"))
    label = F.when(F.col("d") & F.col("b"), "Both").when(F.col("d"), "Dense").when(F.col("b"), "Bm25").otherwise("Graph")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", EXACT)), "seen")
    out = fused.select("query_id", "chunk_id", F.col("raw").alias("score"), label.alias("label"), "seen")
    return out.withColumn("place", F.row_number().over(w) - 1).where(F.col("place") < k).drop("seen")


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's terms in the text: the offline reranker."""
    q = F.array_distinct(index_terms(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, index_terms(text))) / F.size(q)).otherwise(F.lit(0.0))


def rerank(fused: DataFrame, queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Fused hits in the order of ``overlap_score``; ties, and hits without text, keep the fused order."""
    scored = fused.join(queries.select("query_id", F.col("text").alias("query")), "query_id").join(chunks.select("chunk_id", "text"), "chunk_id", "left")
    scored = scored.withColumn("rerank_score", F.coalesce(overlap_score(F.col("query"), F.col("text")), F.lit(0.0)))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("rerank_score", EXACT)), "place")
    return scored.withColumn("rank0", F.row_number().over(w) - 1).where(F.col("rank0") < k).select("query_id", "chunk_id", "rerank_score", "score", "label", "rank0")


def merged_evidence(lists: dict[str, DataFrame]) -> DataFrame:
    """chunk_id, conf, place over (query_id, chunk_id, conf, ord) lists: best confidence first, then first seen."""
    rows = reduce(DataFrame.unionByName, [r.select("query_id", "chunk_id", "conf", (F.lit(i * 1_000_000) + F.col("ord")).alias("seen")) for i, r in enumerate(lists.values())])
    best = rows.groupBy("query_id", "chunk_id").agg(F.max("conf").alias("conf"), F.min("seen").alias("seen"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("conf", EXACT)), "seen", "chunk_id")
    return best.withColumn("place", F.row_number().over(w) - 1).drop("seen")
