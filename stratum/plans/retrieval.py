"""Search: lexical, dense, hybrid, fused, reranked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.operators import fusion, kept, lexical, quantised, vectors
from stratum.plans.common import PARENTS, SOURCES, VECTORS, bm25, knn, terms
from stratum.sources.staging import shared_dir, stage
from stratum.sources.tables import live, load, sources


#: What the queries of an application keep between them: indexes and tables in the shared folder.
_KEPT: dict[tuple, object] = {}


def remembered(spark: SparkSession, d: str, name: str, make: Callable[[], object]) -> object:
    """What ``make`` builds over the tables in ``d``, once an application."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def shown(df: DataFrame) -> DataFrame:
    """Scores as they are reported and compared with SQL; operators rank by the whole ones."""
    return df.withColumns({c: F.round(c, 6) for c in ("score", "rerank_score") if c in df.columns})


def benchmark_queries(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    return sources(spark, d).select(F.col("source_id").alias("chunk_id"), "text")


def parent_chunks(spark: SparkSession, d: str) -> DataFrame:
    from stratum.operators.structure import parents

    return parents(sources(spark, d)).select((F.col("source_id") * 10_000 + F.col("parent_no")).alias("chunk_id"), "source_id", "text", "n_tokens", "token_start")


def document_index(spark: SparkSession, d: str) -> kept.KeptIndex:
    return remembered(spark, d, "documents", lambda: kept.create(spark, shared_dir(spark), document_chunks(spark, d)))


def parent_index(spark: SparkSession, d: str) -> tuple[kept.KeptIndex, DataFrame]:
    """The index of the parents, and their ids by source."""

    def make() -> tuple[kept.KeptIndex, DataFrame]:
        chunks = stage(parent_chunks(spark, d))
        return kept.create(spark, shared_dir(spark), chunks), chunks.select("chunk_id", "source_id")

    return remembered(spark, d, "parents", make)


def vector_rows(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").alias("kind"))


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 20 is a query."""
    return load(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("kind"))


def live_ids(spark: SparkSession, d: str) -> DataFrame:
    return live(sources(spark, d)).select(F.col("source_id").alias("chunk_id"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    index, chunks = parent_index(spark, d)
    live_parents = chunks.join(live(sources(spark, d)).select("source_id"), "source_id", "left_semi")
    return shown(lexical.bm25(chunks, benchmark_queries(spark, d), scope=live_parents.select("chunk_id"), k=10, lists=index))


def bm25_any_topk(spark: SparkSession, d: str) -> DataFrame:
    return shown(lexical.bm25(document_chunks(spark, d), benchmark_queries(spark, d), scope=live_ids(spark, d), k=10, every=False, lists=document_index(spark, d)))


def index_upsert(spark: SparkSession, d: str) -> DataFrame:
    """An index of two thirds of the documents; then the others come in, every fifth changes to its second half, every seventh goes; and the search over what there is."""
    chunks = document_chunks(spark, d)
    n = F.col("chunk_id")
    index = kept.create(spark, shared_dir(spark), chunks.where(n % 3 > 0))
    index.change(chunks.where(n % 3 == 0), chunks.where(n % 7 == 0).select("chunk_id"))
    half = F.expr("substring(text, length(text) div 2 + 1)")
    index.change(chunks.where((n % 5 == 0) & (n % 7 > 0)).withColumn("text", half), chunks.where(n % 7 == 0).select("chunk_id"))
    return shown(lexical.bm25(chunks, benchmark_queries(spark, d), k=10, every=False, lists=index))


def knn_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return shown(vectors.knn(vector_rows(spark, d), vector_queries(spark, d), 10))


def knn_filtered_topk(spark: SparkSession, d: str) -> DataFrame:
    scope = vector_rows(spark, d).join(live_ids(spark, d), "chunk_id", "left_semi")
    return shown(vectors.knn(scope, vector_queries(spark, d), 10))


def knn_ivf_topk(spark: SparkSession, d: str) -> DataFrame:
    return shown(vectors.ivf(vector_rows(spark, d), vector_queries(spark, d), 10))


def vector_index(spark: SparkSession, d: str) -> quantised.Index:
    """The quantised index of the embeddings, built once an application."""

    def make() -> quantised.Index:
        root, none = shared_dir(spark), spark.createDataFrame([], "coordinate string, generation int, status string")
        registry = quantised.build(vector_rows(spark, d), vector_queries(spark, d), root, "embeddings", none)
        return quantised.opened(spark, registry, root, "embeddings")

    return remembered(spark, d, "vectors", make)


def knn_pq_topk(spark: SparkSession, d: str) -> DataFrame:
    return shown(quantised.search(vector_index(spark, d), vector_queries(spark, d), 10))


def item_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = vector_rows(spark, d)
    return benchmark_queries(spark, d).join(v, F.col("query_id") == F.col("chunk_id")).select("query_id", "vector")


def _lists(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    scope, n = live_ids(spark, d), fusion.pool(10)
    dense = vectors.knn(vector_rows(spark, d).join(scope, "chunk_id", "left_semi"), item_vectors(spark, d), n)
    return {"dense": dense, "bm25": lexical.bm25(document_chunks(spark, d), benchmark_queries(spark, d), scope=scope, k=n, every=False, lists=document_index(spark, d))}


def hybrid_retrieval(spark: SparkSession, d: str) -> DataFrame:
    return shown(fusion.rrf(_lists(spark, d), 10))


def hybrid_reranked(spark: SparkSession, d: str) -> DataFrame:
    return shown(fusion.rerank(fusion.rrf(_lists(spark, d), 20), benchmark_queries(spark, d), document_chunks(spark, d), 10))


def rrf_fuse3(spark: SparkSession, d: str) -> DataFrame:
    """Customers' orders ranked by price, by date and by priority, fused."""
    from pyspark.sql import Window

    o = load(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("chunk_id"), "o_totalprice", "o_orderdate", "o_orderpriority")
    ranked = lambda *by: o.withColumn("rank0", F.row_number().over(Window.partitionBy("query_id").orderBy(*by, "chunk_id")) - 1).where("rank0 < 50")
    return shown(fusion.rrf({"dense": ranked(F.desc("o_totalprice")), "bm25": ranked(F.desc("o_orderdate")), "graph": ranked("o_orderpriority")}, 5))


def evidence_merge(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem")
    a = li.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("query_id"), F.col("l_orderkey").alias("chunk_id"), F.lit(1.0).alias("conf"), F.col("l_linenumber").alias("ord"))
    b = li.select(F.col("l_suppkey").alias("query_id"), F.col("l_orderkey").alias("chunk_id"), F.col("l_discount").alias("conf"), F.col("l_linenumber").alias("ord"))
    return fusion.merged_evidence({"evidence": a, "walk": b}).where("place < 20")


QUERIES = {f.__name__: f for f in (hybrid_retrieval, bm25_topk, bm25_any_topk, index_upsert, knn_cosine_topk, knn_filtered_topk, knn_ivf_topk, knn_pq_topk, hybrid_reranked, rrf_fuse3, evidence_merge)}

_DOCS = "chunk_docs AS (SELECT source_id AS chunk_id, text FROM src), asks AS (SELECT item_id AS query_id, text FROM benchmark), scope AS (SELECT source_id AS chunk_id FROM alive)"
_HYBRID = f"""WITH {SOURCES}, {_DOCS}, {bm25("chunk_docs", "asks", False, "scope", 50)}, {VECTORS},
live_vecs AS (SELECT * FROM vecs WHERE chunk_id IN (SELECT chunk_id FROM scope)), item_vecs AS (SELECT query_id, vector FROM asks JOIN vecs ON query_id = chunk_id),
{knn("live_vecs", "item_vecs", 50)}, ranked AS (
    SELECT query_id, chunk_id, rank0, 0 AS list FROM dense UNION ALL SELECT query_id, chunk_id, rank0, 1 AS list FROM lexical
), fused AS (
    SELECT query_id, chunk_id, sum(1 / (60 + rank0)) AS exact, CASE WHEN count(DISTINCT list) = 2 THEN 'Both' WHEN max(list) = 0 THEN 'Dense' ELSE 'Bm25' END AS label, min(list * 1000000 + rank0) AS seen
    FROM ranked GROUP BY query_id, chunk_id
), placed AS (SELECT query_id, chunk_id, round(exact, 6) AS score, label, row_number() OVER (PARTITION BY query_id ORDER BY round(exact, 12) DESC, seen) - 1 AS place FROM fused)"""

ORACLES = {
    "bm25_topk": f"""WITH {SOURCES}, {PARENTS}, chunks AS (SELECT source_id * 10000 + parent_no AS chunk_id, source_id, text FROM parents),
asks AS (SELECT item_id AS query_id, text FROM benchmark), scope AS (SELECT chunk_id FROM chunks JOIN alive USING (source_id)), {bm25("chunks", "asks", True, "scope", 10)} SELECT * FROM lexical""",
    "bm25_any_topk": f"""WITH {SOURCES}, {_DOCS}, {bm25("chunk_docs", "asks", False, "scope", 10)} SELECT * FROM lexical""",
    "index_upsert": f"""WITH {SOURCES}, final AS (SELECT source_id AS chunk_id, CASE WHEN source_id % 5 = 0 THEN substr(text, length(text) // 2 + 1) ELSE text END AS text FROM src WHERE source_id % 7 > 0),
asks AS (SELECT item_id AS query_id, text FROM benchmark), {bm25("final", "asks", False, None, 10)} SELECT * FROM lexical""",
    "knn_cosine_topk": f"WITH {VECTORS}, {knn('vecs', 'asked_vecs', 10)} SELECT * FROM dense",
    "knn_filtered_topk": f"WITH {SOURCES}, {VECTORS}, live_vecs AS (SELECT * FROM vecs WHERE chunk_id IN (SELECT source_id FROM alive)), {knn('live_vecs', 'asked_vecs', 10)} SELECT * FROM dense",
    "hybrid_retrieval": _HYBRID + " SELECT * FROM placed WHERE place < 10",
    "hybrid_reranked": _HYBRID
    + f""", scored20 AS (
    SELECT p.query_id, p.chunk_id, p.score, p.label, p.place, len(list_intersect(q.t, c.t)) / len(q.t) AS exact
    FROM (SELECT * FROM placed WHERE place < 20) p
    JOIN (SELECT query_id, list_distinct({terms("text")}) AS t FROM asks) q USING (query_id)
    JOIN (SELECT chunk_id, list_distinct({terms("text")}) AS t FROM chunk_docs) c USING (chunk_id)
) SELECT query_id, chunk_id, round(exact, 6) AS rerank_score, score, label, row_number() OVER (PARTITION BY query_id ORDER BY round(exact, 12) DESC, place) - 1 AS rank0 FROM scored20 QUALIFY rank0 < 10""",
    "rrf_fuse3": """WITH o AS (SELECT o_custkey AS query_id, o_orderkey AS chunk_id, * FROM orders), ranked AS (
    SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY o_totalprice DESC, chunk_id) - 1 AS rank0, 0 AS list FROM o
    UNION ALL SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY o_orderdate DESC, chunk_id) - 1, 1 FROM o
    UNION ALL SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY o_orderpriority, chunk_id) - 1, 2 FROM o
), fused AS (
    SELECT query_id, chunk_id, sum(1 / (60 + rank0)) AS exact, CASE WHEN bool_or(list = 0) AND bool_or(list = 1) THEN 'Both' WHEN bool_or(list = 0) THEN 'Dense' WHEN bool_or(list = 1) THEN 'Bm25' ELSE 'Graph' END AS label, min(list * 1000000 + rank0) AS seen
    FROM ranked WHERE rank0 < 50 GROUP BY query_id, chunk_id
) SELECT query_id, chunk_id, round(exact, 6) AS score, label, row_number() OVER (PARTITION BY query_id ORDER BY round(exact, 12) DESC, seen) - 1 AS place FROM fused QUALIFY place < 5""",
    "evidence_merge": """WITH r AS (
    SELECT l_suppkey AS query_id, l_orderkey AS chunk_id, 1.0::DOUBLE AS conf, l_linenumber AS seen FROM lineitem WHERE l_returnflag = 'R'
    UNION ALL SELECT l_suppkey, l_orderkey, l_discount, 1000000 + l_linenumber FROM lineitem
), b AS (SELECT query_id, chunk_id, max(conf) AS conf, min(seen) AS seen FROM r GROUP BY ALL)
SELECT query_id, chunk_id, conf, row_number() OVER (PARTITION BY query_id ORDER BY conf DESC, seen, chunk_id) - 1 AS place FROM b QUALIFY place < 20""",
}
