"""The graph as a list of chunks for each question: the entities it names, their evidence, and what a walk from them comes to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.operators import graph, mentions, vectors
from stratum.operators.lexical import EXACT
from stratum.sources.staging import stage

#: Entities near a question that stand in for names, and the cosine that they need.
NEAREST, LEAST_COSINE = 5, 0.5


@dataclass(frozen=True)
class Graph:
    """Entities of notebooks.

    * ``nodes``: notebook_id, node_id, name, canonical (may be null), kind,
    * ``edges``: from_node, to_node, relation, w, each within a notebook,
    * ``mentions``: node_id, chunk_id, a row a mention,
    * ``chunks``: chunk_id, level, token_start of the live ones,
    * ``vectors``: node_id, vector, for questions that name nothing.
    """

    nodes: DataFrame
    edges: DataFrame
    mentions: DataFrame
    chunks: DataFrame
    vectors: DataFrame | None = None


def seeds(questions: DataFrame, g: Graph, of: DataFrame) -> DataFrame:
    """query_id, logical_id, nth of the entities that each question (query_id, notebook_id, text, vector) starts from.

    These are all entities of its notebook that it names, longest names first.
    Where it names none, the nearest ones by their vectors stand in. A question that says
    too little besides its names starts from nothing.
    """
    named = stage(mentions.seeds(of.select("node_id", "notebook_id", F.col("name")), questions, by="notebook_id", most=None, widest=None))
    signal = mentions.relational(questions, named, None)
    by_name = named.join(signal.where("walk").select("query_id"), "query_id", "left_semi").join(of.select("node_id", "logical_id", "key"), "node_id").select("query_id", "logical_id", F.col("start").alias("ord"), "key")
    found = by_name
    if g.vectors is not None:
        unnamed = signal.where((F.col("n_seeds") == 0) & (F.col("residual") >= mentions.LEAST_SIGNAL)).select("query_id")
        near = vectors.knn(g.vectors.join(g.nodes.select("node_id", "notebook_id"), "node_id").select(F.col("node_id").alias("chunk_id"), "vector", "notebook_id"), questions.join(unnamed, "query_id", "left_semi"), NEAREST, by="notebook_id")
        near = near.where(F.round("score", EXACT) >= LEAST_COSINE).join(of.select(F.col("node_id").alias("chunk_id"), "logical_id", "key"), "chunk_id")
        found = by_name.unionByName(near.select("query_id", "logical_id", F.col("rank0").alias("ord"), "key"))
    one = found.groupBy("query_id", "logical_id").agg(F.min("ord").alias("ord"), F.min("key").alias("key"))
    w = Window.partitionBy("query_id").orderBy("ord", "key", "logical_id")
    return one.withColumn("nth", F.row_number().over(w) - 1).select("query_id", "logical_id", "nth")


def chunks_of(g: Graph, of: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """logical_id, chunk_id, at: the live chunks that mention each wanted entity most, the first k.

    k are enough for a list of k: what comes later has k of its own before it.
    """
    ids = of.join(wanted.select("logical_id").distinct(), "logical_id", "left_semi").select("node_id", "logical_id")
    n = g.mentions.join(ids, "node_id").groupBy("logical_id", "chunk_id").agg(F.count(F.lit(1)).alias("n")).join(g.chunks.select("chunk_id", "level", "token_start"), "chunk_id")
    w = Window.partitionBy("logical_id").orderBy(F.desc("n"), "level", F.col("token_start").asc_nulls_last(), "chunk_id")
    return n.withColumn("at", F.row_number().over(w) - 1).where(F.col("at") < k).select("logical_id", "chunk_id", "at")


def graph_list(questions: DataFrame, g: Graph, k: int = graph.MOST, rounds: int = graph.ROUNDS, epsilon: float = graph.EPSILON) -> DataFrame:
    """query_id, chunk_id, conf, rank0: the k chunks that the graph gives each question.

    Chunks that mention a seed count 1, those of the entities that a walk comes to
    the share of the best entity's mass; a chunk counts once, with the most.
    Questions without seeds have no rows.
    """
    of = stage(graph.logical(g.nodes, "notebook_id"))
    chosen = stage(seeds(questions, g, of))
    reached = stage(graph.walked(of, g.edges, chosen, k, rounds, epsilon, by="notebook_id"))
    held = stage(chunks_of(g, of, chosen.select("logical_id").unionByName(reached.select("logical_id")), k))
    sure = chosen.join(held, "logical_id").select("query_id", "chunk_id", (F.col("nth") * k + F.col("at")).alias("ord"))
    more = reached.join(held, "logical_id").select("query_id", "chunk_id", "conf", (F.col("rank0") * k + F.col("at")).alias("ord"))
    return graph.composed(sure, more, k)
