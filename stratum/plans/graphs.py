"""The graph's list for questions, and tiered search with it, as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratum.operators import fusion, graph, mentions, search
from stratum.operators.graph_list import LEAST_COSINE, NEAREST, Graph, graph_list as listed
from stratum.plans.common import terms
from stratum.plans.extras import seeded
from stratum.plans.knowledge import _EDGES, _edges
from stratum.plans.retrieval import remembered
from stratum.plans.search import _CORPUS, _FITS, _UNITS, _shown, _tier0, _tier1, _tier2, CONTEXT, POOL, corpus, questions
from stratum.sources.staging import stage
from stratum.sources.tables import load

#: Rounds of a walk, which SQL unrolls.
ROUNDS = 10


def entities(spark: SparkSession, d: str) -> Graph:
    """The second words of passages as names of entities, in the notebooks whose chunks mention them.

    Entities of a chunk are linked, and each with the next of its notebook by
    a relation of some confidence; an entity's vector is its passage's.
    """

    def make() -> Graph:
        c = corpus(spark, d)
        chunks = c.chunks.where("level = 1").select("chunk_id", "notebook_id", "level", "token_start")
        names = load(spark, d, "benchmark").where("item_id % 3 > 0").select(F.col("item_id").alias("node_id"), F.get(F.split("text", " "), F.lit(1)).alias("name"))
        found = mentions.detect(names, c.chunks.where("level = 1").select("chunk_id", "text", "notebook_id"), keep=("notebook_id",)).select(F.col("node_id").alias("item_id"), "chunk_id", "notebook_id")
        said = stage(found.select("item_id", "notebook_id", "chunk_id", (F.col("item_id") * 100 + F.substring("notebook_id", 4, 9).cast("int")).alias("node_id")))
        nodes = said.select("notebook_id", "node_id", "item_id").distinct().join(names.withColumnRenamed("node_id", "item_id"), "item_id")
        nodes = stage(nodes.select("notebook_id", "node_id", "item_id", "name", F.lit(None).cast("string").alias("canonical"), (F.col("item_id") % 2).alias("kind")))
        none = F.lit(None).cast("double")
        co = graph.cooccurrence(said, None).select("from_node", "to_node", F.lit("co_occurs").alias("relation"), F.col("weight").cast("double").alias("weight"), none.alias("confidence"))
        w = Window.partitionBy("notebook_id").orderBy("node_id")
        near = nodes.select(F.col("node_id").alias("from_node"), F.lead("node_id").over(w).alias("to_node"), F.lit("near").alias("relation"), F.lit(1.0).alias("weight"), (F.col("item_id") % 10 / 10).alias("confidence")).where("to_node is not null")
        vectors = nodes.join(load(spark, d, "embeddings"), F.col("item_id") == F.col("vec_id")).select("node_id", F.col("embedding").alias("vector"))
        return Graph(nodes.drop("item_id"), stage(graph.weighted(co.unionByName(near))), said.select("node_id", "chunk_id"), chunks.drop("notebook_id"), vectors)

    return remembered(spark, d, "entities", make)


def graph_list(spark: SparkSession, d: str) -> DataFrame:
    out = listed(questions(spark, d), entities(spark, d), fusion.pool(POOL), ROUNDS, 0.0)
    return out.withColumn("conf", F.round("conf", 6))


def tiered_search_graph(spark: SparkSession, d: str) -> DataFrame:
    g = entities(spark, d)
    return _shown(search.tiered_search(questions(spark, d), corpus(spark, d), CONTEXT, POOL, graph=lambda q: listed(q, g, fusion.pool(POOL), ROUNDS, 0.0)))


def ppr_many(spark: SparkSession, d: str) -> DataFrame:
    """Walks from the suppliers of each nation."""
    seeds = load(spark, d, "supplier").select(F.col("s_nationkey").alias("query_id"), F.col("s_suppkey").alias("seed"))
    return graph.walks(_edges(spark, d), seeds, ROUNDS, 0.0).withColumn("score", F.round("score", 6))


QUERIES = {f.__name__: f for f in (graph_list, tiered_search_graph, ppr_many)}


def _walks(home: str) -> str:
    """CTEs r0 to r<ROUNDS> (query_id, node_id, score) over ``ways`` (a, b, w) from seeds (query_id, node_id)."""
    steps = [
        f"""k{i} AS MATERIALIZED (SELECT query_id, b AS node_id, sum(score * p) AS got FROM r{i - 1} JOIN p ON a = node_id GROUP BY ALL
), r{i} AS MATERIALIZED (SELECT query_id, node_id, sum(score) AS score FROM (
    SELECT query_id, node_id, 0.85 * got AS score FROM k{i} UNION ALL SELECT h.query_id, h.node_id, home * (1 - 0.85 * coalesce(kept, 0)) FROM home h LEFT JOIN (SELECT query_id, sum(got) AS kept FROM k{i} GROUP BY query_id) USING (query_id)
) GROUP BY ALL)"""
        for i in range(1, ROUNDS + 1)
    ]
    return f"""p AS MATERIALIZED (SELECT a, b, w / sum(w) OVER (PARTITION BY a) AS p FROM ways), home AS MATERIALIZED (SELECT query_id, node_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY query_id) AS home FROM {home}),
r0 AS MATERIALIZED (SELECT query_id, node_id, home AS score FROM home), {", ".join(steps)}"""


_STOP = ", ".join(f"'{x}'" for x in mentions.STOP_WORDS)
_NAME = "split_part(text, ' ', 2)"
#: CTEs that end in ``listed`` (query_id, chunk_id, conf, rank0), after the corpus.
_LISTED = rf"""names AS (SELECT item_id, {_NAME} AS name, {terms(_NAME)} AS t FROM benchmark WHERE item_id % 3 > 0
), kt AS (SELECT chunk_id, notebook_id, {terms("text")} AS t FROM chunks WHERE level = 1), ks AS (SELECT chunk_id, notebook_id, t, unnest(range(len(t))) AS start FROM kt
), kg AS (SELECT chunk_id, notebook_id, array_to_string(t[start + 1:start + width], ' ') AS gram FROM (SELECT *, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS width FROM ks) WHERE start + width <= len(t)
), said AS MATERIALIZED (SELECT item_id, notebook_id, chunk_id, item_id * 100 + CAST(substr(notebook_id, 4) AS INTEGER) AS node_id, name FROM kg JOIN names ON gram = array_to_string(names.t, ' ') WHERE len(names.t) > 0
), logic AS MATERIALIZED (SELECT *, min(node_id) OVER w AS logical_id, min(name) OVER w AS called FROM (SELECT DISTINCT item_id, notebook_id, node_id, name, lower(name) AS key, item_id % 2 AS kind FROM said) WINDOW w AS (PARTITION BY notebook_id, key, kind)
), present AS (SELECT DISTINCT chunk_id, node_id FROM said
), links AS (SELECT a.node_id AS from_node, b.node_id AS to_node, 'co_occurs' AS relation, ln(1 + count(*)) AS w FROM present a JOIN present b ON a.chunk_id = b.chunk_id AND a.node_id < b.node_id GROUP BY ALL
    UNION ALL SELECT * FROM (SELECT node_id, lead(node_id) OVER (PARTITION BY notebook_id ORDER BY node_id) AS to_node, 'near', greatest(3.0 * (item_id % 10 / 10), 0.01) FROM logic) WHERE to_node IS NOT NULL
), le AS (SELECT x.logical_id AS a, y.logical_id AS b, relation, w FROM links JOIN logic x ON from_node = x.node_id JOIN logic y ON to_node = y.node_id WHERE x.logical_id <> y.logical_id
), ways AS (SELECT a, b, sum(w) AS w FROM (SELECT a, b, w FROM le UNION ALL SELECT b, a, w FROM le WHERE relation = 'co_occurs') GROUP BY ALL
), n AS (SELECT notebook_id, node_id, array_to_string({terms("called")}, ' ') AS gram FROM logic), q AS (SELECT query_id, notebook_id, text FROM asks), {seeded("notebook_id", whole=True)},
claims AS (SELECT query_id, count(*) AS n_seeds, flatten(list(range(start, start + width))) AS claimed FROM seeded GROUP BY query_id), qw AS (SELECT query_id, unnest(t) AS w, unnest(range(len(t))) AS i FROM qt
), signal AS (SELECT query_id, coalesce(any_value(n_seeds), 0) AS n_seeds, count(*) FILTER (NOT list_contains(coalesce(claimed, []), i) AND w NOT IN ({_STOP})) AS residual FROM qw LEFT JOIN claims USING (query_id) GROUP BY query_id
), near AS (
    SELECT query_id, logical_id, key, c, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 12) DESC, node_id) - 1 AS ord FROM (
        SELECT a.query_id, l.logical_id, l.key, l.node_id, list_inner_product(u.embedding::DOUBLE[], v.embedding::DOUBLE[]) / sqrt(list_inner_product(u.embedding::DOUBLE[], u.embedding::DOUBLE[]) * list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) AS c
        FROM asks a JOIN signal s ON s.query_id = a.query_id AND s.n_seeds = 0 AND residual >= {mentions.LEAST_SIGNAL} JOIN embeddings u ON u.vec_id = a.query_id JOIN logic l ON l.notebook_id = a.notebook_id JOIN embeddings v ON v.vec_id = l.item_id
    ) QUALIFY ord < {NEAREST}
), started AS (
    SELECT query_id, logical_id, start AS ord, key FROM seeded JOIN logic USING (node_id) JOIN signal USING (query_id) WHERE residual >= {mentions.LEAST_SIGNAL}
    UNION ALL SELECT query_id, logical_id, ord, key FROM near WHERE round(c, 12) >= {LEAST_COSINE}
), chosen AS MATERIALIZED (SELECT query_id, logical_id AS node_id, row_number() OVER (PARTITION BY query_id ORDER BY min(ord), min(key), logical_id) - 1 AS nth FROM started GROUP BY query_id, logical_id
), {_walks("chosen")}, walked AS (
    SELECT query_id, logical_id, score / max(score) OVER (PARTITION BY query_id) AS conf, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, called, kind, logical_id) - 1 AS rank0
    FROM (SELECT r.* FROM r{ROUNDS} r ANTI JOIN chosen USING (query_id, node_id)) JOIN (SELECT DISTINCT logical_id, called, kind FROM logic) ON node_id = logical_id WHERE score > 0 QUALIFY rank0 < 50
), held AS (
    SELECT logical_id, chunk_id, row_number() OVER (PARTITION BY logical_id ORDER BY count(*) DESC, any_value(token_start), chunk_id) - 1 AS spot FROM said JOIN logic USING (node_id) JOIN chunks c USING (chunk_id) GROUP BY logical_id, chunk_id QUALIFY spot < 50
), every_ AS (
    SELECT query_id, chunk_id, 1.0::DOUBLE AS conf, nth * 50 + spot AS seen FROM chosen JOIN held ON node_id = logical_id UNION ALL SELECT query_id, chunk_id, conf, 1000000 + rank0 * 50 + spot FROM walked JOIN held USING (logical_id)
), listed AS (
    SELECT query_id, chunk_id, max(conf) AS conf, row_number() OVER (PARTITION BY query_id ORDER BY round(max(conf), 12) DESC, min(seen), chunk_id) - 1 AS rank0 FROM every_ GROUP BY query_id, chunk_id QUALIFY rank0 < 50
)"""

ORACLES = {
    "graph_list": f"WITH RECURSIVE {_CORPUS}, {_LISTED} SELECT query_id, chunk_id, round(conf, 6) AS conf, rank0 FROM listed",
    "tiered_search_graph": f"""WITH RECURSIVE {_CORPUS}, {_LISTED}, {_tier0(46154)}, {_FITS}, rest AS (SELECT asks.*, fits FROM asks JOIN fits USING (notebook_id) WHERE query_id NOT IN (SELECT query_id FROM tier0)
), small AS (SELECT * FROM rest WHERE fits), large AS (SELECT * FROM rest WHERE NOT fits), {_tier1(30000, "small")}, {_tier2(46154, "large", "listed")}, every AS (SELECT * FROM tier0 UNION ALL SELECT * FROM tier1 UNION ALL SELECT * FROM tier2)
SELECT query_id, tier, row_number() OVER (PARTITION BY query_id ORDER BY source_id, level, token_start, chunk_id, coalesce(parent_id, -1)) - 1 AS order_index, chunk_id, source_id, coalesce(parent_id, -1) AS parent_id, label, tokens, sha256(text) AS text_sha256 FROM every""",
    "ppr_many": f"""WITH {_EDGES}, ways AS (SELECT a, b, sum(w) AS w FROM (SELECT from_node AS a, to_node AS b, w FROM edges WHERE from_node <> to_node UNION ALL SELECT to_node, from_node, w FROM edges WHERE relation = 'co_occurs' AND from_node <> to_node) GROUP BY ALL),
chosen AS (SELECT s_nationkey AS query_id, s_suppkey AS node_id FROM supplier), {_walks("chosen")} SELECT query_id, node_id, round(score, 6) AS score FROM r{ROUNDS}""",
}
