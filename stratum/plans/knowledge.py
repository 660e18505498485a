"""Entity graph, resolution, enrichment, evaluation, answers and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratum.operators import answer, enrich, evaluate, graph, lexical, resolve, router
from stratum.plans.common import SOURCES, VECTORS, bm25, knn
from stratum.plans.retrieval import benchmark_queries, document_chunks, shown, vector_queries, vector_rows
from stratum.sources.staging import stage
from stratum.sources.tables import entity_mentions, entity_nodes, load, sources
from stratum.streaming import events

#: A vocabulary of relations and aliases for the order tables' statuses.
RELATIONS, ALIASES = ("supplies", "returns", "ships"), (("n", "supplies"), ("r", "returns"), ("a", "ships"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers that share orders, and suppliers of the same nation as a one-way relation."""
    co = graph.cooccurrence(entity_mentions(spark, d)).select("from_node", "to_node", F.lit("co_occurs").alias("relation"), F.col("weight").cast("double").alias("weight"), F.lit(None).cast("double").alias("confidence"))
    s = load(spark, d, "supplier")
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    sem = s.select(F.col("s_suppkey").alias("from_node"), F.lead("s_suppkey").over(w).alias("to_node"), F.lit("near").alias("relation"), F.lit(1.0).alias("weight"), (F.col("s_suppkey") % 10 / 10).alias("confidence")).where("to_node is not null")
    return graph.weighted(co.unionByName(sem))


def entity_lookup_tiered(spark: SparkSession, d: str) -> DataFrame:
    q = load(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.expr("left(n_name, 8)").alias("text"))
    return graph.lookup(entity_nodes(spark, d), entity_mentions(spark, d), q)


def entity_lookup_prefix_first(spark: SparkSession, d: str) -> DataFrame:
    q = load(spark, d, "region").select(F.col("r_regionkey").alias("query_id"), F.expr("right(r_name, 1)").alias("text"))
    return graph.lookup(entity_nodes(spark, d), entity_mentions(spark, d), q, prefix_first=True)


def entity_evidence(spark: SparkSession, d: str) -> DataFrame:
    return graph.evidence(entity_nodes(spark, d), entity_mentions(spark, d))


def cooccurrence_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.cooccurrence(entity_mentions(spark, d))


def edge_blend(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select("from_node", "to_node", "relation", F.round("w", 6).alias("w"))


def expand_neighbors_2hop(spark: SparkSession, d: str) -> DataFrame:
    seeds = load(spark, d, "supplier").select(F.col("s_suppkey").alias("seed"))
    return graph.neighbours(_edges(spark, d), seeds).withColumns({c: F.round(c, 6) for c in ("w", "conf")})


def ppr_10iter(spark: SparkSession, d: str) -> DataFrame:
    seeds = load(spark, d, "supplier").where("s_nationkey = 0").select(F.col("s_suppkey").alias("seed"))
    ranks = graph.pagerank(entity_nodes(spark, d), _edges(spark, d), seeds, rounds=10, epsilon=0.0)
    return ranks.select("node_id", F.round("score", 6).alias("score"))


def resolve_tier1(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_type").alias("name"), F.col("p_brand").alias("kind"))
    return resolve.exact_pairs(p)


def resolve_knn_band(spark: SparkSession, d: str) -> DataFrame:
    return shown(resolve.near_pairs(vector_rows(spark, d), vector_queries(spark, d)))


def connected_components(spark: SparkSession, d: str) -> DataFrame:
    """Over all orders, each linked with its customer's next one: a chain for every customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    edges = load(spark, d, "orders").select(F.col("o_orderkey").alias("u"), F.lead("o_orderkey").over(w).alias("v"))
    return resolve.components(edges.where("v is not null"))


def group_confidence(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as a chain in order of time, linked as surely as the earlier one's cents say."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("long") % 100 / 100
    edges = load(spark, d, "orders").select(F.col("o_orderkey").alias("u"), F.lead("o_orderkey").over(w).alias("v"), cents.alias("confidence")).where("v is not null")
    return resolve.path_confidence(edges, stage(resolve.components(edges)))


def connected_components_orders(spark: SparkSession, d: str) -> DataFrame:
    """Over the links of all orders: every customer with its orders, under their own keys."""
    o = load(spark, d, "orders")
    return resolve.components(o.select((F.col("o_custkey") * 2).alias("u"), (F.col("o_orderkey") * 2 + 1).alias("v")))


def canonical_names(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part").select(F.col("p_brand").alias("component"), F.col("p_name").alias("name"))
    return resolve.canonical_names(p)


def triple_validate(spark: SparkSession, d: str) -> DataFrame:
    li, s, p = load(spark, d, "lineitem"), load(spark, d, "supplier"), load(spark, d, "part")
    nodes = s.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("node_id")).unionByName(p.groupBy(F.col("p_brand").alias("name")).agg((F.min("p_partkey") + 1_000_000).alias("node_id")))
    t = li.join(s, li["l_suppkey"] == s["s_suppkey"]).join(p, li["l_partkey"] == p["p_partkey"]).select(F.col("l_orderkey").alias("chunk_id"), F.col("s_name").alias("subject"), F.col("l_returnflag").alias("predicate"), F.col("p_brand").alias("object"), (F.col("l_discount") * 10).alias("confidence"))
    chunks = load(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("chunk_id"))
    aliases = spark.createDataFrame(list(ALIASES), "alias string, canonical string")
    words = spark.createDataFrame([(x,) for x in RELATIONS[:2]], "relation string")
    return enrich.valid_triples(t, chunks, nodes, aliases, words).withColumn("confidence", F.round("confidence", 6))


def relation_sample(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("chunk_id")).agg(F.sum("l_linenumber").alias("n_entities"))
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("source_id"))
    return enrich.relation_sample(c.join(o, "chunk_id"))


def map_merge(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "conversations")
    parts = c.select(F.col("conv_id").alias("source_id"), F.col("turn").alias("part"), F.regexp_extract_all("text", F.lit(r"(?:^| )([A-Z][a-z]+)"), F.lit(1)).alias("entities"), F.element_at(F.split("text", r"\."), 1).alias("summary"))
    return enrich.merged_map(parts).select("source_id", F.array_join("entities", ",").alias("entities"), "summary")


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Of BM25 over all documents, where gold is the documents that contain the passage. One batch of passages: documents are read once for their terms, and no index is built."""
    q, chunks = benchmark_queries(spark, d), document_chunks(spark, d)
    lists = lexical.scan(chunks, lexical.all_terms(q))
    got = lexical.bm25(chunks, q, k=5, every=False, lists=lists)
    gold = lexical.holders(lists, chunks, q)
    return evaluate.recall(got, gold).select("query_id", F.round("recall", 6).alias("recall"), "hit")


def p95_latency(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.p95(load(spark, d, "events"), "value", "event_type")


def promotion_gate(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    kind = F.when(F.col("o_orderpriority").startswith("1"), "bridging").when(F.col("o_orderpriority").startswith("2"), "rollup").otherwise("single_hop")
    told = evaluate.gate(o.select(kind.alias("kind"), (F.col("o_orderkey") % 3 > 0).cast("double").alias("graph"), (F.col("o_orderkey") % 2).cast("double").alias("hybrid"), (F.col("o_totalprice") / 1000).alias("ms")), o.select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("chunk_id")))
    return told.withColumns({c: F.round(c, 6) for c in ("graph_recall", "hybrid_recall", "delta_pp")})


def chat_history_pairs(spark: SparkSession, d: str) -> DataFrame:
    return answer.recent(answer.turn_pairs(load(spark, d, "conversations")))


def speaker_runs(spark: SparkSession, d: str) -> DataFrame:
    return answer.speaker_runs(load(spark, d, "conversations"))


def dialogue_validate(spark: SparkSession, d: str) -> DataFrame:
    return answer.dialogue_valid(load(spark, d, "conversations"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers that cite: a conversation's turn, with markers made of its numbers."""
    c = load(spark, d, "conversations").where("role = 'assistant'")
    n = F.col("conv_id") % 4 + 1
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("answer_id"), F.concat(F.lit("So [["), n.cast("string"), F.lit("]], see [ "), (n + 1).cast("string"), F.lit(","), n.cast("string"), F.lit("] not [x] (3) "), "text").alias("text"))


def citation_markers(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d)
    units = a.select(F.col("answer_id").alias("for_answer"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos")).withColumn("unit_id", F.col("for_answer") * 10 + F.col("pos"))
    return answer.citations(a, units)


def citation_diag(spark: SparkSession, d: str) -> DataFrame:
    return answer.citation_diagnosis(_answers(spark, d))


def prompt_assembly(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "conversations")
    units = c.select(F.col("conv_id").alias("query_id"), F.col("turn").cast("int").alias("order_index"), F.col("role").alias("title"), F.when(F.col("turn") % 2 == 0, F.lit("intro")).alias("section"), "text")
    return answer.prompts(units)


def document_order(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem")
    u = li.select(F.col("l_suppkey").alias("query_id"), F.col("l_orderkey").alias("source_id"), F.lit(1).alias("level"), F.col("l_linenumber").alias("token_start"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("unit_id"))
    return router.document_order(u).select("query_id", "unit_id", "order_index")


def event_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return events.tumbling(load(spark, d, "events"))


def event_session(spark: SparkSession, d: str) -> DataFrame:
    return events.sessions(load(spark, d, "events"))


def json_leaves(spark: SparkSession, d: str) -> DataFrame:
    from stratum.sources.extract import json_leaves as leaves

    return leaves(load(spark, d, "events").select(F.col("event_id").alias("source_id"), F.col("props").alias("raw"))).select("source_id", "leaf_no", "text")


QUERIES = {
    f.__name__: f
    for f in (entity_lookup_tiered, entity_lookup_prefix_first, entity_evidence, cooccurrence_edges, edge_blend, expand_neighbors_2hop, ppr_10iter, resolve_tier1, resolve_knn_band, connected_components, group_confidence, connected_components_orders, canonical_names, triple_validate, relation_sample, map_merge, recall_at_k, p95_latency, promotion_gate, chat_history_pairs, speaker_runs, dialogue_validate, citation_markers, citation_diag, prompt_assembly, document_order, event_tumbling, event_session, json_leaves)
}

_NODES = "nodes AS (SELECT s_suppkey AS node_id, lower(s_name) AS a, lower(n_name) AS b, n_name AS logical, n_regionkey AS kind FROM supplier JOIN nation ON s_nationkey = n_nationkey), counts AS (SELECT l_suppkey AS node_id, count(*) AS m FROM lineitem GROUP BY 1)"
_CO = """present AS (SELECT DISTINCT l_orderkey AS chunk_id, l_suppkey AS node_id FROM lineitem), firsts AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY node_id) AS n FROM present QUALIFY n <= 30),
co AS (SELECT a.node_id AS from_node, b.node_id AS to_node, count(*) AS weight, min(a.chunk_id) AS first_chunk FROM firsts a JOIN firsts b ON a.chunk_id = b.chunk_id AND a.node_id < b.node_id GROUP BY ALL)"""
_EDGES = f"""{_CO}, sem AS (SELECT s_suppkey AS from_node, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS to_node, s_suppkey % 10 / 10 AS confidence FROM supplier),
edges AS (SELECT from_node, to_node, 'co_occurs' AS relation, greatest(ln(1 + greatest(weight, 0)), 0.01) AS w FROM co UNION ALL SELECT from_node, to_node, 'near', greatest(3.0 * coalesce(confidence, 0.5), 0.01) FROM sem WHERE to_node IS NOT NULL)"""


def _lookup(queries: str, more: str) -> str:
    return f"""WITH {_NODES}, q AS ({queries}), hits AS (SELECT query_id, n.*, CASE WHEN a = q OR b = q THEN 0 WHEN starts_with(a, q) OR starts_with(b, q) THEN 1 ELSE 2 END AS tier FROM nodes n JOIN q ON contains(a, q) OR contains(b, q)),
best AS (SELECT *, min(tier) OVER (PARTITION BY query_id) AS top FROM hits), g AS (SELECT query_id, b, kind, min(logical) AS name, min(tier) AS tier, count(*) AS n_nodes, CAST(sum(coalesce(m, 0)) AS BIGINT) AS n_mentions FROM best LEFT JOIN counts USING (node_id) {more} GROUP BY query_id, b, kind)
SELECT query_id, kind, name, tier, n_nodes, n_mentions, row_number() OVER (PARTITION BY query_id ORDER BY tier, length(name), name, kind) - 1 AS rank0 FROM g QUALIFY rank0 < 10"""


def _pagerank(rounds: int) -> str:
    steps = [f"""r{i} AS (SELECT b.node_id, 0.85 * coalesce(got, 0) + (0.15 + 0.85 * (SELECT coalesce(sum(score) FILTER (NOT leads), 0) FROM r{i - 1} JOIN base USING (node_id))) * home AS score
    FROM base b LEFT JOIN (SELECT p.b, sum(score * p.p) AS got FROM r{i - 1} JOIN p ON p.a = node_id GROUP BY p.b) x ON x.b = b.node_id)""" for i in range(1, rounds + 1)]
    return f"""WITH {_EDGES}, ways AS (SELECT a, b, sum(w) AS w FROM (SELECT from_node AS a, to_node AS b, w FROM edges UNION ALL SELECT to_node, from_node, w FROM edges WHERE relation = 'co_occurs') GROUP BY a, b),
p AS MATERIALIZED (SELECT a, b, w / sum(w) OVER (PARTITION BY a) AS p FROM ways), seeds AS (SELECT s_suppkey AS seed FROM supplier WHERE s_nationkey = 0),
base AS MATERIALIZED (SELECT s_suppkey AS node_id, CASE WHEN s_suppkey IN (SELECT seed FROM seeds) THEN 1.0::DOUBLE / (SELECT count(*) FROM seeds) ELSE 0 END AS home, s_suppkey IN (SELECT a FROM p) AS leads FROM supplier),
r0 AS (SELECT node_id, home AS score FROM base), {", ".join(steps)} SELECT node_id, round(score, 6) AS score FROM r{rounds}"""


_ANSWERS = "answers AS (SELECT conv_id * 100 + turn AS answer_id, 'So [[' || (conv_id % 4 + 1) || ']], see [ ' || (conv_id % 4 + 2) || ',' || (conv_id % 4 + 1) || '] not [x] (3) ' || text AS text FROM conversations WHERE role = 'assistant')"
_RUNS = """x AS (SELECT *, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
y AS (SELECT *, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run_no FROM x), runs AS (SELECT conv_id, run_no, role, count(*) AS n_turns, min(turn) AS first_turn FROM y GROUP BY ALL)"""

ORACLES = {
    "entity_lookup_tiered": _lookup("SELECT n_nationkey AS query_id, lower(left(n_name, 8)) AS q FROM nation", ""),
    "entity_lookup_prefix_first": _lookup("SELECT r_regionkey AS query_id, lower(right(r_name, 1)) AS q FROM region", "WHERE tier < 2 OR top = 2"),
    "entity_evidence": f"WITH {_NODES}, e AS (SELECT b AS name, l_orderkey AS chunk_id, count(*) AS n FROM lineitem JOIN nodes ON l_suppkey = node_id GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, chunk_id) - 1 AS rank0 FROM e QUALIFY rank0 < 10",
    "cooccurrence_edges": f"WITH {_CO} SELECT * FROM co",
    "edge_blend": f"WITH {_EDGES} SELECT from_node, to_node, relation, round(w, 6) AS w FROM edges",
    "expand_neighbors_2hop": f"""WITH {_EDGES}, u AS (SELECT from_node AS a, to_node AS b, w FROM edges UNION ALL SELECT to_node, from_node, w FROM edges), s AS (SELECT DISTINCT a, b FROM u),
h AS (SELECT a AS seed, b AS node_id FROM s UNION SELECT x.a, y.b FROM s x JOIN s y ON x.b = y.a), best AS (SELECT a AS node_id, max(w) AS w FROM u GROUP BY a),
o AS (SELECT seed, node_id, w, row_number() OVER (PARTITION BY seed ORDER BY w DESC, node_id) - 1 AS rank0 FROM h JOIN best USING (node_id) WHERE seed <> node_id QUALIFY rank0 < 50)
SELECT seed, node_id, round(w, 6) AS w, round(w / max(w) OVER (PARTITION BY seed), 6) AS conf, rank0 FROM o""",
    "ppr_10iter": _pagerank(10),
    "resolve_tier1": "WITH n AS (SELECT p_partkey AS node_id, lower(trim(p_type)) AS key, p_brand AS kind FROM part), f AS (SELECT key, kind, min(node_id) AS v FROM n GROUP BY ALL) SELECT node_id AS u, v FROM n JOIN f USING (key, kind) WHERE node_id <> v",
    "resolve_knn_band": f"""WITH {VECTORS}, s AS (SELECT q.query_id, v.chunk_id, list_inner_product(q.vector, v.vector) / sqrt(list_inner_product(q.vector, q.vector) * list_inner_product(v.vector, v.vector)) AS exact FROM asked_vecs q JOIN vecs v ON q.kind = v.kind),
r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(exact, 12) DESC, chunk_id) <= 8)
SELECT query_id, chunk_id, round(exact, 6) AS score, CASE WHEN exact >= 0.9 THEN 'merge' WHEN exact < 0.72 THEN 'separate' ELSE 'ask' END AS verdict FROM r WHERE query_id <> chunk_id""",
    "connected_components": "SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1",
    "group_confidence": """WITH o AS (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) % 100 / 100 AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
s AS (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component, count(*) OVER (PARTITION BY o_custkey) AS n FROM o), a AS (SELECT s.*, x.k AS at FROM s JOIN o x ON x.o_orderkey = s.component WHERE n > 1),
p AS (SELECT a.o_orderkey AS node, a.component, min(x.c) AS confidence FROM a JOIN o x ON x.o_custkey = a.o_custkey AND x.k >= least(a.k, a.at) AND x.k < greatest(a.k, a.at) GROUP BY ALL)
SELECT * FROM p UNION ALL SELECT component, component, min(confidence) FROM p GROUP BY component""",
    "connected_components_orders": """WITH c AS (SELECT o_custkey, o_orderkey, least(o_custkey * 2, min(o_orderkey) OVER (PARTITION BY o_custkey) * 2 + 1) AS component FROM orders)
SELECT DISTINCT o_custkey * 2 AS node, component FROM c UNION ALL SELECT o_orderkey * 2 + 1, component FROM c""",
    "canonical_names": "WITH n AS (SELECT p_brand AS component, p_name AS name, count(*) OVER (PARTITION BY p_brand) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_name) AS k FROM part) SELECT component, name AS canonical, n FROM n WHERE k = 1 AND n >= 2",
    "triple_validate": """WITH nodes AS (SELECT lower(s_name) AS name, s_suppkey AS node_id FROM supplier UNION ALL SELECT lower(p_brand), min(p_partkey) + 1000000 FROM part GROUP BY p_brand),
t AS (SELECT l_orderkey AS chunk_id, lower(s_name) AS s, lower(p_brand) AS o, CASE l_returnflag WHEN 'N' THEN 'supplies' WHEN 'R' THEN 'returns' ELSE 'ships' END AS relation, l_discount * 10 AS confidence FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)
SELECT chunk_id, f.node_id AS from_node, relation, g.node_id AS to_node, round(confidence, 6) AS confidence FROM t JOIN nodes f ON t.s = f.name JOIN nodes g ON t.o = g.name
WHERE confidence BETWEEN 0.5 AND 1 AND relation IN ('supplies', 'returns') AND f.node_id <> g.node_id AND chunk_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""",
    "relation_sample": """WITH c AS (SELECT l_orderkey AS chunk_id, CAST(sum(l_linenumber) AS BIGINT) AS n_entities FROM lineitem GROUP BY 1), x AS (SELECT o_custkey AS source_id, chunk_id, n_entities FROM c JOIN orders ON chunk_id = o_orderkey WHERE n_entities >= 8),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n_entities DESC, chunk_id) AS place, count(*) OVER (PARTITION BY source_id) AS of FROM x) SELECT source_id, chunk_id, n_entities, place FROM r WHERE place <= least(ceil(of * 0.1), 24)""",
    "map_merge": r"""WITH c AS (SELECT conv_id, turn, regexp_extract_all(text, '(?:^| )([A-Z][a-z]+)', 1) AS e, split_part(text, '.', 1) AS s FROM conversations), a AS (SELECT conv_id, flatten(list(e ORDER BY turn)) AS e, list_filter(list(s ORDER BY turn), lambda x: x <> '') AS s FROM c GROUP BY conv_id)
SELECT conv_id AS source_id, array_to_string(list_filter(e, lambda x, i: list_position(e, x) = i), ',') AS entities, array_to_string(s, ' ') AS summary FROM a""",
    "p95_latency": "SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type",
    "promotion_gate": """WITH a AS (SELECT CASE left(o_orderpriority, 1) WHEN '1' THEN 'bridging' WHEN '2' THEN 'rollup' ELSE 'single_hop' END AS kind, CASE WHEN o_orderkey % 3 > 0 THEN 1.0 ELSE 0.0 END AS graph, CAST(o_orderkey % 2 AS DOUBLE) AS hybrid, o_totalprice / 1000 AS ms FROM orders),
m AS (SELECT coalesce(avg(graph) FILTER (kind <> 'single_hop'), 0) AS g, coalesce(avg(hybrid) FILTER (kind <> 'single_hop'), 0) AS h, quantile_disc(ms, 0.95) AS p95_ms, count(*) AS sample_n FROM a),
c AS (SELECT count(DISTINCT o_custkey) AS n_sources, count(DISTINCT (o_custkey, o_orderkey)) AS n_chunks FROM orders)
SELECT round(g, 6) AS graph_recall, round(h, 6) AS hybrid_recall, round(100 * (g - h), 6) AS delta_pp, p95_ms, sample_n, n_sources, n_chunks, n_sources >= 3 AND n_chunks >= 50 AND round(100 * (g - h), 6) >= 5 AND p95_ms < 500 AS passed FROM m, c""",
    "recall_at_k": f"""WITH {SOURCES}, chunk_docs AS (SELECT source_id AS chunk_id, text FROM src), asks AS (SELECT item_id AS query_id, text FROM benchmark), {bm25("chunk_docs", "asks", False, None, 5)},
gold AS (SELECT DISTINCT query_id, chunk_id FROM chunk_docs c JOIN asks q ON contains(c.text, q.text))
SELECT query_id, round(count(l.chunk_id) / count(*), 6) AS recall, count(l.chunk_id) > 0 AS hit FROM gold LEFT JOIN lexical l USING (query_id, chunk_id) GROUP BY query_id""",
    "chat_history_pairs": """WITH x AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, turn AS turn_id, text AS question, answer FROM x WHERE role = 'user' AND next_role = 'assistant' AND trim(answer) <> '')
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn_id DESC) AS back FROM p QUALIFY back <= 3""",
    "speaker_runs": f"WITH {_RUNS} SELECT * FROM runs",
    "dialogue_validate": f"WITH {_RUNS}, v AS (SELECT conv_id, max(n_turns) AS longest, CAST(sum(n_turns) AS BIGINT) AS n_turns, count(DISTINCT role) AS n_speakers FROM runs GROUP BY conv_id) SELECT *, n_turns >= 2 AND n_speakers >= 2 AND longest <= 2 AS valid FROM v",
    "citation_markers": f"""WITH {_ANSWERS}, m AS (SELECT answer_id, list_transform(flatten(list_transform(regexp_extract_all(text, '\\[(\\s*\\d+\\s*(?:,\\s*\\d+\\s*)*)\\]', 1), lambda x: string_split(x, ','))), lambda x: CAST(trim(x) AS INTEGER)) AS m FROM answers),
d AS (SELECT answer_id, list_filter(m, lambda x, i: list_position(m, x) = i) AS m FROM m), e AS (SELECT answer_id, unnest(m) AS marker, unnest(range(len(m))) AS ordinal FROM d)
SELECT answer_id, ordinal, marker, answer_id * 10 + marker - 1 AS unit_id FROM e WHERE marker BETWEEN 1 AND 4""",
    "citation_diag": f"""WITH {_ANSWERS} SELECT answer_id, 3 AS n_markers, length(regexp_replace(text, '[^\\[]', '', 'g')) AS n_brackets, contains(text, '【') AS wide, contains(text, '[^') AS footnote, regexp_matches(text, '\\(\\d+\\)') AS round FROM answers""",
    "prompt_assembly": "SELECT conv_id AS query_id, string_agg('[' || (turn + 1) || '] (' || role || CASE WHEN turn % 2 = 0 THEN ' — §intro' ELSE '' END || '): ' || text, chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id",
    "document_order": "SELECT l_suppkey AS query_id, l_orderkey * 10 + l_linenumber AS unit_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber) - 1 AS order_index FROM lineitem",
    "event_tumbling": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "event_session": """WITH x AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM y GROUP BY user_id, s""",
    "json_leaves": "SELECT event_id AS source_id, 0 AS leaf_no, '/k: ' || json_extract_string(props, '$.k') AS text FROM events",
}
