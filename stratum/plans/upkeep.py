"""Upkeep of the corpus, resolution of entities and the whole graph expansion, as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions.text import pair_key
from stratum.operators import answer, catalog, graph, mentions, resolve, upkeep
from stratum.plans.common import SOURCES, terms
from stratum.plans.extras import SEEDED, _names
from stratum.plans.knowledge import _EDGES, _edges
from stratum.sources import sinks
from stratum.sources.staging import shared_dir, stage
from stratum.sources.tables import entity_mentions, entity_nodes, load, sources


def jsonl_sniff(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as lines; every third user's begin with what isn't JSON."""
    e = load(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "props"))).alias("e"))
    raw = F.array_join(F.transform("e", lambda x: x["props"]), "\n")
    return e.select("user_id", upkeep.is_jsonl(F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("plain\n"), raw)).otherwise(raw)).alias("jsonl"))


def transcript_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as transcripts; every seventh has a segment that ends before it starts."""
    c = load(spark, d, "conversations").where("text is not null")
    start = F.col("turn") * 10.0
    return upkeep.transcript_blocks(c.select(F.col("conv_id").alias("source_id"), F.col("turn").alias("seg_no"), start.alias("start"), F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") == 1), start - 1).otherwise(start + 5).alias("end"), "text"))


def prose_chunks(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "table").when(F.col("l_returnflag") == "N", "paragraph")
    return li.where(upkeep.is_prose(kind, F.col("l_linenumber") - 1)).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def scanned_sources(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "pages")
    return p.select("page_id", upkeep.needs_ocr(F.when(F.col("page_id") % 2 == 0, "pdf").otherwise("html"), F.when(F.col("page_id") % 3 == 0, F.lit("  ")).otherwise(F.col("html"))).alias("needs_ocr"))


def graph_write(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "supplier")
    rows = s.select(F.col("s_nationkey").alias("source_id"), F.col("s_suppkey").alias("node_id"), F.col("s_name").alias("name"))
    new = rows.where("source_id % 5 = 0").withColumn("name", F.concat("name", F.lit("!")))
    return upkeep.written_graph(rows, new.unionByName(new), "source_id", "node_id")


def summary_replace(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem")
    chunks = li.select(F.col("l_orderkey").alias("source_id"), F.when(F.col("l_linenumber") == 1, "summary").otherwise("child").alias("kind"), F.col("l_partkey").alias("chunk_id"))
    new = load(spark, d, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("source_id"), F.lit("summary").alias("kind"), F.lit(-1).cast("long").alias("chunk_id"))
    return upkeep.with_summary(chunks, new).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("chunk_id").alias("ids"))


def overview_freshness(spark: SparkSession, d: str) -> DataFrame:
    now = catalog.set_hash(sources(spark, d).where("selected and not trashed"))
    n = F.substring("notebook_id", 4, 9).cast("int")
    rows = now.select("notebook_id", F.when(n % 4 == 0, "failed").otherwise("ready").alias("status"), F.when(n % 4 == 1, 0).otherwise(9).alias("file_bytes"), F.when(n % 4 == 2, "old").otherwise(F.col("set_hash")).alias("set_hash"))
    return upkeep.overview_status(rows, now)


def active_indexes(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "nation")
    registry = n.select(F.col("n_name").alias("coordinate"), (F.col("n_regionkey") % 2).alias("model"), F.when(F.col("n_nationkey") % 3 == 0, "stale").otherwise("active").alias("status"))
    used = load(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("coordinate"))
    return upkeep.active_indexes(registry, used)


def generation_reseed(spark: SparkSession, d: str) -> DataFrame:
    """A label's vectors embedded anew: the next generation has the others as they were, and readers see it when it is active."""
    v = load(spark, d, "embeddings").select(F.col("label").alias("source_id"), F.col("vec_id").alias("chunk_id"), "embedding")
    root = shared_dir(spark)
    none = spark.createDataFrame([], "coordinate string, generation int, status string")
    one = sinks.activate(sinks.new_generation(v, none, root, "c"), "c")
    old = sinks.read_active(spark, one, root, "c")
    again = old.where("source_id = 3").withColumn("chunk_id", F.col("chunk_id") + 1_000_000)
    two = sinks.activate(sinks.new_generation(old.where("source_id <> 3").unionByName(again), one, root, "c"), "c")
    return sinks.read_active(spark, two, root, "c").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("first"))


def sweep_plan(spark: SparkSession, d: str) -> DataFrame:
    """Customers as generations of their nations: some lost their row, some their folder, and their status goes by the sign of what they owe."""
    c = load(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("coordinate"), F.col("c_custkey").cast("int").alias("generation"), "c_acctbal")
    status = F.when(F.col("c_acctbal") < 0, "stale").when(F.col("generation") % 4 == 0, "building").otherwise("active")
    return sinks.sweep_plan(c.where("generation % 5 > 0").withColumn("status", status), c.where("generation % 3 > 0"))


def _orders(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as chunks of customers' notebooks by segment, and line items of low discount as mentions."""
    o, c = load(spark, d, "orders"), load(spark, d, "customer")
    chunks = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("notebook_id"), F.col("o_orderkey").alias("chunk_id"), F.col("o_orderpriority").alias("text"))
    return chunks, load(spark, d, "lineitem").where("l_discount < 0.05").select(F.col("l_orderkey").alias("chunk_id"))


def dense_chunks(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.dense_chunks(*_orders(spark, d))


def question_context(spark: SparkSession, d: str) -> DataFrame:
    chunks, said = _orders(spark, d)
    return upkeep.question_context(upkeep.dense_chunks(chunks, said, 5), chunks)


def valid_questions(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem")
    s = load(spark, d, "supplier").where("s_suppkey % 5 > 0").select(F.col("s_name").alias("name"))
    q = li.join(load(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("question_id"), F.when(F.col("l_orderkey") % 9 == 0, "odd").otherwise("bridging").alias("kind"), F.upper("s_name").alias("seed"), F.col("l_partkey").alias("chunk_id"))
    fed = load(spark, d, "part").where("p_size > 1").select(F.col("p_partkey").alias("chunk_id"))
    return upkeep.valid_questions(q, fed, s).select("question_id").distinct()


def latest_eval(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    return upkeep.latest(e.select("event_type", F.struct("ts", "event_id").alias("ran_at"), "value"), "event_type", "ran_at").select("event_type", F.col("ran_at.event_id").alias("event_id"), "value")


def notes_by_source(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").where("l_linenumber = 1")
    g = upkeep.notes_by_source(li.select(F.col("l_orderkey").alias("note_id"), F.col("l_suppkey").alias("source_id")))
    return g.select("source_id", F.array_join(F.transform("note_ids", lambda x: x.cast("string")), ",").alias("notes"), "place")


def listing_orders(spark: SparkSession, d: str) -> DataFrame:
    """Pinned notes first, then the newest."""
    o = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", (F.col("o_orderstatus") == "P").alias("pinned"))
    return upkeep.listed(o, "o_custkey", F.desc("pinned"), F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "place")


def node_texts(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part")
    return p.select("p_partkey", upkeep.node_text(F.col("p_brand"), F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).when(F.col("p_partkey") % 3 == 0, F.lit(" "))).alias("text"))


def bounded_maps(spark: SparkSession, d: str) -> DataFrame:
    s = sources(spark, d)
    entities, summary = upkeep.bounded_map(F.split("text", " "), F.col("text"))
    return s.select("source_id", F.size(entities).alias("n"), F.sha2(F.array_join(entities, " "), 256).alias("entities_sha256"), F.length(summary).alias("summary_chars"))


def anchor_pages(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem")
    located = li.select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "A", F.lit("row 3")).otherwise(upkeep.anchor(F.when(F.col("l_returnflag") == "R", "pdf").otherwise("text"), F.col("l_linenumber"))).alias("locator"))
    return located.select("l_orderkey", "l_linenumber", "locator", F.coalesce(upkeep.anchor_page(F.col("locator")), F.lit(-1)).alias("page"))


def worth_enriching(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "orders").select(F.col("o_orderkey").alias("source_id"), (F.col("o_totalprice") / 100).cast("long").alias("tokens"))
    b = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.when(F.col("l_returnflag") == "N", "code").otherwise("paragraph").alias("block_type"), F.col("l_linenumber").alias("level"))
    return upkeep.worth_enriching(s, b).select("source_id")


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Parts as what was found in their brands' texts: entities, dates and defined terms by turns."""
    p = load(spark, d, "part")
    k = F.col("p_partkey") % 3
    found = p.select(F.col("p_brand").alias("source_id"), k.cast("int").alias("class"), F.col("p_partkey").alias("pos"), F.when(k == 1, F.upper("p_type")).otherwise(F.col("p_type")).alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("definition"))
    n = upkeep.built_nodes(found)
    return n.select("source_id", "key", "name", "kind", F.coalesce("definition", F.lit("")).alias("definition"))


def relational_signal(spark: SparkSession, d: str) -> DataFrame:
    q = load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise(F.substring_index("text", " ", 3)).alias("text"))
    found = mentions.seeds(_names(spark, d).where("node_id % 3 > 0"), q)
    return mentions.relational(q, found)


def _seed_names(spark: SparkSession, d: str) -> DataFrame:
    """Every nation as a query for itself, its name in lower case."""
    n = load(spark, d, "nation")
    return n.select(F.col("n_nationkey").alias("query_id"), F.lower("n_name").alias("name"), F.col("n_regionkey").alias("kind"))


def expand_neighbors_full(spark: SparkSession, d: str) -> DataFrame:
    out = graph.expanded(entity_nodes(spark, d), _edges(spark, d), _seed_names(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("w", "conf")})


def ppr_topk(spark: SparkSession, d: str) -> DataFrame:
    seeds = _seed_names(spark, d).where("query_id < 3").select("name", "kind")
    out = graph.ranked_names(entity_nodes(spark, d), _edges(spark, d), seeds, k=10, rounds=10, epsilon=0.0)
    return out.withColumns({c: F.round(c, 6) for c in ("score", "conf")})


def graph_compose(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as queries: orders that name them, and orders of those of the same nation by discount."""
    li = load(spark, d, "lineitem")
    sure = li.select(F.col("l_suppkey").alias("query_id"), F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("ord")).where("chunk_id % 7 = 0")
    walk = li.select(((F.col("l_suppkey") + 1) % 50).alias("query_id"), F.col("l_orderkey").alias("chunk_id"), F.col("l_discount").alias("conf"), F.col("l_linenumber").alias("ord"))
    return graph.composed(sure, walk, 20)


def _live_nations(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "nation").where("n_nationkey % 4 > 0").select(F.col("n_nationkey").alias("source_id"))


def entity_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers by region, their nations as sources."""
    s, n, r = load(spark, d, "supplier"), load(spark, d, "nation"), load(spark, d, "region")
    nodes = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("node_id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 > 0, F.col("r_name")).alias("canonical"), (F.col("s_suppkey") % 2).alias("kind"), F.col("s_nationkey").alias("source_id"), F.when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("of "), "n_name")).alias("definition"))
    out = graph.rollup(nodes, entity_mentions(spark, d), _live_nations(spark, d))
    return out.withColumn("definition", F.coalesce("definition", F.lit("")))


def entity_evidence_live(spark: SparkSession, d: str) -> DataFrame:
    """Orders as chunks of customers' nations."""
    o, c = load(spark, d, "orders"), load(spark, d, "customer")
    chunks = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("chunk_id"), F.col("c_nationkey").alias("source_id"), (F.col("o_orderkey") % 2).alias("level"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderkey") % 7).alias("token_start"))
    return graph.live_evidence(entity_nodes(spark, d), entity_mentions(spark, d), chunks, _live_nations(spark, d))


def chat_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns of four messages, of which some answers are unfinished."""
    c = load(spark, d, "conversations")
    return answer.complete_turns(c.select("conv_id", F.expr("turn div 4").alias("turn_id"), F.col("turn").alias("pos"), "role", "text", F.when(F.col("turn") % 8 == 3, "cut").alias("state")))


def _entities(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with a part's type as their name, of kinds by their label."""
    v, p = load(spark, d, "embeddings"), load(spark, d, "part")
    return v.join(p, F.col("vec_id") == F.col("p_partkey")).select(F.col("vec_id").alias("node_id"), F.col("p_type").alias("name"), F.col("label").cast("string").alias("kind"), F.col("embedding").alias("vector"))


def resolve_notebook(spark: SparkSession, d: str) -> DataFrame:
    """All tiers; the verdicts kept are on names whose lengths differ by an even number, the surer ones by 0 or 4."""
    n = stage(_entities(spark, d))
    names = n.select("name", "kind").distinct()
    x, y = names.select(F.lower("name").alias("a"), "kind"), names.select(F.lower("name").alias("b"), "kind")
    apart = F.abs(F.length("a") - F.length("b"))
    cache = x.join(y, "kind").where("a < b").select(pair_key(F.col("kind"), F.col("a"), F.col("b")).alias("key"), (apart % 2 == 0).alias("same"), F.when(apart % 4 == 0, 0.95).otherwise(0.8).alias("confidence"), F.when(apart == 8, "v0").otherwise("v1").alias("prompt_version"))
    updates = resolve.resolved(n.select("node_id", "name", "kind"), n.select(F.col("node_id").alias("chunk_id"), "vector"), cache, "v1")
    out = resolve.applied(n.select("node_id", "name", "kind"), updates, "v1")
    return out.select("node_id", F.coalesce("canonical", F.lit("")).alias("canonical"), F.round(F.coalesce("confidence", F.lit(-1.0)), 6).alias("confidence"), "prompt_version")


QUERIES = {
    f.__name__: f
    for f in (jsonl_sniff, sweep_plan, transcript_blocks, prose_chunks, scanned_sources, graph_write, summary_replace, overview_freshness, active_indexes, generation_reseed, dense_chunks, question_context, valid_questions, latest_eval, notes_by_source, listing_orders, node_texts, bounded_maps, anchor_pages, worth_enriching, graph_nodes, relational_signal, entity_rollup, entity_evidence_live, chat_turns, expand_neighbors_full, ppr_topk, graph_compose, resolve_notebook)
}

_DENSE = """chunks AS (SELECT c_mktsegment AS notebook_id, o_orderkey AS chunk_id, o_orderpriority AS text FROM orders JOIN customer ON o_custkey = c_custkey), m AS (SELECT l_orderkey AS chunk_id, count(*) AS m FROM lineitem WHERE l_discount < 0.05 GROUP BY 1),
dense AS (SELECT notebook_id, chunk_id, coalesce(m, 0) AS n, row_number() OVER (PARTITION BY notebook_id ORDER BY coalesce(m, 0) DESC, chunk_id) - 1 AS rank0 FROM chunks LEFT JOIN m USING (chunk_id))"""
_LOGICAL = "ents AS (SELECT s_suppkey AS node_id, lower(n_name) AS key, n_name AS name, n_regionkey AS kind FROM supplier JOIN nation ON s_nationkey = n_nationkey), logic AS (SELECT *, min(node_id) OVER (PARTITION BY key, kind) AS logical_id FROM ents)"


def _ranks(rounds: int) -> str:
    steps = [f"""r{i} AS (SELECT b.node_id, 0.85 * coalesce(got, 0) + (0.15 + 0.85 * (SELECT coalesce(sum(score) FILTER (NOT leads), 0) FROM r{i - 1} JOIN base USING (node_id))) * home AS score
    FROM base b LEFT JOIN (SELECT p.b, sum(score * p.p) AS got FROM r{i - 1} JOIN p ON p.a = node_id GROUP BY p.b) x ON x.b = b.node_id)""" for i in range(1, rounds + 1)]
    return f"""WITH {_EDGES}, {_LOGICAL}, le AS (SELECT x.logical_id AS from_node, y.logical_id AS to_node, relation, w FROM edges JOIN logic x ON from_node = x.node_id JOIN logic y ON to_node = y.node_id WHERE x.logical_id <> y.logical_id),
ways AS (SELECT a, b, sum(w) AS w FROM (SELECT from_node AS a, to_node AS b, w FROM le UNION ALL SELECT to_node, from_node, w FROM le WHERE relation = 'co_occurs') GROUP BY a, b), p AS MATERIALIZED (SELECT a, b, w / sum(w) OVER (PARTITION BY a) AS p FROM ways),
seeds AS (SELECT DISTINCT logical_id AS seed FROM logic JOIN nation ON key = lower(n_name) AND kind = n_regionkey WHERE n_nationkey < 3),
base AS MATERIALIZED (SELECT DISTINCT logical_id AS node_id, CASE WHEN logical_id IN (SELECT seed FROM seeds) THEN 1.0::DOUBLE / (SELECT count(*) FROM seeds) ELSE 0 END AS home, logical_id IN (SELECT a FROM p) AS leads FROM logic),
r0 AS (SELECT node_id, home AS score FROM base), {", ".join(steps)}, top AS (SELECT name, kind, score, row_number() OVER (ORDER BY round(score, 12) DESC, name, kind) - 1 AS rank0 FROM r{rounds} JOIN (SELECT DISTINCT logical_id, name, kind FROM logic) ON node_id = logical_id WHERE node_id NOT IN (SELECT seed FROM seeds) QUALIFY rank0 < 10)
SELECT name, kind, round(score, 6) AS score, CASE WHEN max(score) OVER () > 0 THEN round(score / max(score) OVER (), 6) ELSE 0 END AS conf, rank0 FROM top"""


ORACLES = {
    "jsonl_sniff": "SELECT user_id, user_id % 3 <> 0 AND count(*) >= 2 AS jsonl FROM events GROUP BY user_id",
    "sweep_plan": """WITH c AS (SELECT CAST(c_nationkey AS VARCHAR) AS coordinate, CAST(c_custkey AS INTEGER) AS generation, CASE WHEN c_acctbal < 0 THEN 'stale' WHEN c_custkey % 4 = 0 THEN 'building' ELSE 'active' END AS status FROM customer WHERE c_custkey % 5 > 0 OR c_custkey % 3 > 0)
SELECT coordinate, generation, CASE WHEN generation % 3 > 0 THEN CASE WHEN generation % 5 > 0 AND status <> 'stale' THEN 'keep' ELSE 'drop' END WHEN status = 'stale' THEN 'forget' WHEN status = 'active' THEN 'missing' ELSE 'wait' END AS action FROM c""",
    "transcript_blocks": """WITH c AS (SELECT conv_id AS source_id, turn AS seg_no, text, turn * 10.0::DOUBLE AS start, CASE WHEN conv_id % 7 = 0 AND turn = 1 THEN turn * 10.0::DOUBLE - 1 ELSE turn * 10.0::DOUBLE + 5 END AS "end" FROM conversations WHERE text IS NOT NULL),
x AS (SELECT *, bool_or("end" < start) OVER (PARTITION BY source_id) AS bad, CAST(coalesce(sum(strlen(text) + 2) OVER (PARTITION BY source_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_start FROM c)
SELECT source_id, seg_no, text, byte_start, byte_start + strlen(text) AS byte_end, start, "end" FROM x WHERE NOT bad""",
    "prose_chunks": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_linenumber > 1 AND l_returnflag <> 'R' GROUP BY l_returnflag",
    "scanned_sources": "SELECT page_id, page_id % 2 = 0 AND page_id % 3 = 0 AS needs_ocr FROM pages",
    "graph_write": "SELECT s_nationkey AS source_id, s_suppkey AS node_id, CASE WHEN s_nationkey % 5 = 0 THEN s_name || '!' ELSE s_name END AS name FROM supplier",
    "summary_replace": """WITH r AS (SELECT l_orderkey AS s, CASE WHEN l_linenumber = 1 THEN 'summary' ELSE 'child' END AS kind, l_partkey AS c FROM lineitem), n AS (SELECT o_orderkey AS s, 'summary' AS kind, -1 AS c FROM orders WHERE o_orderkey % 4 = 0),
u AS (SELECT * FROM r WHERE NOT (kind = 'summary' AND s IN (SELECT s FROM n)) UNION ALL SELECT * FROM n) SELECT kind, count(*) AS n, CAST(sum(c) AS BIGINT) AS ids FROM u GROUP BY kind""",
    "overview_freshness": f"WITH {SOURCES}, n AS (SELECT DISTINCT notebook_id, CAST(substr(notebook_id, 4) AS INTEGER) % 4 AS k FROM alive) SELECT notebook_id, CASE k WHEN 0 THEN 'failed' WHEN 1 THEN 'missing' WHEN 2 THEN 'stale' ELSE 'ready' END AS status FROM n",
    "active_indexes": "SELECT n_name AS coordinate, n_regionkey % 2 AS model, 'active' AS status FROM nation WHERE n_nationkey % 3 <> 0 AND n_nationkey IN (SELECT s_nationkey FROM supplier)",
    "generation_reseed": "SELECT label AS source_id, count(*) AS n, min(vec_id) + CASE WHEN label = 3 THEN 1000000 ELSE 0 END AS first FROM embeddings GROUP BY label",
    "dense_chunks": f"WITH {_DENSE} SELECT * FROM dense WHERE rank0 < 40",
    "question_context": f"WITH {_DENSE} SELECT notebook_id, string_agg('[' || chunk_id || '] ' || text, chr(10) ORDER BY rank0) AS context FROM dense JOIN chunks USING (notebook_id, chunk_id) WHERE rank0 < 5 GROUP BY notebook_id",
    "valid_questions": "WITH p AS (SELECT p_partkey FROM part WHERE p_size > 1) SELECT l_orderkey AS question_id FROM lineitem GROUP BY l_orderkey HAVING l_orderkey % 9 <> 0 AND bool_and(l_suppkey % 5 > 0 AND l_partkey IN (SELECT p_partkey FROM p))",
    "latest_eval": "SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1",
    "notes_by_source": "SELECT l_suppkey AS source_id, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY l_orderkey) AS notes, min(l_orderkey) AS place FROM lineitem WHERE l_linenumber = 1 GROUP BY l_suppkey",
    "listing_orders": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'P' DESC, o_orderdate DESC, o_orderkey DESC) - 1 AS place FROM orders",
    "node_texts": "SELECT p_partkey, p_brand || ': ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN ' — ' || p_type ELSE '' END AS text FROM part",
    "bounded_maps": f"WITH {SOURCES}, x AS (SELECT source_id, text, list_transform(string_split(text, ' ')[1:200], lambda w: substring(w, 1, 1000)) AS e FROM src) SELECT source_id, len(e) AS n, sha256(array_to_string(e, ' ')) AS entities_sha256, length(substring(text, 1, 4000)) AS summary_chars FROM x",
    "anchor_pages": """SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'row 3' WHEN 'R' THEN '{"kind":"pdf","page":' || l_linenumber || '}' ELSE '{"kind":"text","page":' || l_linenumber || '}' END AS locator, CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE -1 END AS page FROM lineitem""",
    "worth_enriching": "SELECT o_orderkey AS source_id FROM orders WHERE o_totalprice / 100 >= 2000 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'N')",
    "graph_nodes": """WITH f AS (SELECT p_brand AS source_id, p_partkey % 3 AS class, p_partkey AS pos, CASE WHEN p_partkey % 3 = 1 THEN upper(p_type) ELSE p_type END AS name, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS definition FROM part),
w AS (SELECT source_id, lower(name) AS key, name, class FROM f QUALIFY row_number() OVER (PARTITION BY source_id, lower(name) ORDER BY class, pos) = 1),
t AS (SELECT source_id, lower(name) AS key, definition FROM f WHERE class = 2 AND definition IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id, lower(name) ORDER BY pos) = 1)
SELECT source_id, key, name, CASE WHEN class = 1 THEN 'date' ELSE 'concept' END AS kind, coalesce(definition, '') AS definition FROM w LEFT JOIN t USING (source_id, key)""",
    "entity_rollup": """WITH m AS (SELECT l_suppkey AS id, count(*) AS m FROM lineitem GROUP BY 1), n AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 > 0 THEN r_name ELSE s_name END AS name, s_suppkey % 2 AS kind, s_nationkey AS src, CASE WHEN s_suppkey % 4 = 1 THEN 'of ' || n_name END AS definition
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_nationkey % 4 > 0) SELECT min(name) AS name, kind, count(DISTINCT src) AS n_sources, CAST(sum(coalesce(m, 0)) AS BIGINT) AS n_mentions, coalesce(min(definition), '') AS definition FROM n LEFT JOIN m USING (id) GROUP BY lower(name), kind""",
    "entity_evidence_live": """WITH c AS (SELECT o_orderkey AS chunk_id, o_orderkey % 2 AS level, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 7 END AS token_start FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 4 > 0),
n AS (SELECT lower(n_name) AS name, n_regionkey AS kind, l_orderkey AS chunk_id, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)
SELECT name, kind, chunk_id, n, row_number() OVER (PARTITION BY name, kind ORDER BY n DESC, level, token_start NULLS LAST, chunk_id) - 1 AS rank0 FROM n JOIN c USING (chunk_id) QUALIFY rank0 < 10""",
    "chat_turns": """WITH c AS (SELECT *, turn // 4 AS t FROM conversations), g AS (SELECT conv_id, t, arg_max(text, turn) FILTER (role = 'user') AS question, arg_max(text, turn) FILTER (role = 'assistant' AND turn % 8 <> 3 AND trim(text, ' ') <> '') AS answer FROM c GROUP BY conv_id, t)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY t) AS turn_id, question, answer FROM g WHERE question IS NOT NULL AND answer IS NOT NULL""",
    "expand_neighbors_full": f"""WITH {_EDGES}, {_LOGICAL}, u AS (SELECT from_node AS a, to_node AS b, w, relation FROM edges WHERE from_node <> to_node UNION ALL SELECT to_node, from_node, w, relation FROM edges WHERE from_node <> to_node), s AS (SELECT DISTINCT a, b FROM u),
st AS (SELECT n_nationkey AS query_id, node_id, logical_id FROM nation JOIN logic ON key = lower(n_name) AND kind = n_regionkey), h AS (SELECT query_id, b AS node_id FROM st JOIN s ON a = node_id UNION SELECT query_id, y.b FROM st JOIN s x ON x.a = node_id JOIN s y ON x.b = y.a),
best AS (SELECT a AS node_id, w, relation FROM u QUALIFY row_number() OVER (PARTITION BY a ORDER BY w DESC, relation) = 1),
g AS (SELECT query_id, logical_id, name, kind, w, relation FROM h JOIN best USING (node_id) JOIN logic USING (node_id) QUALIFY row_number() OVER (PARTITION BY query_id, logical_id ORDER BY w DESC, relation) = 1),
o AS (SELECT g.*, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, name, kind) - 1 AS rank0 FROM g ANTI JOIN st USING (query_id, logical_id) QUALIFY rank0 < 50)
SELECT query_id, name, kind, relation, round(w, 6) AS w, round(w / max(w) OVER (PARTITION BY query_id), 6) AS conf, rank0 FROM o""",
    "ppr_topk": _ranks(10),
    "graph_compose": """WITH r AS (SELECT l_suppkey AS query_id, l_orderkey AS chunk_id, 1.0::DOUBLE AS conf, l_linenumber AS seen FROM lineitem WHERE l_orderkey % 7 = 0 UNION ALL SELECT (l_suppkey + 1) % 50, l_orderkey, l_discount, 1000000 + l_linenumber FROM lineitem),
b AS (SELECT query_id, chunk_id, max(conf) AS conf, min(seen) AS seen FROM r GROUP BY ALL) SELECT query_id, chunk_id, conf, row_number() OVER (PARTITION BY query_id ORDER BY conf DESC, seen, chunk_id) - 1 AS rank0 FROM b QUALIFY rank0 < 20""",
    "relational_signal": rf"""WITH RECURSIVE n AS (SELECT item_id AS node_id, array_to_string({terms("split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)")}, ' ') AS gram FROM benchmark WHERE item_id % 3 > 0),
q AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN text ELSE array_to_string(string_split(text, ' ')[1:3], ' ') END AS text FROM benchmark), {SEEDED},
c AS (SELECT query_id, count(*) AS seeds, flatten(list(range(start, start + width))) AS claimed FROM seeded GROUP BY query_id),
w AS (SELECT query_id, unnest(t) AS w, unnest(range(len(t))) AS i FROM qt), r AS (SELECT query_id, count(*) FILTER (NOT list_contains(coalesce(claimed, []), i) AND w NOT IN ({", ".join(f"'{x}'" for x in mentions.STOP_WORDS)})) AS residual FROM w LEFT JOIN c USING (query_id) GROUP BY query_id)
SELECT query_id, coalesce(seeds, 0) AS n_seeds, coalesce(residual, 0) AS residual, coalesce(seeds, 0) > 0 AND coalesce(residual, 0) >= 2 AS walk FROM q LEFT JOIN c USING (query_id) LEFT JOIN r USING (query_id)""",
    "resolve_notebook": """WITH RECURSIVE n AS (SELECT vec_id AS node_id, p_type AS name, lower(p_type) AS low, CAST(label AS VARCHAR) AS kind, CAST(embedding AS DOUBLE[]) AS v FROM embeddings JOIN part ON vec_id = p_partkey),
sure AS (SELECT node_id AS u, min(node_id) OVER (PARTITION BY low, kind) AS v, 1.0::DOUBLE AS c FROM n),
near AS (SELECT q.node_id AS u, n.node_id AS v, q.low AS a, n.low AS b, list_inner_product(q.v, n.v) / sqrt(list_inner_product(q.v, q.v) * list_inner_product(n.v, n.v)) AS c FROM n q JOIN n ON q.kind = n.kind),
top AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY u ORDER BY round(c, 12) DESC, v) <= 8),
edges AS MATERIALIZED (SELECT * FROM sure WHERE u <> v UNION ALL SELECT u, v, c FROM top WHERE u <> v AND c >= 0.9 UNION ALL SELECT u, v, 0.95 FROM top WHERE u <> v AND c < 0.9 AND c >= 0.72 AND a <> b AND abs(length(a) - length(b)) % 4 = 0 AND abs(length(a) - length(b)) <> 8),
ends AS MATERIALIZED (SELECT u, v FROM edges UNION SELECT v, u FROM edges), reach AS (SELECT u AS node, u AS c FROM ends UNION SELECT e.v, r.c FROM reach r JOIN ends e ON r.node = e.u),
comp AS MATERIALIZED (SELECT node, min(c) AS component FROM reach GROUP BY node), best_ AS MATERIALIZED (SELECT a, b, max(c) AS c FROM (SELECT u AS a, v AS b, c FROM edges UNION ALL SELECT v, u, c FROM edges) GROUP BY ALL),
wide AS (SELECT DISTINCT component AS node, 2.0::DOUBLE AS c FROM comp UNION SELECT b, least(w.c, e.c) FROM wide w JOIN best_ e ON w.node = e.a),
path AS (SELECT node, component, max(c) AS c FROM wide JOIN comp USING (node) GROUP BY ALL), conf AS (SELECT node, CASE WHEN node = component THEN min(CASE WHEN node <> component THEN c END) OVER (PARTITION BY component) ELSE c END AS confidence FROM path),
best AS (SELECT component, name AS canonical FROM comp JOIN n ON node = node_id QUALIFY row_number() OVER (PARTITION BY component ORDER BY length(name) DESC, name) = 1)
SELECT node_id, coalesce(canonical, '') AS canonical, round(coalesce(confidence, -1), 6) AS confidence, 'v1' AS prompt_version FROM n LEFT JOIN comp ON node = node_id LEFT JOIN conf USING (node) LEFT JOIN best USING (component)""",
}
