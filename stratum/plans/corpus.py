"""Catalog listings, lifecycle, chunks, positions and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratum.functions import text as T
from stratum.operators import catalog, router, structure
from stratum.plans.common import PARENTS, SOURCES
from stratum.sources.tables import live, load, sources


def live_scope_chunks(spark: SparkSession, d: str) -> DataFrame:
    return structure.parents(live(sources(spark, d)))


def notebook_source_counts(spark: SparkSession, d: str) -> DataFrame:
    s = sources(spark, d)
    return catalog.source_counts(s.select("notebook_id").distinct(), s)


def trashed_sources(spark: SparkSession, d: str) -> DataFrame:
    return sources(spark, d).where("trashed").select("notebook_id", "source_id", F.length("text").cast("long").alias("n_chars"))


def source_dedup_first(spark: SparkSession, d: str) -> DataFrame:
    s = sources(spark, d)
    return catalog.add_sources(s.where("source_id % 2 = 1"), s.where("source_id % 2 = 0"))


def restore_antijoin(spark: SparkSession, d: str) -> DataFrame:
    return catalog.restorable(sources(spark, d)).select("notebook_id", "source_id")


def source_set_hash(spark: SparkSession, d: str) -> DataFrame:
    return catalog.set_hash(live(sources(spark, d)))


def status_recovery(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    status = F.when(F.col("event_type") == "view", "parsing").when(F.col("event_type") == "click", "embedding").otherwise("indexed")
    return catalog.recovered(e.select("event_id", status.alias("status"), F.when(F.col("user_id") % 3 == 0, "enriching").otherwise("done").alias("enrichment_status")))


def latest_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("version"), "event_type")
    return catalog.upsert_latest(e, "user_id", "version").select("user_id", F.col("version.event_id").alias("event_id"), "event_type")


def cascade_chunks(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return catalog.cascade(o, load(spark, d, "lineitem"), "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


def chunk_parents(spark: SparkSession, d: str) -> DataFrame:
    return structure.parents(sources(spark, d))


def chunk_children_overlap(spark: SparkSession, d: str) -> DataFrame:
    return structure.children(structure.parents(sources(spark, d)))


def chunk_token_offsets(spark: SparkSession, d: str) -> DataFrame:
    return structure.token_offsets(structure.parents(sources(spark, d))).select("source_id", "parent_no", "run_start", "run_end")


def line_blocks(spark: SparkSession, d: str) -> DataFrame:
    return structure.line_blocks(sources(spark, d))


def section_outline(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as headings, of a level by their length."""
    b = structure.line_blocks(sources(spark, d))
    total = b.withColumn("doc_end", F.max("byte_end").over(Window.partitionBy("source_id")))
    heads = total.select("source_id", F.col("block_no").alias("pos"), (F.length("text") % 3 + 1).alias("level"), F.col("text").alias("title"), F.col("byte_start").alias("start"), "doc_end")
    return structure.outline(heads).select("source_id", "pos", "level", "ordinal", "start", "end")


def section_midpoint_join(spark: SparkSession, d: str) -> DataFrame:
    b = structure.line_blocks(sources(spark, d))
    ends = b.withColumn("end", F.lead("byte_start", 1).over(Window.partitionBy("source_id").orderBy("block_no")))
    sections = ends.select("source_id", F.col("block_no").alias("section_id"), F.col("byte_start").alias("start"), F.coalesce("end", F.col("byte_end") + 1).alias("end"))
    chunks = b.groupBy("source_id", F.expr("byte_start div 1000").alias("chunk_id")).agg(F.min("byte_start").alias("start"), F.max("byte_end").alias("end"))
    return structure.section_of_midpoint(sections, chunks)


def anchor_asof(spark: SparkSession, d: str) -> DataFrame:
    b = structure.line_blocks(sources(spark, d))
    chunks = b.groupBy("source_id", F.expr("byte_start div 700").alias("chunk_id")).agg((F.max("byte_end") - 1).alias("start"))
    return structure.last_block_before(chunks, b.select("source_id", "block_no", F.col("byte_start").alias("start")))


def anchor_interval(spark: SparkSession, d: str) -> DataFrame:
    b = structure.line_blocks(sources(spark, d)).withColumn("start", F.col("byte_start"))
    chunks = b.groupBy("source_id", F.expr("byte_start div 700").alias("chunk_id")).agg(F.min("byte_start").alias("start"), F.max("byte_end").alias("end"))
    return structure.blocks_within(chunks, b.select("source_id", "start", F.col("block_no").alias("start_second"), (F.col("block_no") + 1).alias("end_second")))


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return sources(spark, d).select("source_id", T.estimated_tokens(F.col("text")).alias("tokens"))


def tier_decision(spark: SparkSession, d: str) -> DataFrame:
    s = live(sources(spark, d)).select("notebook_id", "source_id", T.estimated_tokens(F.col("text")).alias("tokens"))
    return router.tier_decision(s, router.tier_caps(32_768)[0])


def budget_trim(spark: SparkSession, d: str) -> DataFrame:
    s = live(sources(spark, d)).select("notebook_id", "source_id", T.estimated_tokens(F.col("text")).alias("tokens"))
    return router.budget_cut(s, 4000, "notebook_id", [F.desc("tokens"), "source_id"]).select("notebook_id", "source_id", "tokens", "running", "place")


def parent_automerge(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem")
    children = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.col("l_orderkey").alias("parent_id")).distinct()
    hits = li.where("l_returnflag <> 'N'").groupBy(F.pmod(F.col("l_suppkey"), F.lit(5)).alias("query_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id")).agg(F.max("l_extendedprice").alias("score"))
    return router.auto_merge(hits, children)


def excerpt_sample(spark: SparkSession, d: str) -> DataFrame:
    """Up to two parents of each live source, in a share of it and a total of its notebook."""
    src = live(sources(spark, d))
    return router.excerpts(structure.parents(src).join(src.select("source_id", "notebook_id"), "source_id"))


def source_text_concat(spark: SparkSession, d: str) -> DataFrame:
    p = structure.parents(sources(spark, d))
    return p.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("parent_no", "text"))).alias("p")).select("source_id", F.sha2(F.array_join(F.transform("p", lambda x: x["text"]), ""), 256).alias("text_sha256"))


def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages").select("page_id", T.normalized_url(F.col("url")).alias("url"))


def needs_js(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "pages")
    text = F.trim(F.regexp_replace("html", "<[^>]*>", " "))
    return p.select("page_id", T.needs_js(text, F.col("html")).alias("needs_js"), F.octet_length(text).cast("long").alias("text_bytes"))


def query_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "benchmark").select("item_id", T.sanitized_query(F.col("text")).alias("query"))


def node_ids(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "supplier").select("s_suppkey", T.node_id(F.col("s_nationkey"), F.col("s_name"), F.lit("concept")).alias("node_id"), T.normalized_name(F.concat("s_name", F.lit(" . "))).alias("name"), T.slug(F.col("s_name")).alias("slug"))


def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    return sources(spark, d).select("source_id", F.sha2(T.prefixed(F.col("notebook_id"), F.when(F.col("selected"), F.col("language")), F.col("text")), 256).alias("embedded_sha256"))


QUERIES = {
    f.__name__: f
    for f in (live_scope_chunks, notebook_source_counts, trashed_sources, source_dedup_first, restore_antijoin, source_set_hash, status_recovery, latest_upsert, cascade_chunks, chunk_parents, chunk_children_overlap, chunk_token_offsets, line_blocks, section_outline, section_midpoint_join, anchor_asof, anchor_interval, token_estimate, tier_decision, budget_trim, parent_automerge, excerpt_sample, source_text_concat, url_normalize, needs_js, query_sanitize, node_ids, embedding_text)
}

_TOKENS = r"CAST(length(regexp_replace(text, '[^\x{1100}-\x{11FF}\x{2E80}-\x{9FFF}\x{A960}-\x{A97F}\x{AC00}-\x{D7FF}\x{F900}-\x{FAFF}\x{FE30}-\x{FE4F}\x{FF00}-\x{FFEF}\x{20000}-\x{2FA1F}]', '', 'g')) + (length(text) - length(regexp_replace(text, '[^\x{1100}-\x{11FF}\x{2E80}-\x{9FFF}\x{A960}-\x{A97F}\x{AC00}-\x{D7FF}\x{F900}-\x{FAFF}\x{FE30}-\x{FE4F}\x{FF00}-\x{FFEF}\x{20000}-\x{2FA1F}]', '', 'g'))) // 4 AS BIGINT)"
_BLOCKS = """pieces AS (SELECT source_id, unnest(p) AS line, unnest(range(len(p))) AS line_no FROM (SELECT source_id, string_split(text, chr(10)) AS p FROM src)
), placed AS (
    SELECT source_id, line_no, line, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY source_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_start FROM pieces
), blocks AS (
    SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY line_no) - 1 AS block_no, line AS text, byte_start, byte_start + strlen(line) AS byte_end FROM placed WHERE trim(line, ' ') <> ''
)"""
_LIVE_TOKENS = f"tokens AS (SELECT notebook_id, source_id, {_TOKENS} AS tokens FROM alive)"

ORACLES = {
    "live_scope_chunks": f"WITH {SOURCES}, {PARENTS} SELECT * FROM parents WHERE source_id IN (SELECT source_id FROM alive)",
    "notebook_source_counts": f"WITH {SOURCES} SELECT notebook_id, count(*) FILTER (NOT trashed) AS n_live, count(*) AS n_all FROM src GROUP BY notebook_id",
    "trashed_sources": f"WITH {SOURCES} SELECT notebook_id, source_id, length(text) AS n_chars FROM src WHERE trashed",
    "source_dedup_first": f"""WITH {SOURCES}, b AS (SELECT notebook_id, raw_content_hash, source_id, 0 AS new FROM src WHERE source_id % 2 = 0 AND NOT trashed UNION ALL SELECT notebook_id, raw_content_hash, source_id, 1 FROM src WHERE source_id % 2 = 1),
w AS (SELECT *, row_number() OVER (PARTITION BY notebook_id, raw_content_hash ORDER BY new, source_id) AS n FROM b)
SELECT i.notebook_id, i.raw_content_hash, i.source_id, w.source_id AS winner_id, w.new = 0 OR w.source_id <> i.source_id AS was_existing FROM src i JOIN w ON w.n = 1 AND w.notebook_id = i.notebook_id AND w.raw_content_hash = i.raw_content_hash WHERE i.source_id % 2 = 1""",
    "restore_antijoin": f"WITH {SOURCES} SELECT notebook_id, source_id FROM src t WHERE trashed AND NOT EXISTS (SELECT 1 FROM src l WHERE NOT l.trashed AND l.notebook_id = t.notebook_id AND l.raw_content_hash = t.raw_content_hash)",
    "source_set_hash": f"WITH {SOURCES} SELECT notebook_id, sha256(string_agg(CAST(source_id AS VARCHAR) || chr(0) || raw_content_hash || chr(0), '' ORDER BY CAST(source_id AS VARCHAR))) AS set_hash FROM alive GROUP BY notebook_id",
    "status_recovery": "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'error' ELSE 'indexed' END AS status, CASE WHEN user_id % 3 = 0 THEN 'pending' ELSE 'done' END AS enrichment_status FROM events",
    "latest_upsert": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "cascade_chunks": "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY l_orderkey",
    "chunk_parents": f"WITH {SOURCES}, {PARENTS} SELECT * FROM parents",
    "chunk_children_overlap": rf"""WITH {SOURCES}, {PARENTS}, w AS (SELECT source_id, parent_no, string_split(text, ' ') AS v FROM parents),
n AS (SELECT source_id, parent_no, v, unnest(range(0, 1 + CAST(greatest(0, ceil((len(v) - 128) / 112)) AS BIGINT))) AS child_no FROM w)
SELECT source_id, parent_no, child_no, array_to_string(v[child_no * 112 + 1:child_no * 112 + 128], ' ') AS text, len(v[child_no * 112 + 1:child_no * 112 + 128]) AS n_tokens FROM n""",
    "chunk_token_offsets": f"WITH {SOURCES}, {PARENTS} SELECT source_id, parent_no, CAST(sum(n_tokens) OVER w - n_tokens AS BIGINT) AS run_start, CAST(sum(n_tokens) OVER w AS BIGINT) AS run_end FROM parents WINDOW w AS (PARTITION BY source_id ORDER BY parent_no)",
    "line_blocks": f"WITH {SOURCES}, {_BLOCKS} SELECT * FROM blocks",
    "section_outline": f"""WITH {SOURCES}, {_BLOCKS}, h AS (SELECT source_id, block_no AS pos, length(text) % 3 + 1 AS level, byte_start AS start, max(byte_end) OVER (PARTITION BY source_id) AS doc_end FROM blocks),
e AS (SELECT a.source_id, a.pos, min(b.start) AS next FROM h a JOIN h b ON a.source_id = b.source_id AND b.pos > a.pos AND b.level <= a.level GROUP BY ALL),
u AS (SELECT a.source_id, a.pos, max(b.pos) AS up FROM h a JOIN h b ON a.source_id = b.source_id AND b.pos < a.pos AND b.level < a.level GROUP BY ALL),
x AS (SELECT h.*, coalesce(e.next, h.doc_end) AS "end", coalesce(u.up, -1) AS up FROM h LEFT JOIN e USING (source_id, pos) LEFT JOIN u USING (source_id, pos))
SELECT source_id, pos, level, row_number() OVER (PARTITION BY source_id, level, up ORDER BY pos) AS ordinal, start, "end" FROM x""",
    "section_midpoint_join": f"""WITH {SOURCES}, {_BLOCKS}, s AS (SELECT source_id, block_no AS section_id, byte_start AS s, coalesce(lead(byte_start) OVER (PARTITION BY source_id ORDER BY block_no), byte_end + 1) AS e FROM blocks),
c AS (SELECT source_id, byte_start // 1000 AS chunk_id, (min(byte_start) + max(byte_end)) // 2 AS mid FROM blocks GROUP BY ALL)
SELECT source_id, section_id, chunk_id, mid FROM c JOIN s USING (source_id) WHERE mid >= s AND mid < e""",
    "anchor_asof": f"""WITH {SOURCES}, {_BLOCKS}, c AS (SELECT source_id, byte_start // 700 AS chunk_id, max(byte_end) - 1 AS start FROM blocks GROUP BY ALL)
SELECT c.source_id, chunk_id, max(block_no) AS anchor FROM c JOIN blocks b ON b.source_id = c.source_id AND b.byte_start <= c.start GROUP BY ALL""",
    "anchor_interval": f"""WITH {SOURCES}, {_BLOCKS}, c AS (SELECT source_id, byte_start // 700 AS chunk_id, min(byte_start) AS s, max(byte_end) AS e FROM blocks GROUP BY ALL)
SELECT c.source_id, chunk_id, min(block_no) AS start_second, max(block_no + 1) AS end_second FROM c JOIN blocks b ON b.source_id = c.source_id AND b.byte_start >= s AND b.byte_start < e GROUP BY ALL""",
    "token_estimate": f"WITH {SOURCES} SELECT source_id, {_TOKENS} AS tokens FROM src",
    "tier_decision": f"""WITH {SOURCES}, {_LIVE_TOKENS}, t AS (SELECT notebook_id, CAST(sum(tokens) AS BIGINT) AS total_tokens, max(CASE WHEN tokens > 19596 THEN 1 ELSE 0 END) AS oversized FROM tokens GROUP BY notebook_id)
SELECT *, CASE WHEN total_tokens <= 19596 AND oversized = 0 THEN 1 ELSE 2 END AS tier, abs(total_tokens - 19596) <= 256 AS near_cap FROM t""",
    "budget_trim": f"""WITH {SOURCES}, {_LIVE_TOKENS}, r AS (SELECT *, CAST(sum(tokens) OVER w AS BIGINT) AS running, row_number() OVER w - 1 AS place FROM tokens WINDOW w AS (PARTITION BY notebook_id ORDER BY tokens DESC, source_id ROWS UNBOUNDED PRECEDING))
SELECT notebook_id, source_id, tokens, running, place FROM r WHERE running <= 4000 OR place = 0""",
    "parent_automerge": """WITH c AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS chunk_id, l_orderkey AS parent_id FROM lineitem),
h AS (SELECT l_suppkey % 5 AS query_id, l_orderkey * 10 + l_linenumber AS chunk_id, l_orderkey AS parent_id, max(l_extendedprice) AS score FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL),
t AS (SELECT parent_id, count(*) AS total FROM c GROUP BY parent_id), g AS (SELECT query_id, parent_id, count(*) AS got, max(score) AS best FROM h GROUP BY ALL),
m AS (SELECT query_id, parent_id, best FROM g JOIN t USING (parent_id) WHERE got * 2 >= total)
SELECT query_id, parent_id AS unit_id, true AS merged, best AS score FROM m UNION ALL SELECT query_id, chunk_id, false, score FROM h ANTI JOIN m USING (query_id, parent_id)""",
    "excerpt_sample": f"""WITH {SOURCES}, {PARENTS}, q AS (SELECT notebook_id, source_id, parent_no, length(parents.text) AS n, coalesce(sum(length(parents.text)) OVER (PARTITION BY source_id ORDER BY parent_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM parents JOIN alive USING (source_id) WHERE parent_no < 2),
p AS (SELECT notebook_id, source_id, parent_no, CAST(least(n, 1200 - before) AS BIGINT) AS n_chars FROM q WHERE before < 1200),
r AS (SELECT *, sum(n_chars) OVER w AS running, row_number() OVER w - 1 AS place FROM p WINDOW w AS (PARTITION BY notebook_id ORDER BY source_id, parent_no ROWS UNBOUNDED PRECEDING))
SELECT notebook_id, source_id, parent_no, n_chars, place FROM r WHERE running <= 7000 OR place = 0""",
    "source_text_concat": f"WITH {SOURCES}, {PARENTS} SELECT source_id, sha256(string_agg(text, '' ORDER BY parent_no)) AS text_sha256 FROM parents GROUP BY source_id",
    "url_normalize": r"""WITH u AS (SELECT page_id, trim(url) AS raw, regexp_replace(trim(url), '#.*$', '') AS bare FROM pages),
p AS (SELECT page_id, raw, lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)) AS host, regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1) AS path, regexp_extract(bare, '(\?.*)$', 1) AS query FROM u)
SELECT page_id, CASE WHEN scheme = '' THEN raw ELSE scheme || '://' || CASE WHEN scheme = 'http' THEN regexp_replace(host, ':80$', '') WHEN scheme = 'https' THEN regexp_replace(host, ':443$', '') ELSE host END || CASE WHEN path = '' THEN '/' WHEN length(path) > 1 THEN regexp_replace(path, '/$', '') ELSE path END || query END AS url FROM p""",
    "needs_js": """WITH t AS (SELECT page_id, html, trim(regexp_replace(html, '<[^>]*>', ' ', 'g'), ' ') AS t FROM pages)
SELECT page_id, strlen(t) < 200 OR (strlen(t) < 1000 AND strlen(t) / nullif(strlen(html), 0) < 0.01) AS needs_js, strlen(t) AS text_bytes FROM t""",
    "query_sanitize": r"SELECT item_id, nullif(array_to_string(list_filter(string_split_regex(text, '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '' AND x NOT IN ('AND', 'OR', 'NOT', 'NEAR')), ' '), '') AS query FROM benchmark",
    "node_ids": r"SELECT s_suppkey, sha256(CAST(s_nationkey AS VARCHAR) || chr(0) || lower(s_name) || chr(0) || 'concept') AS node_id, trim(lower(regexp_replace(s_name || ' . ', '\s+', ' ', 'g')), ' .') || ' ' AS name, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM supplier",
    "embedding_text": f"WITH {SOURCES} SELECT source_id, sha256(CASE WHEN notebook_id <> '' THEN '[Document: ' || notebook_id || '] ' ELSE '' END || CASE WHEN selected AND language <> '' THEN '[Section: ' || language || '] ' ELSE '' END || text) AS embedded_sha256 FROM src",
}
