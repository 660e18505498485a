"""Mentions, seeds, structure of pages, notes and snippets, as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions.address import is_public
from stratum.functions.embed import embedded
from stratum.operators import language, mentions, router, structure
from stratum.plans.common import SOURCES, terms
from stratum.plans.corpus import _BLOCKS
from stratum.sources.tables import load, sources


def _names(spark: SparkSession, d: str) -> DataFrame:
    """The first two words of each benchmark passage as a name."""
    return load(spark, d, "benchmark").select(F.col("item_id").alias("node_id"), F.substring_index("text", " ", 2).alias("name"))


def mention_detection(spark: SparkSession, d: str) -> DataFrame:
    chunks = sources(spark, d).select(F.col("source_id").alias("chunk_id"), "text")
    return mentions.detect(_names(spark, d), chunks)


def mention_spans(spark: SparkSession, d: str) -> DataFrame:
    """Openings of passages, and their third words, in documents of which every fifth is code or a table."""
    b = load(spark, d, "benchmark")
    names = b.select(F.col("item_id").alias("node_id"), F.substring_index("text", " ", 2).alias("name")).unionByName(b.select((F.col("item_id") + 1_000_000).alias("node_id"), F.get(F.split("text", " "), F.lit(2)).alias("name")))
    kind = F.when(F.col("source_id") % 10 == 0, "code").when(F.col("source_id") % 10 == 5, "table").otherwise("paragraph")
    return mentions.mention_spans(names, sources(spark, d).select(F.col("source_id").alias("chunk_id"), "text", kind.alias("block_type"), F.lit(1).alias("level")))


def question_seeds(spark: SparkSession, d: str) -> DataFrame:
    return mentions.seeds(_names(spark, d), load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


def source_language(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of the labelled documents of even ids, and what they say of every document."""
    s = sources(spark, d)
    return language.sure_language(s, language.profiles(s.where("source_id % 2 = 0").select("language", "text")))


def page_headings(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("seg_no"), F.col("l_quantity").alias("font_size"), F.col("l_returnflag").alias("text"))
    return mentions.page_headings(li)


def notes_export(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "conversations")
    return mentions.notes_markdown(c.select(F.col("conv_id").alias("notebook_id"), F.col("turn").alias("note_id"), (F.col("role") == "user").alias("pinned"), F.col("text").alias("content")))


def structural_section(spark: SparkSession, d: str) -> DataFrame:
    b = structure.line_blocks(sources(spark, d))
    heads = b.select("source_id", F.col("block_no").alias("pos"), (F.length("text") % 3 + 1).alias("level"), F.col("text").alias("title"))
    return router.nth_section(heads, "the", 2).select("source_id", "pos", "level")


def citation_snippet(spark: SparkSession, d: str) -> DataFrame:
    s = sources(spark, d)
    cut = s.select("source_id", mentions.snippet(F.col("text"), (F.octet_length("text") / 2).cast("int"), (F.octet_length("text") / 2 + 40).cast("int")).alias("s"))
    return cut.select("source_id", "s.text", "s.mark_start", "s.mark_stop")


def json_objects(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    return e.select("event_id", mentions.first_json(F.concat(F.lit('Sure: "x" '), "props", F.lit(" } done {}"))).alias("json"))


def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    return sources(spark, d).select("source_id", F.transform(embedded(F.col("text")), lambda v: F.round(v, 6)).alias("vector"))


def public_pages(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages").select("page_id", is_public(F.col("url")).alias("public"))


QUERIES = {f.__name__: f for f in (mention_detection, mention_spans, source_language, question_seeds, page_headings, notes_export, structural_section, citation_snippet, json_objects, hash_embedding, public_pages)}

def seeded(own: str = "", whole: bool = False) -> str:
    """CTEs that end in ``seeded`` (query_id, node_id, start, width) over ``n`` (node_id, gram) and ``q`` (query_id, text), which may have to agree on a column. ``whole``: names of any width in all of a question."""
    return rf"""qt AS (SELECT query_id, ({terms("text")}){"[1:64]" * (not whole)} AS t FROM q), qs AS (SELECT query_id, t, unnest(range(len(t))) AS start FROM qt), qg AS (SELECT query_id, start, unnest({"range(1, len(t) - start + 1)" if whole else "[1, 2, 3, 4, 5]"}) AS width, t FROM qs),
qh AS (SELECT qg.query_id, start, width, min(node_id) AS node_id FROM qg {f"JOIN q USING (query_id)" if own else ""} JOIN n ON gram = array_to_string(t[start + 1:start + width], ' ') {f"AND n.{own} = q.{own}" if own else ""} WHERE start + width <= len(t) AND gram <> '' GROUP BY ALL),
qo AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY width DESC, start) AS k FROM qh), fold AS (
    SELECT query_id, k, [{{'start': start, 'width': width, 'node_id': node_id}}] AS taken FROM qo WHERE k = 1
    UNION ALL SELECT o.query_id, o.k, CASE WHEN len(list_filter(taken, lambda y: o.start < y.start + y.width AND y.start < o.start + o.width)) > 0 THEN taken ELSE list_append(taken, {{'start': o.start, 'width': o.width, 'node_id': o.node_id}}) END
    FROM fold f JOIN qo o ON o.query_id = f.query_id AND o.k = f.k + 1
), seeded AS (SELECT query_id, x.node_id, CAST(x.start AS INTEGER) AS start, x.width FROM (SELECT query_id, unnest(taken) AS x FROM fold WHERE (query_id, k) IN (SELECT query_id, max(k) FROM fold GROUP BY query_id)))"""


SEEDED = seeded()
_SEED_NAMES = f"n AS (SELECT item_id AS node_id, array_to_string({terms("split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)")}, ' ') AS gram FROM benchmark)"

ORACLES = {
    "public_pages": r"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '\.+$', '') AS host FROM pages)
SELECT page_id, scheme IN ('http', 'https') AND host NOT IN ('', 'localhost') AND NOT regexp_matches(host, '\.(localhost|local|internal)$') AND NOT regexp_matches(host, '^(10|127|0|192\.168|169\.254|172\.(1[6-9]|2[0-9]|3[01]))\.[0-9.]+$') AS public FROM h""",
    "question_seeds": f"WITH RECURSIVE {_SEED_NAMES}, q AS (SELECT item_id AS query_id, text FROM benchmark), {SEEDED} SELECT * FROM seeded",
    "source_language": rf"""WITH {SOURCES}, words AS (SELECT source_id, language, ' ' || w || ' ' AS w, length(w) AS l FROM (SELECT source_id, language, unnest(string_split_regex(lower(text), '[^\p{{L}}]+')) AS w FROM src) WHERE w <> ''),
grams AS (SELECT source_id, language, substring(w, i, 3) AS gram, count(*) AS n FROM (SELECT *, unnest(range(1, l + 1)) AS i FROM words) GROUP BY ALL),
known AS (SELECT language, gram, 301 - row_number() OVER (PARTITION BY language ORDER BY sum(n) DESC, gram) AS weight FROM grams WHERE source_id % 2 = 0 AND language IS NOT NULL GROUP BY language, gram QUALIFY weight > 0),
scores AS (SELECT source_id, k.language, sum(n * weight) AS score FROM grams g JOIN known k USING (gram) GROUP BY ALL), size AS (SELECT source_id, sum(n) AS size FROM grams GROUP BY source_id),
best AS (SELECT *, lead(score) OVER w AS second FROM scores WINDOW w AS (PARTITION BY source_id ORDER BY score DESC, language) QUALIFY row_number() OVER w = 1)
SELECT s.source_id, b.language FROM src s LEFT JOIN (SELECT source_id, language FROM best JOIN size USING (source_id) WHERE size >= 20 AND score * 100 >= coalesce(second, 0) * 115) b USING (source_id)""",
    "mention_spans": rf"""WITH RECURSIVE {SOURCES}, n AS (SELECT item_id AS node_id, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) AS name FROM benchmark UNION ALL SELECT item_id + 1000000, split_part(text, ' ', 3) FROM benchmark),
c AS (SELECT source_id AS chunk_id, text, lower(text) AS low FROM src WHERE source_id % 5 <> 0), found AS (
    SELECT node_id, lower(name) AS name, length(name) AS size, chunk_id, low, text, CAST(strpos(low, lower(name)) AS BIGINT) AS p, 0::BIGINT AS past FROM n JOIN c ON contains(low, lower(name)) WHERE regexp_matches(name, '[\p{{L}}\p{{M}}\p{{N}}]')
), walk AS (
    SELECT *, NOT regexp_matches(CASE WHEN p > 1 THEN substring(low, p - 1, 1) ELSE ' ' END, '[\p{{L}}\p{{N}}]') AND NOT regexp_matches(substring(low, p + size, 1), '[\p{{L}}\p{{N}}]') AS free FROM found
    UNION ALL
    SELECT node_id, name, size, chunk_id, low, text, q AS p, past, NOT regexp_matches(CASE WHEN q > 1 THEN substring(low, q - 1, 1) ELSE ' ' END, '[\p{{L}}\p{{N}}]') AND NOT regexp_matches(substring(low, q + size, 1), '[\p{{L}}\p{{N}}]')
    FROM (SELECT node_id, name, size, chunk_id, low, text, past, (CASE WHEN free THEN p + size ELSE p + 1 END) - 1 + nullif(strpos(substring(low, CASE WHEN free THEN p + size ELSE p + 1 END), name), 0) AS q FROM walk) WHERE q IS NOT NULL
) SELECT node_id, chunk_id, p - 1 AS start, p - 1 + size AS stop, substring(text, p, size) AS said FROM walk WHERE free""",
    "mention_detection": rf"""WITH {SOURCES}, n AS (SELECT item_id AS node_id, array_to_string({terms("split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)")}, ' ') AS gram FROM benchmark),
t AS (SELECT source_id AS chunk_id, {terms("text")} AS t FROM src), w AS (SELECT chunk_id, t, unnest(range(len(t))) AS start FROM t),
g AS (SELECT chunk_id, start, unnest([1, 2, 3, 4, 5]) AS width, t FROM w), s AS (SELECT chunk_id, start, width, array_to_string(t[start + 1:start + width], ' ') AS gram FROM g WHERE start + width <= len(t))
SELECT node_id, chunk_id, start, width FROM s JOIN n USING (gram) WHERE gram <> ''""",
    "page_headings": """WITH c AS (SELECT l_orderkey AS page, round(l_quantity) AS size, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT page, size AS modal_size FROM c QUALIFY row_number() OVER (PARTITION BY page ORDER BY n DESC, size) = 1)
SELECT page, l_linenumber AS seg_no, modal_size, l_quantity >= 1.2 * modal_size AND length(l_returnflag) <= 120 AS heading FROM lineitem JOIN m ON page = l_orderkey""",
    "notes_export": "SELECT conv_id AS notebook_id, '# NOTES' || chr(10) || chr(10) || string_agg('- ' || text, chr(10) || chr(10) ORDER BY role <> 'user', turn) AS markdown FROM conversations GROUP BY conv_id",
    "structural_section": rf"""WITH {SOURCES}, {_BLOCKS}, h AS (SELECT source_id, block_no AS pos, length(text) % 3 + 1 AS level, list_contains(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), 'the') AS has FROM blocks),
x AS (SELECT *, bool_or(has) OVER w AS named, min(level) OVER w AS top FROM h WINDOW w AS (PARTITION BY source_id)), y AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY pos) AS n FROM x WHERE CASE WHEN named THEN has ELSE level = top END)
SELECT source_id, pos, level FROM y WHERE n = 2""",
    "json_objects": "SELECT event_id, props AS json FROM events",
}
