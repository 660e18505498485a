"""The registered queries of the ten operators, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratum.llm import bpe, chat, embed_dedup, exact_dedup, filter_audit, langid, line_dedup, mixing, ngram_join, pii, ranked_search, token_store, toxicity
from stratum.llm._common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.report(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_dedup(table(spark, sf_dir, "embeddings"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], turns.schema)
    return chat.report(turns.unionByName(planted))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_store, op2_toxicity, op3_ngram_join, op4_embed_dedup, op5_chat, op6_line_dedup, op7_mixing, op8_exact_dedup, op9_langid, op10_bpe, op11_pii, op12_ranked_search, op13_filter_audit)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op3_ngram_join": r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words
), sizes AS (SELECT doc_id, len(s) AS n FROM sets), tokens AS (
    SELECT doc_id, n, t FROM (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets)
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id != b.doc_id
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, n AS n_shingles, min(r.b) AS component_id FROM sizes s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, n""",
    "op4_embed_dedup": """
WITH RECURSIVE v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), u AS (
    SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id != b.vec_id AND a.norm > 0 AND b.norm > 0
    WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT r.a AS vec_id, coalesce(any_value(c.n), 0) AS n_links, min(r.b) AS component_id, r.a = min(r.b) AS kept
FROM reach r LEFT JOIN counts c ON c.a = r.a GROUP BY r.a""",
    "op5_chat": """
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), moves AS (
    SELECT *, lag(role) OVER w AS before, row_number() OVER w AS place,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end
    FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY place)) AS loss_sha256,
    CAST(7 + sum(length(text) + 4 * (length(text) - length(replace(text, '&', ''))) + 3 * (length(text) - length(replace(text, '<', '')))
        + 5 * (length(text) - length(replace(replace(text, '[', ''), ']', '')))
        + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11 ELSE 11 END) AS BIGINT) AS formatted_chars,
    bool_and(CASE WHEN place = 1 THEN role IN ('system', 'user') WHEN role = 'user' THEN before IN ('assistant', 'system') AND (before = 'assistant' OR place = 2)
        WHEN role = 'assistant' THEN before = 'user' ELSE false END) AND bool_or(from_end = 1 AND role = 'assistant') AS valid
FROM moves GROUP BY conv_id""",
    "op6_line_dedup": """
WITH pieces AS (
    SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents
), raw AS (
    SELECT doc_id, unnest(parts) AS whole, unnest(range(len(parts))) AS line_no FROM pieces
), lines AS (
    SELECT doc_id, line_no, trim(whole, ' ') AS line FROM raw WHERE trim(whole, ' ') != ''
), firsts AS (
    SELECT line, min(doc_id * 1000000 + line_no) AS place, length(line) AS n FROM lines GROUP BY line
), near AS (
    SELECT DISTINCT a.line FROM firsts a JOIN firsts b ON left(a.line, 8) = left(b.line, 8) AND a.n BETWEEN b.n - 1 AND b.n + 1
    WHERE b.place < a.place AND a.n >= 16 AND b.n >= 16 AND left(a.line, least(a.n, b.n) // 2) = left(b.line, least(a.n, b.n) // 2) AND levenshtein(a.line, b.line) <= 1
    UNION SELECT DISTINCT a.line FROM firsts a JOIN firsts b ON right(a.line, 8) = right(b.line, 8) AND a.n BETWEEN b.n - 1 AND b.n + 1
    WHERE b.place < a.place AND a.n >= 16 AND b.n >= 16 AND right(a.line, least(a.n, b.n) // 2) = right(b.line, least(a.n, b.n) // 2) AND levenshtein(a.line, b.line) <= 1
), gone AS (
    SELECT l.doc_id, l.line_no FROM lines l JOIN firsts f USING (line) LEFT JOIN near n USING (line)
    WHERE f.place != l.doc_id * 1000000 + l.line_no OR n.line IS NOT NULL
), kept AS (
    SELECT r.doc_id, string_agg(r.whole, chr(10) ORDER BY r.line_no) AS text FROM raw r ANTI JOIN gone g ON r.doc_id = g.doc_id AND r.line_no = g.line_no GROUP BY r.doc_id
), counts AS (
    SELECT d.doc_id, count(l.line_no) AS n_lines, count(l.line_no) - count(g.line_no) AS n_kept FROM documents d LEFT JOIN lines l ON d.doc_id = l.doc_id
    LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line_no = g.line_no GROUP BY d.doc_id
)
SELECT c.doc_id, n_lines, n_kept, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM counts c JOIN documents d ON c.doc_id = d.doc_id LEFT JOIN kept k ON c.doc_id = k.doc_id""",
    "op7_mixing": r"""
WITH sized AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), totals AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight
    FROM sized GROUP BY source
), ranked AS (
    SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM totals
), levels AS (
    SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level,
        row_number() OVER (ORDER BY ratio, source NULLS LAST) AS place
    FROM ranked WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goal AS (
    SELECT source, source_size, CASE WHEN f.level IS NULL THEN cap ELSE least(cap, weight * f.level) END AS target
    FROM levels LEFT JOIN (SELECT level FROM levels WHERE ratio >= level ORDER BY place LIMIT 1) f ON true
), rated AS (
    SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN least(2.0::DOUBLE, target / source_size) ELSE 0 END AS rate,
        ('0x' || substr(md5('20-' || doc_id), 1, 13))::BIGINT * (1.0::DOUBLE / 4503599627370496) AS draw
    FROM sized JOIN goal ON sized.source IS NOT DISTINCT FROM goal.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated""",
    "op8_exact_dedup": f"""
WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents), k AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM k""",
    "op12_ranked_search": r"""
WITH tokens AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), tfs AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY doc_id, term), sizes AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id), totals AS (
    SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes
), weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tfs, totals GROUP BY term, n_docs
), asked AS (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scored AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN sizes USING (doc_id), totals GROUP BY item_id, doc_id
), placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10""",
    "op13_filter_audit": r"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), said AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), judged AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
        || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
    FROM d LEFT JOIN said ON d.doc_id = said.doc_id
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a JOIN letters b ON a.x != b.x JOIN letters c ON c.x NOT IN (a.x, b.x)
    JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), steps AS (
    SELECT filter_order, step, substr(filter_order, step, 1) AS filter, left(filter_order, step - 1) AS earlier FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)
), met AS (
    SELECT part, good, toxic, filter_order, step, filter, fails = filter AS alone, contains(fails, filter) AS fails, length(translate(earlier, fails, '')) < step - 1 AS gone FROM judged, steps
), counted AS (
    SELECT part, filter_order, step, filter, count(*) FILTER (NOT fails AND NOT gone) AS kept, count(*) FILTER (fails AND NOT gone) AS removed, count(*) FILTER (fails AND gone) AS redundant,
        count(*) FILTER (alone) AS unique_fails, CAST(coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS BIGINT) AS toxic_lost
    FROM met GROUP BY part, filter_order, step, filter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM counted""",
}
