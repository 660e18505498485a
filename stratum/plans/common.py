"""SQL that several checks start from."""

from __future__ import annotations

SOURCES = """src AS (
    SELECT doc_id AS source_id, source AS notebook_id, doc_id % 7 <> 0 AS selected, doc_id % 11 = 0 AS trashed, sha256(text) AS raw_content_hash, lang AS language, text FROM documents
), alive AS (SELECT * FROM src WHERE selected AND NOT trashed)"""

PARENTS = r"""word_lists AS (
    SELECT source_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM src WHERE text IS NOT NULL
), numbered AS (
    SELECT source_id, w, unnest(range(0, CAST(ceil(len(w) / 512) AS BIGINT))) AS parent_no FROM word_lists WHERE len(w) > 0
), parents AS (
    SELECT source_id, parent_no, array_to_string(w[parent_no * 512 + 1:parent_no * 512 + 512], ' ') AS text,
        CAST(least(len(w) - parent_no * 512, 512) AS INTEGER) AS n_tokens, parent_no * 512 AS token_start, least(len(w), (parent_no + 1) * 512) AS token_end
    FROM numbered
)"""


def terms(column: str) -> str:
    return rf"list_filter(string_split_regex(strip_accents(lower({column})), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda x: x <> '')"


def query_terms(column: str) -> str:
    return rf"list_distinct(list_transform(list_filter(string_split_regex({column}, '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda x: x <> '' AND x NOT IN ('AND', 'OR', 'NOT', 'NEAR')), lambda x: strip_accents(lower(x))))"


def bm25(chunks: str, queries: str, every: bool, scope: str | None, k: int, own: bool = False) -> str:
    """CTEs that end in ``lexical`` (query_id, chunk_id, score, rank0); with ``own`` a query meets chunks of its notebook."""
    return f"""term_lists AS (SELECT chunk_id, {terms("text")} AS t FROM {chunks}
), totals AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM term_lists
), asked AS (SELECT query_id, {"notebook_id, " * own}len(q) AS n_terms, unnest(q) AS term FROM (SELECT query_id, {"notebook_id, " * own}{query_terms("text")} AS q FROM {queries})
), exploded AS (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM term_lists
), tfs AS (SELECT chunk_id, dl, term, count(*) AS tf FROM exploded WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term
), scored AS (
    SELECT query_id, chunk_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS exact
    FROM tfs JOIN dfs USING (term) JOIN asked USING (term) {f"JOIN (SELECT chunk_id, notebook_id FROM {chunks}) o USING (chunk_id, notebook_id)" if own else ""} CROSS JOIN totals {f"WHERE chunk_id IN (SELECT chunk_id FROM {scope})" if scope else ""}
    GROUP BY query_id, chunk_id, n_terms {"HAVING count(*) = n_terms" if every else ""}
), lexical AS (
    SELECT query_id, chunk_id, round(exact, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(exact, 12) DESC, chunk_id) - 1 AS rank0 FROM scored QUALIFY rank0 < {k}
)"""


def knn(vectors: str, queries: str, k: int, name: str = "dense", own: bool = False) -> str:
    """CTEs that end in ``name`` (query_id, chunk_id, score, rank0)."""
    return f"""{name}_scored AS (
    SELECT q.query_id, v.chunk_id, list_inner_product(q.vector, v.vector) / sqrt(list_inner_product(q.vector, q.vector) * list_inner_product(v.vector, v.vector)) AS exact
    FROM {queries} q JOIN {vectors} v ON {"q.notebook_id = v.notebook_id" if own else "true"}
), {name} AS (
    SELECT query_id, chunk_id, round(exact, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(exact, 12) DESC, chunk_id) - 1 AS rank0 FROM {name}_scored QUALIFY rank0 < {k}
)"""


VECTORS = "vecs AS (SELECT vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS vector, label AS kind FROM embeddings), asked_vecs AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS vector, label AS kind FROM embeddings WHERE vec_id % 20 = 0)"
