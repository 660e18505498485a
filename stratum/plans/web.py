"""The main content of the crawled pages, as a registered query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratum.operators import pages
from stratum.sources.tables import load, spread


def main_content(spark: SparkSession, d: str) -> DataFrame:
    return pages.main_content(spread(load(spark, d, "pages")))


QUERIES = {f.__name__: f for f in (main_content,)}


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _names(*tags: str) -> str:
    return ", ".join(f"'{t}'" for t in tags)


def _text(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))"


def _words(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN 0 ELSE length({x}) - length(replace({x}, ' ', '')) + 1 END"


#: Character references that the pages hold; the old ones count without their semicolon too, as in titles that were cut.
_REFERENCES = "text"
for _name, _sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("#x27", "''"), ("amp", "&")):
    _REFERENCES = f"regexp_replace({_REFERENCES}, '&{_name};?', '{_sign}', 'g')"
_HEADS = range(1, 7)

ORACLES = {
    # an element's end is the first row after it that leaves its depth
    "main_content": rf"""WITH m AS (SELECT page_id, string_split('body' || chr(2) || regexp_replace(regexp_replace(regexp_replace(html, {_q(pages.DROPPED)}, ' ', 'g'), {_q(pages.SPACES)}, ' ', 'g'), {_q(pages.TAGS)}, chr(1) || '\1' || chr(2), 'g'), chr(1)) AS segs FROM pages
), p AS (SELECT page_id, i AS seg_no, split_part(segs[i + 1], chr(2), 1) AS head, split_part(segs[i + 1], chr(2), 2) AS body FROM (SELECT page_id, segs, unnest(range(len(segs))) AS i FROM m)
), t AS (SELECT page_id, seg_no, lower(regexp_extract(head, '^/?([A-Za-z0-9]+)', 1)) AS tag, starts_with(head, '/') AS shut, regexp_matches(head, {_q(pages.HINTED)}) AS hinted, {_text("body")} AS text, {_text(f"array_to_string(regexp_extract_all(body, {_q(pages.LINKS)}, 1), ' ')")} AS linked FROM p
), s AS (SELECT *, {_words("text")} AS n_words, {_words("linked")} AS n_linked, sum(CASE WHEN shut THEN -1 ELSE 1 END) OVER (PARTITION BY page_id, tag ORDER BY seg_no) AS after FROM t
), o AS (SELECT page_id, tag, seg_no, after FROM s WHERE NOT shut AND (tag IN ({_names(*pages.ASIDES)}) OR hinted AND tag IN ({_names(*pages.CONTAINERS)}))
), e AS (SELECT o.page_id, o.seg_no, min(k.seg_no) AS ends FROM o LEFT JOIN s k ON o.page_id = k.page_id AND o.tag = k.tag AND k.seg_no > o.seg_no AND k.after < o.after GROUP BY ALL
), c AS (SELECT s.page_id, s.seg_no, any_value(s.tag) AS tag, any_value(s.shut) AS shut, any_value(s.text) AS text, any_value(s.n_words) AS n_words, any_value(s.n_linked) AS n_linked, count(e.seg_no) AS aside FROM s LEFT JOIN e ON s.page_id = e.page_id AND e.seg_no <= s.seg_no AND (e.ends IS NULL OR s.seg_no < e.ends) WHERE s.text <> '' GROUP BY s.page_id, s.seg_no
), g AS (SELECT *, NOT shut AND regexp_matches(tag, '^h[1-6]$') AS head, CASE WHEN aside > 0 OR {pages.ONE_LINKED_IN} * n_linked > n_words THEN false WHEN NOT (NOT shut AND regexp_matches(tag, '^h[1-6]$')) AND n_words >= {pages.LEAST_WORDS} THEN true END AS good FROM c
), n AS (SELECT *, last_value(good IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier, first_value(good IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY seg_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM g
), j AS (SELECT *, CASE WHEN good IS NOT NULL THEN good WHEN head THEN coalesce(later, false) WHEN regexp_matches(text, {_q(pages.STOPS)}) THEN coalesce(earlier, false) OR coalesce(later, false) ELSE coalesce(earlier, later, false) AND coalesce(later, earlier, false) END AS stays FROM n
), r AS (SELECT page_id, seg_no, CASE WHEN shut THEN 'p' ELSE tag END AS tag, text, CASE WHEN stays THEN 2 WHEN aside = 0 THEN 1 ELSE 0 END AS rank FROM j
), b AS (SELECT page_id, seg_no, tag, trim(regexp_replace({_REFERENCES}, '\s+', ' ', 'g')) AS text FROM r QUALIFY rank = max(rank) OVER (PARTITION BY page_id)
), h AS (SELECT *, {", ".join(f"last_value(CASE WHEN tag = 'h{n}' THEN seg_no END IGNORE NULLS) OVER w AS n{n}, last_value(CASE WHEN tag = 'h{n}' THEN text END IGNORE NULLS) OVER w AS t{n}" for n in _HEADS)} FROM b WHERE text <> '' WINDOW w AS (PARTITION BY page_id ORDER BY seg_no ROWS UNBOUNDED PRECEDING))
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY seg_no) - 1 AS INTEGER) AS block_no,
    CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN 'heading' WHEN tag IN ('li', 'dt', 'dd') THEN 'list_item' WHEN tag IN ('tr', 'td', 'th') THEN 'table' WHEN tag = 'pre' THEN 'code' ELSE 'paragraph' END AS block_type,
    array_to_string(list_filter([{", ".join(f"CASE WHEN n{n} > greatest(-1{''.join(f', coalesce(n{m}, -1)' for m in range(1, n))}) THEN t{n} END" for n in _HEADS)}], lambda x: x IS NOT NULL), ' > ') AS section_path,
    text, CAST(coalesce(sum(strlen(text) + 2) OVER (PARTITION BY page_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_start FROM h""",
}
