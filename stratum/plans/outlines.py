"""Structural maps of the documents, as a registered query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.operators import maps, structure
from stratum.plans.common import PARENTS, SOURCES
from stratum.sources.tables import sources


def structural_map(spark: SparkSession, d: str) -> DataFrame:
    """Windows of words as parts; one batch in seven can't be read, so some sources have no map."""
    parents = structure.parents(sources(spark, d))
    got = maps.structural_map(parents.select("source_id", F.col("parent_no").alias("part"), "text"), lambda b: maps.phrases(b.where("(source_id + part) % 7 <> 0")))
    said = F.array_join(F.transform("definitions", lambda x: F.concat(x["term"], F.lit("="), x["text"])), "|")
    return got.select("source_id", "status", F.array_join("entities", ",").alias("entities"), said.alias("definitions"), F.array_join("dates", ",").alias("dates"), "summary")


QUERIES = {f.__name__: f for f in (structural_map,)}


def _union(field: str, bound: int) -> str:
    return f"list_filter({field}, lambda x, i: list_position({field}, x) = i)[1:{bound}]"


ORACLES = {
    # merging is associative under the bounds, so all maps of a source are merged at once
    "structural_map": rf"""WITH RECURSIVE {SOURCES}, {PARENTS}, sized AS (SELECT source_id, parent_no, text, strlen(text) AS n FROM parents
), walk AS (
    SELECT source_id, parent_no, 0 AS batch, n AS used FROM sized WHERE parent_no = 0
    UNION ALL
    SELECT s.source_id, s.parent_no, CASE WHEN used + 2 + n > {maps.BATCH_BYTES} THEN batch + 1 ELSE batch END, CASE WHEN used + 2 + n > {maps.BATCH_BYTES} THEN n ELSE used + 2 + n END
    FROM walk w JOIN sized s ON s.source_id = w.source_id AND s.parent_no = w.parent_no + 1
), asked AS (SELECT source_id, batch, string_agg(text, chr(10) || chr(10) ORDER BY parent_no) AS text FROM walk JOIN sized USING (source_id, parent_no) GROUP BY ALL
), found AS (
    SELECT source_id, batch, regexp_extract_all(text, '{maps.NAMES}') AS e, regexp_extract_all(text, '{maps.DATES}') AS t, trim(regexp_extract(text, '{maps.FIRST}')) AS s,
        list_transform(regexp_extract_all(text, '{maps.DEFINED}', 1), lambda x, i: x || '=' || substr(trim(regexp_extract_all(text, '{maps.DEFINED}', 2)[i]), 1, {maps.FIELD_CHARS})) AS f
    FROM asked WHERE (source_id + batch) % 7 <> 0
), per AS (
    SELECT source_id, flatten(list(e ORDER BY batch)) AS e, flatten(list(t ORDER BY batch)) AS t, flatten(list(f ORDER BY batch)) AS f, array_to_string(list_filter(list(substr(s, 1, {maps.SUMMARY_CHARS}) ORDER BY batch), lambda x: x <> ''), ' ') AS s FROM found GROUP BY source_id
), mapped AS (SELECT source_id, array_to_string({_union("e", maps.MOST_ITEMS)}, ',') AS entities, array_to_string(f[1:{maps.MOST_ITEMS}], '|') AS definitions, array_to_string({_union("t", maps.MOST_ITEMS)}, ',') AS dates, substr(s, 1, {maps.SUMMARY_CHARS}) AS summary FROM per)
SELECT source_id, CASE WHEN m.source_id IS NULL THEN 'fallback' ELSE 'ok' END AS status, coalesce(entities, '') AS entities, coalesce(definitions, '') AS definitions, coalesce(dates, '') AS dates, coalesce(summary, '') AS summary
FROM (SELECT DISTINCT source_id FROM parents) LEFT JOIN mapped m USING (source_id)""",
}
