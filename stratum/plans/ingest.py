"""Extraction and indexing of raw sources, as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.operators import catalog, enrich
from stratum.plans.common import SOURCES
from stratum.sources import extract
from stratum.sources.tables import load, sources


def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    return extract.blocks(load(spark, d, "pages").select(F.col("page_id").alias("source_id"), F.lit("html").alias("kind"), F.col("html").alias("raw")))


def text_blocks(spark: SparkSession, d: str) -> DataFrame:
    return extract.blocks(load(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.lit("text").alias("kind"), F.col("text").alias("raw")))


def markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    return extract.blocks(load(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.lit("markdown").alias("kind"), F.col("text").alias("raw")))


def jsonl_blocks(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as one JSON-lines source."""
    e = load(spark, d, "events").groupBy(F.col("user_id").alias("source_id")).agg(F.array_sort(F.collect_list(F.struct("event_id", "props"))).alias("e"))
    return extract.blocks(e.select("source_id", F.lit("jsonl").alias("kind"), F.array_join(F.transform("e", lambda x: x["props"]), "\n").alias("raw"))).select("source_id", "block_no", "text")


def csv_blocks(spark: SparkSession, d: str) -> DataFrame:
    """A nation's suppliers as one CSV source."""
    s = load(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("source_id")).agg(F.array_sort(F.collect_list(F.concat_ws(",", F.col("s_suppkey"), F.col("s_name")))).alias("r"))
    return extract.blocks(s.select("source_id", F.lit("csv").alias("kind"), F.concat(F.lit("Key,Name\n"), F.array_join("r", "\n")).alias("raw"))).select("source_id", "block_no", "text", "anchor")


def extension_kinds(spark: SparkSession, d: str) -> DataFrame:
    ext = F.element_at(F.array(*(F.lit(x) for x in ("TXT", "md", "JSON", "csv", "exe"))), (F.col("page_id") % 5 + 1).cast("int"))
    return load(spark, d, "pages").select("page_id", extract.kind_of(ext).alias("kind"))


def eligible_sources(spark: SparkSession, d: str) -> DataFrame:
    s = sources(spark, d).withColumn("status", F.when(F.col("source_id") % 5 == 0, "error").otherwise("indexed")).withColumn("enrichment_status", F.when(F.col("source_id") % 3 == 0, F.lit(None)).when(F.col("source_id") % 3 == 1, "pending").otherwise("enriched"))
    return enrich.eligible(s).select("source_id")


def uncached_jobs(spark: SparkSession, d: str) -> DataFrame:
    s = sources(spark, d).select("source_id", F.concat_ws("|", "raw_content_hash", F.lit("v1")).alias("cache_key"))
    return enrich.uncached(s, s.where("source_id % 4 = 0")).select("source_id")


def partition_replace(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit("old").alias("version"))
    new = load(spark, d, "lineitem").where("l_orderkey % 10 = 0 and l_linenumber = 1").select("l_orderkey", "l_linenumber", F.lit("new").alias("version"))
    return catalog.replace_partition(li, new, "l_orderkey").groupBy("version").agg(F.count(F.lit(1)).alias("n"))


def generation_flip(spark: SparkSession, d: str) -> DataFrame:
    status = F.element_at(F.array(F.lit("active"), F.lit("building"), F.lit("stale")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    registry = load(spark, d, "nation").select((F.col("n_regionkey")).cast("string").alias("coordinate"), F.col("n_nationkey").alias("generation"), status.alias("status"))
    return catalog.flip(registry, "2")


def coref_substitute(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages whose first word and a later span are rewritten."""
    b = load(spark, d, "benchmark")
    first = F.substring_index("text", " ", 1)
    subs = F.array(F.struct(F.lit(0).alias("start"), F.length(first).alias("stop"), first.alias("mention"), F.lit("ENTITY").alias("antecedent")), F.struct(F.lit(1).alias("start"), (F.length(first) + 3).alias("stop"), F.lit("wrong").alias("mention"), F.lit("X").alias("antecedent")))
    return b.select("item_id", enrich.substituted(F.col("text"), subs).alias("text"))


QUERIES = {f.__name__: f for f in (page_blocks, text_blocks, markdown_blocks, jsonl_blocks, csv_blocks, extension_kinds, eligible_sources, uncached_jobs, partition_replace, generation_flip, coref_substitute)}

ORACLES = {
    "jsonl_blocks": "WITH e AS (SELECT user_id, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events) SELECT user_id AS source_id, CAST(n AS INTEGER) AS block_no, '/' || n || '/k: ' || json_extract_string(props, '$.k') AS text FROM e",
    "csv_blocks": "WITH s AS (SELECT CAST(s_nationkey AS BIGINT) AS source_id, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey || ',' || s_name) AS n FROM supplier) SELECT source_id, CAST(n - 1 AS INTEGER) AS block_no, 'Key: ' || s_suppkey || '; Name: ' || s_name AS text, '/row[' || n || ']' AS anchor FROM s",
    "extension_kinds": "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'markdown' WHEN 2 THEN 'json' WHEN 3 THEN 'csv' END AS kind FROM pages",
    "eligible_sources": f"WITH {SOURCES} SELECT source_id FROM alive WHERE source_id % 5 <> 0 AND source_id % 3 <> 2",
    "uncached_jobs": f"WITH {SOURCES} SELECT source_id FROM src a WHERE raw_content_hash NOT IN (SELECT raw_content_hash FROM src WHERE source_id % 4 = 0)",
    "partition_replace": "SELECT 'old' AS version, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 10 = 0 AND l_linenumber = 1) UNION ALL SELECT 'new', count(*) FROM lineitem WHERE l_orderkey % 10 = 0 AND l_linenumber = 1",
    "generation_flip": """WITH r AS (SELECT CAST(n_regionkey AS VARCHAR) AS coordinate, n_nationkey AS generation, CASE n_nationkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'building' ELSE 'stale' END AS status FROM nation), b AS (SELECT count(*) > 0 AS ready FROM r WHERE coordinate = '2' AND status = 'building')
SELECT coordinate, generation, CASE WHEN coordinate = '2' AND ready AND status = 'active' THEN 'stale' WHEN coordinate = '2' AND ready AND status = 'building' THEN 'active' ELSE status END AS status FROM r, b""",
    "coref_substitute": "SELECT item_id, 'ENTITY' || substr(text, length(split_part(text, ' ', 1)) + 1) AS text FROM benchmark",
}
