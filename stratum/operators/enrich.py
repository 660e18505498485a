"""Enrichment: relations, triples, coreference, document maps, what is embedded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the sampling of chunks for relations, and of the floor of a triple's confidence.
DENSITY, FRACTION, CAP, CONFIDENCE = 8, 0.1, 24, 0.5


def relation_sample(chunks: DataFrame, density: int = DENSITY, fraction: float = FRACTION, cap: int = CAP) -> DataFrame:
    """source_id, chunk_id, n_entities, place: a source's densest chunks, a tenth of them and no more than the cap."""
    dense = chunks.where(F.col("n_entities") >= density)
    w = Window.partitionBy("source_id")
    ranked = dense.withColumn("place", F.row_number().over(w.orderBy(F.desc("n_entities"), "chunk_id"))).withColumn("of", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("place") <= F.least(F.ceil(F.col("of") * fraction), F.lit(cap))).select("source_id", "chunk_id", "n_entities", "place")


def valid_triples(triples: DataFrame, chunks: DataFrame, nodes: DataFrame, aliases: DataFrame, vocabulary: DataFrame, floor: float = CONFIDENCE) -> DataFrame:
    """Triples (chunk_id, subject, predicate, object, confidence) as edges: sure enough, known chunk, ends and predicate, no loops."""
    t = triples.where((F.col("confidence") >= floor) & (F.col("confidence") <= 1)).join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    ends = nodes.select(F.lower("name").alias("name"), "node_id")
    t = t.withColumn("s", F.lower("subject")).withColumn("o", F.lower("object"))
    t = t.join(ends.select(F.col("name").alias("s"), F.col("node_id").alias("from_node")), "s").join(ends.select(F.col("name").alias("o"), F.col("node_id").alias("to_node")), "o").where("from_node != to_node")
    # the vocabulary and its aliases are a few dozen fixed rows
    t = t.withColumn("p", F.lower("predicate")).join(F.broadcast(aliases.select(F.col("alias").alias("p"), "canonical")), "p", "left").withColumn("relation", F.coalesce("canonical", "p"))
    return t.join(F.broadcast(vocabulary.select("relation")), "relation", "left_semi").select("chunk_id", "from_node", "relation", "to_node", "confidence")


def substituted(text: Column, substitutions: Column) -> Column:
    """Text with spans (start, stop, mention, antecedent) replaced from right to left; overlaps and spans that aren't the mention are skipped."""
    ordered = F.reverse(F.array_sort(substitutions))
    start = F.struct(text.alias("text"), F.lit(1 << 30).alias("limit"))

    def step(acc: Column, s: Column) -> Column:
        fits = (s["stop"] <= acc["limit"]) & (F.substring(acc["text"], s["start"] + 1, s["stop"] - s["start"]) == s["mention"])
        new = F.concat(F.substr(acc["text"], F.lit(1), s["start"]), s["antecedent"], F.substr(acc["text"], s["stop"] + 1, F.lit(1 << 30)))
        return F.struct(F.when(fits, new).otherwise(acc["text"]).alias("text"), F.when(fits, s["start"]).otherwise(acc["limit"]).alias("limit"))

    return F.aggregate(ordered, start, step, lambda acc: acc["text"])


def merged_map(parts: DataFrame) -> DataFrame:
    """source_id, entities, summary over (source_id, part, entities, summary): first-seen union and summaries in order."""
    per = parts.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("part", "entities", "summary"))).alias("p"))
    return per.select("source_id", F.array_distinct(F.flatten(F.transform("p", lambda x: x["entities"]))).alias("entities"), F.array_join(F.filter(F.transform("p", lambda x: x["summary"]), lambda s: s != ""), " ").alias("summary"))


def eligible(sources: DataFrame) -> DataFrame:
    return sources.where((F.col("status") == "indexed") & ~F.col("trashed") & F.col("selected") & (F.col("enrichment_status").isNull() | F.col("enrichment_status").isin("none", "pending", "failed")))


def uncached(jobs: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Jobs whose key hasn't been enriched yet."""
    return jobs.join(cache.select(key), key, "left_anti")
