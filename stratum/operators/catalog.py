"""Notebooks and sources: counts, dedup, lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRANSIENT = ("parsing", "embedding")


def source_counts(notebooks: DataFrame, sources: DataFrame) -> DataFrame:
    """notebook_id, n_live, n_all; notebooks without sources count 0. One pass over the sources."""
    per = sources.groupBy("notebook_id").agg(F.sum((~F.col("trashed")).cast("int")).alias("l"), F.count(F.lit(1)).alias("a"))
    return notebooks.join(per, "notebook_id", "left").select("notebook_id", F.coalesce("l", F.lit(0)).alias("n_live"), F.coalesce("a", F.lit(0)).alias("n_all"))


def add_sources(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """notebook_id, raw_content_hash, source_id, winner_id, was_existing: the first live row of a hash wins.

    Winners are an aggregate of the hashes alone, so texts don't shuffle.
    """
    both = existing.where("not trashed").select("notebook_id", "raw_content_hash", "source_id", F.lit(0).alias("new")).unionByName(incoming.select("notebook_id", "raw_content_hash", "source_id", F.lit(1).alias("new")))
    winner = both.groupBy("notebook_id", "raw_content_hash").agg(F.min(F.struct("new", "source_id")).alias("w"))
    key = ["notebook_id", "raw_content_hash"]
    return incoming.select(*key, "source_id").join(winner, key).select(*key, "source_id", F.col("w.source_id").alias("winner_id"), ((F.col("w.new") == 0) | (F.col("w.source_id") != F.col("source_id"))).alias("was_existing"))


def restorable(sources: DataFrame) -> DataFrame:
    """Trashed sources whose content no other live source of the notebook has."""
    alive = sources.where("not trashed").select("notebook_id", "raw_content_hash").distinct()
    return sources.where("trashed").join(alive, ["notebook_id", "raw_content_hash"], "left_anti")


def recovered(sources: DataFrame) -> DataFrame:
    """Statuses after a crash: what was under way failed, enrichment under way is pending again."""
    return sources.withColumn("status", F.when(F.col("status").isin(*TRANSIENT), "error").otherwise(F.col("status"))).withColumn("enrichment_status", F.when(F.col("enrichment_status") == "enriching", "pending").otherwise(F.col("enrichment_status")))


def set_hash(sources: DataFrame) -> DataFrame:
    """notebook_id, set_hash: sha256 over ids and hashes in order of the id."""
    item = F.concat(F.col("source_id").cast("string"), F.lit("\0"), F.coalesce("raw_content_hash", F.lit("")), F.lit("\0"))
    per = sources.groupBy("notebook_id").agg(F.array_sort(F.collect_list(F.struct(F.col("source_id").cast("string").alias("k"), item.alias("v")))).alias("items"))
    return per.select("notebook_id", F.sha2(F.concat_ws("", F.transform("items", lambda x: x["v"])), 256).alias("set_hash"))


def cascade(keep: DataFrame, dependent: DataFrame, key: str) -> DataFrame:
    """Rows of a dependent table whose owner is still there."""
    return dependent.join(keep.select(key), key, "left_semi")


def replace_partition(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of ``existing`` but those of the keys that ``new`` brings, and ``new``."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert_latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The latest row of each key."""
    latest = rows.groupBy(key).agg(F.max(F.struct(version, *[c for c in rows.columns if c not in (key, version)])).alias("r"))
    return latest.select(key, "r.*").select(*rows.columns)


def flip(registry: DataFrame, coordinate: str) -> DataFrame:
    """Registry after a coordinate's building generation becomes active; unchanged where none is building."""
    here = F.col("coordinate") == coordinate
    ready = registry.where(here & (F.col("status") == "building")).select(F.lit(True).alias("ready")).limit(1)
    out = registry.join(F.broadcast(ready), F.lit(True), "left")
    status = F.when(here & F.col("ready") & (F.col("status") == "active"), "stale").when(here & F.col("ready") & (F.col("status") == "building"), "active").otherwise(F.col("status"))
    return out.withColumn("status", status).drop("ready")
