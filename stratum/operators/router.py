"""Context under a token budget: tiers, auto-merge, trimming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the tier caps.
RESERVED_OUT, OVERHEAD, MARGIN, FRACTION, BANDS, UNKNOWN = 2048, 512, 256, 0.65, ((8_192, 4_000), (32_768, 20_000), (None, 48_000)), (4_000, 16_000)


def tier_caps(context: int, reserved: int = 0) -> tuple[int, int]:
    """Caps of tier 1 and 2 for a model's context size; reserved history takes half of it at most."""
    if context <= 0:
        return UNKNOWN
    usable = max(0, context - RESERVED_OUT - OVERHEAD)
    usable -= min(reserved, usable // 2)
    band = next(cap for limit, cap in BANDS if limit is None or context <= limit)
    return min(int(usable * FRACTION), band), usable


def tier_decision(sources: DataFrame, cap: int) -> DataFrame:
    """notebook_id, total_tokens, oversized, tier over (notebook_id, source_id, tokens): whole corpora that fit are tier 1."""
    fit = sources.groupBy("notebook_id").agg(F.sum("tokens").alias("total_tokens"), F.max(F.when(F.col("tokens") > cap, 1).otherwise(0)).alias("oversized"))
    return fit.withColumn("tier", F.when((F.col("total_tokens") <= cap) & (F.col("oversized") == 0), 1).otherwise(2)).withColumn("near_cap", F.abs(F.col("total_tokens") - cap) <= MARGIN)


def budget_cut(units: DataFrame, cap: int, group: str, order: list, cost: str = "tokens") -> DataFrame:
    """The units of each group up to the first that overflows; the first always stays."""
    w = Window.partitionBy(group).orderBy(*order)
    run = units.withColumn("running", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(w) - 1)
    return run.where((F.col("running") <= cap) | (F.col("place") == 0))


def excerpts(chunks: DataFrame, each: int = 1200, total: int = 7000, most: int = 2) -> DataFrame:
    """notebook_id, source_id, parent_no, n_chars, place: what of a source's first chunks (notebook_id, source_id, parent_no, text) fits its share, up to the total of the notebook."""
    of = Window.partitionBy("source_id").orderBy("parent_no")
    x = chunks.select("notebook_id", "source_id", "parent_no", F.length("text").alias("n")).withColumn("nth", F.row_number().over(of)).where(F.col("nth") <= most)
    before = F.coalesce(F.sum("n").over(of.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("n_chars", F.least(F.col("n"), F.lit(each) - before)).where("n_chars > 0")
    return budget_cut(x, total, "notebook_id", ["source_id", "parent_no"], "n_chars").select("notebook_id", "source_id", "parent_no", "n_chars", "place")


def auto_merge(hits: DataFrame, children: DataFrame) -> DataFrame:
    """query_id, unit_id, merged, score: parents with half of their children among the hits, else the children.

    ``hits``: query_id, chunk_id, score; ``children``: chunk_id, parent_id. A
    merged parent takes its best child's score; chunks without parent stay.
    """
    total = children.where("parent_id is not null").groupBy("parent_id").agg(F.count(F.lit(1)).alias("total"))
    known = hits.join(children, "chunk_id")
    got = known.where("parent_id is not null").groupBy("query_id", "parent_id").agg(F.count(F.lit(1)).alias("got"), F.max("score").alias("best")).join(total, "parent_id")
    merging = got.where(F.col("got") * 2 >= F.col("total"))
    rest = known.join(merging.select("query_id", "parent_id"), ["query_id", "parent_id"], "left_anti")
    return merging.select("query_id", F.col("parent_id").alias("unit_id"), F.lit(True).alias("merged"), F.col("best").alias("score")).unionByName(rest.select("query_id", F.col("chunk_id").alias("unit_id"), F.lit(False).alias("merged"), "score"))


def document_order(units: DataFrame) -> DataFrame:
    """0-based order of the units of a query: by source, then level, then token start."""
    return units.withColumn("order_index", F.row_number().over(Window.partitionBy("query_id").orderBy("source_id", "level", "token_start", "unit_id")) - 1)


def nth_section(sections: DataFrame, noun: str, n: int) -> DataFrame:
    """Per source, the n-th section with the noun as a word of its title; without any such title, the n-th of the shallowest level."""
    has = F.array_contains(F.split(F.lower("title"), r"[^\p{L}\p{N}]+"), noun)
    w = Window.partitionBy("source_id")
    x = sections.withColumn("has", has.cast("int")).withColumn("any", F.max("has").over(w)).withColumn("top", F.min("level").over(w))
    x = x.where(F.when(F.col("any") == 1, F.col("has") == 1).otherwise(F.col("level") == F.col("top")))
    return x.withColumn("nth", F.row_number().over(w.orderBy("pos"))).where(F.col("nth") == n).drop("has", "any", "top", "nth")
