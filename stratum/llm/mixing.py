"""Mixing sources to target weights.

Words are summed by source, targets follow the weights, and every document is
emitted floor(rate) times plus once more with a probability of the fraction,
decided by a hash of its id. The rate of a source is its target over its size.

Null or empty texts have size 0 and are taken with 0 words. A null source is a
source of its own, last in order. Rows that repeat an id share its draw, so
reruns and any partitioning agree. A source without words has target 0 and an
empty table gives an empty table. Columns of the input pass through
``mix``; the names it adds are chosen so that none is overwritten. A text of any
length is counted in its row. The windows over sources are one task with a row a
source, which fits millions of sources, not one a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.llm._common import WORD, free_name, stage, unit

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2.0, 20


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """From (source, source_size), the target of each source.

    Water-filling in closed form: by rising ratio of limit to weight, the
    sources before the level are at their limit and the others share what is
    left by weight. The frame has one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("limit") / F.col("weight"))
    every = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.withColumn("all_size", F.sum("source_size").over(every)).withColumn("all_weight", F.sum("weight").over(every)).withColumn("full", F.coalesce(F.sum("limit").over(before), F.lit(0.0))).withColumn("full_weight", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = level.withColumn("level", (F.col("all_size") * F.lit(share) - F.col("full")) / (F.col("all_weight") - F.col("full_weight")))
    # the first source whose limit isn't below the level sets it for itself and all after it
    free = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(every)
    out = level.withColumn("free", free["level"])
    return out.select("source", "source_size", F.when(F.col("free").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("weight") * F.col("free"))).alias("target"))


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, size, source_size, target, copies."""
    sized = stage(docs.select("doc_id", "source", words(F.col("text")).alias("size")))
    goal = stage(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    goal = goal.select(F.col("source").alias("of"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    return sized.join(goal, F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", rate).select("doc_id", "source", "size", "source_size", "target", (F.floor("rate") + (unit(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate")).cast("long")).alias("copies"))


def mixed(docs: DataFrame, **kw) -> DataFrame:
    """The report of the mix: per row of ``docs`` its size, its source's size and target, and the words taken."""
    return copies(docs, **kw).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The mixed documents themselves: each row repeated as often as it is taken, with the columns of ``docs``."""
    n, of, rate = (free_name(docs, x) for x in ("mix_copies", "mix_of", "mix_rate"))
    totals = docs.groupBy("source").agg(F.sum(words(F.col("text"))).alias("source_size"))
    goal = stage(targets(totals, weights, share, most)).select(F.col("source").alias(of), F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0)).alias(rate))
    out = docs.join(goal, docs["source"].eqNullSafe(F.col(of))).withColumn(n, (F.floor(rate) + (unit(F.col("doc_id"), seed) < F.col(rate) - F.floor(rate)).cast("long")).cast("int"))
    return out.where(F.col(n) > 0).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)
