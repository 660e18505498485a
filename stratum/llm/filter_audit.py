"""Filter interaction audit by a mask histogram.

Every document gets a five-bit mask of the filters that it fails, by native
expressions; the fifth, repeated text, comes from a grouping of texts (by
digest) that gives each its least id. Documents are then counted by part and
mask: at most 32 cells a part hold all that any order of the filters can do, so
the 120 orders are enumerated from the cells and no document is read again.

The filters fail a document with: A fewer than ``LEAST_WORDS`` words; B fewer
than half of its words distinct; C more than 2 % of its code points A-Z; D one
of the signs ``#$%&*|``; E a text that a smaller id has too, anywhere in the table.

A null text counts as empty, a null source as the part of the empty name. A row
with a null id has no smaller id and is none, so it never fails E nor makes
another fail it, and has no label. Rows that repeat an id count one by one; of
equal texts all rows of the least id pass E. A document with several labels is
good or toxic where any of them says so. An empty table gives an empty table.
Only doc_id, text and source are read, so further columns may have any name. A
text of any length that fits a row is judged in its row.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm._common import WORD, stage

#: Filters by name; the place is the bit of the mask.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 2, r"[#$%&*|]"
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def masked(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, part, digest of the text, and mask, the bits of the filters A to D that the text fails."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    d = d.select("doc_id", "part", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    fails = (n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > MOST_CAPITALS * F.length("text"), F.col("text").rlike(SIGNS))
    return d.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0)).alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: at most 32 rows a part."""
    rows = stage(masked(docs))
    # a table of the repeated texts alone: the join below is of two plain exchanges, of which Spark can split a hot text's
    least = stage(rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "least"))
    said = labels.groupBy("doc_id").agg(F.max(F.coalesce((F.col("quality") == 1).cast("long"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("long"), F.lit(0))).alias("toxic"))
    repeated = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    full = rows.join(least, "digest", "left").select("doc_id", "part", (F.col("mask") + F.when(repeated, 1 << 4).otherwise(0)).alias("mask"))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return full.join(said, "doc_id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), count("good"), count("toxic"))


def _total(of: str, value: str, holds) -> Column:
    return F.aggregate(of, F.lit(0).cast("long"), lambda a, c: a + F.when(holds(c["mask"]), c[value]).otherwise(F.lit(0).cast("long")))


def enumerated(found: DataFrame) -> DataFrame:
    """From the cells, one row for each part, order of the filters and step.

    A filter's Shapley total needs no sum over orders: of the 120, a document that
    fails k filters is removed by each of them in 120 / k.
    """
    every = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    steps = every.select("part", "cells", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit_of = lambda place: F.expr(f"shiftleft(1, ascii(substr(filter_order, {place}, 1)) - {ord(FILTERS[0])})")
    earlier = sum((F.when(F.lit(i) < F.col("step"), bit_of(i)).otherwise(0) for i in range(1, len(FILTERS))), F.lit(0))
    steps = steps.select("*", bit_of("step").alias("bit"), earlier.alias("earlier"))
    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    before = lambda m: m.bitwiseAND(F.col("earlier")) != 0
    removed = lambda m: fails(m) & ~before(m)
    share = lambda a, c: a + F.when(fails(c["mask"]), c["n"] * (F.lit(len(ORDERS)) / F.bit_count(c["mask"])).cast("long")).otherwise(F.lit(0).cast("long"))
    return steps.select(
        "part",
        "filter_order",
        "step",
        _total("cells", "n", lambda m: ~fails(m) & ~before(m)).alias("kept"),
        _total("cells", "n", removed).alias("removed"),
        _total("cells", "n", lambda m: fails(m) & before(m)).alias("redundant"),
        _total("cells", "n", lambda m: m == F.col("bit")).alias("unique_fails"),
        _total("cells", "good", removed).alias("good_lost"),
        _total("cells", "toxic", removed).alias("toxic_lost"),
        F.aggregate("cells", F.lit(0).cast("long"), share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter removes, at each step of each order, in each part of ``docs``."""
    return enumerated(stage(cells(docs, labels)))
