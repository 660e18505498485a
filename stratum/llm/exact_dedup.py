"""Exact dedup with a two-pass Bloom filter.

The first pass sets, for the hash of every normalised text, its places in a
filter that tells places set once from places set again; the parts' filters are
merged by bit operations. A text whose places were all set again is possibly
repeated, any other is certainly not. In the second pass only the possibly
repeated rows shuffle, by the digest of their text; the rest pass straight
through as groups of one. The filter has ``bloom.PER_ROW`` bits a row, up to
``bloom.MOST`` (128 MB a map, enough for 67 million rows); beyond that more and
more rows shuffle, and results stay the same.

Texts are equal when identical after lower-casing A-Z; null counts as empty.
Of equal texts the row with the largest id stays, null ids being smallest; rows
that repeat an id are one document of the group each (``group_size`` counts
rows), and where they repeat the id that stays, all of them are kept. An empty
table gives an empty table. Only the id and text columns are read. A text of any
length that fits a row is normalised and digested in the JVM and moves no further.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm import bloom
from stratum.llm._common import stage


def normal(text):
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact_dedup(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    clean = normal(F.col("text"))
    rows = stage(docs.select("doc_id", clean.alias("t")).select("doc_id", F.xxhash64("t").alias("h"), F.sha2("t", 256).alias("text_sha256")))
    bits = bits or bloom.size(rows.count())
    shared = spark.sparkContext.broadcast(bloom.maps(rows.select("h"), bits)[1])

    def flag(batches):
        again = shared.value
        for batch in batches:
            hit = bloom.has(again, batch.column(1).to_numpy(zero_copy_only=False), bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(hit)], names=["doc_id", "text_sha256", "maybe"])

    flagged = stage(rows.mapInArrow(flag, "doc_id bigint, text_sha256 string, maybe boolean"))
    maybe = flagged.where("maybe").select("doc_id", "text_sha256")
    # as a table, so that the join below is of two plain exchanges, of which Spark can split a hot group's
    groups = stage(maybe.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    alone = flagged.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    return alone.unionByName(maybe.join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", "text_sha256")).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
