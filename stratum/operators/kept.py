"""A kept inverted index: postings in partitions by a hash of the term, changed by small segments and merged when those grow.

    <root>/postings/seg=<n>/bucket=<b>   term, chunk_id, tf, dl
    <root>/lengths/seg=<n>               chunk_id, dl
    <root>/gone/seg=<n>                  chunk_id of what earlier segments no longer hold
    <root>/log                           version, segments

A segment counts once a row of the log names it, and the log's last row is what
readers see, so a write that fails leaves a folder that the next write of that
number replaces. One writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions.text import index_terms

BUCKETS = 64
#: Parts that a chunk's terms are dealt in: a row a part passes from task to task, not one a term.
PARTS = 8
#: Chunks of later segments, as a share of the first's, at which a change merges them.
GROWN = 0.25
POSTINGS, LENGTHS, GONE = "term string, chunk_id bigint, tf bigint, dl int, seg int, bucket int", "chunk_id bigint, dl int, seg int", "chunk_id bigint, seg int"


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def counted(terms: Column) -> Column:
    """Structs (term, tf) of the distinct terms of a list, counted where the list lies: runs of the sorted list."""
    let = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)
    last = lambda s: F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == F.size(s)) | (F.get(s, i) != F.get(s, i - 1)))
    runs = let(F.sort_array(terms), lambda s: let(last(s), lambda e: F.transform(e, lambda end, j: F.struct(F.get(s, end - 1).alias("term"), (end - F.coalesce(F.get(e, j - 1), F.lit(0))).cast("long").alias("tf")))))
    return F.when(F.size(terms) > 0, runs)


@dataclass(frozen=True)
class KeptIndex:
    """The index in a folder that driver and executors share."""

    spark: SparkSession
    root: str

    # what there is

    def segments(self) -> list[int]:
        """Segments of the last version, oldest first."""
        last = self.spark.read.schema("version int, segments array<int>").parquet(f"{self.root}/log").orderBy(F.desc("version")).first()
        return list(last["segments"])

    def _table(self, name: str, shape: str) -> DataFrame:
        return self.spark.read.schema(shape).option("basePath", f"{self.root}/{name}").parquet(*(f"{self.root}/{name}/seg={n}" for n in self.segments()))

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows (chunk_id, seg) that no later segment has taken back."""
        if len(self.segments()) == 1:
            return rows.drop("seg")
        last = self._table("gone", GONE).groupBy("chunk_id").agg(F.max("seg").alias("gone"))
        return rows.join(last, "chunk_id", "left").where(F.col("gone").isNull() | (F.col("gone") <= F.col("seg"))).drop("gone", "seg")

    def lengths(self) -> DataFrame:
        """chunk_id, dl of all chunks."""
        return self._live(self._table("lengths", LENGTHS))

    def postings(self) -> DataFrame:
        """term, chunk_id, tf, dl of all chunks."""
        return self._live(self._table("postings", POSTINGS).drop("bucket"))

    def hits(self, terms: DataFrame) -> DataFrame:
        """chunk_id, dl, term, tf of the chunks that hold some of the terms (term): only their partitions are read."""
        asked = terms.select("term").distinct()
        parts = [r[0] for r in asked.select(bucket(F.col("term"))).distinct().collect()]  # BUCKETS at most
        rows = self._table("postings", POSTINGS).where(F.col("bucket").isin(parts)).drop("bucket")
        return self._live(rows.join(asked, "term", "left_semi")).select("chunk_id", "dl", "term", "tf")

    # changes

    def _write(self, n: int, postings: DataFrame, lengths: DataFrame, gone: DataFrame) -> None:
        dealt = postings.select("term", "chunk_id", "tf", "dl").withColumn("bucket", bucket(F.col("term")))
        # what lies by term compresses and is sorted in tasks of bounded size
        dealt.sortWithinPartitions("bucket", "term", "chunk_id").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.root}/postings/seg={n}")
        lengths.select("chunk_id", "dl").write.mode("overwrite").parquet(f"{self.root}/lengths/seg={n}")
        gone.select(F.col("chunk_id").cast("long").alias("chunk_id")).distinct().write.mode("overwrite").parquet(f"{self.root}/gone/seg={n}")

    def _commit(self, version: int, segments: list[int]) -> None:
        self.spark.createDataFrame([(version, segments)], "version int, segments array<int>").coalesce(1).write.mode("append").parquet(f"{self.root}/log")

    def _indexed(self, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Postings and lengths of chunks (chunk_id, text); a chunk without terms has a length of 0, one without text none."""
        lists = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), index_terms(F.col("text")).alias("terms")).withColumn("dl", F.when(F.col("terms").isNotNull(), F.size("terms")))
        parts = lists.select("chunk_id", "dl", F.transform(counted(F.col("terms")), lambda x: F.struct((bucket(x["term"]) % PARTS).alias("part"), x["term"].alias("term"), x["tf"].alias("tf"))).alias("found"))
        of = lambda p: F.filter("found", lambda x: x["part"] == p)
        parts = parts.select("chunk_id", "dl", F.posexplode(F.array(*map(of, range(PARTS)))).alias("part", "found")).where(F.size("found") > 0)
        # a common term's part is split over tasks
        dealt = parts.select("chunk_id", "dl", "part", F.col("found.term").alias("terms"), F.col("found.tf").cast("array<int>").alias("tfs")).hint("rebalance", "part")
        rows = dealt.select("chunk_id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
        return rows.select(F.col("x.terms").alias("term"), "chunk_id", F.col("x.tfs").cast("long").alias("tf"), "dl"), lists

    def change(self, chunks: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
        """Puts chunks (chunk_id, text) in, in place of those of the same ids, and takes deleted ones (chunk_id) out.

        A chunk that is in both goes in. Where the later segments have grown to GROWN
        of the first, all are merged into one.
        """
        none = self.spark.createDataFrame([], "chunk_id bigint, text string")
        chunks = none if chunks is None else chunks
        ids = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"))
        ids = ids if deleted is None else ids.unionByName(deleted.select(F.col("chunk_id").cast("long").alias("chunk_id")))
        now = self.segments()
        n = max(now) + 1
        self._write(n, *self._indexed(chunks), ids)
        self._commit(n, [*now, n])
        sizes = dict(self._table("lengths", LENGTHS).groupBy("seg").count().collect())  # a row a segment
        if sum(sizes.get(s, 0) for s in [*now[1:], n]) > GROWN * sizes.get(now[0], 0):
            self.merge()

    def merge(self) -> None:
        """All live postings in one segment; readers see it when it is written."""
        n = max(self.segments()) + 1
        # a common term's partition is split over tasks
        dealt = self.postings().withColumn("bucket", bucket(F.col("term"))).hint("rebalance", "bucket")
        self._write(n, dealt, self.lengths(), self.spark.createDataFrame([], "chunk_id bigint"))
        self._commit(n, [n])


def create(spark: SparkSession, root: str, chunks: DataFrame) -> KeptIndex:
    """A new index of chunks (chunk_id, text)."""
    index = KeptIndex(spark, root)
    index._write(1, *index._indexed(chunks), spark.createDataFrame([], "chunk_id bigint"))
    index._commit(1, [1])
    return index
