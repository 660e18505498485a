"""Ranked lexical search with MaxScore in shards of an inverted index.

``build`` makes the index where the documents lie: a task turns so many of its
documents into a shard, in which every term has a posting list of the documents
that hold it, by rising id, with the counts. ``Index.search`` takes the document
frequencies of the queries' terms and the totals over all shards, and ranks in
each shard. There the terms of a query are ordered by their upper bounds, the
largest addition that a posting of the shard makes. Lists whose bounds together
don't exceed the tenth best score so far are non-essential: a document in none
of the others can't qualify. Candidates come from the essential lists alone, and
the non-essential ones are probed for them, from the largest bound on, only while
what is left to add lifts the candidate over the tenth best score. Documents are
taken by ranges of rising id, so a later one of an equal score loses the tie and
the bound may be strict. A shard's ten best of each query leave it; the best of
those are the answer, which is exact.

Terms are maximal runs of letters, digits and anything beyond ASCII, with A-Z
lower-cased. With N documents that have a term, L terms in them, n terms in a
document, and df documents holding a term, a term weighs
floor(1000 * ln((2N + 2) / (2df + 1))) and adds
weight * ((10^9 tf) div (1000 tf + 8m)) with m = 25 + (75 n N) div L.

Null and empty texts have no terms and are never found. Rows that repeat an id
are documents of their own, each with a rank; among equal scores null ids come
first, then smaller ids, and rows of one id are alike. Items of one id, and those
of a null id, are one query with the terms of all. Empty tables on either side
give an empty table. Only doc_id, item_id and text are read, so further columns
may have any name. A text of any length that fits a row is one document: a shard
is closed once it holds ``SHARD_TERMS`` terms.

Queries are searched in blocks of about ``BLOCK_TERMS`` terms, so what a worker
holds of them is bounded, however many there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.llm._common import stage

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A shard is closed with so many documents or terms; one longer text is a shard with what came before it.
SHARD_DOCS, SHARD_TERMS = 16_384, 3_000_000
#: Terms of the queries that are searched at a time (in expectation); documents of a shard that are ranked at a time.
BLOCK_TERMS, RANGE = 200_000, 2048
#: The first row of a shard, without a term, has its documents: how many ids are null, the ids (0 for those) and the sizes. The others are posting lists.
ROW = "shard string, term string, nulls int, ids array<bigint>, sizes array<bigint>, at array<int>, tf array<bigint>"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(TERM), F.lit(0))


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values, kind))


def shard(name: str, ids: pa.Array, found: pa.Array) -> pa.RecordBatch:
    """A shard's rows from ids and term lists; documents lie by rising id, null first."""
    order = pc.sort_indices(pa.table({"id": ids}), sort_keys=[("id", "ascending")], null_placement="at_start")
    ids, found = ids.take(order), found.take(order)
    sizes, n = np.diff(found.offsets.to_numpy()).astype(np.int64), max(1, len(ids))
    coded = found.flatten().dictionary_encode()
    # by term and document, with the number of times
    key, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + np.repeat(np.arange(len(ids)), sizes), return_counts=True)
    ends = np.searchsorted(key // n, np.arange(len(coded.dictionary)), "right")
    rows, own, others = 1 + len(ends), np.full(1 + len(ends), len(ids)), np.concatenate([[0], ends])
    return pa.RecordBatch.from_arrays(
        [
            pa.array([name] * rows, pa.string()),
            pa.concat_arrays([pa.nulls(1, pa.string()), coded.dictionary.cast(pa.string())]),
            pa.array([ids.null_count] * rows, pa.int32()),
            _lists(ids.fill_null(0).to_numpy(), own, pa.int64()),
            _lists(sizes, own, pa.int64()),
            _lists(key % n, others, pa.int32()),
            _lists(tf, others, pa.int64()),
        ],
        names=["shard", "term", "nulls", "ids", "sizes", "at", "tf"],
    )


def _shards(batches: Iterator[pa.RecordBatch], most_docs: int, most_terms: int) -> Iterator[pa.RecordBatch]:
    """The shards of a task. Their names tell them apart in the table that is written; a task that is run again writes its own anew."""
    part, made, held, docs, words = TaskContext.get().partitionId(), 0, [], 0, 0

    def close() -> pa.RecordBatch:
        nonlocal made, held, docs, words
        made, now = made + 1, pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held, docs, words = [], 0, 0
        return shard(f"{part}-{made}", now.column(0), now.column(1))

    for batch in batches:
        ends = batch.column(1).offsets.to_numpy().astype(np.int64)
        at = 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[at] + most_terms - words, "left"))
            stop = min(batch.num_rows, max(stop, at + 1), at + most_docs - docs)
            held.append(batch.slice(at, stop - at))
            docs, words, at = docs + stop - at, words + int(ends[stop] - ends[at]), stop
            if docs >= most_docs or words >= most_terms:
                yield close()
    if held:
        yield close()


@dataclass(frozen=True)
class Index:
    """Two tables: the documents of each shard, and its posting lists."""

    lengths: DataFrame
    postings: DataFrame

    def search(self, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
        """item_id, rank, doc_id, score of the k best documents of each item."""
        asked = items.select("item_id", F.explode(terms(F.col("text"))).alias("term"))
        asked = stage(asked.groupBy(F.col("item_id").cast("long").alias("item_id"), "term").agg(F.count(F.lit(1)).alias("times")))
        n_asked = asked.count()
        total = self.lengths.select(F.explode("sizes").alias("n")).where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = stage(self.postings.join(asked.select("term").distinct(), "term", "left_semi"))
        df = held.groupBy("term").agg(F.sum(F.size("at")).cast("long").alias("df"))
        weight = F.floor(1000 * F.log((2.0 * total[0] + 2) / (2.0 * F.col("df") + 1))).cast("long")
        blocks = max(1, math.ceil(n_asked / block_terms))
        weighed = stage(asked.join(df, "term").select("item_id", "term", (F.col("times") * weight).alias("weight"), F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block")))
        best = None
        for block in range(blocks):
            found = self._searched(weighed.where(F.col("block") == block), held, tuple(total), k)
            best = found if best is None else best.unionByName(found)
        # the rows of a task are cut to its k best of an item before they shuffle
        w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
        return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")

    def _searched(self, weighed: DataFrame, held: DataFrame, total: tuple[int, int], k: int) -> DataFrame:
        """item_id, doc_id, score: the k best of each query of a block in every shard."""
        queries: dict[int | None, list[tuple[str, int]]] = {}
        for r in weighed.select("item_id", "term", "weight").toLocalIterator():  # a block: about BLOCK_TERMS rows
            queries.setdefault(r["item_id"], []).append((r["term"], r["weight"]))
        shared = weighed.sparkSession.sparkContext.broadcast(queries)

        def rank(docs: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
            hits = list(ranked(docs, lists, shared.value, total, k)) if len(docs) and len(lists) else []
            ids = [None if at < docs["nulls"].iloc[0] else int(docs["ids"].iloc[0][at]) for _, at, _ in hits]
            return pd.DataFrame({"item_id": pd.array([item for item, *_ in hits], "Int64"), "doc_id": pd.array(ids, "Int64"), "score": pd.array([s for *_, s in hits], "int64")})

        return self.lengths.groupBy("shard").cogroup(held.groupBy("shard")).applyInPandas(rank, "item_id bigint, doc_id bigint, score bigint")


def ranked(docs: pd.DataFrame, lists: pd.DataFrame, queries: dict, total: tuple[int, int], k: int) -> Iterator[tuple]:
    """(item, place, score) of the k best documents of a shard for each query."""
    n_docs, n_terms = total
    m = 25 + (75 * np.asarray(docs["sizes"].iloc[0], np.int64) * n_docs) // max(1, n_terms)
    postings, bounds = {}, {}
    for term, at, tf in zip(lists["term"], lists["at"], lists["tf"]):
        at, tf = np.asarray(at, np.int64), np.asarray(tf, np.int64)
        adds = (1_000_000_000 * tf) // (1000 * tf + 8 * m[at])
        postings[term], bounds[term] = (at, adds), int(adds.max())
    for item, asked in queries.items():
        here = sorted(((w * bounds[t], w, t) for t, w in asked if w > 0 and t in postings), key=lambda x: x[0])
        if here:
            yield from ((item, *hit) for hit in max_score([(b, w, *postings[t]) for b, w, t in here], len(m), k))


def max_score(lists: list[tuple[int, int, np.ndarray, np.ndarray]], n: int, k: int, span: int = RANGE) -> list[tuple[int, int]]:
    """(place, score) of the k best of n places, from (bound, weight, places, additions) of each term by rising bound."""
    below = np.concatenate([[0], np.cumsum([b for b, *_ in lists])])  # what the first i lists can add together
    best_at, best, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for start in range(0, n, span):
        stop = min(n, start + span)
        split = int(np.searchsorted(below, least, "right")) - 1  # so many lists can't lift a place over the k-th best
        if split == len(lists):
            break
        score = np.zeros(stop - start, np.int64)
        for _, w, at, adds in lists[split:]:
            a, b = np.searchsorted(at, (start, stop))
            score[at[a:b] - start] += w * adds[a:b]
        places = np.flatnonzero(score)
        score = score[places]
        for i in range(split - 1, -1, -1):
            alive = score + below[i + 1] > least
            places, score = places[alive], score[alive]
            if not len(places):
                break
            _, w, at, adds = lists[i]
            found = np.searchsorted(at, places + start)
            hit = np.flatnonzero(at[np.minimum(found, len(at) - 1)] == places + start)
            score[hit] += w * adds[found[hit]]
        alive = score > least
        if alive.any():
            best_at, best = np.concatenate([best_at, places[alive] + start]), np.concatenate([best, score[alive]])
            top = np.lexsort((best_at, -best))[:k]
            best_at, best = best_at[top], best[top]
            least = int(best[-1]) if len(best) == k else 0
    return list(zip(best_at.tolist(), best.tolist()))


def build(docs: DataFrame, shard_docs: int = SHARD_DOCS, shard_terms: int = SHARD_TERMS) -> Index:
    """The index of ``docs`` (doc_id, text), written once to the shared folder."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), terms(F.col("text")).alias("terms"))
    rows = stage(found.mapInArrow(lambda batches: _shards(batches, shard_docs, shard_terms), ROW))
    return Index(rows.where("term is null").select("shard", "nulls", "ids", "sizes"), rows.where("term is not null").select("shard", "term", "at", "tf"))


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each item."""
    return build(docs).search(items, k)
