"""Connected components by alternating large and small stars.

Each round every node points its larger, then its smaller neighbours to the
least node it knows, as aggregates and joins only, until nothing changes. The
number of rounds grows with the logarithm of the longest path. Rounds are cut
by tables in the shared folder.

Before the first round each task replaces a bounded number of its edges at a time by
stars that link the same nodes, so chains that lie together are short from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.sources.staging import stage


#: Edges that a task shortens at a time.
LOCAL = 500_000


def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars (u, v) that link what the edges (u, v) link, LOCAL edges at a time."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        ends = pa.concat_arrays([c for name in ("u", "v") for c in table.column(name).chunks]).dictionary_encode()
        u, v = np.split(ends.indices.to_numpy(), 2)
        least = np.arange(len(ends.dictionary))
        while True:
            m, now = np.minimum(least[u], least[v]), least.copy()
            np.minimum.at(now, least[u], m)
            np.minimum.at(now, least[v], m)
            now = now[now]
            if (now == least).all():
                break
            least = now
        at = np.flatnonzero(least != np.arange(len(least)))
        return pa.RecordBatch.from_arrays([ends.dictionary.take(pa.array(x)) for x in (at, least[at])], names=["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= LOCAL:
            yield stars(held)
            held, n = [], 0
    if held:
        yield stars(held)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v). Large: neighbours over u go to u's least; small: those under u, and u."""
    sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # as a table, so that the join below is of two plain exchanges, of which Spark can split a hub's
    least = stage(sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    joined = sides.join(least, "u")
    out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """From (u, v), node and the least node it is linked with, for every node of an edge but the least ones themselves."""
    kind = edges.schema["u"].dataType.simpleString()
    links = edges.where("u != v").select("u", F.col("v").cast(kind).alias("v")).mapInArrow(shortened, f"u {kind}, v {kind}")
    now = stage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    sign = None
    for _ in range(most_rounds):
        now = stage(_star(_star(now, True), False))
        new = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == sign or not new[0]:
            break
        sign = new
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
