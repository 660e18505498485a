"""Exact, filtered and approximate nearest neighbours by cosine."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.operators.lexical import EXACT, top

#: Vectors of a block; queries and rows meet block by block.
BLOCK = 1024
#: Vectors of a batch that are compared with all centres at a time.
CELL_ROWS = 256
#: Share of the true neighbours that an approximate search aims at (0.9 is asked for), and queries it is measured on.
RECALL, MEASURED = 0.95, 512
#: Cells of an index at most; beyond that cells grow with the table, and the same share of it is searched.
MOST_CELLS = 4096


def blocks(rows: DataFrame, key: str, ids: str, vectors: str, by: str | None = None) -> DataFrame:
    """Vectors of (key, vector[, by]) packed where they lie into rows of up to BLOCK: ids, vectors[, by]; nothing shuffles. Null and empty vectors, and those with null components, are left out."""
    held = usable(rows).select(*([by] if by else []), F.col(key).cast("long").alias("k"), F.col("vector").cast("array<double>").alias("vector"))
    if by:
        held = held.where(F.col(by).isNotNull())

    def pack(batches):
        for batch in batches:
            groups = batch.column(0).unique() if by else [None]
            for g in groups:
                part = batch if g is None else batch.filter(pc.equal(batch.column(0), g))
                for at in range(0, part.num_rows, BLOCK):
                    x = part.slice(at, BLOCK)
                    k, v = x.column(x.num_columns - 2), x.column(x.num_columns - 1)
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (k, v)]
                    yield pa.RecordBatch.from_arrays([*([pa.array([g.as_py()], g.type)] if by else []), *lists], names=[*([by] if by else []), ids, vectors])

    kind = f"{by} {rows.schema[by].dataType.simpleString()}, " if by else ""
    return held.mapInArrow(pack, f"{kind}{ids} array<bigint>, {vectors} array<array<double>>")


def usable(rows: DataFrame) -> DataFrame:
    """Rows whose vector has components, none of them null."""
    return rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull()))


def _stacked(of: str, vectors) -> np.ndarray:
    if len({len(v) for v in vectors}) > 1:
        raise ValueError(f"{of} have different numbers of components: {sorted({len(v) for v in vectors})[:5]}")
    return np.vstack(vectors).astype(np.float64)


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, by: str | None = None) -> DataFrame:
    """query_id, chunk_id, score (cosine), rank0: the k nearest of every query.

    ``vectors``: chunk_id, vector; ``queries``: query_id, vector. Both are packed
    into blocks where they lie, every block of vectors meets each of queries once,
    and leaves k rows a query; only those shuffle for the final ranking. Any
    filter on ``vectors`` comes before the top k. ``by`` names a column of both
    that has to be equal, and not null; blocks then meet by it. Null and empty vectors
    and those with null components are nobody's neighbour and have none; vectors of
    different lengths are an error.
    """
    rows, asked = blocks(vectors, "chunk_id", "ids", "xs", by), blocks(queries, "query_id", "qids", "qs", by)
    met = rows.join(asked, by) if by else rows.crossJoin(asked)
    return top(met.select("ids", "xs", "qids", "qs").mapInPandas(_best(k), "query_id bigint, chunk_id bigint, score double"), k)


def _best(k: int):
    """Blocks of rows (ids, xs) that met blocks of queries (qids, qs) -> the k nearest rows of the block for each query."""

    def best(frames):
        for f in frames:
            for ids, xs, qids, qs in zip(f["ids"], f["xs"], f["qids"], f["qs"]):
                x, q = unit(_stacked("vectors", xs)), unit(_stacked("queries", qs))
                if x.shape[1] != q.shape[1]:
                    raise ValueError(f"vectors have {x.shape[1]} components and queries {q.shape[1]}")
                s = q @ x.T
                ids = np.asarray(ids)
                order = np.lexsort((np.broadcast_to(ids, s.shape), -np.round(s, EXACT)), axis=1)[:, :k]
                yield pd.DataFrame({"query_id": np.repeat(np.asarray(qids), order.shape[1]), "chunk_id": ids[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})

    return best


def _query_blocks(queries: DataFrame) -> int:
    return max(1, -(-queries.count() // BLOCK))


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def nearest_cells(v: pd.Series, centres: np.ndarray, n: int) -> list[np.ndarray]:
    """The n nearest centres of each vector, for CELL_ROWS vectors at a time: a batch against all centres is many times the batch."""
    out: list[np.ndarray] = []
    for i in range(0, len(v), CELL_ROWS):
        s = unit(np.vstack(v.iloc[i : i + CELL_ROWS]).astype(float)) @ centres.T
        out += list(np.argsort(-s, axis=1)[:, :n].astype(np.int32))
    return out


def ivf(vectors: DataFrame, queries: DataFrame, k: int = 10, cells: int | None = None, probe: int | None = None, sample: int = 20_000, recall: float = RECALL) -> DataFrame:
    """Approximate k nearest: cells around centres fitted on a bounded sample, the nearest ``probe`` of them searched exactly.

    The fit sees at most ``sample`` vectors; every vector is indexed. Blocks of
    vectors and queries meet by an equi-join on the cell. Without ``probe`` as many cells
    are searched as ``recall`` takes, measured against ``knn`` over all vectors.
    """
    rows, queries = usable(vectors), usable(queries)
    cells = cells or min(MOST_CELLS, max(1, int(rows.count() ** 0.5)))
    drawn = rows.orderBy(F.xxhash64("chunk_id")).limit(sample).select("vector").toPandas()
    if drawn.empty:
        return knn(vectors, queries, k)
    centres = _spherical_means(unit(np.vstack(drawn["vector"]).astype(float)), min(cells, len(drawn)))
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # cells x dimensions

    def near(n: int):
        @F.pandas_udf("array<int>")
        def cell(v: pd.Series) -> pd.Series:
            return pd.Series(nearest_cells(v, shared.value, n))

        return cell

    rows = rows.withColumn("cell", F.explode(near(1)("vector")))
    if probe is None:
        some = queries.orderBy(F.xxhash64("query_id")).limit(MEASURED)
        order = some.select("query_id", near(len(centres))("vector").alias("cells"))
        places = knn(vectors, some, k).join(rows.select("chunk_id", "cell"), "chunk_id").join(order, "query_id").groupBy(F.array_position("cells", F.col("cell")).alias("place")).count()
        probe = _probes(dict(places.collect()), recall)  # a row a cell at most
    # a row a cell; the blocks of a large cell are dealt over tasks
    sizes = F.broadcast(rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")))
    packed_rows = rows.join(sizes, "cell").groupBy("cell", F.pmod(F.xxhash64("chunk_id"), "blocks").alias("at")).agg(F.collect_list("chunk_id").alias("ids"), F.collect_list("vector").alias("xs"))
    asked = queries.withColumn("cell", F.explode(near(min(probe, len(centres)))("vector")))
    packed = asked.groupBy("cell", F.pmod(F.xxhash64("query_id"), F.lit(_query_blocks(queries))).alias("qb")).agg(F.collect_list("query_id").alias("qids"), F.collect_list("vector").alias("qs"))
    met = packed_rows.join(packed.join(sizes, "cell").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))), ["cell", "at"])
    return top(met.select("ids", "xs", "qids", "qs").mapInPandas(_best(k), "query_id bigint, chunk_id bigint, score double"), k)


def _probes(found: dict[int, int], recall: float) -> int:
    """The least number of cells that hold ``recall`` of the neighbours, from how many lie in the n-th nearest cell."""
    total, seen = sum(found.values()), 0
    for place in sorted(found):
        seen += found[place]
        if seen >= recall * total:
            return place
    return 1


def _spherical_means(x: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(0)
    c = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        at = np.concatenate([(x[i : i + BLOCK] @ c.T).argmax(axis=1) for i in range(0, len(x), BLOCK)])
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(np.bincount(at, minlength=cells)[:, None] > 0, unit(sums), c)
    return c
