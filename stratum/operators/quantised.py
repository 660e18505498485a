"""A kept approximate index: product-quantised codes that are scanned, vectors that are fetched for the best of them.

A vector is cut into parts, and a part is told by the nearest of 256 centres of its
own, fitted on a bounded sample. A query makes a table of its dot products with all
centres, so a row's score is a sum of as many entries as it has parts. The best
``fetched`` rows by that score are compared exactly. How many that takes is
measured once, when the index is built, against exact search.

    <root>/<coordinate>/gen=<n>     chunk_id, code, vector
    <root>/<coordinate>-books       generation, part, centres, fetched

Rows are a generation behind a registry: readers keep to the active one until the
next is complete. A search reads ids and codes of all rows, and vectors of what it fetches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratum.operators.lexical import top
from stratum.operators.vectors import BLOCK, MEASURED, RECALL, _stacked, blocks, knn, unit, usable
from stratum.sources import sinks

#: Centres of a part, components of one, vectors of the fit at most, and rounds of it.
CENTRES, WIDTH, SAMPLE, ROUNDS = 256, 4, 20_000, 10
#: Codes of a block.
CODES = 16_384


@dataclass(frozen=True)
class Index:
    rows: DataFrame  # chunk_id, code, vector
    books: np.ndarray  # parts x centres x components of a part
    fetched: int


def _cut(x: np.ndarray) -> np.ndarray:
    """n x d -> parts x n x WIDTH, the last part filled with zeros."""
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % WIDTH)))
    return x.reshape(len(x), -1, WIDTH).swapaxes(0, 1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([((centres**2).sum(axis=1) - 2 * x[i : i + BLOCK] @ centres.T).argmin(axis=1) for i in range(0, len(x), BLOCK)])


def fitted(sample: np.ndarray, centres: int = CENTRES) -> np.ndarray:
    """Centres of each part by k-means on unit vectors."""
    rng, out = np.random.default_rng(0), []
    for part in _cut(unit(sample)):
        c = part[rng.choice(len(part), centres, replace=len(part) < centres)]
        for _ in range(ROUNDS):
            at = _nearest(part, c)
            sums, n = np.zeros_like(c), np.bincount(at, minlength=len(c))[:, None]
            np.add.at(sums, at, part)
            c = np.where(n > 0, sums / np.maximum(n, 1), c)
        out.append(c)
    return np.array(out)


def coded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """chunk_id, code, vector: a byte a part."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)  # parts x 256 x WIDTH

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = unit(np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1))
                code = np.array([_nearest(p, c) for p, c in zip(_cut(x), shared.value)], np.uint8).T
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in code], pa.binary()), batch.column(1)], names=["chunk_id", "code", "vector"])

    rows = usable(vectors).select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("vector").cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, "chunk_id bigint, code binary, vector array<double>")


def build(vectors: DataFrame, queries: DataFrame, root: str, coordinate: str, registry: DataFrame, k: int = 10, recall: float = RECALL) -> DataFrame:
    """Writes the next generation of the index of (chunk_id, vector) and gives the registry in which it is active.

    The fit sees SAMPLE vectors at most, drawn by a hash of their ids; every vector is
    coded. ``queries`` (query_id, vector), of which MEASURED at most are tried, tell how many rows ``recall`` takes.
    """
    spark = vectors.sparkSession
    drawn = usable(vectors).orderBy(F.xxhash64("chunk_id")).limit(SAMPLE).select("vector").toPandas()
    books = fitted(np.vstack(drawn["vector"]).astype(float)) if len(drawn) else np.zeros((1, CENTRES, WIDTH))
    building = sinks.new_generation(coded(vectors, books), registry, root, coordinate)
    n = building.where((F.col("coordinate") == coordinate) & (F.col("status") == "building")).agg(F.max("generation")).first()[0]
    rows = spark.read.parquet(f"{root}/{coordinate}/gen={n}")
    fetched = _measured(rows, books, queries, k, recall)
    told = [(n, i, [float(v) for v in c.ravel()], fetched) for i, c in enumerate(books)]
    spark.createDataFrame(told, "generation int, part int, centres array<double>, fetched int").coalesce(1).write.mode("append").parquet(f"{root}/{coordinate}-books")
    return sinks.activate(building, coordinate)


def _measured(rows: DataFrame, books: np.ndarray, queries: DataFrame, k: int, recall: float) -> int:
    """The least number of rows to fetch, in steps of a half more, with which so much of the exact answer is among them."""
    some = usable(queries).orderBy(F.xxhash64("query_id")).limit(MEASURED)
    exact = knn(rows, some, k).select("query_id", "chunk_id")
    total, n = exact.count(), k
    most = max(1, rows.count())
    while n < most:
        met = scanned(rows, books, some, n).join(exact, ["query_id", "chunk_id"], "left_semi").count()
        if met >= recall * total:
            break
        n += n // 2 + 1
    return min(n, most)


def opened(spark: SparkSession, registry: DataFrame, root: str, coordinate: str) -> Index | None:
    """The active generation of the index; None where there is none."""
    row = registry.where((F.col("coordinate") == coordinate) & (F.col("status") == "active")).first()
    if row is None:
        return None
    parts = spark.read.parquet(f"{root}/{coordinate}-books").where(F.col("generation") == row["generation"]).orderBy("part").collect()  # a row a part
    books = np.array([r["centres"] for r in parts]).reshape(len(parts), -1, WIDTH)
    return Index(sinks.read_active(spark, registry, root, coordinate), books, parts[0]["fetched"])


def scanned(rows: DataFrame, books: np.ndarray, queries: DataFrame, n: int) -> DataFrame:
    """query_id, chunk_id of the n best rows of each query by their codes. Codes and queries are packed where they lie and meet block by block."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CODES):
                part = batch.slice(at, CODES)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([b"".join(part.column(1).to_pylist())], pa.binary())], names=["ids", "codes"])

    def best(frames):
        books = shared.value
        for f in frames:
            for ids, codes, qids, qs in zip(f["ids"], f["codes"], f["qids"], f["qs"]):
                code, parts = np.frombuffer(codes, np.uint8).reshape(len(ids), -1), _cut(unit(_stacked("queries", qs)))
                if len(parts) != len(books):
                    raise ValueError(f"the index is of vectors with {len(books)} parts of {WIDTH} components, and queries have {len(parts)}")
                tables = np.einsum("pqw,pcw->pqc", parts, books)
                s = np.zeros((len(qids), len(ids)))
                for p in range(code.shape[1]):
                    s += tables[p][:, code[:, p]]
                order = np.argpartition(-s, min(n, s.shape[1] - 1), axis=1)[:, :n]
                yield pd.DataFrame({"query_id": np.repeat(np.asarray(qids), order.shape[1]), "chunk_id": np.asarray(ids)[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})

    met = rows.select("chunk_id", "code").mapInArrow(pack, "ids array<bigint>, codes binary").crossJoin(blocks(queries, "query_id", "qids", "qs"))
    found = met.mapInPandas(best, "query_id bigint, chunk_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n).select("query_id", "chunk_id")


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, chunk_id, score (cosine), rank0: the k nearest of those whose codes are best."""
    held = scanned(index.rows, index.books, queries, max(k, index.fetched))
    asked = usable(queries).select("query_id", F.col("vector").cast("array<double>").alias("q"))
    pairs = held.join(index.rows.select("chunk_id", "vector"), "chunk_id").join(asked, "query_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot("vector", "vector") * dot("q", "q"))
    same = F.when(F.size("vector") != F.size("q"), F.raise_error(F.lit("vectors and queries have different numbers of components")))
    return top(pairs.select("query_id", "chunk_id", F.coalesce(same.cast("double"), F.when(norm > 0, dot("vector", "q") / norm).otherwise(F.lit(0.0))).alias("score")), k)
