"""The quantised index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.operators import quantised, vectors

D = "/root/testdata/sf0.1"
NONE = "coordinate string, generation int, status string"


def recalled(found, exact):
    return found.select("query_id", "chunk_id").join(exact, ["query_id", "chunk_id"], "left_semi").count() / exact.count()


def test_recall_on_the_embeddings_table(spark, tmp_path):
    rows = spark.read.parquet(f"{D}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    asked = rows.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    registry = quantised.build(rows, asked, str(tmp_path), "c", spark.createDataFrame([], NONE))
    index = quantised.opened(spark, registry, str(tmp_path), "c")
    found = quantised.search(index, asked)
    exact = vectors.knn(rows, asked)
    print("fetched", index.fetched, "recall", recalled(found, exact.select("query_id", "chunk_id")))
    assert index.rows.count() == rows.count() and index.fetched < rows.count() / 4
    assert recalled(found, exact.select("query_id", "chunk_id")) >= 0.9
    near = found.join(exact.withColumnRenamed("score", "want"), ["query_id", "chunk_id"]).agg(F.max(F.abs(F.col("score") - F.col("want")))).first()[0]
    assert near < 1e-9


def test_planted_vectors_come_first_in_each_generation(spark, tmp_path):
    """Of many vectors in other directions, each planted one is found first by itself; the next generation is read when it is active."""
    rng = np.random.default_rng(1)
    back = [(i, [float(x) for x in rng.normal(size=10)]) for i in range(500)]
    planted = [(1000 + i, [float(x) for x in rng.normal(size=10)]) for i in range(25)]
    odd = [(2000, None), (2001, []), (2002, [None] * 10), (2003, [0.0] * 10)]
    shape = "chunk_id long, vector array<double>"
    asked = spark.createDataFrame(planted, shape).withColumnRenamed("chunk_id", "query_id")
    one = quantised.build(spark.createDataFrame(back + odd, shape), asked, str(tmp_path), "c", spark.createDataFrame([], NONE))
    two = quantised.build(spark.createDataFrame(back + planted + odd, shape).repartition(3), asked, str(tmp_path), "c", one)
    first, second = (quantised.opened(spark, r, str(tmp_path), "c") for r in (one, two))
    assert {r.chunk_id for r in quantised.search(first, asked, 1).collect()} <= set(range(500))
    assert {(r.query_id, r.chunk_id) for r in quantised.search(second, asked, 1).collect()} == {(i, i) for i, _ in planted}
    assert second.rows.where("chunk_id >= 2000").count() == 1
    assert quantised.opened(spark, two, str(tmp_path), "other") is None
    with pytest.raises(Exception, match="components"):
        quantised.search(second, spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "query_id long, vector array<double>")).collect()


def test_no_vectors(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id long, vector array<double>")
    registry = quantised.build(none, none.withColumnRenamed("chunk_id", "query_id"), str(tmp_path), "c", spark.createDataFrame([], NONE))
    index = quantised.opened(spark, registry, str(tmp_path), "c")
    assert quantised.search(index, spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")).count() == 0
