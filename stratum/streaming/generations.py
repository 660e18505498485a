"""Generations filled by a stream: micro-batches under their numbers, a log of those that are in, and the flip after the last."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.sources import sinks

_LOG = "batch bigint, n_rows bigint"


def _place(root: str, coordinate: str, generation: int) -> tuple[str, str]:
    """Folders of a generation's rows and of its log; the log lies beside the generations, where no search reads it."""
    return f"{root}/{coordinate}/gen={generation}", f"{root}-commits/{coordinate}/gen={generation}"


def begun(registry: DataFrame, coordinate: str) -> tuple[DataFrame, int]:
    """The registry with a building generation of the coordinate, and its number: the one that is building already, or the next."""
    here = registry.where(F.col("coordinate") == coordinate)
    last, building = here.agg(F.coalesce(F.max("generation"), F.lit(0)), F.max(F.when(F.col("status") == "building", F.col("generation")))).first()
    if building is not None:
        return registry, building
    row = registry.sparkSession.createDataFrame([(coordinate, last + 1, "building")], "coordinate string, generation int, status string")
    return registry.unionByName(row), last + 1


def commits(spark: SparkSession, root: str, coordinate: str, generation: int) -> DataFrame:
    """batch, n_rows of the batches that are in; empty where none is."""
    log = _place(root, coordinate, generation)[1]
    path = spark._jvm.org.apache.hadoop.fs.Path(log)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "batch=*/_SUCCESS"))
    return spark.read.schema(_LOG).option("basePath", log).parquet(*(s.getPath().getParent().toString() for s in found)).select("batch", "n_rows") if found else spark.createDataFrame([], _LOG)


def filled(rows: DataFrame, root: str, coordinate: str, generation: int, checkpoint: str, embed: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
    """Runs a stream of rows to its end into a building generation, each micro-batch embedded as it comes.

    A batch writes its rows under its number, then its line of the log. The stream
    gives a batch that didn't end the same number and rows again: without its line its
    folder is overwritten, with it nothing is done. So a run that stops anywhere goes on from the
    checkpoint, and no row is in twice. A generation has its own checkpoint.
    """
    data, log = _place(root, coordinate, generation)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not commits(spark, root, coordinate, generation).where(F.col("batch") == number).isEmpty():
            return
        folder = f"{data}/batch={number}"
        embed(batch).write.mode("overwrite").parquet(folder)
        _committed(spark.read.parquet(folder).agg(F.count(F.lit(1)).alias("n_rows")), f"{log}/batch={number}")

    rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def _committed(line: DataFrame, path: str) -> None:
    line.coalesce(1).write.mode("overwrite").parquet(path)


def complete(spark: SparkSession, root: str, coordinate: str, generation: int) -> bool:
    """Whether the log has batches from 0 without a gap, and the folders hold the rows that it says and no others."""
    data, _ = _place(root, coordinate, generation)
    said = commits(spark, root, coordinate, generation)
    n, last = said.agg(F.count(F.lit(1)), F.max("batch")).first()
    if not n or last != n - 1:
        return False
    there = spark.read.parquet(data).groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count(F.lit(1)).alias("n"))
    return said.join(there, "batch", "full").where(~F.coalesce("n_rows", F.lit(0)).eqNullSafe(F.coalesce("n", F.lit(0)))).isEmpty()


def populated(rows: DataFrame, registry: DataFrame, root: str, coordinate: str, checkpoint: str, embed: Callable[[DataFrame], DataFrame] = lambda rows: rows, replaces: str | None = None) -> DataFrame:
    """The registry after a stream was run to its end into the coordinate's building generation, which is then active.

    With ``replaces`` the generation of that other coordinate is stale once the new one is active, as after
    a change of the model. A stream without any row changes nothing, and readers keep what they had.
    """
    spark = rows.sparkSession
    now, generation = begun(registry, coordinate)
    filled(rows, root, coordinate, generation, f"{checkpoint}/{coordinate}/gen={generation}", embed)
    if not complete(spark, root, coordinate, generation):
        return registry
    return sinks.moved(now, replaces, coordinate) if replaces else sinks.activate(now, coordinate)
