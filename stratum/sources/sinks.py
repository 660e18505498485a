"""Writes: replaced partitions, logs, and generations behind a registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.operators.catalog import flip


def replace_partitions(rows: DataFrame, path: str, *keys: str) -> None:
    """Overwrites the partitions that ``rows`` has rows for, and leaves the others."""
    rows.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def new_generation(rows: DataFrame, registry: DataFrame, root: str, coordinate: str) -> DataFrame:
    """Writes a set of vectors as the next generation of its coordinate, and gives the registry with it as building.

    Readers keep to the active generation until ``activate``; a failed write
    leaves a folder that no registry names.
    """
    last = registry.where(F.col("coordinate") == coordinate).agg(F.coalesce(F.max("generation"), F.lit(0))).first()[0]
    rows.write.parquet(f"{root}/{coordinate}/gen={last + 1}")
    row = rows.sparkSession.createDataFrame([(coordinate, last + 1, "building")], "coordinate string, generation int, status string")
    return registry.unionByName(row)


def activate(registry: DataFrame, coordinate: str) -> DataFrame:
    return flip(registry, coordinate)


def read_active(spark: SparkSession, registry: DataFrame, root: str, coordinate: str) -> DataFrame | None:
    """The active generation of a coordinate; None if there is none, which a search takes as empty."""
    row = registry.where((F.col("coordinate") == coordinate) & (F.col("status") == "active")).first()
    return None if row is None else spark.read.parquet(f"{root}/{coordinate}/gen={row['generation']}")


def orphans(registry: DataFrame, folders: DataFrame) -> DataFrame:
    """Folders (coordinate, generation) that no row but a stale one names."""
    return folders.join(registry.where("status <> 'stale'").select("coordinate", "generation"), ["coordinate", "generation"], "left_anti")


def retired(registry: DataFrame, coordinate: str) -> DataFrame:
    """The registry with the coordinate's active generation stale: nothing reads it any more, and a sweep drops it."""
    gone = (F.col("coordinate") == coordinate) & (F.col("status") == "active")
    return registry.withColumn("status", F.when(gone, F.lit("stale")).otherwise(F.col("status")))


def moved(registry: DataFrame, old: str, new: str) -> DataFrame:
    """The registry after a corpus was embedded anew under another coordinate: its generation is active, and only then the old one's is stale.

    Where the new coordinate has nothing that is building, nothing changes.
    """
    ready = registry.where((F.col("coordinate") == new) & (F.col("status") == "building"))
    return registry if ready.isEmpty() else retired(activate(registry, new), old)


def sweep_plan(registry: DataFrame, folders: DataFrame) -> DataFrame:
    """coordinate, generation, action over a registry and the folders (coordinate, generation) that are there.

    Folders of active and building generations are kept; those of stale ones, or
    that no row names, as a failed write leaves them, are dropped. Rows of stale
    generations without a folder are forgotten, and an active one without is missing.
    """
    r, f = registry.select("coordinate", "generation", "status"), folders.select("coordinate", "generation").distinct().withColumn("there", F.lit(True))
    both = r.join(f, ["coordinate", "generation"], "full")
    live = F.coalesce(F.col("status").isin("active", "building"), F.lit(False))
    action = F.when(F.col("there") & live, "keep").when(F.col("there"), "drop").when(F.col("status") == "stale", "forget").when(F.col("status") == "active", "missing").otherwise("wait")
    return both.select("coordinate", "generation", action.alias("action"))


def generation_folders(spark: SparkSession, root: str) -> DataFrame:
    """coordinate, generation of the folders under the root, from the file system that Spark sees."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "*/gen=*")) or []
    parts = [(s.getPath().getParent().getName(), int(s.getPath().getName().removeprefix("gen="))) for s in found]  # a folder a generation
    return spark.createDataFrame(parts, "coordinate string, generation int")


def _drop(spark: SparkSession, root: str, coordinate: str, generation: int) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{coordinate}/gen={generation}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def swept(spark: SparkSession, registry: DataFrame, root: str) -> DataFrame:
    """Drops the folders that the plan says, and gives the registry without the rows of what is gone.

    What is to go is written to ``<root>-journal`` before anything goes, and what went
    after. A sweep that stops anywhere is made good by the next one: folders that are
    still there are planned again, and rows stay until their folders are gone. Nothing that is read is ever touched.
    """
    plan = sweep_plan(registry, generation_folders(spark, root)).where("action in ('drop', 'forget')").collect()  # a row a generation
    shape = "coordinate string, generation int, step string"
    drops = [(r["coordinate"], r["generation"]) for r in plan if r["action"] == "drop"]
    if drops:
        spark.createDataFrame([(*d, "marked") for d in drops], shape).coalesce(1).write.mode("append").parquet(f"{root}-journal")
        for coordinate, generation in drops:
            _drop(spark, root, coordinate, generation)
        spark.createDataFrame([(*d, "dropped") for d in drops], shape).coalesce(1).write.mode("append").parquet(f"{root}-journal")
    gone = spark.createDataFrame([(r["coordinate"], r["generation"]) for r in plan], "coordinate string, generation int")
    return registry.join(gone, ["coordinate", "generation"], "left_anti").select(*registry.columns)
