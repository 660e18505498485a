"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a temporary one in local mode, as in tests, and an error on a cluster.

    All folders of an application lie in one, named by its id, which can go when
    its results are written.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = os.path.join(tempfile.gettempdir(), "stratum-checkpoints")
    return f"{top.rstrip('/')}/stratum-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Writes the rows and reads them back, which cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
