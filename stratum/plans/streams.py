"""Generations that streams fill, as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.sources import sinks
from stratum.sources.staging import shared_dir
from stratum.sources.tables import load
from stratum.streaming import events, generations

#: Files that the rows of the stream come in, two a micro-batch.
FILES = 6


def _unit(rows: DataFrame) -> DataFrame:
    """Vectors of length 1; those without a direction, or with a null component, are left out."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return rows.withColumn("norm", norm).where("norm > 0 and norm < double('inf')").select("vec_id", F.transform(wide, lambda x: x / F.col("norm")).alias("vector"))


def generation_stream(spark: SparkSession, d: str) -> DataFrame:
    """Vectors embedded anew by a stream, as units under another coordinate, after which the old one's generation is stale.

    One row a vector that a search sees, with the coordinates that are active.
    """
    root, come, checkpoint = (shared_dir(spark) for _ in range(3))
    v = load(spark, d, "embeddings").select("vec_id", "embedding")
    v.repartition(FILES, "vec_id").write.parquet(come)
    none = spark.createDataFrame([], "coordinate string, generation int, status string")
    old = sinks.activate(sinks.new_generation(v, none, root, "raw"), "raw")
    now = generations.populated(events.read_stream(spark, come, v, 2), old, root, "unit", checkpoint, _unit, replaces="raw")
    active = now.where("status = 'active'").agg(F.array_join(F.array_sort(F.collect_list("coordinate")), ",")).first()[0]  # a row a generation
    seen = sinks.read_active(spark, now, root, "unit")
    return seen.select("vec_id", F.lit(active).alias("active"), F.round(F.get("vector", F.lit(0)), 6).alias("x0"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 6).alias("length"))


QUERIES = {f.__name__: f for f in (generation_stream,)}

ORACLES = {
    "generation_stream": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v WHERE len(list_filter(e, lambda x: x IS NULL)) = 0)
SELECT vec_id, 'unit' AS active, round(e[1] / norm, 6) AS x0, 1.0::DOUBLE AS length FROM n WHERE norm > 0 AND norm < 'inf'::DOUBLE""",
}
