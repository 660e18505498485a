"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.sources.batches import map_batches, sliced, slices  # noqa: F401  for the operators here
from stratum.sources.staging import shared_dir, stage  # noqa: F401
from stratum.sources.tables import spread

#: A word is a run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def fold(key: Column) -> Column:
    """crc32 of the id as text, modulo 4; remainder 2 is held out from learning."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 4


def held_out(key: Column) -> Column:
    return fold(key) == 2


def unit(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) fixed by the key as text and the seed: 52 bits of an md5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("long") * F.lit(2.0**-52)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame doesn't have."""
    while stem.lower() in {c.lower() for c in df.columns}:
        stem += "_"
    return stem
