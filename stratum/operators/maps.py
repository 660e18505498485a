"""Structural maps of documents: batches of parts are read one by one, and the maps of batches are merged level by level."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.operators.upkeep import FIELD_CHARS, MOST_ITEMS, SUMMARY_CHARS
from stratum.sources.batches import sliced
from stratum.sources.staging import stage

#: Bytes of a batch, and of what stands between two of its parts.
BATCH_BYTES, SEPARATOR = 8192, "\n\n"
#: What a map holds beside its source and the number of its part.
FIELDS = ("entities", "definitions", "dates", "summary")
MAP = "source_id bigint, part bigint, entities array<string>, definitions array<struct<term:string,text:string>>, dates array<string>, summary string"


def batched(sizes: DataFrame, most: int = BATCH_BYTES, least: int = 1) -> DataFrame:
    """source_id, part, batch over (source_id, part, n_bytes): parts of a source packed in order into batches of bounded bytes.

    A batch takes parts while they and what stands between them fit, and at least ``least``
    of them while there are any; a larger part is a batch of its own. Parts pass in order, and only the batch
    that is open is known, so a source of any number of parts needs no more memory than another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, batch, held, used = object(), 0, 0, 0
        for rows in sliced(batches):
            out = []
            for s, n in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist()):
                if s != source:
                    source, batch, held, used = s, 0, 0, 0
                elif held >= least and used + len(SEPARATOR) + n > most:
                    batch, held, used = batch + 1, 0, 0
                used += n + (len(SEPARATOR) if held else 0)
                held += 1
                out.append(batch)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(out, pa.int64())], names=["source_id", "part", "batch"])

    rows = sizes.select(F.col("source_id").cast("long").alias("source_id"), F.col("part").cast("long").alias("part"), F.col("n_bytes").cast("long").alias("n_bytes"))
    return rows.repartition("source_id").sortWithinPartitions("source_id", "part").mapInArrow(run, "source_id bigint, part bigint, batch bigint")


def _bounded(maps: DataFrame) -> DataFrame:
    """Maps within the bounds of their items and texts; the first of a kind stay."""
    short = lambda x: F.substring(x, 1, FIELD_CHARS)
    names = lambda c: F.slice(F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), short)), 1, MOST_ITEMS)
    said = F.transform(F.slice(F.coalesce("definitions", F.array().cast("array<struct<term:string,text:string>>")), 1, MOST_ITEMS), lambda d: F.struct(short(d["term"]).alias("term"), short(d["text"]).alias("text")))
    return maps.select(F.col("source_id").cast("long").alias("source_id"), F.col("part").cast("long").alias("part"), names(F.col("entities")).alias("entities"), said.alias("definitions"), names(F.col("dates")).alias("dates"), F.substring(F.coalesce("summary", F.lit("")), 1, SUMMARY_CHARS).alias("summary"))


def rendered(maps: DataFrame) -> DataFrame:
    """source_id, part, text of maps, as a reduction reads them."""
    shown = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    return maps.select("source_id", "part", F.concat(F.lit("entities="), shown("entities"), F.lit("; dates="), shown("dates"), F.lit("; summary="), "summary").alias("text"))


def merged(maps: DataFrame) -> DataFrame:
    """One map of each (source_id, batch) over maps with their batch: first-seen union of entities and dates, definitions and summaries in order. ``part`` is the batch."""
    per = maps.groupBy("source_id", "batch").agg(F.array_sort(F.collect_list(F.struct("part", F.struct(*FIELDS).alias("m")))).alias("x"))
    of = lambda field: F.transform("x", lambda x: x["m"][field])
    union = {f: F.flatten(of(f)).alias(f) for f in ("entities", "definitions", "dates")}
    summary = F.array_join(F.filter(of("summary"), lambda s: F.trim(s) != ""), " ").alias("summary")
    return _bounded(per.select("source_id", F.col("batch").alias("part"), *union.values(), summary))


def structural_map(parents: DataFrame, read: Callable[[DataFrame], DataFrame], reduce: Callable[[DataFrame], DataFrame] | None = None, most: int = BATCH_BYTES) -> DataFrame:
    """source_id, status, entities, definitions, dates, summary over (source_id, part, text): one map a source.

    ``read`` makes maps (``MAP``) of batches (source_id, part, text) and leaves out those of which it can't; a
    source without any has the status fallback and empty fields, others are ok. A source of one batch has its map. Of others
    the maps are packed by the bytes of their text and each batch of two or more is given to ``reduce``, as
    (source_id, part, text); where it gives no map, or is None, the maps are merged. That goes on until a source has one.
    A batch is bounded, so no source is ever held whole. A null text is empty; (source_id, part) is unique.
    """
    texts = parents.select(F.col("source_id").cast("long").alias("source_id"), F.col("part").cast("long").alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    places = batched(texts.select("source_id", "part", F.octet_length("text").alias("n_bytes")), most)
    groups = texts.join(places, ["source_id", "part"]).groupBy("source_id", "batch").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("x"))
    asked = groups.select("source_id", F.col("batch").alias("part"), F.array_join(F.transform("x", lambda x: x["text"]), SEPARATOR).alias("text"))
    maps = stage(_bounded(read(asked)))
    while not maps.groupBy("source_id").count().where("count > 1").isEmpty():
        shown = rendered(maps)
        at = stage(batched(shown.select("source_id", "part", F.octet_length("text").alias("n_bytes")), most, 2))
        placed = maps.join(at, ["source_id", "part"])
        plain = merged(placed)
        if reduce is None:
            maps = stage(plain)
            continue
        many = at.groupBy("source_id", "batch").count().where("count > 1").select("source_id", "batch")
        groups = shown.join(at, ["source_id", "part"]).join(many, ["source_id", "batch"], "left_semi").groupBy("source_id", "batch").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("x"))
        lines = F.transform("x", lambda x, i: F.concat(F.lit("Section "), (i + 1).cast("string"), F.lit(": "), x["text"]))
        new = stage(_bounded(reduce(groups.select("source_id", F.col("batch").alias("part"), F.array_join(lines, "\n").alias("text")))))
        maps = stage(new.unionByName(plain.join(new, ["source_id", "part"], "left_anti")))
    every = texts.select("source_id").distinct().join(maps.drop("part").withColumn("status", F.lit("ok")), "source_id", "left")
    empty = {"entities": F.array().cast("array<string>"), "definitions": F.array().cast("array<struct<term:string,text:string>>"), "dates": F.array().cast("array<string>"), "summary": F.lit("")}
    return every.select("source_id", F.coalesce("status", F.lit("fallback")).alias("status"), *(F.coalesce(f, empty[f]).alias(f) for f in FIELDS))


#: Patterns of the stand-in for a model, which the SQL that checks it shares.
NAMES, DATES, DEFINED, FIRST = r"\b[A-Z][a-z]+", r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b|\b[12][0-9]{3}\b", r"\b([A-Z][a-z]+) (?:is|means) ([^.!?\n]+)", r"^[^.!?\n]*[.!?]?"


def phrases(batches: DataFrame) -> DataFrame:
    """A stand-in for a model: capitalised words, dates and years, what is said to be or to mean something, and the first sentence."""
    found: dict[str, Column] = {
        "entities": F.regexp_extract_all("text", F.lit(NAMES), F.lit(0)),
        "definitions": F.zip_with(F.regexp_extract_all("text", F.lit(DEFINED), F.lit(1)), F.regexp_extract_all("text", F.lit(DEFINED), F.lit(2)), lambda a, b: F.struct(a.alias("term"), F.trim(b).alias("text"))),
        "dates": F.regexp_extract_all("text", F.lit(DATES), F.lit(0)),
        "summary": F.trim(F.regexp_extract("text", FIRST, 0)),
    }
    return batches.select("source_id", "part", *(c.alias(f) for f, c in found.items()))
