"""The language of a source, where the text leaves no doubt: ranked trigram profiles and a margin between the best two."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.sources.batches import sliced
from stratum.sources.staging import stage

#: Trigrams of a profile; trigrams that a text needs, and by how many percent the best language has to lead.
RANKS, LEAST, LEAD = 300, 20, 15


def trigrams(texts: DataFrame, key: str) -> DataFrame:
    """key, gram, n of (key, text): how often a text has a letter between its neighbours, a blank before and after a word; and the number of its letters, with an empty gram.

    These are the trigrams of every word in lower case, a blank before and after it.
    They are counted where the text lies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keys, grams, counts, rows = batch.column(0), [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                at = np.flatnonzero(c != 32)
                if not len(at):
                    continue
                found, n = np.unique(c[at - 1] << 42 | c[at] << 21 | c[at + 1], return_counts=True)
                grams += [found, [-1]]
                counts += [n, [len(at)]]
                rows += [np.full(len(found) + 1, i)]
            if not rows:
                continue
            found, which = np.unique(np.concatenate(grams), return_inverse=True)
            names = ["" if g < 0 else chr(g >> 42) + chr(g >> 21 & 0x1FFFFF) + chr(g & 0x1FFFFF) for g in found.tolist()]
            names = pa.DictionaryArray.from_arrays(pa.array(which.ravel(), pa.int32()), pa.array(names, pa.string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.concatenate(rows))), names, pa.array(np.concatenate(counts), pa.int64())], names=[key, "gram", "n"])

    letters = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " ")), F.lit(" "))
    return texts.select(key, letters.alias("letters")).mapInArrow(run, f"{key} {texts.schema[key].dataType.simpleString()}, gram string, n bigint")


def profiles(labelled: DataFrame) -> DataFrame:
    """language, gram, weight: the RANKS most frequent trigrams of each language of (language, text), the first weighing most."""
    n = trigrams(labelled.where("language is not null"), "language").where("gram != ''").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "gram"))
    return n.withColumn("rank", rank).where(F.col("rank") <= RANKS).select("language", "gram", (RANKS + 1 - F.col("rank")).alias("weight"))


def sure_language(texts: DataFrame, known: DataFrame, lead: int = LEAD) -> DataFrame:
    """source_id, language over (source_id, text) and profiles: the language of a text, null where it says too little or two are near.

    A text counts each of its trigrams with its weight in a language's profile.
    Null and empty texts have no language; rows that repeat an id count as one text.
    """
    # a table first, so that it is broadcast where it is small; the empty gram, without language, is the size of a text
    size = texts.sparkSession.range(1).select(F.lit(None).cast(known.schema["language"].dataType).alias("language"), F.lit("").alias("gram"), F.lit(1).alias("weight"))
    known = stage(known.select("language", "gram", "weight").unionByName(size))
    scores = trigrams(texts, "source_id").join(known, "gram").groupBy("source_id", "language").agg(F.sum(F.col("n") * F.col("weight")).alias("score"))
    scores = scores.withColumn("size", F.max(F.when(F.col("language").isNull(), F.col("score"))).over(Window.partitionBy("source_id"))).where("language is not null")
    w = Window.partitionBy("source_id").orderBy(F.desc("score"), "language")
    best = scores.withColumn("second", F.lead("score").over(w)).withColumn("nth", F.row_number().over(w)).where("nth = 1")
    sure = best.where((F.col("size") >= LEAST) & (F.col("score") * 100 >= F.coalesce("second", F.lit(0)) * (100 + lead)))
    return texts.select("source_id").distinct().join(sure.select("source_id", "language"), "source_id", "left")
