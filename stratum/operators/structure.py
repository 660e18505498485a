"""Chunks, sections, offsets, and joins on positions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions.text import words
from stratum.sources.batches import sliced

PARENT, CHILD, OVERLAP = 512, 128, 16
#: ASCII white space.
WHITE = " \t\n\x0b\f\r"
#: Levels of headings.
LEVELS = 6


def parents(docs: DataFrame, size: int = PARENT) -> DataFrame:
    """source_id, parent_no, text, n_tokens, token_start, token_end: windows of ``size`` words that tile the text."""
    w = docs.select("source_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    rows = w.select("source_id", F.size("w").alias("n"), "w", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / size).cast("int"))).alias("parent_no"))
    piece = F.slice("w", F.col("parent_no") * size + 1, size)
    return rows.select("source_id", "parent_no", F.array_join(piece, " ").alias("text"), F.size(piece).alias("n_tokens"), (F.col("parent_no") * size).alias("token_start"), F.least(F.col("n"), (F.col("parent_no") + 1) * size).alias("token_end"))


def packed(docs: DataFrame, size: int = PARENT, tolerance: int = 1, keep: str | None = None) -> DataFrame:
    """source_id, parent_no, text, n_tokens, token_start, byte_start, byte_end: non-blank lines packed greedily into parents.

    ``keep`` names a string of the docs that goes along.

    A parent takes lines while their words stay within ``size`` and the tolerance,
    and is the slice of the source from its first line to its last, separators
    included. A longer line closes the parent before it and is split into runs of
    that many words, each a parent. Each text is one pass of one row.
    """
    most = size + tolerance

    def cut(text: str):
        """(first character, last, words) of each parent."""
        held = None
        for m in re.finditer(r"[^\n]+", text):
            n = len(m[0].encode().split())  # bytes are split at ASCII white space alone
            if not n:
                continue
            a, b = m.end() - len(m[0].lstrip(WHITE)), m.start() + len(m[0].rstrip(WHITE))
            if held and (n > most or held[2] + n > most):
                yield held
                held = None
            if n > most:
                spots = [w.span() for w in re.finditer(rf"[^{WHITE}]+", m[0])]
                for i in range(0, n, most):
                    part = spots[i : i + most]
                    yield m.start() + part[0][0], m.start() + part[-1][1], len(part)
            else:
                held = (held[0], b, held[2] + n) if held else (a, b, n)
        if held:
            yield held

    def run(batches):
        for batch in sliced(batches):
            out = []
            for source, text, kept in zip(*(c.to_pylist() for c in batch.columns)):
                at = byte = words_ = 0
                for no, (a, b, n) in enumerate(cut(text or "")):
                    byte += len(text[at:a].encode())
                    data = text[a:b].encode()
                    out.append((source, no, text[a:b], n, words_, byte, byte + len(data), kept))
                    at, byte, words_ = b, byte + len(data), words_ + n
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 8, (pa.int64(), pa.int32(), pa.string(), pa.int32(), *[pa.int64()] * 3, pa.string()))], names=["source_id", "parent_no", "text", "n_tokens", "token_start", "byte_start", "byte_end", keep or "kept"])

    along = F.col(keep) if keep else F.lit(None)
    found = docs.select(F.col("source_id").cast("long").alias("source_id"), "text", along.cast("string").alias("kept")).mapInArrow(run, f"source_id bigint, parent_no int, text string, n_tokens int, token_start bigint, byte_start bigint, byte_end bigint, {keep or 'kept'} string")
    return found if keep else found.drop("kept")


def children(parent: DataFrame, size: int = CHILD, overlap: int = OVERLAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """source_id, parent_no, child_no, text, n_tokens: windows within a parent that share ``overlap`` words. ``keep`` names columns of the parent that go along."""
    step = size - overlap
    w = parent.select("source_id", "parent_no", *keep, words(F.col("text")).alias("w"))
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - size) / step).cast("int"))
    rows = w.select("source_id", "parent_no", *keep, "w", F.explode(F.sequence(F.lit(0), last)).alias("child_no"))
    piece = F.slice("w", F.col("child_no") * step + 1, size)
    return rows.select("source_id", "parent_no", *keep, "child_no", F.array_join(piece, " ").alias("text"), F.size(piece).alias("n_tokens"))


def token_offsets(chunks: DataFrame) -> DataFrame:
    """Adds start and end of each chunk in the running token count of its source."""
    w = Window.partitionBy("source_id").orderBy("parent_no").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("run_end", F.sum("n_tokens").over(w)).withColumn("run_start", F.col("run_end") - F.col("n_tokens"))


def line_blocks(docs: DataFrame) -> DataFrame:
    """source_id, block_no, text, byte_start, byte_end of the non-blank lines; offsets are bytes of the UTF-8 text."""
    lines = docs.select("source_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    w = Window.partitionBy("source_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    at = lines.withColumn("byte_start", F.coalesce(F.sum(F.octet_length("line") + 1).over(w), F.lit(0)))
    kept = at.where(F.trim("line") != "")
    order = Window.partitionBy("source_id").orderBy("line_no")
    return kept.select("source_id", (F.row_number().over(order) - 1).alias("block_no"), F.col("line").alias("text"), "byte_start", (F.col("byte_start") + F.octet_length("line")).alias("byte_end"))


def outline(heads: DataFrame) -> DataFrame:
    """source_id, pos, level (1 to LEVELS), title, start, doc_end -> adds ordinal among siblings and the section's end.

    A section ends where a heading of its level or a shallower one starts.
    Ordinals start anew below each shallower heading. Every level is one running
    value over the headings, forwards for ordinals and backwards for ends, so a
    document costs as much as it has headings.
    """
    level = F.col("level")
    upto, ahead = (Window.partitionBy("source_id").orderBy(o).rowsBetween(Window.unboundedPreceding, till) for o, till in (("pos", 0), (F.desc("pos"), -1)))
    of = lambda values: F.get(F.array(*values), (level - 1).cast("int"))
    x = heads.withColumn("end", F.coalesce(of([F.last(F.when(level <= n, F.col("start")), ignorenulls=True).over(ahead) for n in range(1, LEVELS + 1)]), F.col("doc_end")))
    for n in range(1, LEVELS + 1):
        x = x.withColumn(f"n{n}", F.count(F.when(level == n, 1)).over(upto))
    before = [F.coalesce(F.last(F.when(level < n, F.col(f"n{n}")), ignorenulls=True).over(upto), F.lit(0)) for n in range(1, LEVELS + 1)]
    return x.withColumn("ordinal", of([F.col(f"n{n}") for n in range(1, LEVELS + 1)]) - of(before)).drop(*(f"n{n}" for n in range(1, LEVELS + 1)))


def section_of_midpoint(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks (source_id, chunk_id, start, end) in the sections (source_id, section_id, start, end) that their midpoints lie in.

    Sections of one level don't overlap; where there are several levels, a column
    of that name tells them apart and a chunk lies in a section of each. Both sides
    go through one sorted pass of their source, so nothing multiplies.
    """
    levels = range(1, LEVELS + 1) if "level" in sections.columns else [None]
    c = chunks.select("source_id", "chunk_id", F.expr("(start + end) div 2").alias("at"), F.lit(None).alias("s"), F.lit(None).cast("int").alias("level"), F.lit(1).alias("side"))
    s = sections.select("source_id", F.lit(None).alias("chunk_id"), F.col("start").alias("at"), F.struct("section_id", "end").alias("s"), (F.col("level") if levels[0] else F.lit(None)).cast("int").alias("level"), F.lit(0).alias("side"))
    w = Window.partitionBy("source_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.array(*(F.last(F.when(F.lit(n is None) | (F.col("level") == n), F.col("s")), ignorenulls=True).over(w) for n in levels))
    met = s.unionByName(c.withColumn("s", F.lit(None).cast(s.schema["s"].dataType))).withColumn("last", last).where("side = 1")
    return met.select("source_id", "chunk_id", F.col("at").alias("mid"), F.explode("last").alias("s")).where(F.col("mid") < F.col("s.end")).select("source_id", "s.section_id", "chunk_id", "mid")


def last_block_before(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """As-of join: for each chunk (source_id, chunk_id, start) the last block (source_id, block_no, start) that starts no later.

    Both sides go through one sorted pass of their source, so nothing multiplies.
    """
    both = chunks.select("source_id", "chunk_id", "start", F.lit(None).cast("long").alias("block_no"), F.lit(1).alias("side")).unionByName(blocks.select("source_id", F.lit(None).cast("long").alias("chunk_id"), "start", F.col("block_no").cast("long").alias("block_no"), F.lit(0).alias("side")))
    w = Window.partitionBy("source_id").orderBy("start", "side", "block_no").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("anchor", F.last("block_no", ignorenulls=True).over(w)).where("side = 1").select("source_id", "chunk_id", "anchor")


def blocks_within(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """For each chunk, first and last time of the blocks (start, start_second, end_second) that begin inside it; times rise with the start.

    The first block at or after the chunk's start and the last before its end
    come from two running values over both sides in order, whatever chunks overlap.
    """
    none = F.lit(None).cast("struct<b:bigint,t:bigint>")
    time = lambda c: F.struct(F.col("start").cast("long").alias("b"), F.col(c).cast("long").alias("t"))
    b = blocks.select("source_id", F.col("start").alias("at"), F.lit(None).cast("long").alias("chunk_id"), F.lit(None).cast("string").alias("edge"), F.lit(1).alias("side"), time("start_second").alias("first"), time("end_second").alias("last"))
    edges = [chunks.select("source_id", F.col(c).alias("at"), F.col("chunk_id").cast("long").alias("chunk_id"), F.lit(c).alias("edge"), F.lit(0).alias("side"), none.alias("first"), none.alias("last")) for c in ("start", "end")]
    ahead, back = (Window.partitionBy("source_id").orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in ((F.desc("at"), F.desc("side")), ("at", "side")))
    both = b.unionByName(edges[0]).unionByName(edges[1]).withColumn("first", F.last("first", ignorenulls=True).over(ahead)).withColumn("last", F.last("last", ignorenulls=True).over(back))
    of = both.where("side = 0").groupBy("source_id", "chunk_id").agg(F.max(F.when(F.col("edge") == "start", F.col("first"))).alias("f"), F.max(F.when(F.col("edge") == "end", F.col("last"))).alias("l"), F.max("at").alias("end"))
    return of.where(F.col("f.b") < F.col("end")).select("source_id", "chunk_id", F.col("f.t").alias("start_second"), F.col("l.t").alias("end_second"))
