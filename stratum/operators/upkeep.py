"""Upkeep of a corpus: what is replaced, shown, checked and bounded around indexing and enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Types of block that aren't prose, tokens from which a source is enriched, bytes that a sniff sees, and bounds of a document map.
NOT_PROSE, LEAST_TOKENS, SNIFFED = ("code", "table", "html"), 2000, 65_536
MOST_ITEMS, FIELD_CHARS, SUMMARY_CHARS = 200, 1000, 4000
#: Kinds of evaluation question, and chunks that their context is made of.
QUESTION_KINDS, CONTEXT_CHUNKS = ("single_hop", "bridging", "rollup"), 40


def is_prose(block_type: Column, level: Column) -> Column:
    """Leaves of prose: what is mentioned in code, tables or raw pages doesn't count."""
    return (level > 0) & F.coalesce(~block_type.isin(*NOT_PROSE), F.lit(True))


def needs_ocr(kind: Column, text: Column) -> Column:
    return (kind == "pdf") & (F.trim(F.coalesce(text, F.lit(""))) == "")


def is_jsonl(raw: Column) -> Column:
    """Whether the first two lines that aren't blank are JSON values of their own, within the first bytes; null isn't."""
    window = F.substring(raw.cast("binary"), 1, SNIFFED)
    lines = F.filter(F.transform(F.split(F.regexp_replace(window.cast("string"), "^﻿", ""), "\n"), F.trim), lambda x: F.trim(F.regexp_replace(x, "\r", "")) != "")
    whole = lambda i: F.try_parse_json(F.get(lines, F.lit(i))).isNotNull()
    return F.coalesce(F.is_valid_utf8(window.cast("string")) & (F.size(lines) >= 2) & whole(0) & whole(1), F.lit(False))


def node_text(kind: Column, name: Column, definition: Column) -> Column:
    """What is embedded for a node of the graph."""
    return F.concat(kind, F.lit(": "), name, F.when(F.coalesce(F.trim(definition), F.lit("")) != "", F.concat(F.lit(" — "), definition)).otherwise(""))


def bounded_map(entities: Column, summary: Column) -> tuple[Column, Column]:
    """Entities and summary of a document map within their bounds."""
    return F.transform(F.slice(entities, 1, MOST_ITEMS), lambda x: F.substring(x, 1, FIELD_CHARS)), F.substring(summary, 1, SUMMARY_CHARS)


def anchor(kind: Column, page: Column) -> Column:
    return F.to_json(F.struct(kind.alias("kind"), page.alias("page")))


def anchor_page(locator: Column) -> Column:
    """Page of a PDF's anchor; null for other anchors and for what isn't one."""
    a = F.from_json(locator, "kind string, page int")
    return F.when(a["kind"] == "pdf", a["page"])


def transcript_blocks(segments: DataFrame) -> DataFrame:
    """source_id, seg_no, text, byte_start, byte_end, start, end over (source_id, seg_no, start, end, text): where segments stand in the text that joins them by blank lines.

    A source with a segment that has no times, or ends before it starts, gives none. A null text counts as empty.
    """
    segments = segments.withColumn("text", F.coalesce("text", F.lit("")))
    ok = F.coalesce((F.col("start") >= 0) & (F.col("end") >= F.col("start")) & ~F.isnan("start") & ~F.isnan("end") & (F.col("end") < float("inf")), F.lit(False))
    of = Window.partitionBy("source_id")
    x = segments.withColumn("bad", F.max((~ok).cast("int")).over(of)).where("bad = 0").drop("bad")
    at = F.coalesce(F.sum(F.octet_length("text") + 2).over(of.orderBy("seg_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return x.select("source_id", "seg_no", "text", at.alias("byte_start"), (at + F.octet_length("text")).alias("byte_end"), "start", "end")


def written_graph(existing: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Rows of the sources that ``new`` brings replaced by its own, the first of each key."""
    w = Window.partitionBy(*key).orderBy(*[c for c in new.columns if c not in key])
    first = new.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
    return existing.join(new.select("source_id").distinct(), "source_id", "left_anti").unionByName(first)


def with_summary(chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """Chunks with the summary of each source in ``summaries`` replaced."""
    gone = summaries.select("source_id", F.lit("summary").alias("kind")).distinct()
    return chunks.join(gone, ["source_id", "kind"], "left_anti").unionByName(summaries)


def overview_status(overviews: DataFrame, hashes: DataFrame) -> DataFrame:
    """notebook_id, status: a ready overview without its file is missing, of other sources than now stale; others stay as they are."""
    x = overviews.join(hashes.select("notebook_id", F.col("set_hash").alias("now")), "notebook_id", "left")
    status = F.when(F.col("status") != "ready", F.col("status")).when(F.coalesce("file_bytes", F.lit(0)) == 0, "missing").when(~F.col("set_hash").eqNullSafe(F.col("now")), "stale").otherwise("ready")
    return x.select("notebook_id", status.alias("status"))


def active_indexes(registry: DataFrame, used: DataFrame) -> DataFrame:
    """Active rows of the coordinates that are used, by model."""
    return registry.where("status = 'active'").join(used.select("coordinate").distinct(), "coordinate", "left_semi").orderBy("model", "coordinate")


def dense_chunks(chunks: DataFrame, mentions: DataFrame, k: int = CONTEXT_CHUNKS) -> DataFrame:
    """notebook_id, chunk_id, n, rank0: the chunks of each notebook that mention most; chunks without mentions count 0."""
    n = chunks.select("notebook_id", "chunk_id").join(mentions.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("m")), "chunk_id", "left").select("notebook_id", "chunk_id", F.coalesce("m", F.lit(0)).alias("n"))
    w = Window.partitionBy("notebook_id").orderBy(F.desc("n"), "chunk_id")
    return n.withColumn("rank0", F.row_number().over(w) - 1).where(F.col("rank0") < k)


def question_context(dense: DataFrame, texts: DataFrame) -> DataFrame:
    """notebook_id, context: the dense chunks with their ids, best first."""
    line = F.concat(F.lit("["), F.col("chunk_id").cast("string"), F.lit("] "), "text")
    per = dense.join(texts.select("chunk_id", "text"), "chunk_id").groupBy("notebook_id").agg(F.array_sort(F.collect_list(F.struct("rank0", line.alias("line")))).alias("x"))
    return per.select("notebook_id", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("context"))


def valid_questions(questions: DataFrame, fed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Questions (question_id, kind, seed, chunk_id) of a known kind, each gold chunk among those fed and live, each seed a name of the graph. One bad row takes its question out."""
    names = nodes.select(F.lower("name").alias("s"), F.lit(True).alias("named")).distinct()
    live = fed.select("chunk_id", F.lit(True).alias("live")).distinct()
    x = questions.withColumn("s", F.lower("seed")).join(names, "s", "left").join(live, "chunk_id", "left")
    bad = x.where(~F.coalesce(F.col("kind").isin(*QUESTION_KINDS), F.lit(False)) | F.col("named").isNull() | F.col("live").isNull()).select("question_id").distinct()
    return questions.join(bad, "question_id", "left_anti")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def notes_by_source(notes: DataFrame) -> DataFrame:
    """source_id, note_ids, place over (note_id, source_id of its first citation or null): groups in the order of their first note; notes without citation are one group."""
    g = notes.groupBy("source_id").agg(F.array_sort(F.collect_list("note_id")).alias("note_ids"), F.min("note_id").alias("first"))
    counted = g.withColumn("place", F.col("first"))
    return counted.select("source_id", "note_ids", "place")


def listed(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """Adds the 0-based place of each row in the listing of its group."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)


def worth_enriching(sources: DataFrame, blocks: DataFrame) -> DataFrame:
    """Sources (source_id, tokens) that are long enough and have prose at all."""
    prose = blocks.where(is_prose(F.col("block_type"), F.col("level"))).select("source_id").distinct()
    return sources.where(F.col("tokens") >= LEAST_TOKENS).join(prose, "source_id", "left_semi")


def built_nodes(found: DataFrame) -> DataFrame:
    """source_id, key, name, kind, definition over (source_id, class, pos, name, definition): class 0 are entities, 1 dates, 2 terms with a definition.

    Names of a source are one node whatever their case. The first of the lowest
    class gives its spelling; a date is one only where no entity has the name; the
    first definition that any term of that name has stays.
    """
    x = found.where(F.trim("name") != "").withColumn("key", F.lower("name"))
    first = F.min(F.struct("class", "pos", "name"))
    per = x.groupBy("source_id", "key").agg(first.alias("f"), F.min(F.when((F.col("class") == 2) & F.col("definition").isNotNull(), F.struct("pos", "definition"))).alias("d"))
    return per.select("source_id", "key", F.col("f.name").alias("name"), F.when(F.col("f.class") == 1, "date").otherwise("concept").alias("kind"), F.col("d.definition").alias("definition"))
