"""Chat history, prompts and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions.text import markers

HISTORY = 6


def turn_pairs(messages: DataFrame) -> DataFrame:
    """conv_id, turn_id, question, answer: complete pairs of a user's turn and the assistant's that follows it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = messages.withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    return x.where("role = 'user' and next_role = 'assistant' and trim(answer) != ''").select("conv_id", F.col("turn").alias("turn_id"), F.col("text").alias("question"), "answer")


def complete_turns(messages: DataFrame) -> DataFrame:
    """conv_id, turn_id, question, answer over (conv_id, turn_id, pos, role, text, state): the last question of a turn and its last answer that is finished and not blank; turns with both, in the order in which they began."""
    done = (F.col("role") == "assistant") & F.col("state").isNull() & (F.trim("text") != "")
    last = lambda c: F.max(F.when(c, F.struct("pos", "text")))
    t = messages.groupBy("conv_id", "turn_id").agg(F.min("pos").alias("began"), last(F.col("role") == "user").alias("q"), last(done).alias("a")).where("q is not null and a is not null")
    order = F.row_number().over(Window.partitionBy("conv_id").orderBy("began"))
    return t.select("conv_id", order.alias("turn_id"), F.col("q.text").alias("question"), F.col("a.text").alias("answer"))


def recent(pairs: DataFrame, messages: int = HISTORY) -> DataFrame:
    """The last pairs of each conversation, two messages each."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn_id"))
    return pairs.withColumn("back", F.row_number().over(w)).where(F.col("back") <= messages // 2)


def speaker_runs(messages: DataFrame) -> DataFrame:
    """conv_id, run_no, role, n_turns, first_turn: runs of turns by one speaker."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = messages.withColumn("new", F.when(F.col("role") == F.lag("role").over(w), 0).otherwise(1)).withColumn("run_no", F.sum("new").over(w))
    return x.groupBy("conv_id", "run_no", "role").agg(F.count(F.lit(1)).alias("n_turns"), F.min("turn").alias("first_turn"))


def cited_unknown(messages: DataFrame, live: DataFrame) -> DataFrame:
    """conv_id of the dialogues with a turn (conv_id, source_ids) that cites what isn't live (source_id)."""
    cited = messages.select("conv_id", F.explode("source_ids").alias("source_id"))
    return cited.join(live.select("source_id"), "source_id", "left_anti").select("conv_id").distinct()


def dialogue_valid(messages: DataFrame, least: int = 2, longest_run: int = 2) -> DataFrame:
    """conv_id, n_turns, n_speakers, longest, valid: enough turns, two speakers, no long runs."""
    longest = speaker_runs(messages).groupBy("conv_id").agg(F.max("n_turns").alias("longest"), F.sum("n_turns").alias("n_turns"), F.count_distinct("role").alias("n_speakers"))
    return longest.withColumn("valid", (F.col("n_turns") >= least) & (F.col("n_speakers") >= 2) & (F.col("longest") <= longest_run))


def citations(answers: DataFrame, units: DataFrame) -> DataFrame:
    """answer_id, ordinal, marker, unit_id: cited units in order; numbers without a unit are left out."""
    cited = answers.select("answer_id", F.posexplode(F.array_distinct(markers(F.col("text")))).alias("ordinal", "marker"))
    return cited.join(units, (cited["answer_id"] == units["for_answer"]) & (cited["marker"] == units["pos"] + 1)).select("answer_id", "ordinal", "marker", "unit_id")


def citation_diagnosis(answers: DataFrame) -> DataFrame:
    t = F.col("text")
    return answers.select("answer_id", F.size(markers(t)).alias("n_markers"), F.length(F.regexp_replace(t, r"[^\[]", "")).alias("n_brackets"), t.contains("【").alias("wide"), t.contains("[^").alias("footnote"), t.rlike(r"\(\d+\)").alias("round"))


def prompts(units: DataFrame) -> DataFrame:
    """query_id, prompt: numbered excerpts in order."""
    line = F.concat(F.lit("["), (F.col("order_index") + 1).cast("string"), F.lit("] ("), "title", F.when(F.coalesce(F.col("section"), F.lit("")) != "", F.concat(F.lit(" — §"), "section")).otherwise(""), F.lit("): "), "text")
    per = units.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("order_index", line.alias("line")))).alias("lines"))
    return per.select("query_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("prompt"))


def fitted(units: DataFrame, history: DataFrame, room: int) -> tuple[DataFrame, DataFrame]:
    """Units and history (query_id, place, tokens) that fit: history keeps its newest within a third, units the first within the rest.

    The first unit of a query always stays.
    """
    newest = Window.partitionBy("query_id").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    kept = history.withColumn("run", F.sum("tokens").over(newest)).where(F.col("run") <= room // 3)
    used = kept.groupBy("query_id").agg(F.max("run").alias("used"))
    first = Window.partitionBy("query_id").orderBy("place")
    u = units.join(used, "query_id", "left").withColumn("run", F.sum("tokens").over(first.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.row_number().over(first))
    return u.where((F.col("run") + F.coalesce("used", F.lit(0)) <= room) | (F.col("n") == 1)).select(*units.columns), kept.select(*history.columns)


def missing_index(queries: DataFrame, live_chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """query_id, retry over queries without hits: to be tried again where there are chunks but no active index, else there is nothing."""
    chunks = live_chunks.select(F.lit(True).alias("has")).limit(1)
    active = registry.where("status = 'active'").select(F.lit(True).alias("ready")).limit(1)
    out = queries.join(F.broadcast(chunks), F.lit(True), "left").join(F.broadcast(active), F.lit(True), "left")
    return out.select("query_id", (F.coalesce("has", F.lit(False)) & ~F.coalesce("ready", F.lit(False))).alias("retry"))
