"""Tiered search: a named part of the sources, else the whole corpus where it fits, else the best of fused lists.

Everything is keyed by the query, so one job answers many. A corpus is given as

* ``sources``: notebook_id, source_id, tokens (null where not counted) of the live ones,
* ``chunks``: notebook_id, source_id, chunk_id, parent_id (null for parents), level, token_start, n_tokens, byte_start, byte_end, text of their parents and children, and tokens, estimated where the column isn't there,
* ``sections``: source_id, level, title, start, end,
* ``vectors``: chunk_id, vector,
* ``index``: a kept index of the chunks, where there is one,

and queries as query_id, notebook_id, text, vector. Null texts name no part and
match nothing; queries of notebooks without live sources get no units.

Units are chosen over ids, places and tokens; texts are fetched for what was chosen.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions.text import NOT_WORD, estimated_tokens, structural_target
from stratum.operators import fusion, lexical, router, vectors
from stratum.operators.kept import KeptIndex
from stratum.sources.staging import stage

#: Confidence that a chunk of the graph needs.
LEAST_CONFIDENCE = 0.1
#: Words of a title that a named part goes by.
TITLES = {"chapter": ["chapter"], "ch": ["chapter"], "section": ["section"], "part": ["part"], "introduction": ["introduction", "intro"], "intro": ["introduction", "intro"], "conclusion": ["conclusion"]}
UNIT = ("query_id", "tier", "chunk_id", "source_id", "parent_id", "label", "graph_confidence", "level", "token_start", "tokens")


@dataclass(frozen=True)
class Corpus:
    sources: DataFrame
    chunks: DataFrame
    sections: DataFrame
    vectors: DataFrame
    index: KeptIndex | None = None


def live_order(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked hits (query_id, chunk_id, rank0) whose chunks are there, in the same order, ranked anew."""
    kept = hits.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return kept.withColumn("rank0", F.row_number().over(Window.partitionBy("query_id").orderBy("rank0")) - 1)


def targets(queries: DataFrame) -> DataFrame:
    """query_id, notebook_id, words, n of the queries that name a part: the n-th with such a title, or where n is null the first."""

    @F.pandas_udf("noun string, n int")
    def named(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([structural_target(t or "") or (None, None) for t in text], columns=["noun", "n"]).astype({"n": "Int32"})

    found = queries.select("query_id", "notebook_id", named("text").alias("t")).where("t.noun is not null")
    words = F.create_map(*(x for noun, ts in TITLES.items() for x in (F.lit(noun), F.array(*map(F.lit, ts)))))
    return found.select("query_id", "notebook_id", words[F.col("t.noun")].alias("words"), F.col("t.n").alias("n"))


def picked_sections(wanted: DataFrame, sections: DataFrame) -> DataFrame:
    """query_id, source_id, start, end: the part that a query names, in each source of its notebook.

    That is the n-th section with a word of the noun's in its title; where no title
    has one, the n-th of the shallowest level. A part without number is looked for
    in titles alone.
    """
    # sections are read once for each noun, not for each query
    nouns = wanted.select("notebook_id", "words").distinct()
    x = nouns.join(sections, "notebook_id").withColumn("has", F.arrays_overlap(F.split(F.lower("title"), NOT_WORD), "words")).drop("title")
    of = Window.partitionBy("words", "source_id")
    x = x.withColumn("any", F.max(F.col("has").cast("int")).over(of)).withColumn("top", F.min("level").over(of))
    x = x.where(F.when(F.col("any") == 1, F.col("has")).otherwise(F.col("level") == F.col("top")))
    nth = x.withColumn("nth", F.row_number().over(of.orderBy("start")))
    asked = wanted.withColumn("nth", F.coalesce("n", F.lit(1)))
    return nth.join(asked, ["notebook_id", "words", "nth"]).where(F.col("n").isNotNull() | F.col("has")).select("query_id", "source_id", "start", "end")


def measured(chunks: DataFrame) -> DataFrame:
    """Chunks without their texts, with their tokens."""
    return (chunks if "tokens" in chunks.columns else chunks.withColumn("tokens", estimated_tokens(F.col("text")))).drop("text")


def with_text(units: DataFrame, chunks: DataFrame) -> DataFrame:
    """Units with the texts of their chunks. Units are tables first: few are broadcast, and texts stay where they lie."""
    return stage(units).join(chunks.select("chunk_id", "text"), "chunk_id")


def _unit(rows: DataFrame, tier: int) -> DataFrame:
    """Parents as units of a tier that fuses nothing."""
    new = {"tier": F.lit(tier), "label": F.lit("Dense"), "graph_confidence": F.lit(None).cast("double"), "parent_id": F.lit(None).cast("long")}
    return rows.withColumns(new).select(*UNIT)


def _named_units(queries: DataFrame, corpus: Corpus, meta: DataFrame, cap: int) -> DataFrame:
    wanted = stage(targets(queries))
    owned = corpus.sections.join(corpus.sources.join(wanted.select("notebook_id").distinct(), "notebook_id", "left_semi").select("notebook_id", "source_id"), "source_id")
    spans = picked_sections(wanted, owned)
    inside = meta.where("level = 0").join(spans, "source_id").where("(byte_start + byte_end) div 2 >= start and (byte_start + byte_end) div 2 < end")
    return _unit(router.budget_cut(inside, cap, "query_id", ["source_id", "byte_start"]), 0)


def tier0_units(queries: DataFrame, corpus: Corpus, cap: int) -> DataFrame:
    """Parents whose midpoint lies in the part that a query names, in document order, up to the cap."""
    return with_text(_named_units(queries, corpus, measured(corpus.chunks), cap), corpus.chunks)


def whole_corpora(corpus: Corpus, cap: int, meta: DataFrame | None = None) -> DataFrame:
    """notebook_id, total_tokens, fits: whether all live sources go in whole.

    Sources without a count are estimated from their parents. A sum near the cap is
    counted again, by the parents' own words.
    """
    meta = measured(corpus.chunks) if meta is None else meta
    parents = meta.where("level = 0").groupBy("source_id").agg(F.sum("tokens").alias("estimate"), F.sum("n_tokens").alias("exact"))
    s = corpus.sources.join(parents, "source_id", "left").withColumn("count", F.coalesce(F.when(F.col("tokens") >= 0, F.col("tokens")), "estimate", F.lit(0)))
    totals = s.groupBy("notebook_id").agg(F.sum("count").alias("total_tokens"), F.sum(F.coalesce("exact", F.lit(0))).alias("exact"), F.max(F.coalesce((F.col("tokens") > cap).cast("int"), F.lit(0))).alias("oversized"))
    near = F.abs(F.col("total_tokens") - cap) <= router.MARGIN
    return totals.select("notebook_id", "total_tokens", ((F.col("total_tokens") <= cap) & (F.col("oversized") == 0) & (~near | (F.col("exact") <= cap))).alias("fits"))


def _whole_units(queries: DataFrame, meta: DataFrame, cap: int) -> DataFrame:
    """Notebooks are cut before queries multiply them, and only those that a query is for."""
    own = meta.where("level = 0").join(queries.select("notebook_id").distinct(), "notebook_id", "left_semi")
    kept = router.budget_cut(own, cap, "notebook_id", ["source_id", "level", "token_start"])
    return _unit(kept.join(queries.select("query_id", "notebook_id"), "notebook_id"), 1)


def tier1_units(queries: DataFrame, corpus: Corpus, cap: int) -> DataFrame:
    """All parents of the queries' notebooks, in document order, up to the cap."""
    return with_text(_whole_units(queries, measured(corpus.chunks), cap), corpus.chunks)


def merged_label(of: str = "label") -> list:
    """Aggregates of the children's labels: the label of what they merge into, and its confidence."""
    has = lambda *names: F.max(F.col(of).isin(*names).cast("int")) == 1
    graph = F.max(F.when(F.col(of) == "Graph", F.col("graph_confidence")))
    dense, words = has("Dense", "Both"), has("Bm25", "Both")
    return [F.when(graph.isNotNull(), "Graph").when(dense & words, "Both").when(words, "Bm25").otherwise("Dense").alias("label"), graph.alias("graph_confidence")]


def _merged_units(hits: DataFrame, meta: DataFrame, cap: int) -> DataFrame:
    found = stage(hits.join(meta, "chunk_id"))
    fed = found.where("parent_id is not null").groupBy("query_id", "parent_id").agg(F.count(F.lit(1)).alias("got"), F.max("score").alias("score"), *merged_label())
    total = meta.join(fed.select("parent_id").distinct(), "parent_id", "left_semi").groupBy("parent_id").agg(F.count(F.lit(1)).alias("total"))
    merging = stage(fed.join(total, "parent_id").where("got * 2 >= total").select("query_id", "parent_id", "score", "label", "graph_confidence"))
    parents = meta.select("chunk_id", "source_id", "level", "token_start", "tokens")
    merged = merging.join(parents, F.col("parent_id") == F.col("chunk_id"))
    rest = found.join(merging.select("query_id", "parent_id"), ["query_id", "parent_id"], "left_anti")
    units = rest.withColumn("tier", F.lit(2)).select(*UNIT, "score").unionByName(merged.withColumn("tier", F.lit(2)).select(*UNIT, "score"))
    return router.budget_cut(units, cap, "query_id", [F.desc(F.round("score", lexical.EXACT)), "source_id", "level", "token_start", "chunk_id", "parent_id"]).select(*UNIT)


def tier2_units(hits: DataFrame, chunks: DataFrame, cap: int) -> DataFrame:
    """Units from fused hits (query_id, chunk_id, score, label, graph_confidence).

    Hits without a chunk are gone. Half of a parent's children or more make way for
    the parent, at the best child's score; the best units within the cap stay.
    """
    return with_text(_merged_units(hits, measured(chunks), cap), chunks)


def fused_hits(queries: DataFrame, corpus: Corpus, k: int, graph: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score, label, graph_confidence of the k best, each query within its notebook.

    ``graph`` (query_id, chunk_id, rank0, conf) is a third list; what is under LEAST_CONFIDENCE doesn't count.
    """
    n, own = fusion.pool(k), corpus.chunks.select("chunk_id", "notebook_id")
    dense = vectors.knn(corpus.vectors.join(own, "chunk_id"), queries, n, by="notebook_id")
    lists = {"dense": live_order(dense, own), "bm25": lexical.bm25(corpus.chunks, queries, scope=own, k=n, every=False, lists=corpus.index)}
    if graph is not None:
        graph = graph.where(F.col("conf") >= LEAST_CONFIDENCE)
        lists["graph"] = live_order(graph, own)
    fused = fusion.rrf(lists, k)
    conf = F.lit(None).cast("double")
    if graph is not None:
        fused = fused.join(graph.select("query_id", "chunk_id", "conf"), ["query_id", "chunk_id"], "left")
        conf = F.when(F.col("label") == "Graph", F.col("conf"))
    return fused.select("query_id", "chunk_id", "score", "label", conf.alias("graph_confidence"))


def tiered_search(queries: DataFrame, corpus: Corpus, context: int, k: int = 20, reserved: int = 0, graph: DataFrame | Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """query_id, tier, order_index, chunk_id, source_id, parent_id, label, graph_confidence, tokens, text: what goes into each query's context.

    Tier 0 where the query names a part that some source has, tier 1 where the
    notebook fits, else tier 2. Only queries that come to it pay for the search:
    ``graph``, the list of ``fused_hits``, may be a function that makes it for those.
    """
    cap1, cap2 = router.tier_caps(context, reserved)
    meta = stage(measured(corpus.chunks))
    first = stage(_named_units(queries, corpus, meta, cap2))
    left = queries.join(first.select("query_id").distinct(), "query_id", "left_anti")
    fits = whole_corpora(corpus, cap1, meta)
    left = stage(left.join(fits.select("notebook_id", "fits"), "notebook_id"))
    second = _whole_units(left.where("fits"), meta, cap1)
    last = left.where("not fits")
    third = _merged_units(fused_hits(last, corpus, k, graph(last) if callable(graph) else graph), meta, cap2)
    units = first.unionByName(second).unionByName(third)
    order = Window.partitionBy("query_id").orderBy("source_id", "level", "token_start", "chunk_id", "parent_id")
    units = units.withColumn("order_index", F.row_number().over(order) - 1)
    return with_text(units, corpus.chunks).select("query_id", "tier", "order_index", "chunk_id", "source_id", "parent_id", "label", "graph_confidence", "tokens", "text")
