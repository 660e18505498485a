"""Tiered search on a small corpus with known answers."""

import pytest

from stratum.operators import router, search, structure

TEXTS = {1: "cats purr", 2: "dogs bark loudly", 3: "cats and dogs meet", 4: "birds sing"}


@pytest.fixture(scope="module")
def corpus(spark):
    """Notebook n with four sources of one parent each, of two children; sections of two of them."""
    sources = spark.createDataFrame([("n", i, 10) for i in TEXTS] + [("m", 9, 10**6)], "notebook_id string, source_id long, tokens long")
    rows = []
    for i, t in TEXTS.items():
        rows.append(("n", i, i * 10, None, 0, 0, 3, 0, 100, t + " whole"))
        rows += [("n", i, i * 10 + k, i * 10, 1, k, 2, None, None, f"{t} piece{k}") for k in (1, 2)]
    rows += [("m", 9, 90 + k, 90 if k else None, min(k, 1), k, 2, None if k else 0, None if k else 9, "cats far away") for k in range(4)]
    chunks = spark.createDataFrame(rows, "notebook_id string, source_id long, chunk_id long, parent_id long, level int, token_start long, n_tokens int, byte_start long, byte_end long, text string")
    sections = spark.createDataFrame([(1, 1, "Chapter one", 0, 40), (1, 1, "Chapter two", 40, 60), (2, 1, "Part", 0, 30), (2, 1, "Rest", 30, 200), (3, 1, "The Conclusion", 0, 200)], "source_id long, level int, title string, start long, end long")
    vectors = spark.createDataFrame([(i * 10 + 1, [float(i == 1), float(i == 2), 1.0]) for i in TEXTS], "chunk_id long, vector array<double>")
    return search.Corpus(sources, chunks, sections, vectors)


def asked(spark, *rows):
    return spark.createDataFrame([(i, n, t, [1.0, 0.0, 0.0]) for i, n, t in rows], "query_id long, notebook_id string, text string, vector array<double>")


def test_named_parts(spark, corpus):
    q = asked(spark, (1, "n", "what is in chapter two?"), (2, "n", "Chapter 3"), (3, "n", "the conclusion, please"), (4, "n", "nothing named"), (5, "n", None), (6, "m", "chapter 1"))
    got = {(r.query_id, r.chunk_id) for r in search.tier0_units(q, corpus, 1000).collect()}
    # source 1 has such a title; source 2 has none and gives its second section of the shallowest level
    assert got == {(1, 10), (1, 20), (3, 30)}


def test_corpora_that_fit(spark, corpus):
    fits = {r.notebook_id: (r.total_tokens, r.fits) for r in search.whole_corpora(corpus, 4000).collect()}
    assert fits == {"n": (40, True), "m": (10**6, False)}
    near = {r.notebook_id: r.fits for r in search.whole_corpora(corpus, 35).collect()}
    assert near["n"] is False  # over the cap
    counted = {r.notebook_id: r.fits for r in search.whole_corpora(search.Corpus(corpus.sources.withColumn("tokens", __import__("pyspark.sql.functions").sql.functions.lit(None).cast("long")), *(getattr(corpus, c) for c in ("chunks", "sections", "vectors"))), 11).collect()}
    assert counted["n"] is False  # estimated 18


def test_whole_corpus_is_cut_at_the_cap(spark, corpus):
    q = asked(spark, (1, "n", "x"), (2, "n", "y"))
    assert [r.chunk_id for r in search.tier1_units(q, corpus, 8).where("query_id = 1").orderBy("source_id").collect()] == [10, 20][:2]
    assert search.tier1_units(q, corpus, 1).count() == 2  # the first unit always stays


def hits(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], "query_id long, chunk_id long, score double, label string, graph_confidence double")


def test_merging_trimming_and_provenance(spark, corpus):
    h = hits(spark, (11, 0.3, "Dense", None), (21, 0.2, "Bm25", None), (22, 0.5, "Graph", 0.4), (31, 0.1, "Dense", None), (32, 0.1, "Bm25", None), (91, 0.9, "Dense", None), (777, 1.0, "Dense", None))
    got = {r.chunk_id: (r.parent_id, r.label, r.graph_confidence) for r in search.tier2_units(h, corpus.chunks, 10**6).collect()}
    assert got == {10: (10, "Dense", None), 20: (20, "Graph", 0.4), 30: (30, "Both", None), 91: (90, "Dense", None)}  # one of three children doesn't merge
    cut = [r.chunk_id for r in search.tier2_units(h, corpus.chunks, 9).collect()]
    assert set(cut) == {91, 20}  # the best by score, until one overflows


def test_search_keeps_to_notebooks_and_falls_through(spark, corpus):
    q = asked(spark, (1, "n", "chapter two"), (2, "n", "cats"), (3, "m", "cats"), (4, "gone", "cats"))
    out = search.tiered_search(q, corpus, context=0).collect()
    tiers = {r.query_id: r.tier for r in out}
    assert tiers == {1: 0, 2: 1, 3: 2}
    assert {r.source_id for r in out if r.query_id == 3} == {9}
    assert [r.order_index for r in sorted((r for r in out if r.query_id == 2), key=lambda r: r.order_index)] == [0, 1, 2, 3]


def test_graph_is_a_third_list(spark, corpus):
    q = asked(spark, (1, "m", "cats"))
    graph = spark.createDataFrame([(1, 90, 0, 1.0), (1, 92, 1, 0.05), (1, 10, 2, 0.9)], "query_id long, chunk_id long, rank0 int, conf double")
    got = {r.chunk_id: r for r in search.fused_hits(q.where("false").union(q), corpus, 20, graph).collect()}
    assert got[90].score > got[91].score and got[92].label == "Bm25"
    alone = {r.chunk_id: (r.label, r.graph_confidence) for r in search.fused_hits(asked(spark, (1, "m", "zebra")), corpus, 20, graph).collect()}
    assert alone == {90: ("Graph", 1.0), 10: ("Graph", 0.9)}


def test_live_order_closes_gaps(spark, corpus):
    h = spark.createDataFrame([(1, 10, 0), (1, 5, 1), (1, 20, 2)], "query_id long, chunk_id long, rank0 int")
    assert [(r.chunk_id, r.rank0) for r in search.live_order(h, corpus.chunks).orderBy("rank0").collect()] == [(10, 0), (20, 1)]


def test_packed_parents(spark):
    lines = ["a b c", "", "  d e ", "f" + " g" * 6, "ü x", "y"]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, " \n ")], "source_id long, text string")
    got = [(r.text, r.n_tokens, r.token_start, r.byte_start, r.byte_end) for r in structure.packed(docs, size=4).orderBy("parent_no").collect()]
    data = "\n".join(lines).encode()
    assert [g[0] for g in got] == ["a b c\n\n  d e", "f g g g g", "g g", "ü x\ny"]
    assert all(data[a:b].decode() == t for t, _, _, a, b in got)
    assert [g[1] for g in got] == [5, 5, 2, 3] and [g[2] for g in got] == [0, 5, 10, 12]
    assert router.tier_caps(0) == router.UNKNOWN


def test_parts_of_a_corpus_are_built_when_asked_for(spark):
    from stratum.plans import search as plans

    c = plans.Documents(spark, "/root/testdata/sf0.001")
    assert search.whole_corpora(c, 30000).count() > 0
    assert not {"index", "sections"} & set(vars(c))
    # texts pass between no tasks on their way to chunks
    plan = structure.children(structure.packed(spark.createDataFrame([(1, "n", "a b\nc")], "source_id long, notebook_id string, text string"), keep="notebook_id"), keep=("notebook_id",))
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in plan.collect()] == [(1, 0, "n", 0, "a b c", 3)]


def test_sections_are_numbered_once_for_all_queries(spark):
    wanted = spark.createDataFrame([(q, "n", ["section"], n) for q, n in ((1, 1), (2, 1), (3, 2), (4, None))], "query_id long, notebook_id string, words array<string>, n int")
    sections = spark.createDataFrame([("n", 1, 1, "a section", 0, 5), ("n", 1, 2, "b", 5, 6), ("n", 1, 1, "Section b", 6, 9), ("n", 2, 2, "x", 0, 4), ("n", 2, 1, "y", 4, 9)], "notebook_id string, source_id long, level int, title string, start long, end long")
    found = search.picked_sections(wanted, sections)
    assert sorted(map(tuple, found.collect())) == [(1, 1, 0, 5), (1, 2, 4, 9), (2, 1, 0, 5), (2, 2, 4, 9), (3, 1, 6, 9), (4, 1, 0, 5)]
    # titles don't multiply by queries: windows come before the join with them
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Window")
