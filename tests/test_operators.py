"""Single operators on small inline tables with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.functions import text as T
from stratum.operators import answer, catalog, enrich, evaluate, fusion, graph, lexical, resolve, router, structure, vectors
from stratum.plans import retrieval
from stratum.sources import extract
from stratum.streaming import events


def ranked(spark, *ids):
    return spark.createDataFrame([(1, c, i) for i, c in enumerate(ids)], "query_id long, chunk_id string, rank0 int")


def test_rrf_first_rank_and_ties(spark):
    r = fusion.rrf({"dense": ranked(spark, "a"), "bm25": ranked(spark, "z")}, 5).orderBy("place").collect()
    assert [(x.chunk_id, x.score, x.label) for x in r] == [("a", 1 / 60, "Dense"), ("z", 1 / 60, "Bm25")]


def test_rrf_labels(spark):
    r = {x.chunk_id: x.label for x in fusion.rrf({"dense": ranked(spark, "a", "b"), "bm25": ranked(spark, "b", "c"), "graph": ranked(spark, "a", "d")}, 9).collect()}
    assert r == {"a": "Dense", "b": "Both", "c": "Bm25", "d": "Graph"}


def test_pool_is_clamped():
    assert (fusion.pool(1), fusion.pool(80), fusion.pool(9000)) == (50, 80, 500)


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw,want", [("ZX9-4471Q", "ZX9 4471Q"), ("cats AND dogs", "cats dogs"), ("...", None), ("and near", "and near"), ("a\"b*", "a b")])
def test_sanitized_query(spark, raw, want):
    assert one(spark, T.sanitized_query(F.col("q")), q=raw) == want


@pytest.mark.parametrize("raw,want", [("HTTPS://Example.COM:443/p/#x", "https://example.com/p"), ("http://a.b:80", "http://a.b/"), ("http://a.b/P?q=1#f", "http://a.b/P?q=1"), ("http://a.b//", "http://a.b//"[:-1]), ("nothing", "nothing")])
def test_normalized_url(spark, raw, want):
    assert one(spark, T.normalized_url(F.col("q")), q=raw) == want


def test_estimated_tokens(spark):
    assert [one(spark, T.estimated_tokens(F.col("q")), q=x) for x in ("", "abcdefgh", "中文abcd", "日本")] == [0, 2, 3, 2]


def test_blended_weight(spark):
    w = lambda **v: one(spark, T.blended_weight(F.col("r"), F.col("w").cast("double"), F.col("c").cast("double")), **v)
    assert abs(w(r="co_occurs", w=1.0, c=None) - np.log(2)) < 1e-9 and w(r="co_occurs", w=0.0, c=None) == 0.01
    assert w(r="x", w=1.0, c=None) == 1.5 and abs(w(r="x", w=1.0, c=0.8) - 2.4) < 1e-9


def test_markers(spark):
    assert one(spark, T.markers(F.col("q")), q="a [1] b [2, 3] [[4]] [x] [5,y] (6)") == [1, 2, 3, 4]


@pytest.mark.parametrize("q,want", [("what is in Chapter 3?", ("chapter", 3)), ("the third section", ("section", 3)), ("part IV please", ("part", 4)), ("section 3.1", None), ("the conclusion", ("conclusion", None)), ("hello", None), ("ch twelve", ("ch", 12))])
def test_structural_target(q, want):
    assert T.structural_target(q) == want


def test_normalized_name(spark):
    assert one(spark, T.normalized_name(F.col("q")), q="  Ada   Lovelace., ") == "ada lovelace"


def test_bm25_needs_all_terms_and_ignores_scope_in_statistics(spark):
    chunks = spark.createDataFrame([(1, "red fox"), (2, "red red hen"), (3, "blue fox")], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "Red fox"), (2, "AND"), (3, "red")], "query_id long, text string")
    got = {(r.query_id, r.chunk_id) for r in lexical.bm25(chunks, q).collect()}
    assert got == {(1, 1), (3, 1), (3, 2)}
    some = lexical.bm25(chunks, q, every=False)
    assert {r.chunk_id for r in some.where("query_id = 1").collect()} == {1, 2, 3}
    narrow = lexical.bm25(chunks, q, scope=spark.createDataFrame([(2,)], "chunk_id long")).where("query_id = 3").first()
    assert narrow.chunk_id == 2 and narrow.score == lexical.bm25(chunks, q).where("query_id = 3 and chunk_id = 2").first().score


def test_ivf_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    x = [(i, (centres[i % 20] + 0.2 * rng.normal(size=16)).tolist()) for i in range(600)]
    v, q = spark.createDataFrame(x, "chunk_id long, vector array<double>"), spark.createDataFrame([(i, e) for i, e in x[:25]], "query_id long, vector array<double>")
    exact, near = ({(r.query_id, r.chunk_id) for r in f(v, q, 10).collect()} for f in (vectors.knn, vectors.ivf))
    assert len(exact) == 250 and len(exact & near) / 250 >= 0.95
    assert vectors.knn(v.limit(0), q, 10).count() == 0


def test_ivf_recall_on_the_embeddings_table(spark):
    d = "/root/testdata/sf0.1"
    exact, near = ({(r.query_id, r.chunk_id) for r in f(spark, d).collect()} for f in (retrieval.knn_cosine_topk, retrieval.knn_ivf_topk))
    assert len(exact) == 1000 and len(exact & near) / len(exact) >= 0.9


def test_ivf_probes_follow_from_recall():
    assert vectors._probes({1: 50, 2: 30, 7: 20}, 0.8) == 2
    assert vectors._probes({1: 50, 2: 30, 7: 20}, 0.81) == 7
    assert vectors._probes({}, 0.9) == 1


def test_sections(spark):
    heads = spark.createDataFrame([(1, 0, 1, "A", 0, 100), (1, 1, 2, "a", 10, 100), (1, 2, 2, "b", 20, 100), (1, 3, 1, "B", 50, 100), (1, 4, 2, "c", 60, 100)], "source_id long, pos int, level int, title string, start int, doc_end int")
    got = [(r.ordinal, r.end) for r in structure.outline(heads).orderBy("pos").collect()]
    assert got == [(1, 50), (1, 20), (2, 50), (2, 100), (1, 100)]


def test_line_blocks_are_byte_exact(spark):
    text = "é one\n\n  \nzwei 中\nlast"
    for r in structure.line_blocks(spark.createDataFrame([(1, text)], "source_id long, text string")).collect():
        assert text.encode()[r.byte_start : r.byte_end].decode() == r.text


def test_children_tile_parents(spark):
    words = [f"w{i}" for i in range(1200)]
    p = structure.parents(spark.createDataFrame([(1, " ".join(words))], "source_id long, text string"))
    assert [r.n_tokens for r in p.orderBy("parent_no").collect()] == [512, 512, 176]
    for r in p.collect():
        kids = [k.text.split() for k in structure.children(p.where(F.col("parent_no") == r.parent_no)).orderBy("child_no").collect()]
        assert kids[0] + [w for k in kids[1:] for w in k[16:]] == r.text.split()


def test_auto_merge_needs_half(spark):
    children = spark.createDataFrame([(i, 1) for i in range(4)] + [(10 + i, 2) for i in range(4)] + [(20, None)], "chunk_id long, parent_id long")
    hits = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.9), (1, 10, 0.3), (1, 20, 0.2)], "query_id long, chunk_id long, score double")
    assert {(r.unit_id, r.merged, r.score) for r in router.auto_merge(hits, children).collect()} == {(1, True, 0.9), (10, False, 0.3), (20, False, 0.2)}


def test_budget_stops_at_first_overflow(spark):
    u = spark.createDataFrame([(1, 0, 5), (1, 1, 9), (1, 2, 1), (2, 0, 99)], "g int, n int, tokens int")
    assert {(r.g, r.n) for r in router.budget_cut(u, 10, "g", ["n"]).collect()} == {(1, 0), (2, 0)}


def test_tier_caps():
    assert router.tier_caps(0) == (4000, 16000)
    assert router.tier_caps(8192) == (3660, 5632) and router.tier_caps(200_000)[0] == 48_000
    assert router.tier_caps(8192, reserved=10**9)[1] == 2816


def test_known_pagerank(spark):
    nodes = spark.createDataFrame([(c,) for c in "ABCD"], "node_id string")
    e = [("A", "B", 1.0), ("A", "C", 0.5), ("B", "C", 1.0), ("C", "A", 0.5), ("C", "D", 1.0)]
    edges = graph.weighted(spark.createDataFrame([(a, b, "r", 1.0, c) for a, b, c in e], "from_node string, to_node string, relation string, weight double, confidence double"))
    for seeds, want in ((["A"], (0.36164185, 0.20493038, 0.27665602, 0.15677174)), (["A", "D"], (0.28181583, 0.15969564, 0.21558911, 0.34289942))):
        got = {r.node_id: r.score for r in graph.pagerank(nodes, edges, spark.createDataFrame([(s,) for s in seeds], "seed string"), rounds=48, epsilon=1e-6).collect()}
        assert abs(sum(got.values()) - 1) < 1e-9 and np.allclose([got[c] for c in "ABCD"], want, atol=1e-5)


def test_recall_counts_missing_gold(spark):
    gold = spark.createDataFrame([(1, "e"), (1, "z"), (2, "q")], "query_id long, chunk_id string")
    got = {r.query_id: (r.recall, r.hit) for r in evaluate.recall(ranked(spark, *"abcde"), gold, 5).collect()}
    assert got == {1: (0.5, True), 2: (0.0, False)}


def test_nearest_rank_p95(spark):
    assert evaluate.p95(spark.range(1, 21), "id").first().p95 == 19


def test_components_of_chains(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    got = {r.node: r.component for r in resolve.components(pairs).collect()}
    assert set(got[i] for i in range(41)) == {0} and got[101] == 100


def test_canonical_is_longest_then_first(spark):
    g = spark.createDataFrame([(1, "bb"), (1, "aaa"), (1, "aab"), (2, "x")], "component int, name string")
    assert [(r.component, r.canonical, r.n) for r in resolve.canonical_names(g).collect()] == [(1, "aaa", 3)]


def test_add_sources_first_wins(spark):
    old = spark.createDataFrame([("n", "h", 5, False), ("n", "t", 1, True)], "notebook_id string, raw_content_hash string, source_id long, trashed boolean")
    new = spark.createDataFrame([("n", "h", 7), ("n", "t", 8), ("n", "t", 9)], "notebook_id string, raw_content_hash string, source_id long")
    assert {(r.source_id, r.winner_id, r.was_existing) for r in catalog.add_sources(new, old).collect()} == {(7, 5, True), (8, 8, False), (9, 8, True)}


def test_substitutions_skip_what_does_not_fit(spark):
    s = spark.createDataFrame([("He met her. He left.", [(0, 2, "He", "Bob"), (7, 10, "her", "Ann"), (8, 12, "er. ", "X"), (12, 14, "It", "Y"), (12, 14, "He", "Bob")])], "t string, s array<struct<start:int,stop:int,mention:string,antecedent:string>>")
    assert s.select(enrich.substituted(F.col("t"), F.col("s")).alias("x")).first().x == "Bob met hXBob left."


def test_history_pairs(spark):
    m = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "q2"), (1, 3, "user", "q3"), (1, 4, "assistant", " ")], "conv_id long, turn long, role string, text string")
    assert [(r.turn_id, r.answer) for r in answer.turn_pairs(m).collect()] == [(0, "a")]


SOURCES = [
    (1, "json", '{"b": [1, {"c": null}], "a": "x"}'),
    (2, "jsonl", '{"k": 1}\nnot json\n\n{"k": 2}'),
    (3, "yaml", "a: 1\n---\nb: two\n"),
    (4, "csv", "﻿Name,Age\nAda,36\nBob\n"),
    (5, "xml", '<r x="1"><a>one</a><b/></r>'),
    (6, "text", "one\ntwo\n\n\nthree é\n"),
    (7, "markdown", "# A\npara\n\n## B ##\n- item\n- \n```\ncode # no\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n\nSet\n===\n<div>x</div>"),
    (8, "html", "<html><head><title>t</title></head><body><nav>no</nav><h1>Head</h1><p>Some <b>bold</b> text</p><ul><li>x</li></ul><script>bad()</script></body></html>"),
    (9, "rtf", r"{\rtf1{\fonttbl{\f0 A;}}First\par Sec\u233?ond\par }"),
    (10, "json", "{broken"),
    (11, "exe", "x"),
    (12, "json", None),
]
WANT = {
    1: ["/a: x", "/b/0: 1", "/b/1/c: null"],
    2: ["/0/k: 1", "/1/k: 2"],
    3: ["/0/a: 1", "/1/b: two"],
    4: ["Name: Ada; Age: 36", "Name: Bob; Age: "],
    5: ["@x=1 ", "one"],
    6: ["one\ntwo", "three é"],
    7: ["A", "para", "B", "item", "code # no", "| a | b |\n|---|---|\n| 1 | 2 |", "Set", "<div>x</div>"],
    8: ["Head", "Some bold text", "x"],
    9: ["First", "Secéond"],
}


def test_extractors(spark):
    out = extract.blocks(spark.createDataFrame(SOURCES, "source_id long, kind string, raw string")).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.source_id, r.block_no)):
        if r.error is None:
            got.setdefault(r.source_id, []).append(r.text)
    assert got == WANT
    assert {r.source_id for r in out if r.error} == {10, 11}
    assert [r.section_path for r in out if r.source_id == 7 and r.text in ("item", "Set")] == ["A > B", "Set"]


def test_text_blocks_are_byte_exact(spark):
    text = "é one\ntwo \n\n\n  three 中\n"
    for _, _, block, at in extract.EXTRACTORS["text"](text):
        a, b = map(int, at.split(":"))
        assert text.encode()[a:b].decode() == block


def test_streams_equal_batches(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = events.read_stream(spark, str(tmp_path / "in"), e)
    q = events.tumbling(stream, late="3650 days").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    batch = events.tumbling(e).withColumn("window_start", F.col("window_start").cast("timestamp"))
    assert spark.table("windows").exceptAll(batch).count() == 0 and spark.table("windows").count() == batch.count()


def test_ingestion_goes_on_from_its_checkpoint(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id")
    for i in range(2):
        e.where(F.col("event_id") % 2 == i).coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))
        stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in/*"))
        events.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "ck"), key="event_id")
        assert spark.read.parquet(str(tmp_path / "out")).count() == e.where(F.col("event_id") % 2 <= i).count()
