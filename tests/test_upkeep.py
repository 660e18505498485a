"""Upkeep, resolution and terms on small inline tables, and the queries without SQL against plain Python."""

import ipaddress
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.functions import address
from stratum.functions import text as T
from stratum.functions.embed import embedded
from stratum.operators import evaluate, graph, lexical, mentions, resolve, upkeep
from stratum.plans import catalog
from stratum.sources import extract, tables

SMALL = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw,want", [("Café CAFÉ cafe\u0301", ["cafe"] * 3), ("हिन्दी भाषा", ["हिन्दी", "भाषा"]), ("Straße-Ärger", ["straße", "arger"]), ("Ελλάς Ёлка", ["ελλας", "елка"]), ("a_b 12\u00a03", ["a", "b", "12", "3"]), ("", [])])
def test_index_terms_are_folded_and_keep_marks(spark, raw, want):
    assert one(spark, T.index_terms(F.col("q")), q=raw) == want
    assert one(spark, T.query_terms(F.col("q")), q=raw + " AND") == list(dict.fromkeys(want))


def test_holders_agree_with_contains(spark):
    texts = {1: "The cat sat on the mat today", 2: "a cat sat", 3: "mat", 4: "the cat sat on the mat today, twice: sat on the mat"}
    passages = {1: "cat sat on the", 2: "mat", 3: "t sat on t", 4: "absent words here now", 5: "sat on"}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id long, text string")
    asked = spark.createDataFrame(list(passages.items()), "query_id long, text string")
    got = {tuple(r) for r in lexical.holders(lexical.term_lists(chunks), chunks, asked).collect()}
    assert got == {(q, c) for q, p in passages.items() for c, t in texts.items() if p in t}


def test_names_of_many_words_are_found(spark):
    names = spark.createDataFrame([(1, "the long name of a very old place"), (2, "place"), (3, "...")], "node_id long, name string")
    chunks = spark.createDataFrame([(7, "In The long, name of a very old PLACE.")], "chunk_id long, text string")
    assert {tuple(r) for r in mentions.detect(names, chunks).collect()} == {(1, 7, 1, 8), (2, 7, 8, 1)}
    assert mentions.detect(names.limit(0), chunks).count() == 0


def test_gate_needs_a_corpus(spark):
    arms = spark.createDataFrame([("bridging", 1.0, 0.0, 10.0)], "kind string, graph double, hybrid double, ms double")
    corpus = spark.range(60).selectExpr("id % 3 AS source_id", "id AS chunk_id")
    assert evaluate.gate(arms, corpus).first().passed
    assert not evaluate.gate(arms, corpus.where("source_id < 2")).first().passed
    assert not evaluate.gate(arms, corpus.where("chunk_id < 40")).first().passed


@pytest.mark.parametrize("raw,want", [('{"a":1}\n\n[2]\nplain', True), ('{"a":1}', False), ("x\n{}\n{}", False), ('\ufeff1\r\n"b"\r\n', True), (None, False), ("", False)])
def test_jsonl_sniff(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(upkeep.is_jsonl(F.col("raw")).alias("x")).first().x is want


def test_transcripts_with_bad_times_give_nothing(spark):
    rows = [(1, 0, 0.0, 1.0, "é"), (1, 1, 1.0, 1.0, "b"), (2, 0, 0.0, float("nan"), "x"), (3, 0, -1.0, 2.0, "x"), (4, 0, None, 2.0, "x")]
    got = upkeep.transcript_blocks(spark.createDataFrame(rows, "source_id long, seg_no long, start double, end double, text string")).orderBy("seg_no").collect()
    assert [(r.source_id, r.byte_start, r.byte_end) for r in got] == [(1, 0, 2), (1, 4, 5)]


def test_nodes_of_a_source(spark):
    rows = [(1, 0, 1, "Alice", None), (1, 0, 2, "ALICE", None), (1, 1, 1, "alice", None), (1, 1, 2, "1999", None), (1, 2, 1, "alice", "a person"), (1, 2, 2, "Alice", "another"), (1, 2, 3, "Term", "new"), (1, 0, 5, " ", None)]
    got = {r.key: (r.name, r.kind, r.definition) for r in upkeep.built_nodes(spark.createDataFrame(rows, "source_id long, class int, pos int, name string, definition string")).collect()}
    assert got == {"alice": ("Alice", "concept", "a person"), "1999": ("1999", "date", None), "term": ("Term", "concept", "new")}


def test_resolution_end_to_end(spark):
    nodes = spark.createDataFrame([(1, "Ada L.", "p"), (2, "ada l", "p"), (3, "Ada Lovelace", "p"), (4, "Lovelace", "p"), (5, "Other", "p"), (6, "Ada L.", "q"), (7, "Countess", "p")], "node_id long, name string, kind string")
    angle = {1: 0.0, 3: 20.0, 4: 60.0, 5: 150.0, 6: 0.0}
    vectors = spark.createDataFrame([(i, [float(np.cos(np.radians(a))), float(np.sin(np.radians(a)))]) for i, a in angle.items()], "chunk_id long, vector array<double>")
    key = lambda a, b: one(spark, T.pair_key(F.lit("p"), F.lit(a), F.lit(b)))
    cache = spark.createDataFrame([(key("lovelace", "ada lovelace"), True, 0.9, "v1"), (key("ada l.", "lovelace"), True, 0.99, "v0")], "key string, same boolean, confidence double, prompt_version string")
    coref = spark.createDataFrame([(7, 1)], "u long, v long")
    got = {r.node_id: (r.canonical, round(r.confidence, 6)) for r in resolve.resolved(nodes, vectors, cache, "v1", coref).collect()}
    sure = {1: 0.9, 2: 1.0, 3: round(float(np.cos(np.radians(20))), 6), 4: 0.9, 7: 1.0}  # by the weakest link on the way from 1, and 1 by the least of those
    assert got == {i: ("Ada Lovelace", c) for i, c in sure.items()}
    after = {r.node_id: r.canonical for r in resolve.applied(nodes.withColumn("canonical", F.lit("stale")), resolve.resolved(nodes, vectors, cache, "v1", coref), "v1").collect()}
    assert after[5] is None and after[6] is None and after[4] == "Ada Lovelace"
    assert resolve.near_pairs(vectors.join(nodes.select(F.col("node_id").alias("chunk_id"), "kind"), "chunk_id").limit(0), nodes.selectExpr("node_id AS query_id", "kind", "array(1D) AS vector")).count() == 0


def test_expansion_leaves_out_seeds_and_dead_nodes(spark):
    nodes = spark.createDataFrame([(1, "a", None, "k"), (2, "A", None, "k"), (3, "b", None, "k"), (4, "c", "B", "k"), (5, "d", None, "k"), (6, "far", None, "k")], "node_id long, name string, canonical string, kind string")
    edges = spark.createDataFrame([(1, 3, "near", 2.0), (2, 4, "kin", 3.0), (3, 5, "near", 1.0), (5, 6, "near", 1.0), (1, 99, "near", 9.0)], "from_node long, to_node long, relation string, w double")
    seeds = spark.createDataFrame([(1, "a", "k"), (1, "unknown", "k")], "query_id long, name string, kind string")
    got = [tuple(r) for r in graph.expanded(nodes, edges, seeds).orderBy("rank0").collect()]
    assert got == [(1, "B", "k", "kin", 3.0, 1.0, 0), (1, "d", "k", "near", 1.0, 1 / 3, 1)]
    assert graph.expanded(nodes, edges, seeds.limit(0)).count() == 0


def test_hash_embedding_against_plain_python(spark):
    rows = catalog.QUERIES["hash_embedding"](spark, SMALL).collect()
    texts = {r.source_id: r.text for r in tables.sources(spark, SMALL).select("source_id", "text").collect()}
    for r in rows[:40]:
        v = np.zeros(64)
        for w in __import__("re").findall(r"[^\W_]+", (texts[r.source_id] or "").lower()):
            h = zlib.crc32(w.encode())
            v[h % 64] += -1 if h >> 31 else 1
        assert np.allclose(r.vector, v / max(np.linalg.norm(v), 1e-12), atol=2e-6)
    assert spark.range(1).select(embedded(F.lit("")).alias("v")).first().v == [0.0] * 64


def test_public_pages_against_plain_python(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in catalog.QUERIES["public_pages"](spark, SMALL).collect():
        host = urls[r.page_id].split("/")[2].split(":")[0] if "://" in (urls[r.page_id] or "") else ""
        try:
            inner = not ipaddress.ip_address(host).is_global
        except ValueError:
            inner = host in ("", "localhost") or host.endswith((".local", ".internal", ".localhost"))
        assert r.public == (not inner and urls[r.page_id].lower().startswith("http"))


@pytest.mark.parametrize("url,want", [("http://user@10.1.2.3:80/x", False), ("http://8.8.8.8", True), ("https://[2606:4700::1111]/", True), ("http://[::1]/", False), ("http://[fe80::1]", False), ("http://[::ffff:127.0.0.1]", False), ("http://[::ffff:8.8.4.4]", True), ("http://[2002:7f00:1::]", False), ("http://[2002:808:808::]", True), ("http://[2001:db8::1]", False), ("http://2130706433/", False), ("http://0x7f.1/", False), ("http://999.1.1.1/", False), ("http://100.100.0.1", False), ("http://224.0.0.1", False), ("ftp://a.com", False), ("http://a.com.", True), ("http://x.internal.", False), ("nothing", False), ("http:///p", False)])
def test_addresses(spark, url, want):
    assert one(spark, address.is_public(F.col("u")), u=url) is want


def test_snippets_and_text_blocks_against_the_texts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in catalog.QUERIES["citation_snippet"](spark, SMALL).collect():
        text = texts[r.source_id]
        assert r.text in text and 0 <= r.mark_start <= r.mark_stop <= len(r.text)
    got = {}
    for r in catalog.QUERIES["text_blocks"](spark, SMALL).collect():
        a, b = map(int, r.anchor.split(":"))
        assert texts[r.source_id].encode()[a:b].decode() == r.text
        got.setdefault(r.source_id, []).append((r.block_no, r.text))
    for i, t in texts.items():
        paragraphs = [p.strip() for p in __import__("re").split(r"\n[^\S\n]*(?:\n[^\S\n]*)+", t or "") if p.strip()]
        assert [x for _, x in sorted(got.get(i, []))] == paragraphs


def test_table_markdown_names_blank_headers(spark):
    df = spark.createDataFrame([(["", " "], [["a|b", "c"], ["d"]])], "h array<string>, r array<array<string>>")
    assert df.select(extract.table_markdown(F.col("h"), F.col("r")).alias("x")).first().x == "| Column 1 | Column 2 |\n| --- | --- |\n| a\\|b | c |\n| d |  |\n"
