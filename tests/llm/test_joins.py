"""Similarity joins, line dedup and components against brute force."""

import random
from collections import defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.llm import embed_dedup, line_dedup, ngram_join
from stratum.llm.components import components

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def near_copies(seed, n_groups=12, copies=14):
    """Groups of texts with a few words changed, some chained, and texts that share a long passage only."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(60)]
    out = []
    for _ in range(n_groups):
        base = [word() for _ in range(rng.choice([3, 8, 40, 120, 300]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 60))):
                w[rng.randrange(len(w))] = word()
            base = w if rng.random() < 0.3 else base
            out.append(" ".join(w))
    out += [" ".join([word() for _ in range(100)] + passage) for _ in range(60)]
    rng.shuffle(out)
    return {i * 3 + 1: t for i, t in enumerate(out)}


@pytest.mark.parametrize("seed,few,block", [(1, 32, 1024), (2, 2, 5), (3, 1, 1024)])
def test_jaccard_join_components(spark, monkeypatch, seed, few, block):
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    texts = near_copies(seed)
    sets, links = brute.jaccard_links(texts, 4, 85)
    want = brute.reach(texts, links)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], COLUMNS).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(docs).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in texts}


def test_jaccard_join_edge_cases(spark, edge):
    out = ngram_join.jaccard_join(edge).collect()
    assert len(out) == edge.count()
    by = {r.doc_id: r for r in out}
    assert by[1].component_id == 1 == by[5].component_id  # equal but for case, in repeated rows too
    assert by[2].n_shingles == by[3].n_shingles == by[4].n_shingles == 0 and by[2].component_id == 2
    assert ngram_join.jaccard_join(edge.limit(0)).count() == 0
    kept = ngram_join.keep_one(edge)
    assert kept.columns == edge.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 7]


@pytest.mark.parametrize("near_chars", [line_dedup.NEAR_CHARS, 1])
def test_line_dedup_matches_brute_force(spark, near_chars):
    rng = random.Random(5)
    base = ["".join(rng.choice("abc é") for _ in range(rng.choice([0, 3, 15, 16, 17, 31, 32, 33, 40]))) for _ in range(40)]
    docs = {}
    for d in range(1, 60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            s = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                i = rng.randrange(len(s) + 1)
                s = rng.choice([s[:i] + "x" + s[i:], s[:i] + s[i + 1 :], s[:i] + "y" + s[i + 1 :]])
            lines.append(s)
        docs[d] = "\n".join(lines)
    docs[60] = None
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame([(i, t, None, None, None) for i, t in docs.items()], COLUMNS).repartition(4), near_chars).collect()}
    assert got == brute.lines_kept(docs, near_chars)


def test_line_dedup_edge_cases(edge):
    clash = edge.withColumn("n_lines", F.lit("mine")).withColumn("gone", F.lit(1))
    out = line_dedup.dedup_lines(clash)
    assert out.columns == [*clash.columns, "n_lines_", "n_kept"]
    rows = out.collect()
    assert len(rows) == edge.count()
    assert [r.text for r in rows if r.doc_id == 2] == [None] and [r.text for r in rows if r.doc_id == 4] == ["   \t\n "]
    assert len({r.text for r in rows if r.doc_id == 5}) == 1
    assert line_dedup.dedup_lines(edge.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2080)] + [(5, 5)]
    want = brute.reach({x for e in edges for x in e}, edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(n, n) == c for n, c in want.items())
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_vectors(rows):
    good = {}
    for n, (_, v) in enumerate(rows):
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            good[n] = np.array(v) / np.linalg.norm(v)
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.9]
    return links


@pytest.mark.parametrize("block", [1024, 4])
def test_embedding_dedup(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(12):
        c = rng.normal(size=16)
        rows += [(None, (c + 0.04 * rng.normal(size=16)).tolist()) for _ in range(12)]
    rows += [(None, rng.normal(size=16).tolist()) for _ in range(100)]
    rows += [rows[0], rows[0], (None, [2 * x for x in rows[0][1]]), (None, None), (None, []), (None, [0.0] * 16), (None, [None] * 16), (None, [float("nan")] * 16), (None, [1e300] * 16), (None, rng.normal(size=8).tolist())]
    rows = [(i * 2 + 1, v) for i, (_, v) in enumerate(rows)]
    links = brute_vectors(rows)
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    comp = brute.reach(range(len(rows)), links)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"n_links": F.lit(1), "component": F.lit("x")})
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_dedup(df).collect()}
    want = {rows[i][0]: (n[i], rows[comp[i]][0], comp[i] == i) for i in range(len(rows))}
    found, exist = sum(x[0] for x in got.values()), sum(x[0] for x in want.values())
    assert found <= exist and found >= 0.98 * exist
    assert sum(got[k] == want[k] for k in want) >= 0.95 * len(want)
    assert embed_dedup.near_dedup(df.limit(0)).count() == 0


def test_embedding_recall_on_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in e.collect()]
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = int((x @ x.T >= 0.9).sum() - len(x))
    got = embed_dedup.near_dedup(e).agg(F.sum("n_links")).first()[0]
    assert 0.9 * want <= got <= want
