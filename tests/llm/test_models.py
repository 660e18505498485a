"""Language ID and toxicity: held-out quality, edge cases, bounds of the samples."""

import zlib
from collections import Counter
from math import log

import brute
import numpy as np
from pyspark.sql import functions as F

from stratum.llm import langid, toxicity

D = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    out = langid.report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_language_edge_cases(spark, edge):
    net = langid.fit(spark.read.parquet(f"{D}/documents.parquet"), per_lang=200)
    clash = edge.withColumn("score", F.lit("x"))
    out = langid.identify(clash, net).collect()
    assert len(out) == edge.count()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in out)
    assert langid.identify(edge.limit(0), net).count() == 0
    assert {r.lang_pred for r in langid.identify(edge, None).collect()} == {"und"}


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (3, 12)).astype(np.uint8), np.array([0, 1, 1])
    net = langid.Network(["a", "b"], rng.normal(size=(256, langid.DIM)), [rng.normal(size=(w, langid.DIM, langid.FILTERS)) for w in langid.WIDTHS], rng.normal(size=len(langid.WIDTHS) * langid.FILTERS), rng.normal(size=(len(langid.WIDTHS) * langid.FILTERS, 2)), np.zeros(2))

    def loss():
        tables = [np.einsum("bd,wdf->wbf", net.embed, k) for k in net.filters]
        return -langid.log_softmax(langid.pooled(x, net, tables) @ net.out + net.out_bias)[np.arange(3), y].mean()

    grads = langid._gradients(net, x, y)
    params = [net.embed, *net.filters, net.bias, net.out, net.out_bias]
    for p, g in zip(params, grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 1e-5
        up = loss()
        p[at] = old - 1e-5
        down = loss()
        p[at] = old
        assert abs((up - down) / 2e-5 - g[at]) < 1e-4 * max(1, abs(g[at])) + 2e-3


def test_toxic_documents_score_higher(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = toxicity.report(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    y, s = out["toxic"].to_numpy(), out["score"].to_numpy()
    rank = s.argsort().argsort()
    n1, n0 = y.sum(), (1 - y).sum()
    assert (rank[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * n0) > 0.9
    assert ((out.predicted == 1) == (out.score >= 0.3)).all() and out.score.between(0, 1).all()


def test_toxicity_edge_cases(spark, edge):
    rows = [(i, ("awful " if i % 2 else "fine ") * 3 + f"w{i % 5}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(edge.withColumn("score", F.lit("x")), model).collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
    bad, good = (r.score for r in toxicity.score(spark.createDataFrame([(1, "awful thing"), (2, "fine thing")], "doc_id long, text string"), model).orderBy("doc_id").collect())
    assert bad > 0.5 > good
    assert toxicity.report(docs, labels.limit(0)).agg(F.max("score")).first()[0] == 0.0
    assert toxicity.report(docs, labels.where("toxic = 1")).agg(F.min("score")).first()[0] == 1.0
    assert toxicity.report(docs.limit(0), labels).count() == 0


def test_every_language_is_learned(spark):
    docs = spark.range(100 * 12).selectExpr("id AS doc_id", "concat('lang', id % 100) AS lang", "repeat(concat('word', id % 100, ' '), 200) AS text")
    assert langid.sample(docs).select("lang").distinct().count() == 100
    few = langid.sample(docs, total=100).groupBy("lang").count().collect()
    assert len(few) == 100 and sum(r["count"] for r in few) < 600


def test_network_against_a_plain_forward_pass():
    rng = np.random.default_rng(4)
    net = langid.Network(["a", "b", "c"], rng.normal(size=(256, langid.DIM)), [rng.normal(size=(w, langid.DIM, langid.FILTERS)) for w in langid.WIDTHS], rng.normal(size=len(langid.WIDTHS) * langid.FILTERS), rng.normal(size=(len(langid.WIDTHS) * langid.FILTERS, 3)), rng.normal(size=3))
    texts = ["Hello there", "é" * 300 + " end", None, "", "12 !?", "x" * 1000]
    langs, scores = langid.predict(texts, net, net.tables())
    for text, lang, score in zip(texts, langs, scores):
        want = brute.forward(net, text, langid.WINDOW)
        assert (lang, score) == ("und", 0.0) if want is None else lang == want[0] and abs(score - want[1]) < 1e-4


def test_kneser_ney_against_a_recount(spark):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcde"), rng.integers(1, 12))) for _ in range(60)]
    texts = [(" ".join(rng.choice(words, 30)), int(c)) for c in (0, 1) * 20]
    rows = spark.createDataFrame([(i, t, c, 0) for i, (t, c) in enumerate(texts)], "doc_id long, text string, toxic int, part int")
    pairs, rest = toxicity.modelled(toxicity.counted(rows))
    counts = (Counter(), Counter())
    for t, c in texts:
        for w in t.split():
            counts[c].update(toxicity.grams(w))
    p, letters = brute.kneser_ney(counts, toxicity.ORDER, toxicity.DISCOUNT)
    got = {(r["history"], r["next"]): (r.p0, r.p1) for r in pairs.collect()}
    assert got.keys() == counts[0].keys() | counts[1].keys()
    assert all(abs(got[g][c] - p(c, *g)) < 1e-9 for g in got for c in (0, 1))
    for h in ("\x02", "\x02" + words[0][:1]):  # what a model says of all characters and one unseen is 1
        assert abs(sum(p(0, h, x) for x in [*letters, None]) - 1) < 1e-9
    table = lambda df: toxicity._table(df)
    model = toxicity.Model("m", table(pairs.select(F.concat("history", "next"), F.log(F.col("p1") / F.col("p0")))), table(rest.select("history", F.log(F.col("rest1") / F.col("rest0")))), np.zeros(5))
    known = toxicity.Differences(model)
    asked = [*words[:20], "zz", "abz", "é", "abcdeabcdeabcde"]
    known.learn(asked)
    for w in asked:
        assert abs(known[w] - sum(log(p(1, *g) / p(0, *g)) for g in toxicity.grams(w))) < 1e-3


def test_hashes_of_grams_agree():
    words = ["a", "word", "longer-than-the-order", "naïve", "😀x"]
    place, gram, less = toxicity.spelled([toxicity.START + w + toxicity.END for w in words])
    want = [g for w in words for g in toxicity.grams(w)]
    at = np.flatnonzero(place)
    assert (gram[at] == toxicity.hashed([h + x for h, x in want])).all()
    assert (less[at - 1] == toxicity.hashed([h for h, _ in want])).all()


def test_sample_is_bounded_in_documents_and_characters(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('word ', 20) AS text").union(spark.createDataFrame([(5000, "x" * 5000)], "doc_id long, text string"))
    labels = docs.selectExpr("doc_id", "1 AS quality", "cast(doc_id % 2 AS int) AS toxic")
    few, sizes = toxicity.labelled(docs, labels, max_docs=200)
    assert 200 < few.count() < 600 and sum(sizes.values()) > 2000
    short = toxicity.labelled(docs, labels, max_chars=20_000)[0]
    assert 200 < short.count() < 600 and short.agg(F.max(F.length("text"))).first()[0] == 100
