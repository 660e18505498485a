"""Copies of a text tie, in whatever order their terms' scores are added."""

import random

from stratum.operators import lexical


def test_copies_have_one_score(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    of = lambda n: " ".join(rng.choices(words, k=n))
    texts = [of(60) for _ in range(8)]
    chunks = [(i, texts[i % 8]) for i in range(160)] + [(1000 + i, of(rng.randrange(5, 90))) for i in range(300)]
    queries = [(i, " ".join(rng.sample(sorted(set(texts[i % 8].split())), 30))) for i in range(16)]
    c, q = spark.createDataFrame(chunks, "chunk_id long, text string").repartition(7), spark.createDataFrame(queries, "query_id long, text string")
    for every in (True, False):
        rows = lexical.bm25(c, q, k=20, every=every).collect()
        for i, _ in queries:
            own = sorted((r.rank0, r.chunk_id, r.score) for r in rows if r.query_id == i and r.chunk_id % 8 == i % 8 and r.chunk_id < 160)
            assert len(own) == 20 and len({s for *_, s in own}) == 1
            assert [c for _, c, _ in own] == sorted(c for _, c, _ in own)
