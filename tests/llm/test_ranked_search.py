"""Ranked search against scoring of every document for every item."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from stratum.llm import ranked_search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def all_scores(docs, items, k=10):
    """(item, rank, id, score) by scoring everything; docs and items are lists of (id, text)."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = defaultdict(Counter)
    for i, t in items:
        asked[i].update(terms(t))
    out = []
    for item, of in asked.items():
        hits = []
        for i, c in counted:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_terms if n_terms else 0
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in of.items() if t in c)
            if s > 0:
                hits.append((-s, (i is not None, i or 0), i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(hits)[:k], 1)]
    return out


def told(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def corpus(seed, n=900):
    """Zipf words, many equal texts, so many equal scores."""
    rng = random.Random(seed)
    words = [f"w{i}" if i % 7 else f"Wörd{i}" for i in range(400)]
    weight = [1 / (i + 1) for i in range(400)]
    texts = [" ".join(rng.choices(words, weight, k=rng.choice([1, 3, 20, 80]))) for _ in range(n)]
    return [(rng.randrange(10**9), texts[rng.randrange(n)] if rng.random() < 0.4 else t) for t in texts], [(i, " ".join(rng.choices(words, weight, k=rng.choice([1, 4, 30])))) for i in range(40)]


@pytest.mark.parametrize("seed,most_docs,most_terms,block", [(1, 16_384, 3_000_000, 200_000), (2, 50, 3_000_000, 60), (3, 16_384, 500, 200_000)])
def test_search_against_all_scores(spark, seed, most_docs, most_terms, block):
    docs, items = corpus(seed)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    index = ranked_search.build(frame, most_docs, most_terms)
    assert index.lengths.count() == {1: 3, 2: 18}.get(seed, index.lengths.count()) and (seed != 3 or index.lengths.count() > 18)
    assert told(index.search(asked, block_terms=block)) == sorted(all_scores(docs, items), key=str)
    assert told(index.search(asked, 3, block_terms=block)) == sorted(all_scores(docs, items, 3), key=str)


def test_max_score_against_sums():
    """Random lists with small bounds, where many places tie at the k-th best score."""
    rng = np.random.default_rng(5)
    for n, k in ((5000, 10), (300, 1), (2500, 40), (7, 10)):
        for _ in range(20):
            lists, total = [], np.zeros(n, np.int64)
            for _ in range(rng.integers(1, 9)):
                at = np.flatnonzero(rng.random(n) < rng.choice([0.001, 0.05, 0.6]))
                adds, w = rng.integers(1, 4, len(at)), int(rng.integers(1, 6))
                if len(at):
                    lists.append((w * int(adds.max()), w, at, adds))
                    total[at] += w * adds
            want = [(int(i), int(total[i])) for i in np.lexsort((np.arange(n), -total))[:k] if total[i] > 0]
            for span in (16, ranked_search.RANGE):
                assert ranked_search.max_score(sorted(lists, key=lambda x: x[0]), n, k, span) == want


def test_lists_that_cannot_qualify_are_not_read():
    """Once ten documents hold the rare term, the common one is probed for few documents, and no candidate comes from it."""

    class Counting(np.ndarray):
        read = 0

        def __getitem__(self, key):
            out = super().__getitem__(key)
            Counting.read += np.size(out)
            return out

    n = 200_000
    rare, common = np.arange(0, n, 5000), np.arange(n)
    adds = np.ones(n, np.int64).view(Counting)
    got = ranked_search.max_score([(1, 1, common, adds), (50, 50, rare, np.ones(len(rare), np.int64))], n, 10)
    assert got == [(int(i), 51) for i in rare[:10]]
    assert Counting.read < n / 4


def test_search_edge_cases(spark, edge):
    """Nulls, repeats, very long texts and clashing columns; items without terms or of one id."""
    docs = [(r.doc_id, r.text) for r in edge.collect()] + [(8, "long words " * 400_000), (None, "test")]
    frame = edge.unionByName(spark.createDataFrame(docs[-2:], "doc_id long, text string"), allowMissingColumns=True)
    items = [(1, "TEST words here"), (1, "é z"), (2, None), (3, " .,; "), (None, "line long"), (None, "中文"), (4, "absent")]
    asked = spark.createDataFrame([(*x, 1, "a") for x in items], "item_id long, text string, rank int, term string")
    got = told(ranked_search.ranked_search(frame, asked))
    assert got == sorted(all_scores(docs, items), key=str)
    assert {r[0] for r in got} == {1, None} and any(r[2] is None for r in got)
    assert ranked_search.ranked_search(frame, asked.limit(0)).count() == 0
    assert ranked_search.ranked_search(frame.limit(0), asked).count() == 0
    assert ranked_search.ranked_search(frame.where("text is null"), asked).count() == 0
