"""Confidence of the way into a group, against all ways."""

import random

from stratum.operators import resolve


def widest(edges, nodes):
    """node -> (least node of its group, the weakest edge on the best way from it)."""
    best = {(n, n): float("inf") for n in nodes}
    for a, b, c in edges:
        best[a, b] = max(c, best.get((a, b), 0))
        best[b, a] = max(c, best.get((b, a), 0))
    for k in nodes:
        for i in nodes:
            for j in nodes:
                if (i, k) in best and (k, j) in best:
                    best[i, j] = max(best.get((i, j), 0), min(best[i, k], best[k, j]))
    least = {n: min(m for m in nodes if (n, m) in best) for n in nodes}
    out = {n: (least[n], best[least[n], n]) for n in nodes}
    return {n: (g, c if n != g else min(v for m, (h, v) in out.items() if h == g and m != n)) for n, (g, c) in out.items()}


def test_path_confidence_against_all_ways(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(40), rng.randrange(40), rng.randrange(1, 60) / 60) for _ in range(34)] + [(i, i + 1, (i * 7 % 30 + 1) / 31) for i in range(100, 118)] + [(200, 200, 0.5)]
    frame = spark.createDataFrame(edges, "u long, v long, confidence double")
    real = [e for e in edges if e[0] != e[1]]
    want = widest(real, sorted({n for a, b, _ in real for n in (a, b)}))
    groups = resolve.components(frame)
    assert {r.node: r.component for r in groups.collect()} == {n: g for n, (g, _) in want.items()}
    for kw in ({}, {"bundle": 5}, {"most": 0}, {"most": 10}):
        got = {r.node: (r.component, r.confidence) for r in resolve.path_confidence(frame, groups, **kw).collect()}
        assert got == want, kw
    # a weak edge hangs on one node, and doesn't lower the others
    weak = spark.createDataFrame([(1, 2, 1.0), (2, 3, 0.95), (3, 4, 0.2)], "u long, v long, confidence double")
    assert {r.node: r.confidence for r in resolve.path_confidence(weak, resolve.components(weak)).collect()} == {1: 0.2, 2: 1.0, 3: 0.95, 4: 0.2}


def test_edges_are_shortened_in_place():
    """Stars link what the edges linked, however they are cut and of whatever type."""
    import pyarrow as pa

    from stratum.operators import components

    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(240)]
    for name in (str, lambda i: i):
        batches = [pa.RecordBatch.from_pydict({"u": [name(a) for a, _ in edges[i : i + 50]], "v": [name(b) for _, b in edges[i : i + 50]]}) for i in range(0, 240, 50)]
        for most in (60, 10**6):
            was, components.LOCAL = components.LOCAL, most
            try:
                out = [(a, b) for x in components.shortened(iter(batches)) for a, b in zip(*(c.to_pylist() for c in x.columns))]
            finally:
                components.LOCAL = was
            nodes = [name(i) for i in range(300)]

            def groups(pairs):
                to = {n: n for n in nodes}

                def find(x):
                    while to[x] != x:
                        x = to[x]
                    return x

                for a, b in pairs:
                    to[find(a)] = find(b)
                return {frozenset(n for n in nodes if find(n) == r) for r in {find(n) for n in nodes}}

            assert groups(out) == groups((name(a), name(b)) for a, b in edges)
            assert most < 10**6 or all(sum(a == x for x, _ in out) == 1 for a, _ in out)
