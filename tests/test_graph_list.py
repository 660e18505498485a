"""Walks of many seed sets, seeds by name or nearness, and the list of chunks they give."""

import pytest

from stratum.operators import graph, graph_list


def power(edges, seeds, nodes, rounds=100, eps=1e-6):
    """Plain power iteration over {(a, b): w}."""
    out = {n: sum(w for (a, _), w in edges.items() if a == n) for n in nodes}
    home = {n: (n in seeds) / len(seeds) for n in nodes}
    rank = dict(home)
    for _ in range(rounds):
        lost = sum(r for n, r in rank.items() if not out[n])
        new = {n: (0.15 + 0.85 * lost) * home[n] + 0.85 * sum(rank[a] * w / out[a] for (a, b), w in edges.items() if b == n) for n in nodes}
        moved = sum(abs(new[n] - rank[n]) for n in nodes)
        rank = new
        if moved < eps:
            break
    return rank


WAYS = {(1, 2): 3.0, (1, 3): 1.5, (2, 3): 3.0, (3, 1): 1.5, (3, 4): 3.0, (6, 7): 1.0, (7, 6): 1.0, (8, 9): 2.0}


def test_walks_of_many_seed_sets(spark):
    """Whole graphs in a task and rounds of joins come to the same, for queries of one graph and of several."""
    edges = spark.createDataFrame([("x", a, b, "near", w) for (a, b), w in WAYS.items()] + [("y", 50, 51, "co_occurs", 1.0), ("y", 51, 52, "near", 2.0)], "of string, from_node long, to_node long, relation string, w double")
    sets = {10: {1}, 11: {1, 4}, 12: {6}, 13: {9}, 14: {3, 8}, 15: {42}}
    rows = [("x", q, s) for q, of in sets.items() for s in of] + [("x", 10, 1), ("x", 16, None), ("y", 17, 50), ("z", 18, 60)]
    seeds = spark.createDataFrame(rows, "of string, query_id long, seed long")
    nodes = {*range(1, 10), 42}
    told = lambda frame: {(r.query_id, r.node_id): r.score for r in frame.collect()}
    got = told(graph.walks_by(edges, seeds, "of"))
    for q, of in sets.items():
        want = power(WAYS, of, nodes)
        assert all(abs(got.get((q, n), 0.0) - want[n]) < 1e-9 for n in nodes), q
    other = power({(50, 51): 1.0, (51, 50): 1.0, (51, 52): 2.0}, {50}, {50, 51, 52})
    assert all(abs(got[17, n] - other[n]) < 1e-9 for n in (50, 51, 52)) and got[18, 60] == 1.0
    assert {q for q, _ in got} == {*sets, 17, 18}
    rounds = told(graph.walks(edges, seeds.select("query_id", "seed"), epsilon=1e-3))
    assert all(abs(rounds.get(k, 0.0) - v) < 2e-3 for k, v in got.items()) and {q for q, _ in rounds} == {q for q, _ in got}
    few = told(graph.walks(edges, seeds.select("query_id", "seed"), rounds=3, epsilon=0.0))
    again = told(graph.walks_by(edges, seeds, "of", rounds=3, epsilon=0.0, most_edges=2))  # x is over the bound, y isn't
    assert few.keys() == again.keys() and all(abs(few[k] - again[k]) < 1e-12 for k in few)
    assert graph.walks_by(edges, seeds.limit(0), "of").count() == 0


@pytest.fixture(scope="module")
def world(spark):
    """Notebook n: Ada knows Boole, Boole knows Curie; notebook m has an Ada of its own."""
    nodes = spark.createDataFrame([("n", 1, "Ada Byron", None, 0), ("n", 2, "Boole", None, 0), ("n", 3, "Curie", None, 0), ("n", 4, "M. Curie", "Curie", 0), ("m", 5, "Ada Byron", None, 0)], "notebook_id string, node_id long, name string, canonical string, kind int")
    edges = spark.createDataFrame([(1, 2, "knows", 3.0), (2, 4, "knows", 1.0)], "from_node long, to_node long, relation string, w double")
    said = spark.createDataFrame([(1, 100), (1, 100), (1, 101), (2, 102), (3, 103), (4, 103), (4, 104), (4, 100), (5, 200), (1, 999)], "node_id long, chunk_id long")
    chunks = spark.createDataFrame([(c, 1, c) for c in (100, 101, 102, 103, 104, 200)], "chunk_id long, level int, token_start long")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0]), (5, [1.0, 0.0])], "node_id long, vector array<double>")
    return graph_list.Graph(nodes, edges, said, chunks, vectors)


def asked(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id long, notebook_id string, text string, vector array<double>")


def test_graph_list(spark, world):
    q = asked(
        spark,
        (1, "n", "Who did Ada Byron inspire most?", [0.0, 1.0]),  # named
        (2, "m", "Who did Ada Byron inspire most?", [0.0, 1.0]),  # the other notebook's
        (3, "n", "Ada Byron?", [1.0, 0.0]),  # says nothing besides
        (4, "n", "whose computing engines inspired others", [1.0, 0.1]),  # nearest: Ada at about 1, Boole at 0.68
        (5, "n", "whose computing engines inspired others", [-1.0, -0.1]),  # nothing near
        (6, "n", None, None),
        (7, "gone", "Who did Ada Byron inspire most?", [1.0, 0.0]),
    )
    got = graph_list.graph_list(q, world).orderBy("query_id", "rank0").collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.chunk_id, round(r.conf, 6)))
    assert set(by) == {1, 2, 4}
    # Ada's chunks, the one that names her twice first; then Boole's at 1 and Curie's below, of which 100 counts already
    assert [c for c, _ in by[1]] == [100, 101, 102, 103, 104] and [v for _, v in by[1]][:3] == [1.0, 1.0, 1.0] and 0 < by[1][3][1] == by[1][4][1] < 1
    assert by[2] == [(200, 1.0)]
    assert by[4][:3] == [(100, 1.0), (101, 1.0), (102, 1.0)] and [c for c, _ in by[4]][3:] == [103, 104]
    assert [r.rank0 for r in got if r.query_id == 1] == [0, 1, 2, 3, 4]
    cut = graph_list.graph_list(q.where("query_id = 1"), world, k=2).orderBy("rank0").collect()
    assert [r.chunk_id for r in cut] == [100, 101]
    without = graph_list.Graph(world.nodes, world.edges, world.mentions, world.chunks)
    assert {r.query_id for r in graph_list.graph_list(q, without).collect()} == {1, 2}


