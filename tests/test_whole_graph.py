"""The graph's list over all names of a chunk and of a question, with no bound on how many count."""

from itertools import combinations

from stratum.operators import graph, graph_list, mentions


def test_every_pair_of_a_chunk(spark):
    said = spark.createDataFrame([(n, 1) for n in range(35)] + [(n, 2) for n in (31, 33)], "node_id long, chunk_id long")
    told = {(r.from_node, r.to_node): r.weight for r in graph.cooccurrence(said, None).collect()}
    assert told == {p: 1 + (p == (31, 33)) for p in combinations(range(35), 2)}
    assert graph.cooccurrence(said).count() == 30 * 29 // 2 + 1  # what other queries ask for


def world(spark, names):
    nodes = spark.createDataFrame([("n", i, name, None, 0) for i, name in enumerate(names)], "notebook_id string, node_id long, name string, canonical string, kind int")
    edges = spark.createDataFrame([(0, 1, "knows", 1.0)], "from_node long, to_node long, relation string, w double")
    said = spark.createDataFrame([(i, 100 + i) for i in range(len(names))], "node_id long, chunk_id long")
    chunks = spark.createDataFrame([(100 + i, 1, 0) for i in range(len(names))], "chunk_id long, level int, token_start long")
    return graph_list.Graph(nodes, edges, said, chunks)


def test_all_names_of_a_long_question(spark):
    """More than 64 names, the last after more than 64 words, and one of seven words."""
    names = [f"name{i:02d}" for i in range(70)] + ["one two three four five six seven"]
    text = "who measured and compared " + " with ".join(names[:70]) + " and One, two three four five six seven"
    q = spark.createDataFrame([(1, "n", text)], "query_id long, notebook_id string, text string")
    got = graph_list.graph_list(q, world(spark, names), k=100, rounds=3, epsilon=0.0).collect()
    assert {r.chunk_id for r in got if r.conf == 1.0} == {100 + i for i in range(71)}


def test_a_question_whose_names_come_late(spark):
    """It says enough besides its name, and the name is found where it stands."""
    q = spark.createDataFrame([(1, "n", "compare " * 80 + "name01")], "query_id long, notebook_id string, text string")
    g = world(spark, ["name00", "name01"])
    assert [(r.chunk_id, r.conf) for r in graph_list.graph_list(q, g, rounds=3, epsilon=0.0).where("conf = 1").collect()] == [(101, 1.0)]
    assert mentions.seeds(g.nodes.select("node_id", "name"), q).count() == 0  # as question_seeds has it
