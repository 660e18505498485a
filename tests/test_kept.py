"""A kept index: what is added, changed and deleted, against an index made anew."""

import random

import pytest

from stratum.operators import kept, lexical

WORDS = [f"w{i}" for i in range(60)]


def told(frame):
    return sorted((r.query_id, r.rank0, r.chunk_id, round(r.score, 9)) for r in frame.collect())


@pytest.fixture()
def world(spark, tmp_path):
    rng = random.Random(7)
    text = lambda: " ".join(rng.choices(WORDS, k=rng.randint(0, 30)))
    frame = lambda rows: spark.createDataFrame(sorted(rows.items()), "chunk_id long, text string")
    asked = spark.createDataFrame([(i, " ".join(rng.sample(WORDS, 3))) for i in range(8)] + [(9, None), (10, "absent")], "query_id long, text string")
    state = {i: text() for i in range(80)} | {500: None}
    return text, frame, asked, state, kept.create(spark, str(tmp_path / "index"), frame(state))


def same(world, index, state):
    _, frame, asked, _, _ = world
    for every in (True, False):
        assert told(lexical.bm25(frame(state), asked, every=every, lists=index)) == told(lexical.bm25(frame(state), asked, every=every))


def test_changes_equal_a_fresh_index(spark, world):
    text, frame, asked, state, index = world
    same(world, index, state)
    new = {i: text() for i in range(100, 106)}
    changed = {i: text() for i in range(0, 12, 4)}
    index.change(frame(new | changed), frame({5: "", 7: "", 999: ""}).select("chunk_id"))
    state = {k: v for k, v in (state | new | changed).items() if k not in (5, 7)}
    assert index.segments() == [1, 2]
    same(world, index, state)
    back = {5: text(), 100: text()}  # deleted and comes back, new and changed again; 8 goes and comes in one change
    index.change(frame(back | {8: "w1 w2 w3"}), frame({8: "", 101: ""}).select("chunk_id"))
    state = {k: v for k, v in (state | back | {8: "w1 w2 w3"}).items() if k != 101}
    assert index.segments() == [1, 2, 3]
    same(world, index, state)
    many = {i: text() for i in range(200, 230)}
    index.change(frame(many))  # the later segments have grown
    assert index.segments() == [5]
    same(world, index, state | many)
    assert sorted(r.chunk_id for r in index.lengths().collect()) == sorted(state | many)


def test_a_write_that_fails_is_not_seen(spark, world):
    text, frame, asked, state, index = world
    extra = frame({300: "w1 w2"})
    index._write(2, *index._indexed(extra), extra.select("chunk_id"))  # stopped before the log names it
    assert index.segments() == [1]
    same(world, index, state)
    index.change(frame({301: "w1 w3 w5"}), frame({0: ""}).select("chunk_id"))
    same(world, index, {k: v for k, v in state.items() if k} | {301: "w1 w3 w5"})


def test_only_partitions_of_the_terms_are_read(spark, world):
    _, _, asked, _, index = world
    terms = spark.createDataFrame([("w1",)], "term string")
    plan = index.hits(terms)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket), ", "") or "PartitionFilters: [isnotnull(bucket" in plan
    assert {r.term for r in index.hits(terms).collect()} == {"w1"}


def test_terms_are_counted_where_lists_lie(spark):
    from pyspark.sql import functions as F

    rows = [(1, ["b", "a", "b", "", "a", "b"]), (2, []), (3, None), (4, ["z"])]
    got = spark.createDataFrame(rows, "chunk_id long, terms array<string>").select("chunk_id", F.explode(kept.counted(F.col("terms"))).alias("x")).select("chunk_id", "x.*")
    assert sorted(map(tuple, got.collect())) == [(1, "", 1), (1, "a", 2), (1, "b", 3), (4, "z", 1)]
    # postings pass between tasks as a few rows a chunk: no exchange by term
    chunks = spark.range(3).selectExpr("id AS chunk_id", "concat_ws(' ', 'x', id, 'x', 'é É e') AS text")
    index = kept.KeptIndex(spark, "nowhere")
    plan = index._indexed(chunks)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
    got = sorted(map(tuple, index._indexed(chunks)[0].collect()))
    assert got == sorted(x for i in range(3) for x in [("x", i, 2, 6), (str(i), i, 1, 6), ("e", i, 3, 6)])
