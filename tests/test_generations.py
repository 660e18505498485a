"""Generations that a stream fills, stopped anywhere."""

import pytest
from pyspark.sql import functions as F

from stratum.sources import sinks
from stratum.streaming import events, generations

SHAPE = "coordinate string, generation int, status string"


@pytest.fixture()
def world(spark, tmp_path):
    """Thirty rows in three files, one a micro-batch, and a registry with an active generation of another coordinate."""
    rows = spark.range(30).selectExpr("id AS chunk_id", "'t' || id AS text")
    rows.repartitionByRange(3, "chunk_id").write.parquet(str(tmp_path / "in"))
    root = str(tmp_path / "g")
    registry = sinks.activate(sinks.new_generation(rows, spark.createDataFrame([], SHAPE), root, "old"), "old")
    return root, spark.createDataFrame(registry.collect(), SHAPE), lambda: events.read_stream(spark, str(tmp_path / "in"), rows), str(tmp_path / "ck")


def told(frame):
    return sorted(tuple(r) for r in frame.collect())


def shown(spark, registry, root):
    return sorted((r["chunk_id"], r["v"]) for r in sinks.read_active(spark, registry, root, "new").collect())


def embed(rows):
    return rows.select("chunk_id", F.length("text").alias("v"))


WANT = [(i, len(f"t{i}")) for i in range(30)]


def test_a_stream_fills_and_flips(spark, world):
    root, registry, stream, ck = world
    now = generations.populated(stream(), registry, root, "new", ck, embed)
    assert told(now) == [("new", 1, "active"), ("old", 1, "active")] and shown(spark, now, root) == WANT
    assert told(generations.commits(spark, root, "new", 1)) == [(0, 10), (1, 10), (2, 10)]
    assert told(sinks.generation_folders(spark, root)) == [("new", 1), ("old", 1)]
    # the same generation run again: nothing new comes, nothing changes
    generations.filled(stream(), root, "new", 1, f"{ck}/new/gen=1", embed)
    assert shown(spark, now, root) == WANT


def test_embedding_anew_retires_the_old_coordinate(spark, world):
    root, registry, stream, ck = world
    now = spark.createDataFrame(generations.populated(stream(), registry, root, "new", ck, embed, replaces="old").collect(), SHAPE)
    assert told(now) == [("new", 1, "active"), ("old", 1, "stale")]
    assert told(sinks.swept(spark, now, root)) == [("new", 1, "active")] and shown(spark, now, root) == WANT


@pytest.mark.parametrize("when", ["before the line", "after the line", "while writing"])
@pytest.mark.parametrize("batch", [0, 2])
def test_a_stop_is_made_good(spark, world, monkeypatch, when, batch):
    root, registry, stream, ck = world
    real, seen = generations._committed, []

    def stops(line, path):
        at = len(seen)
        seen.append(path)
        if at == batch and when == "before the line":
            raise RuntimeError("stopped")
        real(line, path)
        if at == batch and when == "after the line":
            raise RuntimeError("stopped")

    def half(rows):
        """Some rows of the batch, then a stop."""
        if len(seen) == batch:
            embed(rows).limit(3).write.mode("overwrite").parquet(f"{root}/new/gen=1/batch={batch}")
            raise RuntimeError("stopped")
        return embed(rows)

    monkeypatch.setattr(generations, "_committed", stops)
    now, generation = generations.begun(registry, "new")
    now = spark.createDataFrame(now.collect(), SHAPE)
    with pytest.raises(Exception, match="stopped"):
        generations.populated(stream(), now, root, "new", ck, half if when == "while writing" else embed)
    assert generation == 1 and sinks.read_active(spark, now, root, "new") is None
    assert len(told(generations.commits(spark, root, "new", 1))) == batch + (when == "after the line")
    monkeypatch.setattr(generations, "_committed", real)
    after = generations.populated(stream(), now, root, "new", ck, embed)
    assert told(after) == [("new", 1, "active"), ("old", 1, "active")] and shown(spark, after, root) == WANT
    assert told(generations.commits(spark, root, "new", 1)) == [(0, 10), (1, 10), (2, 10)]


def test_the_next_generation_leaves_readers_alone_until_it_is_in(spark, world, tmp_path):
    root, registry, stream, ck = world
    one = spark.createDataFrame(generations.populated(stream(), registry, root, "new", ck, embed).collect(), SHAPE)
    building, generation = generations.begun(one, "new")
    assert generation == 2 and generations.begun(spark.createDataFrame(building.collect(), SHAPE), "new")[1] == 2
    assert shown(spark, building, root) == WANT
    two = generations.populated(stream(), one, root, "new", ck, lambda rows: embed(rows).where("chunk_id < 5"))
    assert told(two) == [("new", 1, "stale"), ("new", 2, "active"), ("old", 1, "active")] and shown(spark, two, root) == WANT[:5]


def test_nothing_comes(spark, world, tmp_path):
    root, registry, stream, ck = world
    (tmp_path / "none").mkdir()
    empty = events.read_stream(spark, str(tmp_path / "none"), spark.createDataFrame([], "chunk_id bigint, text string"))
    assert told(generations.populated(empty, registry, root, "new", ck, embed)) == told(registry)
    assert not generations.complete(spark, root, "new", 1)
