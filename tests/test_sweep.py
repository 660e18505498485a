"""Retiring and sweeping generations, stopped anywhere."""

import pytest

from stratum.sources import sinks

SHAPE = "coordinate string, generation int, status string"


def told(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.fixture()
def world(spark, tmp_path):
    """Coordinate a with a stale and an active generation, b with one that is building, and a write that failed."""
    root, rows = str(tmp_path / "g"), spark.range(3).selectExpr("id AS chunk_id")
    registry = spark.createDataFrame([], SHAPE)
    registry = sinks.activate(sinks.new_generation(rows, registry, root, "a"), "a")
    registry = sinks.activate(sinks.new_generation(rows, registry, root, "a"), "a")
    registry = sinks.new_generation(rows, registry, root, "b")
    rows.write.parquet(f"{root}/b/gen=7")
    return root, spark.createDataFrame(registry.collect(), SHAPE)


def test_sweep_drops_what_nothing_reads(spark, world):
    root, registry = world
    plan = sinks.sweep_plan(registry, sinks.generation_folders(spark, root))
    assert told(plan) == [("a", 1, "drop"), ("a", 2, "keep"), ("b", 1, "keep"), ("b", 7, "drop")]
    after = sinks.swept(spark, registry, root)
    assert told(sinks.generation_folders(spark, root)) == [("a", 2), ("b", 1)]
    assert told(after) == [("a", 2, "active"), ("b", 1, "building")]
    assert sinks.read_active(spark, after, root, "a").count() == 3
    assert told(sinks.swept(spark, after, root)) == told(after)
    assert told(spark.read.parquet(f"{root}-journal")) == [("a", 1, "dropped"), ("a", 1, "marked"), ("b", 7, "dropped"), ("b", 7, "marked")]


@pytest.mark.parametrize("stop", [0, 1, 2])
def test_a_sweep_that_stops_is_made_good(spark, world, monkeypatch, stop):
    root, registry = world
    real, done = sinks._drop, []

    def drop(*args):
        if len(done) == stop:
            raise RuntimeError("stopped")
        done.append(args)
        real(*args)
        if len(done) == stop == 2:
            raise RuntimeError("stopped")

    monkeypatch.setattr(sinks, "_drop", drop)
    with pytest.raises(RuntimeError):
        sinks.swept(spark, registry, root)
    assert sinks.read_active(spark, registry, root, "a").count() == 3
    monkeypatch.setattr(sinks, "_drop", real)
    after = sinks.swept(spark, registry, root)
    assert told(after) == [("a", 2, "active"), ("b", 1, "building")]
    assert told(sinks.generation_folders(spark, root)) == [("a", 2), ("b", 1)]


def test_moving_to_another_coordinate(spark, world):
    root, registry = world
    assert told(sinks.moved(registry, "a", "nothing")) == told(registry)
    after = sinks.moved(registry, "a", "b")
    assert told(after) == [("a", 1, "stale"), ("a", 2, "stale"), ("b", 1, "active")]
    left = sinks.swept(spark, spark.createDataFrame(after.collect(), SHAPE), root)
    assert told(left) == [("b", 1, "active")] and told(sinks.generation_folders(spark, root)) == [("b", 1)]
