"""Tiers of notebooks whose sources have no text."""

from stratum.operators import router


def test_sources_without_tokens_are_not_oversized(spark):
    rows = [("a", 1, None), ("a", 2, None), ("b", 3, None), ("b", 4, 7), ("c", 5, 100)]
    got = {r.notebook_id: (r.total_tokens, r.oversized, r.tier, r.near_cap) for r in router.tier_decision(spark.createDataFrame(rows, "notebook_id string, source_id long, tokens long"), 50).collect()}
    assert got == {"a": (None, 0, 2, None), "b": (7, 0, 1, True), "c": (100, 1, 2, True)}
