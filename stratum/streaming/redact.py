"""Removal of fenced text from streams of deltas, with the unfinished part of each key as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FENCE = "```"


def step(held: str, inside: bool, delta: str) -> tuple[str, str, bool]:
    """What may go out, what is held back, and whether a fence is open, after one more delta."""
    text, out = held + delta, []
    while (at := text.find(FENCE)) >= 0:
        if not inside:
            out.append(text[:at])
        text, inside = text[at + len(FENCE) :], not inside
    keep = next((n for n in (2, 1) if text.endswith(FENCE[:n])), 0)
    if not inside:
        out.append(text[: len(text) - keep])
    return "".join(out), text[len(text) - keep :], inside


def redacted(deltas: DataFrame) -> DataFrame:
    """key, upto, text over a stream of (key, seq, delta); deltas of a batch are taken in order of seq."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, inside = state.get if state.exists else ("", False)
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for delta in rows["delta"]:
            text, held, inside = step(held, inside, delta or "")
            out.append(text)
        state.update((held, inside))
        yield pd.DataFrame({"key": [key[0]], "upto": [int(rows["seq"].max())], "text": ["".join(out)]})

    return deltas.groupBy("key").applyInPandasWithState(run, "key bigint, upto bigint, text string", "held string, inside boolean", "append", GroupStateTimeout.NoTimeout)
