"""Cells of vectors: found in bounded memory, the same ones."""

import tracemalloc

import numpy as np
import pandas as pd

from stratum.operators import vectors


def test_a_batch_meets_the_centres_in_slices():
    rng = np.random.default_rng(3)
    v, centres = pd.Series(list(rng.normal(size=(5000, 16)))), vectors.unit(rng.normal(size=(1000, 16)))
    want = np.argsort(-(vectors.unit(np.vstack(v)) @ centres.T), axis=1)[:, :3]
    tracemalloc.start()
    got = vectors.nearest_cells(v, centres, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (np.array(got) == want).all()
    assert peak < 20e6  # all at once: 120 MB
    assert vectors.nearest_cells(v.iloc[:0], centres, 3) == []
