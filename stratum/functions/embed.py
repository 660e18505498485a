"""The offline embedder: terms hashed to signed dimensions, normalised."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from stratum.sources.batches import by_row

DIM = 64
term = re.compile(r"[^\W_]+").findall


def embedded(text: Column, dim: int = DIM, prefix: str = "") -> Column:
    """Unit vector of a text's terms: each adds one, of a hashed sign, at a hashed place. Texts without terms give zeros."""

    @F.arrow_udf("array<double>")
    def embed(t: pa.Array) -> pa.Array:
        def one(s: str | None) -> np.ndarray:
            v = np.zeros(dim)
            terms = term(((prefix + s) if s else prefix).lower())
            if terms:
                h = np.array([zlib.crc32(x.encode()) for x in terms])
                np.add.at(v, h % dim, np.where(h >> 31, -1.0, 1.0))
                v /= max(np.sqrt((v * v).sum()), 1e-12)
            return v

        return by_row((t,), one, pa.list_(pa.float64()))

    return embed(text)
