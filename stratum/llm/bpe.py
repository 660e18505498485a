"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never end up inside one
token, so merges never cross it and the text may be cut there for certain,
inside words as well as between them. The fragments between certain cuts are
encoded on their own by the tokenizers library, remembered, and concatenated.

The pre-tokeniser has to split the fragments where it splits the whole text, so
a pair is left whole where a fresh start could change that:

* after a byte that may end white space: runs of it are split by what follows,
* before an apostrophe, which opens a contraction where no sign stands before it,
* inside the contractions and the special tokens, whatever the vocabulary has,
* inside a character.

Elsewhere a run of letters, digits or signs that is cut goes on as the same kind
of run, and what is forced apart in the vocabulary is apart either way. White
space may be cut off before it, where what stands before is none.

Texts without any certain cut go to the library whole; one very long text is one
row of one task. Null texts count as empty and give no ids. Repeated rows and
ties are encoded row by row; an empty table gives an empty table. Added columns
replace input columns of the same name, all others pass through untouched.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.functions.pieces import LONGEST, REMEMBERED, Pieces, byte_symbols, certain_cuts, cutter, inner_pairs, load, pieces, token_bytes  # noqa: F401  for what is built on this
from stratum.llm._common import map_batches


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids", count: str = "n_tokens", decoded: str | None = None) -> DataFrame:
    """Adds the ids as packed little-endian unsigned 32-bit integers, and their number.

    ``path`` names a byte-level BPE file of the tokenizers library that every
    executor can read. Null text: no ids, 0. ``decoded`` names a column for the
    text that ``decode`` makes of the ids, for callers that want both in one pass.
    """
    new = {ids: "binary", count: "bigint"} | ({decoded: "string"} if decoded else {})
    kept = [c for c in df.columns if c not in new]

    def make():
        cut, known = cutter(token_bytes(path)), pieces(path)
        get, back = known.__getitem__, decoder(path) if decoded else None

        def one(s: str | None) -> bytes:
            return b"".join(map(get, cut(s.encode()))) if s else b""

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [one(s) for s in batch.column(kept.index(text)).to_pylist()]
            out = [pa.array(got, pa.binary()), pa.array([len(x) // 4 for x in got], pa.int64())]
            if decoded:
                out.append(pa.array([back(x) for x in got], pa.string()))
            return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *out], names=[*kept, *new])

        return run

    src = df.select(*kept)
    return map_batches(src, make, _schema(src, **new))


def decoder(path: str) -> Callable[[bytes | None], str | None]:
    """A function from packed ids to their text."""
    known = token_bytes(path)
    n = len(known)

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        got = np.frombuffer(b, "<u4")
        if got.size and int(got.max()) >= n:
            got = got[got < n]
        return b"".join(map(known.__getitem__, got.tolist())).decode("utf-8", "replace")

    return one


def decode(df: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """Adds the text of packed ids, special tokens included. Null ids give null; ids outside the vocabulary give nothing."""
    kept = [c for c in df.columns if c != text]

    def make():
        one = decoder(path)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array([one(b) for b in batch.column(kept.index(ids)).to_pylist()], pa.string())], names=[*kept, text])

        return run

    src = df.select(*kept)
    return map_batches(src, make, _schema(src, **{text: "string"}))


def _schema(df: DataFrame, **more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"`{k}` {v}" for k, v in more.items())])


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document, the digests of its ids and of the text decoded from them."""
    both = encode(docs.select("doc_id", "text"), path, decoded="decoded")
    return both.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
