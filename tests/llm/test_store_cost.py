"""What the token store moves and looks up, and that its ids are the library's."""

import functools

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from stratum.functions import pieces
from stratum.llm import bpe, token_store

WORD = public_tokenizers.path("word_bpe_49k.json")
SIGNS = st.sampled_from([*"abSTzéÀßıΣ×÷ªçñ12.,!*%#'-<>|_ \t\n\x0b\x1f\x85 　中ा́😀", "'s", "%%%", ". ", ", ", "<|endoftext|>", "<|STARTOFTEXT|>", "word", "Été."])

library, encoder = functools.lru_cache(bpe.load), functools.lru_cache(token_store.encoder)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.lists(SIGNS, max_size=25).map("".join), max_size=6), st.integers(0, 2), st.sampled_from([None, 1]))
def test_ids_of_a_batch_are_those_of_its_texts(texts, skipped, end):
    ids, n = encoder(WORD)(pa.array(["skipped. "] * skipped + texts, pa.string())[skipped:], end)
    want = [library(WORD).encode(s or "", add_special_tokens=False).ids + [end] * (end is not None) for s in texts]
    assert n.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x] and ids.dtype == np.dtype("<u2")


def test_a_word_is_looked_up_once_with_and_without_stops(monkeypatch):
    asked = []
    monkeypatch.setattr(pieces.Pieces, "__missing__", lambda self, piece, f=pieces.Pieces.__missing__: asked.append(piece) or f(self, piece))
    token_store.pieces.cache_clear()
    token_store.encoder(WORD)(pa.array(["Qwertzor, qwertzor. qwertzor!! éqwertzü. ÉQWERTZÜ, éqwertzü"] * 3))
    token_store.pieces.cache_clear()
    assert asked.count(b"qwertzor") == 1 and not [x for x in asked if b"qwertzor" in x and x != b"qwertzor"]
    assert not [x for x in asked if x.startswith("éqwertzü".encode()) and x != "éqwertzü".encode()]


def test_digests_do_not_move_with_the_ids(small_docs, monkeypatch):
    moved, kind = [], type(small_docs)
    monkeypatch.setattr(kind, "repartitionByRange", lambda self, *cols, f=kind.repartitionByRange: moved.append(self.columns) or f(self, *cols))
    token_store.write(small_docs, WORD)
    assert len(moved) == 1 and "payload" in moved[0] and "hashes" not in moved[0]


def test_what_a_document_borrows_may_come_in_several_batches(spark, small_docs):
    docs = small_docs.unionByName(small_docs)
    want = sorted(map(tuple, token_store.report(docs, WORD).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = sorted(map(tuple, token_store.report(docs, WORD).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and sum(r[-2] > r[-1] for r in got) >= 200 and max(r[-2] - r[-1] for r in got) > 9
