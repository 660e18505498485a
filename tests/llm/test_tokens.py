"""BPE and the token store against the tokenizers library itself."""

import functools
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratum.llm import bpe, token_store

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


library = functools.lru_cache(bpe.load)


def packed(path, text):
    return np.asarray(library(path).encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_round_trip_matches_library(small_docs, edge):
    t = library(BYTE)
    for docs in (small_docs, edge):
        want = sorted((r.doc_id or -1, hashlib.sha256(packed(BYTE, r.text)).hexdigest(), hashlib.sha256(t.decode(t.encode(r.text or "", add_special_tokens=False).ids, skip_special_tokens=False).encode()).hexdigest()) for r in docs.collect())
        got = sorted((r.doc_id or -1, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, BYTE).collect())
        assert got == want


def test_encode_keeps_other_columns(edge):
    out = bpe.encode(edge, BYTE)
    assert out.columns == [c for c in edge.columns if c != "n_tokens"] + ["token_ids", "n_tokens"]
    assert out.count() == edge.count()
    assert bpe.encode(edge.limit(0), BYTE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'srtZé \t\n 　 中12<|endoftext|>.#"), max_size=40))
def test_certain_cuts_agree_with_whole_text(text):
    t = library(BYTE)
    ids = [i for f in cut()(text.encode()) if f for i in t.encode(f.decode(), add_special_tokens=False).ids]
    assert ids == t.encode(text, add_special_tokens=False).ids


KINDS = "aqxzJQ'srtvdlmZéßñ \t\n\r\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000中文字漢ひらがな한국어हिन्दीالعربية12٣४³.,!?*#_-<|>«»…—'’“”\u0301\u200d😀🏳️‍🌈\x00\x7f"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(KINDS), st.characters(codec="utf-8")), max_size=60), st.sampled_from(["", "<|endoftext|>", "'ll", " 're", "\u3000\u3000", "  \u2003 "]), st.integers(0, 60))
def test_certain_cuts_of_all_kinds_of_characters(text, put, at):
    text = text[:at] + put + text[at:]
    assert b"".join(pieces(BYTE)[f] for f in cut()(text.encode()) if f) == packed(BYTE, text)


def test_texts_without_spaces_are_cut():
    chinese = "他们在山上种了很多树因为那里的土地非常肥沃" * 40
    code = "aGVsbG8gd29ybGQ7x9QzJkQ2xqZ0FBQkNR" * 40
    for text, least in ((chinese, 100), (code, 40), ("x=1;y2=f(x)-3.5e7|q8", 5)):
        parts = cut()(text.encode())
        assert len(parts) >= least and b"".join(parts) == text.encode()
        assert b"".join(pieces(BYTE)[f] for f in parts) == packed(BYTE, text)


@functools.cache
def cut():
    return bpe.cutter(bpe.token_bytes(BYTE))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdsrtZÀÉéßİıΣσ'.,!*&12中_-"), min_size=1, max_size=12), st.booleans())
def test_pieces_agree_with_the_library(text, space):
    for path, piece in ((BYTE, " " * space + text), (WORD, text)):
        assert pieces(path)[piece.encode()] == packed(path, piece)


pieces = functools.lru_cache(lambda path: bpe.Pieces(library(path)))


def test_store_matches_library(small_docs, edge):
    for docs in (small_docs, edge):
        want, start = [], 0
        for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id)):
            ids = packed(WORD, r.text) + b"\1\0\0\0"
            want.append((r.doc_id, start, len(ids) // 4, zlib.crc32(ids)))
            start += len(ids) // 4
        got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_store.report(docs, WORD).collect()]
        assert sorted(got, key=lambda x: x[1]) == want


def test_store_keeps_each_chunk_once(spark, small_docs):
    store = token_store.write(small_docs.unionByName(small_docs), WORD)
    rows = spark.read.parquet(store.documents).collect()
    own = [h for r in rows for h, o in zip(r.hashes, r.owned) if o]
    assert len(own) == len(set(own)) == len({h for r in rows for h in r.hashes})
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.part, r["at"]))] == sorted(r.doc_id for r in rows)


def test_store_keeps_passages_of_different_documents_once(spark, small_docs):
    rng = np.random.default_rng(3)
    vocabulary = sorted({w for r in small_docs.limit(50).collect() for w in (r.text or "").split()})
    some = lambda n: " ".join(rng.choice(vocabulary, n))
    passages = [some(60) for _ in range(40)]
    docs = spark.createDataFrame([(2 * i + k, f"{some(80)} {p} {some(80)}") for i, p in enumerate(passages) for k in (0, 1)], "doc_id long, text string")
    rows = {r.doc_id: r for r in spark.read.parquet(token_store.write(docs, WORD).documents).collect()}
    found = sum(bool(set(rows[2 * i].hashes) & set(rows[2 * i + 1].hashes)) and not all(rows[2 * i + 1].owned) for i in range(40))
    assert found >= 24


def test_read_rejects_a_changed_store(spark, small_docs):
    from pyspark.sql import functions as F

    store = token_store.write(small_docs, WORD)
    bad = spark.read.parquet(store.documents).withColumn("lengths", F.reverse("lengths")).withColumn("payload", F.when(F.col("at") == 0, F.max("payload").over(__import__("pyspark.sql").sql.Window.partitionBy("part"))).otherwise(F.col("payload")))
    path = store.documents + "-bad"
    bad.write.parquet(path)
    with pytest.raises(Exception, match="isn't what its digest says"):
        token_store.read(spark, token_store.Store(path, store.manifest), WORD).collect()


def test_read_rejects_a_store_without_one_of_its_ranges(spark, small_docs):
    store = token_store.write(small_docs, WORD)
    rows = spark.read.parquet(store.documents)
    rows.where(rows["part"] != rows.agg({"part": "max"}).first()[0]).write.parquet(store.documents + "-less")
    with pytest.raises(ValueError, match="don't agree with the manifest"):
        token_store.read(spark, token_store.Store(store.documents + "-less", store.manifest), WORD)


def test_empty_store(edge):
    assert token_store.report(edge.limit(0), WORD).count() == 0


def test_merkle_tells_order_and_count():
    a, b, c = (bytes([i]) for i in range(3))
    assert len({token_store.merkle(x) for x in ([], [a], [a, b], [b, a], [a, b, c], [a, b, c, c])}) == 6
