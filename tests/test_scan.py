"""Batches of queries answered by one reading of the texts, and runs of words made where a list lies."""

import math
import random

import public_tokenizers
from tokenizers import Tokenizer

from stratum.functions import pieces
from stratum.operators import kept, lexical, mentions
from stratum.sources.staging import shared_dir


def plain(texts, queries, k, every, book=None):
    lists = {i: t.split() for i, t in texts.items() if t is not None}
    n, avgdl = len(texts), sum(map(len, lists.values())) / len(lists)
    out = set()
    for q, (text, own) in queries.items():
        terms, scored = list(dict.fromkeys(text.split())), []
        for i, t in lists.items():
            have = [x for x in terms if x in t]
            if not have or (every and len(have) < len(terms)) or (book and book[i] != own):
                continue
            df = {x: sum(x in y for y in lists.values()) for x in have}
            s = sum(max(math.log((n - df[x] + 0.5) / (df[x] + 0.5)), 1e-6) * t.count(x) * 2.2 / (t.count(x) + 1.2 * (0.25 + 0.75 * len(t) / avgdl)) for x in have)
            scored.append((-round(s, 12), i))
        out |= {(q, i, rank, -s) for rank, (s, i) in enumerate(sorted(scored)[:k])}
    return {(q, i, r, round(s, 9)) for q, i, r, s in out}


def test_one_reading_ranks_as_an_index_does(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    texts = {i: " ".join(rng.choices(words, k=rng.randrange(1, 9))) for i in range(150)} | {i: "w1 w2 w2" for i in range(150, 190)} | {200: None, 201: ""}
    book = {i: "ab"[i % 2] for i in texts}
    queries = {q: (" ".join(rng.sample(words, rng.randrange(1, 4))), "ab"[q % 2]) for q in range(9)} | {9: ("w1 w2", "a"), 10: ("w3 unseen", "b")}
    chunks = spark.createDataFrame([(i, t, book[i]) for i, t in texts.items()], "chunk_id long, text string, notebook_id string").repartition(3)
    asked = spark.createDataFrame([(q, t, b) for q, (t, b) in queries.items()], "query_id long, text string, notebook_id string")
    told = lambda df: {(r.query_id, r.chunk_id, r.rank0, round(r.score, 9)) for r in df.collect()}
    index = kept.create(spark, shared_dir(spark), chunks.select("chunk_id", "text"))
    for lists in (None, index, lexical.scan(chunks, lexical.all_terms(asked))):
        assert told(lexical.bm25(chunks, asked, k=4, every=False, lists=lists)) == plain(texts, queries, 4, False)
    assert told(lexical.bm25(chunks, asked, k=4)) == plain(texts, queries, 4, True)
    assert told(lexical.bm25(chunks, asked, k=4, every=False, block_terms=3)) == plain(texts, queries, 4, False)
    own = lexical.bm25(chunks, asked, scope=chunks.select("chunk_id", "notebook_id"), k=4, every=False)
    assert told(own) == plain(texts, queries, 4, False, book)
    assert lexical.bm25(chunks, asked.limit(0)).count() == 0 and lexical.bm25(chunks.limit(0), asked).count() == 0
    gold = {(q, i) for q, (t, _) in queries.items() for i, text in texts.items() if text and t in text}
    assert {tuple(r) for r in lexical.holders(lexical.scan(chunks, lexical.all_terms(asked)), chunks, asked).collect()} == gold


def test_runs_of_words_keep_columns(spark):
    rows = spark.createDataFrame([(1, "A b, c", "x"), (2, "b", "y"), (3, None, "z"), (4, "", "z")], "chunk_id long, text string, book string")
    got = {tuple(r) for r in mentions.spans(rows, "chunk_id", [1, 2, 3], keep=("book",)).collect()}
    assert got == {(1, 0, 1, "a", "x"), (1, 1, 1, "b", "x"), (1, 2, 1, "c", "x"), (1, 0, 2, "a b", "x"), (1, 1, 2, "b c", "x"), (1, 0, 3, "a b c", "x"), (2, 0, 1, "b", "y")}
    names = spark.createDataFrame([(7, "B"), (8, "b c"), (9, "a b c d"), (10, "-")], "node_id long, name string")
    assert {tuple(r) for r in mentions.detect(names, rows, keep=("book",)).collect()} == {(7, 1, 1, 1, "x"), (7, 2, 0, 1, "y"), (8, 1, 1, 2, "x")}


def test_tokens_are_counted_as_the_library_does():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    rng = random.Random(2)
    words = ["word", " naïve", "😀", "<|endoftext|>", "<|endo", "text|>", "中文", "12345", "don't", "'", "\t", "  ", " ", ".", "...", "x_y", "　", "aé́"]
    for text in ["", *("".join(rng.choices(words, k=rng.randrange(1, 30))) for _ in range(500))]:
        assert pieces.counter(path)(text) == len(t.encode(text, add_special_tokens=False)), text
    assert pieces.counter(public_tokenizers.path("word_bpe_49k.json")) is None
