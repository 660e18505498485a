"""Packing by tokens against plain Python."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from stratum.operators import structure, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(text, most):
    """(first byte, last, tokens) of each parent of a text's lines."""
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    out, held, byte = [], None, 0
    for line in (text or "").split("\n"):
        start, byte = byte, byte + len(line.encode()) + 1
        if not line.strip(" "):
            continue
        found = t.encode(line, add_special_tokens=False).offsets
        n = len(found)
        if held and (n > most or held[2] + n > most):
            out.append(held)
            held = None
        if n > most:
            cuts = [0]
            for i in range(most, n, most):
                cuts.append(max(cuts[-1], found[i][0]))
            cuts.append(len(line))
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                out.append((start + len(line[:a].encode()), start + len(line[:b].encode()), min(most, n - k * most)))
        else:
            held = (held[0], start + len(line.encode()), held[2] + n) if held else (start, start + len(line.encode()), n)
    return out + ([held] if held else [])


def test_packed_tokens_against_plain_packing(spark):
    rng = random.Random(3)
    words = ["word", "naïve", "😀", "<|endoftext|>", "中文", "12345", "a" * 30, "don't", "\t"]
    line = lambda n: " ".join(rng.choices(words, k=n))
    texts = {i: "\n".join(line(rng.choice([0, 1, 3, 8, 40])) for _ in range(rng.randrange(12))) for i in range(40)} | {50: None, 51: "", 52: "😀" * 200, 53: " \n\n x", 54: line(20_000)}
    docs = spark.createDataFrame(list(texts.items()), "source_id long, text string").repartition(3)
    for size in (20, 512):
        got = tokens.packed_tokens(docs, structure.line_blocks(docs), PATH, size, 1).collect()
        for i, text in texts.items():
            mine = sorted((r for r in got if r.source_id == i), key=lambda r: r.parent_no)
            want = plain(text, size + 1)
            assert [(r.byte_start, r.byte_end, r.n_tokens) for r in mine] == want, i
            assert [r.parent_no for r in mine] == list(range(len(want)))
            assert [r.token_start for r in mine] == [sum(n for *_, n in want[:k]) for k in range(len(want))]
            data = (text or "").encode()
            assert all(r.text.encode() == data[r.byte_start : r.byte_end] for r in mine)
            assert all(r.n_tokens <= size + 1 for r in mine)
    assert tokens.packed_tokens(docs.limit(0), structure.line_blocks(docs.limit(0)), PATH).count() == 0
