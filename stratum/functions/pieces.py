"""Texts in pieces that a byte-level BPE tokenizer gives the same ids alone; ``stratum.llm.bpe`` says why they do."""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Callable

import numpy as np

#: What a worker remembers: that many fragments, none of more bytes.
REMEMBERED, LONGEST = 400_000, 64
#: Bytes that end white space: the ASCII ones, and the last ones of wider characters (U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000).
WHITE_ENDS = bytes([*range(0x09, 0x0E), 0x20, *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF])
#: What follows an apostrophe in a contraction.
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
#: Signs that are a piece of their own after a word, whatever their number; none of them is of a special token or a contraction.
STOPS = b".,;:!?*&%$#@+-=~^\"()[]{}/\\_`"


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def byte_symbols() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(path: str) -> list[bytes]:
    """By id, the bytes that a token stands for; special tokens stand for their own text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    symbols = byte_symbols()
    special = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    out: dict[int, bytes] = {i: bytes(symbols[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in special}
    out |= special
    return [out.get(i, b"") for i in range(max(out, default=-1) + 1)]


def inner_pairs(tokens: list[bytes]) -> np.ndarray:
    """256 x 256: whether the pair occurs inside some token."""
    seen = np.zeros((256, 256), bool)
    for t in tokens:
        seen[list(t[:-1]), list(t[1:])] = True
    return seen


def certain_cuts(tokens: list[bytes]) -> np.ndarray:
    """256 x 256: whether text may be cut between the bytes of the pair, whatever stands around them."""
    cut = ~inner_pairs([*tokens, *(b"'" + c for c in CONTRACTIONS)])
    cut[list(WHITE_ENDS)] = False
    cut[:, ord("'")] = False
    cut[:, 0x80:0xC0] = False  # inside a character
    return cut


def cutter(tokens: list[bytes]) -> Callable[[bytes], list[bytes]]:
    """Cuts the bytes of a text at all certain cuts."""
    table = certain_cuts(tokens).ravel()

    def cut(data: bytes) -> list[bytes]:
        x = np.frombuffer(data, np.uint8)
        pair = x[:-1].astype(np.uint16)
        pair <<= 8
        pair |= x[1:]
        at = [0, *(np.flatnonzero(table[pair]) + 1).tolist(), len(data)]
        return [data[a:b] for a, b in zip(at, at[1:])]

    return cut


class Pieces(dict):
    """Piece of text -> its packed ids, remembered; pieces are such that the library gives them the same ids alone.

    A piece of Latin letters, after a space or not, is one word to the
    pre-tokeniser, so its merges are asked of the library's model directly;
    stops at its end are a word of their own. Anything else takes the whole way.
    """

    def __init__(self, tokenizer, kind: str = "<u4", most: int = REMEMBERED):
        super().__init__()
        self.tokenizer, self.kind, self.most = tokenizer, kind, most
        self.lower = tokenizer.normalizer is not None
        self.tokenize = tokenizer.model.tokenize
        self.symbols = str.maketrans({chr(b): c for c, b in byte_symbols().items()})
        probes = [b"word", "\u00e9t\u00e9".encode(), b"aaaaaab"] + ([] if self.lower else [b" word", b"Word"])
        self.packed = [np.array([i], kind).tobytes() for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]
        self.direct = all(self._merged(p.decode()) == self._whole(p.decode()) for p in probes)

    def _merged(self, text: str) -> bytes:
        packed = self.packed
        return b"".join([packed[t.id] for t in self.tokenize(text.encode().decode("latin-1").translate(self.symbols))])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _word(self, text: str) -> str | None:
        """The text as the model takes it if it is a word of Latin letters; None if it isn't. Letters there are folded one by one."""
        text = text.lower() if self.lower else text
        core = text if self.lower else text.removeprefix(" ")
        return text if core.isalpha() and max(core) < "\u0250" else None

    def __missing__(self, piece: bytes) -> bytes:
        if not self.direct:
            ids = self._whole(piece.decode())
        elif piece.isalpha() and not (self.lower and not piece.islower()):
            packed = self.packed  # plain ASCII letters, the usual case
            ids = b"".join([packed[t.id] for t in self.tokenize(piece.decode())])
        else:
            head = piece.rstrip(STOPS)
            word = self._word(head.decode()) if head else None
            if word is None:
                ids = self._whole(piece.decode())
            elif len(head) == len(piece):
                ids = self._merged(word)
            else:
                ids = self[head] + self[piece[len(head) :]]
        if len(piece) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids


@functools.lru_cache(maxsize=4)
def pieces(path: str, kind: str = "<u4", most: int = REMEMBERED) -> Pieces:
    """One memory a worker process, for all its tasks."""
    return Pieces(load(path), kind, most)


@functools.lru_cache(maxsize=4)
def counter(path: str) -> Callable[[str], int] | None:
    """A function from a text to its number of tokens, with special tokens taken as plain text; None where the file is no byte-level BPE that texts may be cut for."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not spec.get("normalizer")
    if not (plain and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")):
        return None
    tokenizer = load(path)
    tokenizer.encode_special_tokens = True
    cut, get = cutter(token_bytes(path)), Pieces(tokenizer).__getitem__
    return lambda text: sum(map(len, map(get, cut(text.encode())))) // 4
