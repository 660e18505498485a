"""Scalar functions on text, names and addresses, as column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operators of the lexical query language, which a plain query must not contain.
QUERY_OPERATORS = ("AND", "OR", "NOT", "NEAR")
#: Code point ranges that count one token a character.
CJK = r"[\x{1100}-\x{11FF}\x{2E80}-\x{9FFF}\x{A960}-\x{A97F}\x{AC00}-\x{D7FF}\x{F900}-\x{FAFF}\x{FE30}-\x{FE4F}\x{FF00}-\x{FFEF}\x{20000}-\x{2FA1F}]"
NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"


def _folding() -> tuple[str, str]:
    """Lower-case letters that are a letter with diacritics, and the letters; then the diacritics themselves, which stand for nothing."""
    pairs = {}
    for c in map(chr, range(0xC0, 0x2000)):
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and base.isalpha() and all("\u0300" <= m <= "\u036f" for m in marks):
            pairs[c] = base
    return "".join(pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(pairs.values())


_LETTERS, _BASES = _folding()


def folded(text: Column) -> Column:
    """Lower case without diacritics; marks that aren't diacritics, as the vowels of some scripts, stay."""
    low = F.lower(text)
    # text of single bytes has none of the letters
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, _LETTERS, _BASES))


def query_terms(text: Column) -> Column:
    """Distinct terms of a search query, as the index has them; operators dropped."""
    bare = F.filter(F.split(text, NOT_WORD), lambda w: (w != "") & ~w.isin(*QUERY_OPERATORS))
    return F.array_distinct(F.filter(F.split(folded(F.array_join(bare, " ")), " "), lambda w: w != ""))


def sanitized_query(text: Column) -> Column:
    """The query's terms joined by spaces; null if none is left."""
    bare = F.filter(F.split(text, NOT_WORD), lambda w: (w != "") & ~w.isin(*QUERY_OPERATORS))
    return F.nullif(F.array_join(bare, " "), F.lit(""))


def index_terms(text: Column) -> Column:
    """Terms of indexed text, in order: runs of letters, marks and digits, in lower case without diacritics."""
    return F.array_remove(F.split(folded(text), NOT_WORD), "")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def estimated_tokens(text: Column) -> Column:
    """Characters of CJK scripts, and a quarter of the others."""
    cjk = F.length(F.regexp_replace(text, CJK.replace("[", "[^", 1) + "+", ""))
    return (cjk + F.floor((F.length(text) - cjk) / 4)).cast("long")


def normalized_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, no fragment, no single slash at the end unless it is the root. User and password stay as they are."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    whole = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)
    user = F.regexp_extract(whole, r"^(.*@)?", 1)
    host = F.lower(F.regexp_extract(whole, r"([^@]*)$", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    rest = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$", 1)
    path, query = F.regexp_extract(rest, r"^([^?]*)", 1), F.regexp_extract(rest, r"^[^?]*(\?.*)?$", 1)
    path = F.when(path == "", F.lit("/")).when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)
    return F.when(scheme == "", F.trim(url)).otherwise(F.concat(scheme, F.lit("://"), user, host, path, query))


def needs_js(text: Column, raw: Column, force: Column | None = None) -> Column:
    """Whether extracted text is too little for the page: under 200 bytes, or under 1000 and a hundredth of the raw bytes."""
    n, m = F.octet_length(text), F.octet_length(raw)
    out = (n < 200) | ((n < 1000) & (n / F.nullif(m, F.lit(0)) < 0.01))
    return F.coalesce(out if force is None else force | out, F.lit(False))


def node_id(source: Column, name: Column, kind: Column) -> Column:
    return F.sha2(F.concat_ws(chr(0), source.cast("string"), F.lower(name), kind.cast("string")), 256)


def normalized_name(name: Column) -> Column:
    """White space collapsed, ASCII punctuation at the end stripped, lower case."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(name, r"\s+", " ")), r"\p{Punct}+$", ""))


def pair_key(kind: Column, a: Column, b: Column) -> Column:
    """What a verdict on two names of a kind is kept under, whichever comes first."""
    return F.sha2(F.concat_ws(chr(0), kind.cast("string"), F.least(a, b), F.greatest(a, b)), 256)


def blended_weight(relation: Column, weight: Column, confidence: Column) -> Column:
    """Edge weight: log of the co-occurrences, or three times the confidence; 0.01 at least."""
    together = F.log1p(F.greatest(F.coalesce(weight.cast("double"), F.lit(1.0)), F.lit(0.0)))
    return F.greatest(F.when(relation == "co_occurs", together).otherwise(3.0 * F.coalesce(confidence, F.lit(0.5))), F.lit(0.01))


def prefixed(document: Column, section: Column, body: Column) -> Column:
    """What is embedded for a chunk: where it stands, then its text."""
    return F.concat(F.when(document.isNotNull() & (document != ""), F.concat(F.lit("[Document: "), document, F.lit("] "))).otherwise(""), F.when(section.isNotNull() & (section != ""), F.concat(F.lit("[Section: "), section, F.lit("] "))).otherwise(""), body)


def marker_lists(answer: Column) -> Column:
    """Inner text of every ``[n]`` or ``[n, m]``."""
    return F.regexp_extract_all(answer, F.lit(r"\[(\s*\d+\s*(?:,\s*\d+\s*)*)\]"), F.lit(1))


def markers(answer: Column) -> Column:
    """Cited numbers in order of appearance. A list with a number that is too large for one cites nothing."""
    lists = F.transform(marker_lists(answer), lambda m: F.transform(F.split(m, ","), lambda x: F.regexp_replace(x, r"\s+", "").try_cast("int")))
    return F.flatten(F.filter(lists, lambda ns: F.forall(ns, lambda n: n.isNotNull())))


def slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))


#: Numbers in words and as ordinals, for names of chapters and the like.
CARDINALS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth".split()
STRUCTURE = ("chapter", "ch", "section", "part")
NAMED = ("introduction", "intro", "conclusion")
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def _number(token: str) -> int | None:
    if m := re.fullmatch(r"0*([0-9]{1,9})(?:st|nd|rd|th)?", token):  # nothing has a billion parts
        return int(m[1])
    for names in (CARDINALS, ORDINALS):
        if token in names:
            return names.index(token) + 1
    if token and len(token) < 100 and set(token) <= set(ROMAN):
        values = [ROMAN[c] for c in token]
        return sum(-v if v < max(values[i:]) else v for i, v in enumerate(values))
    return None


def structural_target(query: str) -> tuple[str, int | None] | None:
    """The part of a document that a question names: a noun with its number, or the introduction or conclusion."""
    tokens = [re.sub(r"^\W+|\W+$", "", t) for t in query.lower().split()]
    for i, t in enumerate(tokens):
        if t in STRUCTURE:
            for j in (i + 1, i - 1):
                if 0 <= j < len(tokens) and (n := _number(tokens[j])):
                    return t, n
    for a, b in zip(tokens, tokens[1:]):
        if a == "the" and b in NAMED:
            return b, None
    return None
