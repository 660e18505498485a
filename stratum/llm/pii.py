"""Personal data by weak supervision: labelers vote on candidate spans, EM tells how far to trust them, a classifier decides.

1. Candidates. ``base_spans`` gives what the kinds' strict forms match; these stay whatever the votes. ``wider``
   gives further candidates of the same kinds: e-mail addresses with the sign spelt out, addresses with bracketed dots or
   of version 6, numbers that are written without a plus or with other separators. A wider candidate never overlaps a base span.
2. Labelers. Regular expressions (the strict form, the shape, a check such as Luhn's), gazetteers (top-level domains,
   card issuers, calling codes, special networks) and context (cue words before the span, its neighbours) each vote for, against, or abstain.
3. Reliabilities. The votes of all candidates of all documents are counted by pattern, at most 3^6 a kind, and expectation-maximisation
   estimates from the counts how often each labeler is right on true and on false spans. Strict matches are held true, and abstaining says nothing.
4. Classifier. All candidates are counted by their binary features with the sum of their posteriors, at most 2^14 patterns a kind,
   and a logistic regression a kind is fitted to the counts. The strict form is no feature, so it judges what a span looks like otherwise.
   A wider candidate with a score of ``ADD`` or more is added.

Nothing is sampled; what comes to the driver are counts of patterns, whose number is fixed.

A null text counts as empty and has no span. Rows that repeat an id are judged one by one, an empty table gives an empty
table, and only doc_id and text are read, so further columns may have any name. A text of any length that fits a row is searched whole, in time
that grows with its length; candidates are read off to the left by at most the 64 characters of a local part. Spans are in code points, the end left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm._common import map_batches, stage

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
ADD = 0.5

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive, and from the first digit of a run alone: giving back digits or starting inside a run never matches
QUAD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@]|[\[({<]\s?at\s?[\])}>]|\sat\s", re.I)

AT = re.compile(r"\s?[\[({<]\s?(?:at|@|arroba)\s?[\])}>]\s?|\s(?:at|@)\s", re.I)
SPELT = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\s?[\[({<]\s?(?:dot|punkt|punto|point|\.)\s?[\])}>]\s?|\s(?:dot|punkt|punto|point)\s)[A-Za-z0-9-]+)+", re.I)
BRACKETED = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\s?[\[(]\s?(?:\.|dot)\s?[\])]\s?[0-9]{1,3}){3}(?![0-9])", re.I)
COLONS = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Za-z:])")
NUMBER = re.compile(r"\(?[0-9](?:[ ().\-/_ ]{0,2}[0-9])++")

# fixed values: gazetteers and cue words
TLDS = frozenset("com org net edu gov int info biz io dev app eu de fr es uk us it nl be ch at pl pt br mx ar ca au jp cn in ru se no dk fi ie cz gr tr".split())
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|64[4-9]|35|30[0-5]|36|38|62|50|5[6-9]|6[0-9]")
CALLING = re.compile(r"(?:00)?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])")
SPECIAL = re.compile(r"0+\.|127\.|255\.255\.")
CUES = (
    re.compile(r"\b(?:e-?mail|mail|contact|write to|correo|courriel|kontakt|schreib\w*)\b", re.I),
    re.compile(r"\b(?:ip|host|server|address|adresse|dirección|ping|client|serveur|servidor)\b", re.I),
    re.compile(r"\b(?:card|visa|master ?card|amex|credit|debit|karte|kreditkarte|carte|tarjeta|cc)\b", re.I),
    re.compile(r"\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|handy|téléphone|portable|teléfono|móvil|llam\w+|appel\w*|whatsapp)\b", re.I),
)
OTHER = re.compile(r"(?:\b(?:isbn|issn|doi|order|invoice|ref|section|version|build|chapter|page|id|sku|serial|art|nr|rechnung|bestellung|pedido|factura|commande|facture)\b|[#§$€£%=])", re.I)

STRICT, SHAPE, CHECK, GAZETTEER, CUE, SIDES = range(6)
N_LABELERS = 6
FEATURES = ("bias", "brackets", "undivided", "blanks_hyphens", "dots_slashes", "ten_eleven", "twelve_thirteen", "fourteen_more", "shape", "check", "gazetteer", "cue", "other_cue", "clean", "inside")
#: What the classifier assumes before it sees counts, in the order of FEATURES, and how much that weighs; counts weigh ``COUNTS`` for strict matches and for wider candidates, so it behaves alike at every size.
ASSUMED, FIRMNESS, COUNTS = np.array([-4.0, 0.5, -1.0, 0.5, 0.0, 0.5, 0.0, 0.0, 2.0, 1.5, 1.0, 2.0, -3.0, 0.5, -3.0]), 1.0, 200.0
#: Votes that each labeler is assumed to have had before, and how often it was right in them.
VOTES_BEFORE, RIGHT_BEFORE = 20.0, 0.8
BEFORE = 40


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(values)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each sign outwards: the domain to its right, then the local part to its left, up to the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at + 1) if at > done and text[at - 1] in LOCAL else None
        if m:
            start = at - 1
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """kind, start, end of the strict forms, leftmost and not overlapping within a kind."""
    out = [(EMAIL, *x) for x in _emails(text)]
    out += [(IP, *m.span()) for m in QUAD.finditer(text) if all(map(_small, m.group().split(".")))]
    out += [(CARD, *m.span()) for m in DIGITS.finditer(text) if 12 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d)]
    return out + [(PHONE, *m.span()) for m in PLUS.finditer(text) if 9 <= len(_digits(m.group())) <= 15]


def wider(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Further candidates, in the gaps between the base spans."""
    at, gaps = 0, []
    for start, end in sorted((s, e) for _, s, e in base):
        if start > at:
            gaps.append((at, start))
        at = max(at, end)
    gaps.append((at, len(text)))
    for lo, hi in gaps:
        done = lo
        for m in AT.finditer(text, lo, hi):
            if m.start() < done or not (d := SPELT.match(text, m.end(), hi)):
                continue
            start = m.start()
            while start > max(done, m.start() - 64) and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                yield EMAIL, start, d.end()
                done = d.end()
        done = lo
        for m in BRACKETED.finditer(text, lo, hi):
            yield IP, *m.span()
        for m in COLONS.finditer(text, lo, hi):
            yield IP, *m.span()
        for m in NUMBER.finditer(text, lo, hi):
            n = len(_digits(m.group()))
            if 7 <= n <= 15:
                yield PHONE, *m.span()
            if 12 <= n <= 19:
                yield CARD, *m.span()


def judged(text: str, kind: int, start: int, end: int, strict: bool) -> tuple[list[int], int]:
    """The labelers' votes, each 1, 0 or -1, and the features as bits (the bias apart)."""
    s, before = text[start:end], text[max(0, start - BEFORE) : start]
    digits, groups = _digits(s), re.findall("[0-9]+", s)
    vote = lambda yes: 1 if yes else -1
    if kind == EMAIL:
        domain = re.split(r"@|\bat\b|arroba", s, maxsplit=1, flags=re.I)[-1]
        labels = re.findall("[A-Za-z0-9-]+", domain)
        labels = [x for x in labels if x.lower() not in ("dot", "punkt", "punto", "point")]
        local = re.match(r"[A-Za-z0-9._%+-]*", s).group()
        plain = bool(re.search(r"\sat\s", s, re.I)) and not re.search(r"\W(?:dot|punkt|punto|point)\W", s, re.I)  # "look at that.Then"
        shape = vote(len(labels) > 1 and labels[-1].isalpha() and 2 <= len(labels[-1]) <= 6 and not plain)
        check = vote(not local.startswith((".", "-")) and not local.endswith(".") and ".." not in s)
        known = vote(labels[-1].lower() in TLDS if labels else False)
    elif kind == IP:
        parts = s.split(":") if ":" in s else groups
        shape = vote(len(parts) == 8 or "::" in s if ":" in s else len(parts) == 4)
        check = vote(len({len(p) for p in parts}) > 1 or "::" in s or len(parts) == 8 if ":" in s else all(map(_small, parts)) and all(p == "0" or p[0] != "0" for p in parts))
        known = -1 if SPECIAL.match(s) else 0
    elif kind == CARD:
        sizes = [len(g) for g in groups]
        shape = vote(sizes in ([4, 4, 4, 4], [4, 6, 5], [4, 6, 4]) or (len(sizes) == 1 and sizes[0] in (13, 14, 15, 16)))
        check, known = vote(luhn(digits)), vote(ISSUERS.match(digits))
    else:
        sizes = tuple(map(len, groups))
        shape = vote(s[0] in "+(" or digits[0] == "0" and max(sizes) <= 9 and not re.search("[./_]", s) or sizes in ((3, 3, 4), (1, 3, 3, 4)) or sizes == (3, 4) and "-" in s)
        check = vote(9 <= len(digits) <= 13 and len(set(digits)) > 2)
        known = vote(CALLING.match(digits)) if s[0] == "+" or digits.startswith("00") else 0
    cue, other = bool(CUES[kind].search(before)), bool(OTHER.search(before[-16:]))
    left, right = text[start - 1 : start], text[end : end + 1]
    inside = left.isalnum() or right.isalnum() or (left != "" and left in "_/=#&") or (right != "" and right in "_/=%")
    clean = not inside and (not left or left.isspace() or left in "([<\"'.,;:") and (not right or right.isspace() or right in ")]>\"'.,;:!?")
    votes = [1 if strict else 0, shape, check, known, 1 if cue and not other else -1 if other and not cue else 0, -1 if inside else 1 if clean else 0]
    marks = (
        bool(re.search(r"[()\[\]]", s)), kind in (CARD, PHONE) and len(groups) == 1, bool(re.search(r"[0-9)][  -]+[0-9(]", s)), kind in (CARD, PHONE) and bool(re.search("[./_]", s)),
        10 <= len(digits) <= 11, 12 <= len(digits) <= 13, len(digits) >= 14, shape > 0, check > 0, known > 0, cue, other, clean, inside,
    )
    return votes, sum(1 << i for i, on in enumerate(marks) if on)


SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.int32()), ("features", pa.int32())])


def candidates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id and candidate spans, with the votes as digits of base three and the features as bits."""

    def spans(text: str | None) -> list[tuple]:
        if not text or not ANY.search(text):
            return []
        base, out = base_spans(text), []
        for strict, found in ((True, base), (False, wider(text, base))):
            for kind, start, end in found:
                votes, features = judged(text, kind, start, end, strict)
                out.append((kind, start, end, strict, sum((v + 1) * 3**i for i, v in enumerate(votes)), features))
        return out

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = pa.array([spans(t) for t in batch.column(1).to_pylist()], pa.list_(SPAN))
            return pa.RecordBatch.from_arrays([batch.column(0), found], names=["doc_id", "spans"])

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), make, f"doc_id {kind}, spans array<struct<kind:int,start:bigint,end:bigint,base:boolean,votes:int,features:int>>")


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns (1, 0 or -1 each; the first labeler is the strict form) with their counts.

    Returns the share of true spans among the wider candidates, how often each
    labeler that votes votes 1 on false and on true spans, and the posterior of
    each pattern. Labelers are taken as independent given the truth. What the
    strict form matches is held true: it tells the reliabilities, and how many such
    spans there are says nothing on the share among the others.
    """
    strict = votes[:, STRICT] == 1
    yes, no = votes == 1, votes == -1
    yes[:, STRICT] = no[:, STRICT] = False
    share, p = 0.5, np.tile([[1 - RIGHT_BEFORE], [RIGHT_BEFORE]], (1, votes.shape[1]))
    posterior = np.zeros(len(votes))
    for _ in range(rounds):
        logs = [yes @ np.log(p[c]) + no @ np.log(1 - p[c]) + np.log(share if c else 1 - share) for c in (0, 1)]
        new = np.where(strict, 1.0, 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700))))
        done = np.abs(new - posterior).max(initial=0) < 1e-10
        posterior = new
        if done:
            break
        share = ((posterior * ~strict) @ counts + 1) / (counts @ ~strict + 2)
        for c, w in enumerate(((1 - posterior) * counts, posterior * counts)):
            right = VOTES_BEFORE * (RIGHT_BEFORE if c else 1 - RIGHT_BEFORE)
            p[c] = (w @ yes + right) / (w @ (yes | no) + VOTES_BEFORE)
    return share, p, posterior


def classifier(features: np.ndarray, counts: np.ndarray, truth: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic regression on feature bits with soft labels by Newton's method; weights in the order of FEATURES.

    Both columns of the counts, of strict matches and of wider candidates, weigh ``COUNTS``.
    """
    x = np.concatenate([np.ones((len(features), 1)), (features[:, None] >> np.arange(len(FEATURES) - 1)) & 1], axis=1).astype(float)
    w, b = (counts * (COUNTS / np.maximum(1.0, counts.sum(axis=0)))).sum(axis=1), ASSUMED.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (w * (p - truth)) + FIRMNESS * (b - ASSUMED)
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + FIRMNESS * np.eye(len(b)), grad)
        b -= step
        if np.abs(step).max() < 1e-9:
            break
    return b


def fit(found: DataFrame) -> np.ndarray:
    """Weights by kind and feature, from the candidates of all documents."""
    spark = found.sparkSession
    spans = found.select(F.explode("spans").alias("s")).select("s.kind", "s.base", "s.votes", "s.features")
    patterns = spans.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 4 x 3^6 rows
    told = []
    for k in range(len(KINDS)):
        mine = [(r["votes"], r["n"]) for r in patterns if r["kind"] == k]
        votes = np.array([[v // 3**j % 3 - 1 for j in range(N_LABELERS)] for v, _ in mine]).reshape(-1, N_LABELERS)
        told += [(k, v, float(p)) for (v, _), p in zip(mine, reliabilities(votes, np.array([n for _, n in mine], float))[2])]
    posterior = F.broadcast(spark.createDataFrame(told, "kind int, votes int, truth double"))  # the same number of rows
    seen = spans.join(posterior, ["kind", "votes"]).groupBy("kind", "base", "features").agg(F.count(F.lit(1)).alias("n"), F.avg("truth").alias("truth")).collect()  # at most 8 x 2^14 rows
    out = []
    for k in range(len(KINDS)):
        mine = sorted((r["features"], r["base"], r["n"], r["truth"]) for r in seen if r["kind"] == k)
        counts = np.array([[n * base, n * (not base)] for _, base, n, _ in mine], float).reshape(-1, 2)
        out.append(classifier(np.array([f for f, *_ in mine], np.int64), counts, np.array([t for *_, t in mine], float)))
    return np.array(out)


def _score(span: Column, weights: np.ndarray) -> Column:
    of = lambda i: F.element_at(F.array(*(F.lit(float(w)) for w in weights[:, i])), span["kind"] + 1)
    on = lambda i: F.shiftright(span["features"], i).bitwiseAND(F.lit(1))
    return 1 / (1 + F.exp(-sum((of(i + 1) * on(i) for i in range(len(FEATURES) - 1)), of(0))))


def find(docs: DataFrame, add: float = ADD) -> DataFrame:
    """Per row of ``docs``: doc_id and spans (start, kind, end, base, score) by start, then kind; kinds by their place in KINDS."""
    found = stage(candidates(docs))
    weights = fit(found)
    scored = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base"), _score(s, weights).alias("score")))
    return found.select("doc_id", F.array_sort(F.filter(scored, lambda s: s["base"] | (s["score"] >= add))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def report(docs: DataFrame, add: float = ADD) -> DataFrame:
    """doc_id, counts of base spans by kind, digest of the base spans, all spans, and how many of them the method added."""
    base = F.filter("spans", lambda s: s["base"])
    of = lambda k: F.filter("spans", lambda s: s["base"] & (s["kind"] == k))
    counts = [F.size(of(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return find(docs, add).select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))
