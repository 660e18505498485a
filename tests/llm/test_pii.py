"""Personal data: strict forms against plain regular expressions, EM against known reliabilities, added spans on planted ones."""

import hashlib
import random
import re

import numpy as np

from stratum.llm import pii

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def keeps(kind, s):
    digits = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    """kind, start, end by the forms as they are written, backtracking and all."""
    return [(k, m.start(), m.end()) for k, form in FORMS.items() for m in re.finditer(form, text or "") if keeps(k, m.group())]


def digest(spans):
    order = list(FORMS)
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], order.index(x[0])))).encode()).hexdigest()


def test_strict_forms_against_plain_expressions():
    rng = random.Random(1)
    alphabets = ["0123456789.", "0123456789 -", "+01234 ().-", "ab.@-_%+", "a@.1+ -(", "12.é@ 0+-"]
    for i in range(30_000):
        text = "".join(rng.choices(alphabets[i % 6], k=rng.choice([5, 20, 60])))
        assert sorted(pii.base_spans(text)) == sorted((pii.KINDS.index(k), a, b) for k, a, b in plain(text)), text


def test_report_against_plain_expressions(spark, small_docs):
    got = {r.doc_id: r for r in pii.report(small_docs).collect()}
    for d in small_docs.collect():
        want, r = plain(d.text), got[d.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in want) for kind in FORMS]
        assert r.base_sha256 == digest(want)
        told = [tuple(x.split(":")) for x in r.spans.split(",") if x]
        assert {(k, str(a), str(b)) for k, a, b in want} <= set(told) and len(told) == len(want) + r.n_added
    assert len(got) == small_docs.count()


def test_long_runs_take_linear_time(spark):
    """Runs that make the plain forms try every start: each is searched whole."""
    texts = ["x" * 400_000 + " a@b.co", "1" * 400_000 + ".2.3.4", "a." * 200_000 + "@", "+" + "1(" * 200_000, "1.2.3." * 100_000, "@a" * 200_000, "1:" * 200_000, "( at a" * 100_000, " at a dot" * 50_000, "4 " * 200_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    assert got[0].spans == "email:400001:400007" and got[1].n_ip == 0 and got[4].n_ip == 75_000


def test_report_edge_cases(spark, edge):
    more = spark.createDataFrame([(20, "é a@b.co 😀 1.2.3.4", "start"), (20, "é a@b.co 😀 1.2.3.4", "start"), (None, "+1 (222) 333-4444", None)], "doc_id long, text string, spans string")
    docs = edge.unionByName(more, allowMissingColumns=True)
    out = pii.report(docs).collect()
    assert len(out) == docs.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r.base_sha256 == empty and r.spans == "" and r.n_added == 0 for r in out if r.doc_id in (1, 2, 3, 4, 5))
    assert [r.spans for r in out if r.doc_id == 20] == ["email:2:8,ip:11:18"] * 2
    assert [r.n_phone for r in out if r.doc_id is None and r.spans] == [1]
    assert pii.report(docs.limit(0)).count() == 0
    assert pii.report(docs.where("text is null")).count() == 1


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(3)
    right, n = np.array([1, 0.9, 0.8, 0.7, 0.85, 0.6]), 40_000
    truth = rng.random(n) < 0.3
    votes = np.where(rng.random((n, 6)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None]) * (rng.random((n, 6)) < 0.8)
    votes[:, 0] = truth & (rng.random(n) < 0.1)  # a tenth of the true ones are strict
    patterns, of, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    share, p, posterior = pii.reliabilities(patterns, counts.astype(float))
    assert abs(share - 0.27 / 0.97) < 0.03 and np.abs(p[1] - right)[1:].max() < 0.04 and np.abs(1 - p[0] - right)[1:].max() < 0.04
    assert ((posterior[of.reshape(-1)] > 0.5) == truth).mean() > 0.93
    assert pii.reliabilities(patterns[:0], counts[:0].astype(float))[2].shape == (0,)


def test_posterior_against_bayes_by_hand():
    votes, counts = np.array([[0, 1, 1, 0, 0, 0], [0, -1, -1, 0, 0, 0], [0, 1, -1, 0, 0, 0], [1, -1, -1, 0, 0, 0]]), np.array([60.0, 30.0, 10.0, 5.0])
    share, p, posterior = pii.reliabilities(votes, counts)
    assert posterior[3] == 1
    for v, q in zip(votes[:3], posterior):
        both = [np.prod([p[c][j] if x > 0 else 1 - p[c][j] for j, x in enumerate(v) if x]) * (share if c else 1 - share) for c in (0, 1)]
        assert abs(both[1] / sum(both) - q) < 1e-6


PLANTED = [
    ("Please call me on (030) 555-7713 tomorrow", "phone", "(030) 555-7713"),
    ("my phone is 0049 30 1234567 at home", "phone", "0049 30 1234567"),
    ("tel: 743-555-3824, ask for me", "phone", "743-555-3824"),
    ("mail jane.roe at example dot com today", "email", "jane.roe at example dot com"),
    ("contact jane.roe [at] example.org now", "email", "jane.roe [at] example.org"),
    ("the server 10[.]20[.]30[.]40 is down", "ip", "10[.]20[.]30[.]40"),
    ("host address 2001:db8:85a3:0:0:8a2e:370:7334 answered", "ip", "2001:db8:85a3:0:0:8a2e:370:7334"),
    ("paid by card 4111.1111.1111.1111 yesterday", "card", "4111.1111.1111.1111"),
]
CLEAN = ["order no. 12345678 shipped", "ISBN 978-3-16-148410-0 printed", "section 3.14.15926535", "in 1998-1999 there were 2000 of 3000", "look at that.Then go", "it took 12:30:45:99", "invoice 20250101123456", "build 1234567 of version 7", "about 12 345 678 900 people", "x1234567890y"]


def test_added_spans(spark):
    """Wider forms beside a corpus of strict ones are added, look-alikes aren't."""
    rng = random.Random(4)
    strict = [f"word +1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)} and a{i}@mail.example.com from {rng.randrange(1, 255)}.7.8.9" for i in range(300)]
    strict += [f"the number 4111111111111111 and {rng.randrange(10**9, 10**10)} of it" for _ in range(50)]
    rows = [(i, t) for i, t in enumerate([*(t for t, *_ in PLANTED), *CLEAN, *strict])]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = [t for i, (t, kind, s) in enumerate(PLANTED) if f"{kind}:{t.index(s)}:{t.index(s) + len(s)}" not in got[i].split(",")]
    wrong = [(t, got[len(PLANTED) + i]) for i, t in enumerate(CLEAN) if got[len(PLANTED) + i]]
    assert not missed and not wrong
