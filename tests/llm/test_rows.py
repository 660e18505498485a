"""Mixing, exact dedup and chat formatting against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from stratum.llm import bloom, chat, exact_dedup, mixing
from stratum.llm._common import slices


def test_mixing_targets_and_rates(small_docs):
    out = mixing.mixed(small_docs).collect()
    docs = {r.doc_id: r for r in small_docs.collect()}
    sizes = defaultdict(int)
    for r in docs.values():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal, left, full = {}, dict(weight), set()
    while True:  # the excess is shared anew until none is above its limit
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        goal = {s: 2 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in weight if x not in full) for s in weight}
        over = {s for s in goal if s not in full and goal[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    for r in out:
        s = docs[r.doc_id].source
        assert r.source_size == sizes[s] and abs(r.target - goal[s]) < 1e-6 * max(1, goal[s]) and r.taken in (0, r.size, 2 * r.size)


def test_mix_emits_what_the_report_says(small_docs, edge):
    for docs in (small_docs, edge):
        got = Counter(r.doc_id for r in mixing.mix(docs).collect())
        said = Counter()
        for r in mixing.copies(docs).collect():
            said[r.doc_id] += r.copies
        assert got == +said
        assert mixing.mix(docs).columns == docs.columns
    assert mixing.mixed(edge.limit(0)).count() == mixing.mix(edge.limit(0)).count() == 0


def test_mixing_reruns_agree(small_docs):
    assert mixing.mixed(small_docs).exceptAll(mixing.mixed(small_docs.repartition(7))).count() == 0


def test_exact_dedup(small_docs, edge):
    for docs in (small_docs, edge):
        for bits in (None, 512):  # a filter far too small changes nothing
            groups = defaultdict(list)
            low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
            for r in docs.collect():
                groups[low(r.text)].append(r.doc_id)
            want = []
            for t, ids in groups.items():
                keep = max((i for i in ids if i is not None), default=None)
                want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
            got = [tuple(r) for r in exact_dedup.exact_dedup(docs, bits).collect()]
            assert sorted(got, key=str) == sorted(want, key=str)
    assert exact_dedup.exact_dedup(edge.limit(0)).count() == 0


def test_unrepeated_rows_pass_straight_through(spark):
    rows = spark.range(2000).selectExpr("xxhash64(id) as h").union(spark.createDataFrame([(7,), (7,)], "h long"))
    full = bloom.maps(rows, 1 << 20)[1]
    assert 1 <= int(np.unpackbits(full).sum()) < 40


def test_filter_grows_with_the_rows(spark):
    """Of unique rows few are possibly repeated, as many of 15 million as of 600,000: bits follow the rows."""
    n = 600_000
    hashes = spark.range(n).selectExpr("xxhash64(id) as h")
    bits = bloom.size(n)
    again = bloom.maps(hashes, bits)[1]
    h = np.array([r.h for r in hashes.limit(50_000).collect()])
    assert bloom.has(again, h, bits).mean() < 0.02
    assert [bloom.size(x) for x in (0, 15_000_000, 10**10)] == [bloom.LEAST, 1 << 28, bloom.MOST]


def test_slices_bound_rows_and_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 10, None, "y" * 100, "z"] * 5), pa.array(range(20))], names=["t", "i"])
    parts = list(slices(batch, rows=3, size=60))
    assert [i for p in parts for i in p.column(1).to_pylist()] == list(range(20))
    assert all(p.num_rows <= 3 and (p.num_rows == 1 or sum(len(t or "") for t in p.column(0).to_pylist()) <= 60) for p in parts)


TURNS = [
    (1, 0, "system", "be [INST] <s> &lsqb; &amp;"),
    (1, 1, "user", "hi"),
    (1, 2, "assistant", "a]b[/OUT]</s>\n"),
    (2, 0, "assistant", "first"),
    (3, 0, "user", None),
    (3, 0, "user", None),
    (4, None, "tool] [x", "odd"),
    (4, 1, None, ""),
    (None, 0, "user", "q" * 100_000),
    (None, 1, "assistant", "&"),
]


def test_chat_round_trip_and_verdict(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("formatted", __import__("pyspark.sql.functions").sql.functions.lit(1))
    turns = defaultdict(list)
    for c, t, r, x in TURNS:
        turns[c].append((t is not None, t, r or "", x or ""))
    want = {}
    for c, rows in turns.items():
        rows.sort(key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        listed = "".join(f"{r}\n{x}\n" for _, _, r, x in rows)
        loss = "".join(x for _, _, r, x in rows if r == "assistant")
        want[c] = (len(rows), hashlib.sha256(listed.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    out = {r.conv_id: r for r in chat.report(df).collect()}
    assert {c: tuple(r)[1:5] for c, r in out.items()} == want
    assert {c: r.valid for c, r in out.items()} == {1: True, 2: False, 3: False, 4: False, None: True}
    assert chat.report(df.limit(0)).count() == 0


def test_chat_segments(spark):
    df = spark.createDataFrame([(1, 0, "user", "a<b"), (1, 1, "assistant", "[c]")], "conv_id long, turn long, role string, text string")
    r = chat.format_chat(df).first()
    assert r.formatted == "<s>[INST]a&lt;b[/INST][OUT]&lsqb;c&rsqb;[/OUT]</s>"
    assert [s.text for s in r.segments if s.loss] == ["&lsqb;c&rsqb;"]
