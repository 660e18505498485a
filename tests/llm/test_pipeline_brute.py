"""The whole pipeline against a plain Python version of every stage, on the smallest tables."""

import hashlib
import re
from collections import Counter, defaultdict
from math import floor

import brute
import corpus_pipeline
import numpy as np
from tokenizers import Tokenizer

from stratum.llm import langid, line_dedup, mixing
from stratum.llm.queries import vocabulary

SMALL = "/root/testdata/sf0.001"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain(rows, net):
    """Rows (doc_id, text, source, n_chars) through all five stages, as a count of rows with their ids and decoded text."""
    told = {r[0]: brute.spoken(net, r[1], langid.WINDOW) for r in rows}
    rows = [r for r in rows if told[r[0]][0] != "und" and told[r[0]][1] >= corpus_pipeline.MIN_SCORE]
    kept = brute.lines_kept({r[0]: r[1] for r in rows}, line_dedup.NEAR_CHARS)
    lines = lambda t: sum(bool(x.strip(" ")) for x in (t or "").split("\n"))
    rows = [(i, kept[i], s, len(kept[i]) if lines(kept[i]) < lines(t) else n) for i, t, s, n in rows if lines(kept[i]) or not lines(t)]
    _, links = brute.jaccard_links({r[0]: r[1] for r in rows}, 5, 80)
    least = brute.reach([r[0] for r in rows], links)
    rows = [r for r in rows if least[r[0]] == r[0]]
    sizes = defaultdict(int)
    for _, text, source, _ in rows:
        sizes[source] += words(text)
    goal = brute.targets(sizes)
    out = Counter()
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    for i, text, source, n in rows:
        rate = min(2.0, goal[source] / sizes[source]) if sizes[source] else 0.0
        draw = int(hashlib.md5(f"{mixing.SEED}-{i}".encode()).hexdigest()[:13], 16) * 2.0**-52
        copies = floor(rate) + (draw < rate - floor(rate))
        if copies:
            ids = tokenizer.encode(text or "", add_special_tokens=False).ids
            out[i, text, source, n, tuple(ids), len(ids), tokenizer.decode(ids, skip_special_tokens=False)] += copies
    return out


def test_pipeline_against_plain_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    net = langid.fit(docs)
    want = plain([(r.doc_id, r.text, r.source, r.n_chars) for r in docs.collect()], net)
    got = Counter((r.doc_id, r.text, r.source, r.n_chars, tuple(np.frombuffer(r.token_ids, "<u4").tolist()), r.n_tokens, r.decoded) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert got == want and len(want) > 20
