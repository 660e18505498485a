"""The filter audit against a walk of every document through every order."""

import re
from collections import defaultdict
from itertools import permutations

from stratum.llm import filter_audit


def walked(docs, labels):
    """(part, order, step) -> kept, removed, redundant, unique, good, toxic, shapley."""
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    fails = []
    for i, text, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(set(t) & set("#$%&*|")), "E": i is not None and least[t] < i}
        mine = [(q, x) for d, q, x in labels if i is not None and d == i]
        fails.append((source or "", {k for k, v in f.items() if v}, any(q == 1 for q, _ in mine), any(x == 1 for _, x in mine)))
    out, shapley = {}, defaultdict(int)
    for part in {p for p, *_ in fails}:
        for order in map("".join, permutations("ABCDE")):
            left = [x for x in fails if x[0] == part]
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                failing = [x for x in fails if x[0] == part and f in x[1]]
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(x[1] == {f} for x in failing), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                shapley[part, f] += len(gone)
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def told(frame):
    rows = [tuple(r) for r in frame.collect()]
    out = {r[:3]: r[3:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_audit_against_a_walk(spark, small_docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    want = walked([(r.doc_id, r.text, r.source) for r in small_docs.collect()], [tuple(r) for r in labels.collect()])
    assert told(filter_audit.audit(small_docs, labels)) == want


def test_audit_edge_cases(spark, edge):
    """Nulls, repeats, ties, very long texts and clashing names; a source '' and a null one are one part."""
    more = spark.createDataFrame([(9, "", "en", "", 0), (8, "a " * 1_500_000, "en", "c", 1), (8, "other |", None, "c", 1), (6, "A" * 300_000, None, "c", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = edge.withColumn("mask", edge["size"]).withColumn("digest", edge["size"]).unionByName(more, allowMissingColumns=True)
    labels = [(5, 1, None), (5, 0, 1), (None, 1, 1), (8, None, None), (7, 1, 1), (99, 1, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = walked([(r.doc_id, r.text, r.source) for r in docs.collect()], labels)
    assert told(filter_audit.audit(docs, frame)) == want
    assert len(want) == 600 * 4
    assert filter_audit.audit(docs.limit(0), frame).count() == 0
    assert told(filter_audit.audit(docs, frame.limit(0))).keys() == want.keys()


def test_cells_are_few(spark):
    """A third of all rows share one text, over many parts: cells, not rows, come to the enumeration."""
    docs = spark.range(30_000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'copied text', concat('text ', id)) AS text", "concat('s', id % 5) AS source")
    labels = spark.range(100).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    cells = filter_audit.cells(docs, labels).collect()
    assert len(cells) <= 32 * 5 and sum(r.n for r in cells) == 30_000 and sum(r.good for r in cells) == 100
    assert sum(r.n for r in cells if r.mask & 16) == 9_999
