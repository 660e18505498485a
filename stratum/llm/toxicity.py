"""Toxicity by class-conditional Kneser-Ney models.

Two character models, one of toxic and one of ordinary documents, spell every
word of a text; a character's history is what precedes it in the word, its
start included, of up to ``ORDER - 1`` characters. Both models discount their
counts and back off to one distribution that they share: of ever shorter
histories, down to none, each interpolated with the next, made of continuation
counts over both classes (after how many longer histories a character follows a
short one). Every count enters, of n-grams seen once too. Rare expressions so get
about the same likelihood from both models and decide nothing, while a stem or
word that one class prefers tells.

The difference of the two log-likelihoods a word, averaged over the text, the
same scaled by the root of the length, the largest difference of a single word,
and the log length enter a logistic curve, which is fitted on labelled documents
that the counts haven't seen and weighed to the true share of toxic ones.

Counts and the distributions made of them are aggregates and joins over a bounded
sample of labelled training documents: at most ``MAX_DOCS`` of each class and
``MAX_CHARS`` characters of theirs (both in expectation), chosen by a hash of the
id among those of up to a hundredth of ``MAX_CHARS``. What is sent to the workers
is bounded by the sample: two sorted tables of hashed n-grams. A word is a run of
letters, digits and ``_`` in lower case.

Every text is scored whole, a very long one as one row of one task. Null, empty
and wordless texts get the score that the curve gives to a difference of 0. Rows
of ``labels`` with null ids or labels are ignored; a document with several labels
is toxic if any says so. Without both classes to learn from, every score is the
share of toxic training documents. Repeated rows are scored row by row; an empty
table gives an empty table.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.llm._common import held_out, map_batches, stage, unit

#: Bounds of the sample of labelled training documents, for each class: documents and characters.
MAX_DOCS, MAX_CHARS = 4000, 40_000_000
ORDER, DISCOUNT, SEED, THRESHOLD = 8, 0.75, 2, 0.3
#: Words that a worker remembers.
REMEMBERED = 500_000
START, END = "\x02", "\x03"

tokens = re.compile(r"\w+").findall


def grams(word: str) -> list[tuple[str, str]]:
    """(history, next character) along a word, its end included."""
    s = START + word + END
    return [(s[max(0, i - ORDER + 1) : i], s[i]) for i in range(1, len(s))]


def _scattered(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spelled(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At each character of the strings, one after the other: its place in its string, a hash of the last ORDER characters there, and one of the last ORDER - 1."""
    sizes = np.array([len(s) for s in strings], np.int64)
    c = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    place = np.arange(len(c)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    total = np.zeros(len(c), np.uint64)
    for k in range(ORDER):
        if k == ORDER - 1:
            less = total.copy()
        total[k:] += np.where(place[k:] >= k, c[: len(c) - k] * np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)), np.uint64(0))
    return place, _scattered(total), _scattered(less)


def hashed(strings: list[str]) -> np.ndarray:
    """Hashes of strings of up to ORDER characters, as ``spelled`` gives them."""
    sizes = np.array([len(s) for s in strings], np.int64)
    return spelled(strings)[1][np.cumsum(sizes) - 1] if len(strings) else np.zeros(0, np.uint64)


@dataclass
class Model:
    """Log-likelihood in toxic text minus that in ordinary text.

    After a history that was seen, a character that wasn't seen after it has the
    shared probability in both models, scaled by what each leaves to the
    backoff; so its difference is the history's alone. After a history that
    wasn't seen both models are the shared one, and differ by nothing.
    """

    name: str
    seen: tuple[np.ndarray, np.ndarray]  # sorted hashes of history + character, differences
    unseen: tuple[np.ndarray, np.ndarray]  # sorted hashes of histories, differences
    curve: np.ndarray


def _found(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in the table, and its value or 0."""
    known, values = table
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    hit = known[at] == keys
    return hit, np.where(hit, values[at], 0.0)


class Differences(dict):
    """Word -> its difference, remembered."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def learn(self, words: Iterable[str]) -> None:
        """Makes sure that all these words are known."""
        wanted = set(words)
        if len(self) + len(wanted) > REMEMBERED:
            self.clear()
        new = list(wanted - self.keys())
        if not new:
            return
        place, gram, less = spelled([START + w + END for w in new])
        next_ = np.flatnonzero(place)
        hit, seen = _found(self.model.seen, gram[next_])
        d = np.where(hit, seen, _found(self.model.unseen, less[next_ - 1])[1])
        self.update(zip(new, np.add.reduceat(d, np.flatnonzero(place[next_] == 1)).tolist()))


_memory: dict[str, Differences] = {}


def differences(model: Model) -> Differences:
    """One memory a worker process, for all its tasks with the model."""
    if model.name not in _memory:
        _memory.clear()
        _memory[model.name] = Differences(model)
    return _memory[model.name]


def labelled(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, text, toxic, part of the sample (part 0 is for counts, part 1 for the curve), and the classes' sizes."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    length = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    usable = stage(docs.select("doc_id", length.alias("chars")).join(marked, "doc_id"))
    found = {r["toxic"]: (r["n"], r["chars"]) for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")).collect()}
    rates = {c: min(1.0, max_docs / n, max_chars / max(1, chars)) for c, (n, chars) in found.items()}
    rate = F.when(F.col("toxic") == 1, rates.get(1, 0.0)).otherwise(rates.get(0, 0.0))
    chosen = usable.where((F.col("chars") <= max_chars // 100) & (unit(F.col("doc_id"), SEED) < rate)).select("doc_id", "toxic").distinct().limit(4 * max_docs)
    part = (unit(F.col("doc_id"), SEED + 1) < 0.3).cast("int")
    # a sample of at most 4 * max_docs rows of two numbers
    sample = docs.where(length <= max_chars // 100).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic", part.alias("part"))
    return sample, {c: n for c, (n, _) in found.items()}


def counted(rows: DataFrame) -> DataFrame:
    """history, next, n0, n1 over the texts of part 0."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            seen = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[toxic].update(tokens((text or "").lower()))
            out: tuple[Counter, Counter] = (Counter(), Counter())
            for c in (0, 1):
                for word, n in seen[c].items():
                    for g in grams(word):
                        out[c][g] += n
            keys = list(out[0].keys() | out[1].keys())
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), *(pa.array([out[c][k] for k in keys], pa.int64()) for c in (0, 1))], names=["history", "next", "n0", "n1"])

        return run

    parts = map_batches(rows.where("part = 0").select("text", "toxic"), make, "history string, next string, n0 bigint, n1 bigint")
    return parts.groupBy("history", "next").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _discounted(n: str, total: str, kinds: str, lower):
    """Interpolation of discounted counts with the distribution of the shorter history; that alone where nothing was counted."""
    own = (F.greatest(F.col(n) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(kinds) * lower) / F.col(total)
    return F.when(F.col(total) > 0, own).otherwise(lower)


def shared(counts: DataFrame) -> DataFrame:
    """history, next, p: the distribution that both classes back off to, for histories of up to ORDER - 2 characters.

    Of a history of k characters it counts what precedes: the different histories
    of k + 1 characters that it ends. Rows of a history are as many as characters.
    """
    levels: list[DataFrame] = []
    of = Window.partitionBy("history")
    for k in range(ORDER - 1):
        longer = counts.where(F.length("history") > k).select(F.expr(f"right(history, {k + 1})").alias("longer"), "next").distinct()
        level = longer.groupBy(F.expr(f"right(longer, {k})").alias("history"), "next").agg(F.count(F.lit(1)).alias("n"))
        level = level.withColumn("total", F.sum("n").over(of)).withColumn("kinds", F.count(F.lit(1)).over(of))
        if k:
            below = levels[-1].select(F.col("history").alias("shorter"), "next", F.col("p").alias("lower"))
            level = level.withColumn("shorter", F.expr(f"right(history, {k - 1})")).join(below, ["shorter", "next"])
        else:
            level = level.withColumn("lower", 1.0 / (F.col("kinds") + 1))  # one more for characters never seen
        levels.append(stage(level.select("history", "next", _discounted("n", "total", "kinds", F.col("lower")).alias("p"))))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def modelled(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """history, next, p0, p1 of all n-grams, and history, rest0, rest1: what a class leaves to the shared distribution."""
    kinds = lambda c: F.sum((F.col(c) > 0).cast("int"))
    totals = stage(counts.groupBy("history").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), kinds("n0").alias("k0"), kinds("n1").alias("k1")))
    lower = shared(counts).select(F.col("history").alias("shorter"), "next", F.col("p").alias("lower"))
    rows = counts.join(totals, "history").withColumn("shorter", F.expr("substring(history, 2)")).join(lower, ["shorter", "next"])
    pairs = rows.select("history", "next", *(_discounted(f"n{c}", f"t{c}", f"k{c}", F.col("lower")).alias(f"p{c}") for c in (0, 1)))
    rest = totals.select("history", *(F.when(F.col(f"t{c}") > 0, DISCOUNT * F.col(f"k{c}") / F.col(f"t{c}")).otherwise(1.0).alias(f"rest{c}") for c in (0, 1)))
    return pairs, rest


def _table(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and differences of (string, difference); as large as the sample makes it."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(hashed(batch.column(0).to_pylist()).astype(np.int64)), batch.column(1).cast(pa.float32())], names=["h", "d"])

    got = map_batches(rows, lambda: run, "h bigint, d float").toArrow()
    h, d = got.column("h").to_numpy().astype(np.uint64), got.column("d").to_numpy()
    order = np.argsort(h, kind="stable")
    return h[order], d[order]


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Model | float:
    """The model, or the share of toxic documents where one class is missing. What is collected is bounded by the sample."""
    rows, sizes = labelled(docs, labels, max_docs)
    rows = stage(rows)
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if rows.where("part = 0").select("toxic").distinct().count() < 2:
        return float(share)
    pairs, rest = modelled(stage(counted(rows)))
    seen = _table(pairs.select(F.concat("history", "next"), F.log(F.col("p1") / F.col("p0"))))
    unseen = _table(rest.select("history", F.log(F.col("rest1") / F.col("rest0"))))
    model = Model(uuid.uuid4().hex, seen, unseen, np.zeros(5))
    model.curve = _curve(rows, model, share)
    return model


def features(texts: list[str | None], known: Differences) -> np.ndarray:
    """n x 5: what the curve takes."""
    words = [tokens((t or "").lower()) for t in texts]
    out = np.zeros((len(texts), 5))
    out[:, 0] = 1
    known.learn(chain.from_iterable(words))
    for i, w in enumerate(words):
        if w:
            d = np.fromiter(map(known.__getitem__, w), np.float64, len(w))
            out[i, 1:] = d.sum() / len(w), d.sum() / len(w) ** 0.5, d.max(), np.log(len(w))
    return out


def _curve(rows: DataFrame, model: Model, share: float) -> np.ndarray:
    """Logistic regression by Newton's method on the features of part 1, each class weighed to its true share."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def make():
        known = differences(sent.value)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            f = features(batch.column(0).to_pylist(), known)
            return pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(f[:, i]) for i in range(1, 5))], names=["toxic", "a", "b", "c", "d"])

        return run

    got = map_batches(rows.where("part = 1").select("text", "toxic"), make, "toxic int, a double, b double, c double, d double").toPandas()
    x, y = np.c_[np.ones(len(got)), got[["a", "b", "c", "d"]]], got["toxic"].to_numpy(float)
    w = np.where(y == 1, share / max(1.0, y.sum()), (1 - share) / max(1.0, (1 - y).sum())) * len(y)
    beta = np.zeros(5)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(5)
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - 0.1 * beta)
        beta += step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return beta


def score(docs: DataFrame, model: Model | float, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the probability of toxicity to every row; a column of that name is replaced."""
    kept = [c for c in docs.columns if c != out]
    src = docs.select(*kept)
    if isinstance(model, float):
        return src.withColumn(out, F.lit(model))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def make():
        m = sent.value
        known = differences(m)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            f = features(batch.column(kept.index(text)).to_pylist(), known)
            p = 1 / (1 + np.exp(-np.clip(f @ m.curve, -30, 30)))
            return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(p)], names=[*kept, out])

        return run

    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields), f"`{out}` double"]
    return map_batches(src, make, ", ".join(fields))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on the labelled training documents and scores every document."""
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
