"""Language ID with a byte convolutional network.

Windows of a fixed number of bytes pass an embedding of the bytes, filters of
several widths, max pooling over the window and a softmax layer. Training is
plain numpy on a bounded sample: at most ``PER_LANG`` windows a language and
``MAX_WINDOWS`` together (in expectation), chosen by a hash of the document's id
from all labelled training documents. Every language is learned. Prediction
cuts every whole text into windows of ``WINDOW`` bytes, the last padded with zeros, and averages the windows' log-probabilities weighed
by their bytes; the score is the probability that the average gives the answer.

A text that is null or has no letter gets ``und`` with score 0. Rows without a
lang are never learned from. With fewer than two languages to learn, the
only one (or ``und``) is the answer. Repeated rows are predicted row by row, an
empty table gives an empty table, and extra columns are ignored or, in
``identify``, passed through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm._common import held_out, map_batches, unit

WINDOW, DIM, WIDTHS, FILTERS = 256, 6, (2, 3, 4), 12
#: Bound of the sample: windows learned from a language, and from all languages together, which share them.
PER_LANG, MAX_WINDOWS = 1500, 96_000
EPOCHS, RATE, SEED = 6, 4e-3, 9


@dataclass
class Network:
    langs: list[str]
    embed: np.ndarray  # 256 x DIM
    filters: list[np.ndarray]  # by width: width x DIM x FILTERS
    bias: np.ndarray  # len(WIDTHS) * FILTERS
    out: np.ndarray  # len(WIDTHS) * FILTERS x languages
    out_bias: np.ndarray

    def tables(self) -> list[np.ndarray]:
        """By width: width x 256 x FILTERS, what a byte adds to the filters at each offset."""
        return [np.einsum("bd,wdf->wbf", self.embed, k).astype(np.float32) for k in self.filters]


def windows(data: bytes) -> np.ndarray:
    """n x WINDOW bytes of a text; the last window is padded with zeros."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


def pooled(x: np.ndarray, net: Network, tables: list[np.ndarray] | None = None) -> np.ndarray:
    """Windows -> max-pooled, rectified filter values."""
    parts = []
    for i, table in enumerate(tables or net.tables()):
        width = len(table)
        span = x.shape[1] - width + 1
        act = table[0][x[:, :span]]
        for k in range(1, width):
            act += table[k][x[:, k : k + span]]
        parts.append(act.max(axis=1) + net.bias[i * FILTERS : (i + 1) * FILTERS])
    return np.maximum(np.concatenate(parts, axis=1), 0)


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(x: np.ndarray, y: np.ndarray, langs: list[str]) -> Network:
    """Adam on the cross-entropy of the windows' softmax."""
    rng = np.random.default_rng(SEED)
    n_pool = len(WIDTHS) * FILTERS
    net = Network(langs, rng.normal(0, 0.5, (256, DIM)), [rng.normal(0, 0.5, (w, DIM, FILTERS)) for w in WIDTHS], np.zeros(n_pool), rng.normal(0, 0.2, (n_pool, len(langs))), np.zeros(len(langs)))
    params = [net.embed, *net.filters, net.bias, net.out, net.out_bias]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            rows = order[at : at + 64]
            grads = _gradients(net, x[rows], y[rows])
            t += 1
            for i, (p, g) in enumerate(zip(params, grads)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p -= RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return net


def _gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    n = len(x)
    places, values = [], []
    for table in net.tables():
        width = len(table)
        span = x.shape[1] - width + 1
        act = table[0][x[:, :span]].copy()
        for k in range(1, width):
            act += table[k][x[:, k : k + span]]
        at = act.argmax(axis=1)  # n x FILTERS
        places.append(at)
        values.append(np.take_along_axis(act, at[:, None, :], 1)[:, 0])
    raw = np.concatenate(values, axis=1) + net.bias
    hidden = np.maximum(raw, 0)
    dz = np.exp(log_softmax(hidden @ net.out + net.out_bias))
    dz[np.arange(n), y] -= 1
    dz /= n
    d_hidden = (dz @ net.out.T) * (raw > 0)
    d_embed = np.zeros_like(net.embed)
    d_filters = []
    rows = np.arange(n)[:, None]
    for i, kernel in enumerate(net.filters):
        g = d_hidden[:, i * FILTERS : (i + 1) * FILTERS]  # n x FILTERS
        dk = np.zeros_like(kernel)
        for k in range(len(kernel)):
            byte = x[rows, places[i] + k]  # n x FILTERS
            dk[k] = np.einsum("nfd,nf->df", net.embed[byte], g)
            np.add.at(d_embed, byte, g[:, :, None] * kernel[k].T[None])
        d_filters.append(dk)
    return [d_embed, *d_filters, d_hidden.sum(0), hidden.T @ dz, dz.sum(0)]


def sample(docs: DataFrame, per_lang: int = PER_LANG, total: int = MAX_WINDOWS) -> DataFrame:
    """lang and windows of labelled training documents; about ``per_lang`` windows of each language, or fewer where ``total`` is shared by many."""
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    draw = unit(F.col("doc_id"), SEED)
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("count"), F.min(draw).alias("least"))
    share = F.least(F.lit(float(per_lang)), F.lit(float(total)) / F.col("n_langs"))
    rates = counts.crossJoin(F.broadcast(counts.agg(F.count(F.lit(1)).alias("n_langs")))).select("lang", "least", (share / 2 / F.col("count")).alias("rate"))
    # two windows of a document: of a hot language no more rows pass than of a rare one, and of each its first document
    chosen = labelled.select("doc_id", "lang", "text").join(F.broadcast(rates), "lang").where((draw < F.col("rate")) | (draw == F.col("least")))

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, out = [], []
            for lang, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                w = windows(text.encode())
                for i in sorted({(doc_id or 0) * 7919 % len(w), (doc_id or 0) * 104729 % len(w)}):
                    langs.append(lang)
                    out.append(w[i].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], names=["lang", "window"])

        return run

    return map_batches(chosen.select("lang", "doc_id", "text"), make, "lang string, window binary")


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Network | None:
    """Trains on the driver; what is collected is about MAX_WINDOWS windows of WINDOW bytes and two a language; twice as many are reached by endlessly repeated ids alone."""
    rows = sorted(tuple(r) for r in sample(docs, per_lang).limit(2 * MAX_WINDOWS).collect())
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return None
    x = np.frombuffer(b"".join(bytes(w) for _, w in rows), np.uint8).reshape(len(rows), WINDOW)
    number = {lang: i for i, lang in enumerate(langs)}
    return train(x, np.array([number[lang] for lang, _ in rows]), langs)


def predict(texts: list[str | None], net: Network | None, tables: list[np.ndarray] | None) -> tuple[list[str], list[float]]:
    """The answer and score of each text."""
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    if net is None:
        return langs, scores
    blocks, owner, weight, size = [], [], [], 0

    def flush() -> None:
        if not blocks:
            return
        x = np.concatenate(blocks)
        lp = log_softmax(np.concatenate([pooled(x[i : i + 64], net, tables) for i in range(0, len(x), 64)]) @ net.out + net.out_bias)
        w = np.concatenate(weight)
        who = np.repeat(np.arange(len(owner)), [len(b) for b in blocks])
        total = np.zeros((len(owner), lp.shape[1]))
        np.add.at(total, who, lp * w[:, None])
        p = np.exp(log_softmax(total / np.bincount(who, w)[:, None]))
        for i, row in zip(owner, p):
            langs[i], scores[i] = net.langs[int(row.argmax())], float(row.max())
        blocks.clear(), owner.clear(), weight.clear()

    for i, text in enumerate(texts):
        if not text or not any(map(str.isalpha, text)):
            continue
        data = text.encode()
        b = windows(data)
        n = np.full(len(b), WINDOW, float)
        n[-1] = len(data) - WINDOW * (len(b) - 1)
        blocks.append(b), owner.append(i), weight.append(n)
        size += len(b)
        if size >= 4096:
            flush()
            size = 0
    flush()
    return langs, scores


def identify(docs: DataFrame, net: Network | None, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the predicted language and its score to every row; columns of those names are replaced."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(net)  # some kilobytes, whatever the corpus
    kept = [c for c in docs.columns if c not in (lang, score)]
    src = docs.select(*kept)

    def make():
        net = shared.value
        tables = net.tables() if net else None

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, scores = predict(batch.column(kept.index(text)).to_pylist(), net, tables)
            return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*kept, lang, score])

        return run

    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields), f"`{lang}` string", f"`{score}` double"]
    return map_batches(src, make, ", ".join(fields))


def report(docs: DataFrame) -> DataFrame:
    """Fits on the training folds and predicts every document."""
    net = fit(docs)
    return identify(docs.select("doc_id", "text"), net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
