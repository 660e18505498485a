"""Near-dedup of embeddings by Euclidean p-stable hashing.

Normalised vectors are projected on random Gaussian directions, shifted and cut
into steps; ``PROJECTIONS`` such numbers together are a vector's bucket in one of
``TABLES`` tables. Vectors that share a bucket are compared by exact cosine in
double precision, and pairs of ``COSINE`` or more are links. A pair counts in the
first table that brings it together, so no link counts twice. With these
parameters a pair right at the threshold meets with a probability of about 0.95,
closer ones more surely.

Identical vectors are one class with a weight; only classes are compared. Buckets
are found over ids alone: lone vectors and buckets that hold the same vectors as
one of an earlier table go before any vector moves, packed as narrow as the
column. Large buckets are dealt into blocks, and pairs of blocks are compared in
different tasks, so a bucket never has to fit one task. Pairs never leave a task:
it emits counts of links by vector, and of the links only those that merge groups.

Vectors that are null, empty or zero, or hold null or non-finite components,
link with nothing, and so do vectors of different length. Rows that repeat a
vec_id, or have none, are vectors of their own; ``component_id`` is the smallest
id reached, null ids being ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm._common import stage
from stratum.llm.components import components

COSINE = 0.9
TABLES, PROJECTIONS, STEP, SEED = 20, 12, 2.5, 4
#: Vectors of a block.
BLOCK = 1024


def directions(dim: int, tables: int = TABLES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Projections (dim x tables * PROJECTIONS), shifts, and odd multipliers that fold a bucket's numbers into one."""
    rng = np.random.default_rng([SEED, dim])
    return rng.normal(size=(dim, tables * PROJECTIONS)), rng.uniform(0, STEP, tables * PROJECTIONS), rng.integers(0, 1 << 63, tables * PROJECTIONS, np.uint64) * np.uint64(2) + np.uint64(1)


def buckets(x: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """n x tables bucket keys of normalised vectors."""
    a, b, odd = directions(x.shape[1], tables)
    steps = np.floor((x @ a + b) / STEP).astype(np.int64).astype(np.uint64) * odd
    return steps.reshape(len(x), tables, PROJECTIONS).sum(axis=2).astype(np.int64)


def unit_rows(raw: list[bytes], kind: str) -> np.ndarray:
    """Packed vectors of one length as rows of doubles of length 1."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / top
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _kind(vectors: DataFrame) -> str:
    """How components are packed: as single-precision numbers where the column holds such, which loses nothing."""
    return "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"


def packed(vectors: DataFrame, kind: str) -> DataFrame:
    """rid, vec_id, v: the packed components, or null where the vector links with nothing."""

    def run(batches):
        for batch in batches:
            out = []
            for v in batch.column(2).to_pylist():
                x = np.array(v, kind) if v and None not in v else None
                out.append(x.tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["rid", "vec_id", "v"])

    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("e"))
    return rows.mapInArrow(run, "rid bigint, vec_id bigint, v binary")


def hashed(classes: DataFrame, tables: int, kind: str) -> DataFrame:
    """t, key, node: the bucket of each class in each table."""

    def run(batches):
        for batch in batches:
            raw = batch.column(1).to_pylist()
            for size in {len(v) for v in raw}:
                at = np.flatnonzero([len(v) == size for v in raw])
                keys = buckets(unit_rows([raw[i] for i in at], kind), tables) ^ size
                t = np.broadcast_to(np.arange(tables, dtype=np.int32), keys.shape)
                yield pa.RecordBatch.from_arrays([pa.array(t.ravel()), pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy()[at], tables))], names=["t", "key", "node"])

    return classes.select("node", "v").mapInArrow(run, "t int, key bigint, node bigint")


def dealt(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Buckets with company as pairs of blocks: t, key, i, j, second, node, w, v."""
    mark = F.xxhash64("node")
    sizes = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(mark).alias("x"), F.sum(mark.cast("decimal(20,0)")).alias("s")).where("size > 1")
    # the same vectors again, told by 128 bits and their number, give no new pair
    sizes = stage(sizes.groupBy("size", "x", "s").agg(F.min(F.struct("t", "key")).alias("b")).select("b.t", "b.key", "size"))
    x = rows.join(sizes, ["t", "key"]).withColumn("parts", F.ceil(F.col("size") / BLOCK)).withColumn("own", F.pmod(F.xxhash64("node"), "parts"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    x = x.select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "node")
    return x.join(classes, "node").select("t", "key", "i", "j", "second", "node", "w", "v")


def _compare(t: int, rows: list[tuple], mixed: bool, cosine: float, tables: int, kind: str) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Nodes, weights of their new links, and links that merge groups, of one pair of blocks."""
    second, node, w, raw = (list(x) for x in zip(*rows))
    x = unit_rows(raw, kind)
    keys, second, node, w = buckets(x, tables)[:, :t], np.array(second), np.array(node), np.array(w)
    left, right = (np.flatnonzero(~second), np.flatnonzero(second)) if mixed else (np.arange(len(node)),) * 2
    got, label, links = np.zeros(len(node), np.int64), np.arange(len(node)), []
    for at in range(0, len(left), 512):
        rows_ = left[at : at + 512]
        hit = x[rows_] @ x[right].T >= cosine
        a, b = (rows_[k] if n == 0 else right[k] for n, k in enumerate(np.nonzero(hit)))
        new = (a != b) if mixed else (a < b)
        a, b = a[new], b[new]
        new = ~(keys[a] == keys[b]).any(axis=1) if t else np.ones(len(a), bool)
        a, b = a[new], b[new]
        np.add.at(got, a, w[b])
        np.add.at(got, b, w[a])
        while len(a):  # least label of either end, until none changes
            least = np.minimum(label[a], label[b])
            if (label[a] == least).all() and (label[b] == least).all():
                break
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
            label = label[label]
    merged = np.flatnonzero(label != np.arange(len(node)))
    links = [(int(node[i]), int(node[label[i]])) for i in merged]
    return node, got, links


def compared(rows: DataFrame, cosine: float, tables: int, kind: str) -> DataFrame:
    """a, b, n: with null b, n more links of node a; else a link that merges groups."""
    laid = rows.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")

    def run(batches):
        def out(key, held):
            if len(held) < 2:
                return None
            node, n, links = _compare(key[0], held, key[2] != key[3], cosine, tables, kind)
            some = np.flatnonzero(n)
            a = [*node[some].tolist(), *(x for x, _ in links)]
            b = [*[None] * len(some), *(y for _, y in links)]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([*n[some].tolist(), *[0] * len(links)], pa.int64())], names=["a", "b", "n"]) if a else None

        held, now = [], None
        for batch in batches:
            c = [col.to_pylist() for col in batch.columns]
            for key, row in zip(zip(*c[:4]), zip(*c[4:])):
                if key != now:
                    if now and (got := out(now, held)):
                        yield got
                    held, now = [], key
                held.append(row)
        if now and (got := out(now, held)):
            yield got

    return laid.mapInArrow(run, "a bigint, b bigint, n bigint")


def near_dedup(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES) -> DataFrame:
    """Per row of ``vectors``: vec_id, n_links, component_id, kept."""
    kind = _kind(vectors)
    rows = stage(packed(vectors, kind))
    classes = stage(rows.where("v is not null").groupBy("v").agg(F.min("rid").alias("node"), F.count(F.lit(1)).alias("w")))
    met = dealt(stage(hashed(classes, tables, kind)), classes)
    found = stage(compared(met, cosine, tables, kind))
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("more"))
    merged = components(found.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = classes.join(links, "node", "left").join(merged, "node", "left").select("v", (F.col("w") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    out = stage(rows.select("rid", "vec_id", "v").join(named, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", -1 - F.col("rid")).alias("component")))
    # as a table, so that the join is of two plain exchanges, of which Spark can split a hot component's
    least = stage(out.groupBy("component").agg(F.min("vec_id").alias("component_id")))
    return out.join(least, "component").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
