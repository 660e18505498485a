"""Entity resolution: exact names, near vectors, components, canonical names."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.functions.text import normalized_name, pair_key
from stratum.operators.components import components as stars
from stratum.operators.vectors import knn
from stratum.sources.staging import stage

NEAREST, MERGE, SEPARATE, WRITE = 8, 0.90, 0.72, 0.88
#: Edges of a group that a task spans whole, and of the groups that it takes at a time.
MOST_EDGES, BUNDLE = 1_000_000, 200_000


def exact_pairs(nodes: DataFrame) -> DataFrame:
    """u, v: each node and the first of its normalised name and kind. Linear in the nodes, whatever a group's size."""
    n = nodes.select("node_id", normalized_name(F.col("name")).alias("key"), "kind")
    first = n.groupBy("key", "kind").agg(F.min("node_id").alias("v"))
    return n.join(first, ["key", "kind"]).where("node_id != v").select(F.col("node_id").alias("u"), "v")


def near_pairs(vectors: DataFrame, queries: DataFrame, k: int = NEAREST) -> DataFrame:
    """query_id, chunk_id, score, verdict of the k nearest of the same kind, the node itself left out; nodes without a kind have none."""
    verdict = F.when(F.col("score") >= MERGE, "merge").when(F.col("score") < SEPARATE, "separate").otherwise("ask")
    return knn(vectors, queries, k, by="kind").where("query_id != chunk_id").select("query_id", "chunk_id", "score", verdict.alias("verdict"))


def components(pairs: DataFrame) -> DataFrame:
    """node, component: the least node reachable, for every node of a pair (u, v)."""
    found = stage(stars(pairs.select("u", "v")))
    least = found.select(F.col("component").alias("node"), "component").distinct()
    return found.unionByName(least)


def _widest(edges: pd.DataFrame) -> pd.DataFrame:
    """Over whole groups (component, u, v, confidence): the best edges that span them, then the least edge on the way from a group's least node to each other."""
    ids, at = np.unique(np.concatenate([edges["u"], edges["v"]]), return_inverse=True)
    u, v = np.split(at, 2)
    up, near = list(range(len(ids))), [[] for _ in ids]

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    conf = edges["confidence"].to_numpy(float)
    for i in np.argsort(-conf, kind="stable"):
        a, b = root(u[i]), root(v[i])
        if a != b:
            up[max(a, b)] = min(a, b)
            near[u[i]].append((v[i], conf[i]))
            near[v[i]].append((u[i], conf[i]))
    out = np.full(len(ids), np.inf)
    for start in range(len(ids)):
        if root(start) == start:
            found, todo = [], [(start, -1, np.inf)]
            while todo:
                node, before, least = todo.pop()
                out[node] = least
                found.append(least)
                todo += [(n, node, min(least, c)) for n, c in near[node] if n != before]
            out[start] = min(found)
    of = dict(zip(edges["u"], edges["component"])) | dict(zip(edges["v"], edges["component"]))
    return pd.DataFrame({"node": ids, "component": [of[n] for n in ids], "confidence": out})


def _spread(edges: DataFrame) -> DataFrame:
    """As ``_widest`` by rounds of joins: each round what changed is passed on, until nothing does."""
    both = stage(edges.select("component", "u", "v", "confidence").unionByName(edges.select("component", F.col("v").alias("u"), F.col("u").alias("v"), "confidence")))
    known = stage(both.select("component").distinct().select(F.col("component").alias("node"), "component", F.lit(float("inf")).alias("confidence")))
    new = known
    while not new.isEmpty():
        passed = new.select(F.col("node").alias("u"), F.col("confidence").alias("had")).join(both, "u").groupBy(F.col("v").alias("node"), "component").agg(F.max(F.least("had", "confidence")).alias("confidence"))
        better = passed.join(known.select("node", F.col("confidence").alias("old")), "node", "left").where(F.col("old").isNull() | (F.col("confidence") > F.col("old")))
        new = stage(better.select("node", "component", "confidence"))
        known = stage(known.join(new.select("node"), "node", "left_anti").unionByName(new))
    least = known.where("node != component").groupBy("component").agg(F.min("confidence").alias("least"))
    return known.join(least, "component").select("node", "component", F.when(F.col("node") == F.col("component"), F.col("least")).otherwise(F.col("confidence")).alias("confidence"))


def path_confidence(edges: DataFrame, groups: DataFrame, most: int = MOST_EDGES, bundle: int = BUNDLE) -> DataFrame:
    """node, component, confidence over edges (u, v, confidence) and the components of their nodes.

    A node is in its group as surely as the weakest edge on the best way from the
    group's least node; the least node itself as surely as the least sure other.
    Groups of up to ``most`` edges are spanned whole in a task, about ``bundle``
    edges of many groups at a time; in larger ones confidence spreads by joins.
    """
    e = edges.where("u != v").groupBy("u", "v").agg(F.max("confidence").alias("confidence")).join(groups.select(F.col("node").alias("u"), "component"), "u")
    e = stage(e.select("component", "u", "v", "confidence"))
    large = stage(e.groupBy("component").count().where(F.col("count") > most).select("component"))
    small = e.join(large, "component", "left_anti")
    n = max(1, -(-e.count() // bundle))
    id_ = e.schema["u"].dataType.simpleString()
    out = small.groupBy(F.pmod(F.xxhash64("component"), F.lit(n))).applyInPandas(_widest, f"node {id_}, component {id_}, confidence double")
    return out if large.isEmpty() else out.unionByName(_spread(e.join(large, "component", "left_semi")))


def canonical_names(groups: DataFrame) -> DataFrame:
    """component, canonical, n over (component, name): the longest name, the first of equally long ones; groups of two or more."""
    best = groups.groupBy("component").agg(F.min(F.struct((-F.length("name")).alias("l"), "name")).alias("b"), F.count(F.lit(1)).alias("n"))
    return best.where("n >= 2").select("component", F.col("b.name").alias("canonical"), "n")


def current_cache(cache: DataFrame, version: str) -> DataFrame:
    """Verdicts of the present version; others are gone."""
    return cache.where(F.col("prompt_version") == version)


def decided(pairs: DataFrame, cache: DataFrame) -> DataFrame:
    """u, v, confidence of the pairs (query_id, chunk_id, key, score, verdict) to unite: near ones by their score, and those to be asked whose cached verdict (key, same, confidence) says the same surely enough."""
    sure = cache.where(F.col("same") & (F.col("confidence") >= WRITE)).groupBy("key").agg(F.max("confidence").alias("confidence"))
    ends = [F.col("query_id").alias("u"), F.col("chunk_id").alias("v")]
    near = pairs.where("verdict = 'merge'").select(*ends, F.col("score").alias("confidence"))
    return near.unionByName(pairs.where("verdict = 'ask'").join(sure, "key").select(*ends, "confidence"))


def resolved(nodes: DataFrame, vectors: DataFrame, cache: DataFrame, version: str, coreferences: DataFrame | None = None) -> DataFrame:
    """node_id, canonical, confidence of the nodes (node_id, name, kind) that are one with others.

    Equal normalised names of a kind and coreferences (u, v) are one for certain,
    near vectors of a kind by their cosine, those in between as the cache has it.
    A node's confidence is that of its path into the group; nodes under WRITE are left alone.
    """
    sure = exact_pairs(nodes)
    sure = sure if coreferences is None else sure.unionByName(coreferences.select("u", "v"))
    of = vectors.join(nodes.select(F.col("node_id").alias("chunk_id"), "kind"), "chunk_id").select("chunk_id", "vector", "kind")
    near = near_pairs(of, of.withColumnRenamed("chunk_id", "query_id"))
    name = lambda c, n: nodes.select(F.col("node_id").alias(c), F.lower("name").alias(n), F.col("kind").cast("string").alias(f"kind_{n}"))
    keyed = near.join(name("query_id", "a"), "query_id").join(name("chunk_id", "b"), "chunk_id").withColumn("key", pair_key(F.col("kind_a"), F.col("a"), F.col("b")))
    edges = stage(sure.withColumn("confidence", F.lit(1.0)).unionByName(decided(keyed, current_cache(cache, version))))
    groups = stage(components(edges))
    sure_of = path_confidence(edges, groups).where(F.col("confidence") >= WRITE)
    named = canonical_names(groups.join(nodes, F.col("node") == F.col("node_id")).select("component", "name"))
    return sure_of.join(named, "component").select(F.col("node").alias("node_id"), "canonical", "confidence")


def applied(nodes: DataFrame, updates: DataFrame, version: str) -> DataFrame:
    """Nodes with earlier names taken back and the updates' in their place, all stamped with the version."""
    kept = nodes.drop("canonical", "confidence", "prompt_version")
    return kept.join(updates, "node_id", "left").withColumn("prompt_version", F.lit(version))
