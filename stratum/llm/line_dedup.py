"""Line dedup by a deletion-neighbourhood join.

A line goes if an equal line, or one within one character edit, stands earlier
in the corpus: in a document with a smaller doc_id, or further up in the same.
Earlier lines count whether or not they stay themselves. Blank lines stay
always. The edit bound of a line is a function of its length: one from
``near_chars`` characters on, none below, as one edit makes another word of a
short line; with ``near_chars`` 1 it is one for every line. Lines are compared
trimmed.

* Equal lines meet by their hash; only the first of them is looked at further.
* One edit leaves one half of a line as it is, and three of its quarters. Lines of
  which no other line of the same length, or one more or less, has a half, or then
  any three quarters, have no partner and are left at that. This loses nothing and
  spares most lines their variants.
* The others emit, as hashed keys with those three quarters, what remains of the
  fourth when one character is deleted: with its place, for a substitution;
  without, for a deletion, where it meets the shorter line's whole piece. Equal
  keys are one edit apart, so the first line of a key, not each pair, is what a
  line is held against. The edit distance to it is verified on the lines
  themselves.

Everything is DataFrame functions. Null texts stay null, empty ones empty. Null
doc_ids come first. Rows that repeat a doc_id are one document: where their
lines stand at the same place they share its fate. An empty table gives an
empty table; extra columns pass through, and names that clash are avoided. A text
has to fit a row, and its lines are split and put together again within a task;
one very long line is hashed, cut into pieces and compared like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.llm._common import free_name, stage

#: Characters from which a line goes for one that is an edit away.
NEAR_CHARS = 16
#: Pieces of a line for the first and second look, and the unit of the sizes of all pieces but the one in question; 1 where a line is shorter than a unit of each.
HALVES, QUARTERS = (2, 8), (4, 4)


def _size(n: Column, cut: tuple[int, int]) -> Column:
    """Characters of the pieces of a line of n characters."""
    return F.when(n < cut[0] * cut[1], F.floor(n / cut[0]).cast("int")).otherwise(F.floor(n / (cut[0] * cut[1])).cast("int") * cut[1])


def _around(line: Column, n: Column, p: Column, q: int, cut: tuple[int, int]) -> Column:
    """Hash of the line but its q-th piece: what stands q pieces from its start, and the others from its end."""
    left, right = F.substr(line, F.lit(1), p * q), F.substr(line, n - p * (cut[0] - 1 - q) + 1, p * (cut[0] - 1 - q))
    return F.xxhash64(F.lit(q), p, left, right)


def _piece_keys(line: Column, n: Column, cut: tuple[int, int], near_chars: int) -> Column:
    """Keys of all pieces but one, as the line is cut itself and as one that is a character shorter."""
    own, less = _size(n, cut), _size(n - 1, cut)
    of = lambda p: [_around(line, n, p, q, cut) for q in range(cut[0])]
    return F.when(n < near_chars, F.array().cast("array<bigint>")).when(own == less, F.array(*of(own))).otherwise(F.array(*of(own), *of(less)))


def _lines(docs: DataFrame, near_chars: int) -> DataFrame:
    """Non-blank lines: doc_id, line_no, h1, h2 (96 bits of hash), n characters, keys of the halves."""
    line, n = F.col("line"), F.col("n")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).withColumn("line", F.trim("line")).where("line != ''").withColumn("n", F.length("line"))
    return rows.select("doc_id", "line_no", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), "n", _piece_keys(line, n, HALVES, near_chars).alias("keys"))


def _candidates(first: DataFrame) -> DataFrame:
    """h1, h2, pos, keys of the lines that share all pieces but one with another line of the same length, or one more or less."""
    parts = first.select("h1", "h2", "pos", "n", F.explode("keys").alias("key"))
    # counts as tables, so that the joins are of plain exchanges, of which Spark can split a hot key's
    common = stage(parts.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"))
    shared = parts.join(common, "key")
    # length n meets n as a substitution, and n - 1 and n + 1 as a deletion
    met = shared.select("h1", "h2", "pos", "key", F.explode(F.array("n", F.col("n") - 1)).alias("len"))
    full = stage(met.groupBy("key", "len").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "len"))
    return met.join(full, ["key", "len"]).groupBy("h1", "h2", "pos").agg(F.collect_set("key").alias("keys"))


def _sides(line: Column, n: Column, keys: Column) -> Column:
    """Array of (kind, base, rest): what a line is to be compared as, the hash of its other pieces, and the piece in question."""
    own, less = _size(n, QUARTERS), _size(n - 1, QUARTERS)

    def side(kind: str, p: Column, q: int) -> Column:
        rest = F.substr(line, p * q + 1, n - p * (QUARTERS[0] - 1))
        return F.struct(F.lit(kind).alias("kind"), _around(line, n, p, q, QUARTERS).alias("base"), rest.alias("rest"))

    every = F.array(*(side(kind, p, q) for q in range(QUARTERS[0]) for kind, p in (("sub", own), ("del", less), ("whole", own))))
    return F.filter(every, lambda s: F.array_contains(keys, s["base"]))


def _keys(kind: Column, base: Column, rest: Column) -> Column:
    """Keys of a side: its deletion neighbourhood with places for substitutions, without for deletions, or it as a whole."""
    places = F.sequence(F.lit(0), F.length(rest) - 1)
    cut = lambda i: F.concat(F.substr(rest, F.lit(1), i), F.substr(rest, i + 2, F.lit(1 << 30)))
    sub = F.transform(places, lambda i: F.xxhash64(base, F.length(rest), i, cut(i)))
    gone = F.array_distinct(F.transform(places, lambda i: F.xxhash64(base, cut(i))))
    return F.when(kind == "sub", sub).when(kind == "del", gone).otherwise(F.array(F.xxhash64(base, rest)))


def _near(lines: DataFrame, near_chars: int) -> DataFrame:
    """From h1, h2, pos, line: the lines that have an earlier one within one edit."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = F.length("line")
    again = _candidates(stage(lines.select("h1", "h2", "pos", n.alias("n"), _piece_keys(F.col("line"), n, QUARTERS, near_chars).alias("keys"))))
    kept = stage(lines.join(again.select("h1", "h2", "keys"), ["h1", "h2"]))
    sides = kept.repartition(parts, "h1").select(F.struct("pos", "h1", "h2").alias("x"), F.explode(_sides(F.col("line"), F.length("line"), F.col("keys"))).alias("s")).select("x", "s.*")
    keyed = sides.select("x", (F.col("kind") == "whole").alias("whole"), F.explode(_keys(F.col("kind"), F.col("base"), F.col("rest"))).alias("key"))
    group = Window.partitionBy("key")
    met = keyed.select("x", "whole", F.min(F.when(F.col("whole"), F.col("x"))).over(group).alias("whole_x"), F.min(F.when(~F.col("whole"), F.col("x"))).over(group).alias("cut_x"))
    # in a key with a whole line the cut ones meet it alone, and it meets the first of them; else all meet the first
    other = F.when(F.col("whole_x").isNotNull() & ~F.col("whole"), F.col("whole_x")).otherwise(F.col("cut_x"))
    pairs = stage(met.select("x", other.alias("by")).where("by < x").distinct())
    text = lines.select("h1", "h2", "line")
    left = pairs.select("x", "by", F.col("x.h1").alias("h1"), F.col("x.h2").alias("h2")).join(text, ["h1", "h2"])
    both = left.select("h1", "h2", "line", F.col("by.h1").alias("b1"), F.col("by.h2").alias("b2")).join(text.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("line").alias("earlier")), ["b1", "b2"])
    return both.where(F.levenshtein("line", "earlier", 1) >= 0).select("h1", "h2").distinct()


def dropped_lines(docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """doc_id, line_no, h1 of the lines that go."""
    lines = stage(_lines(docs, near_chars))
    first = stage(lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("pos"), F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    wanted = _candidates(first)
    by_doc = wanted.groupBy(F.col("pos.doc_id").alias("d")).agg(F.collect_list(F.struct(F.col("pos.line_no").alias("line_no"), "h1", "h2", "pos")).alias("wanted"))
    split = F.split("text", "\n", -1)
    texts = by_doc.join(docs.select("doc_id", "text"), F.col("d").eqNullSafe(F.col("doc_id"))).select(F.explode(F.transform("wanted", lambda w: F.struct(w["h1"].alias("h1"), w["h2"].alias("h2"), w["pos"].alias("pos"), F.trim(F.get(split, w["line_no"])).alias("line")))).alias("x")).select("x.*")
    texts = stage(texts.where((F.xxhash64("line") == F.col("h1")) & (F.hash("line") == F.col("h2"))).dropDuplicates(["h1", "h2"]))
    near = stage(_near(texts, near_chars))
    again = first.where("c > 1").select("h1", "h2", "pos")
    equal = lines.select("doc_id", "line_no", "h1", "h2").join(again, ["h1", "h2"]).where(~F.struct("doc_id", "line_no").eqNullSafe(F.col("pos"))).select("doc_id", "line_no", "h1")
    return equal.unionByName(first.join(near, ["h1", "h2"]).select("pos.doc_id", "pos.line_no", "h1"))


def dedup_lines(docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """``docs`` with the lines gone from text, and before/after counts of non-blank lines in n_lines, n_kept (underscored where taken)."""
    gone = dropped_lines(docs, near_chars).groupBy("doc_id").agg(F.collect_set(F.struct("line_no", "h1")).alias("gone"))
    d, g, before, after = (free_name(docs, x) for x in ("gone_id", "gone", "n_lines", "n_kept"))
    gone = gone.select(F.col("doc_id").alias(d), F.col("gone").alias(g))
    out = docs.join(gone, docs["doc_id"].eqNullSafe(gone[d]), "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(g, F.struct(i.alias("line_no"), F.xxhash64(F.trim(x)).alias("h1")))), "\n")
    lines = lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), "\n", -1), lambda x: F.trim(x) != "")).cast("long")
    out = out.withColumn(before, lines(F.col("text"))).withColumn("text", F.when(F.col(g).isNull(), F.col("text")).otherwise(kept))
    out = out.withColumn(after, F.when(F.col(g).isNull(), F.col(before)).otherwise(lines(F.col("text"))))
    return out.select(*docs.columns, before, after)


def report(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_kept", "text")
