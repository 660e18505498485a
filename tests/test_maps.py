"""Structural maps by levels."""

import pytest
from pyspark.sql import functions as F

from stratum.operators import maps

SHAPE = "source_id bigint, part bigint, text string"


def told(frame):
    return sorted(tuple(r) for r in frame.collect())


def packed(sizes, most, least):
    """Plain greedy packing."""
    out, used, held = [], 0, 0
    for n in sizes:
        if held >= least and used + 2 + n > most:
            out.append((out[-1] + 1) if out else 0)
            used, held = n, 1
        else:
            out.append(out[-1] if out else 0)
            used, held = used + n + (2 if held else 0), held + 1
    return out


@pytest.mark.parametrize("most,least", [(10, 1), (30, 1), (10, 2), (1, 1), (1000, 1)])
def test_batches_are_greedy(spark, most, least):
    sizes = {s: [(s * 7 + i * 13) % 23 for i in range(s * 40)] for s in range(1, 6)}
    rows = [(s, i, n) for s, x in sizes.items() for i, n in enumerate(x)]
    got = told(maps.batched(spark.createDataFrame(rows, "source_id bigint, part bigint, n_bytes bigint").repartition(7), most, least))
    assert got == sorted((s, i, b) for s, x in sizes.items() for i, b in enumerate(packed(x, most, least)))


def names(rows):
    """Words as entities, and the text's first word as its summary; parts that begin with ! can't be read."""
    ok = rows.where("text not like '!%'")
    return ok.select("source_id", "part", F.split("text", r"\s+").alias("entities"), F.array(F.struct(F.substring_index("text", " ", 1).alias("term"), F.lit("d").alias("text"))).alias("definitions"), F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)).alias("dates"), F.substring_index("text", " ", 1).alias("summary"))


def one(spark, rows, reduce=None, most=4):
    got = maps.structural_map(spark.createDataFrame(rows, SHAPE), names, reduce, most).collect()
    return {r["source_id"]: (r["status"], list(r["entities"]), [d["term"] for d in r["definitions"]], list(r["dates"]), r["summary"]) for r in got}


def test_maps_of_batches_are_merged_in_order(spark):
    rows = [(1, 0, "b a 12"), (1, 1, "a c"), (1, 2, "b d 7 12"), (2, 0, "only"), (3, 0, "!x"), (4, 0, "!x"), (4, 1, "good")]
    assert one(spark, rows) == {
        1: ("ok", ["b", "a", "12", "c", "d", "7"], ["b", "a", "b"], ["12", "7"], "b a b"),
        2: ("ok", ["only"], ["only"], [], "only"), 3: ("fallback", [], [], [], ""), 4: ("ok", ["good"], ["good"], [], "good"),
    }


@pytest.mark.parametrize("n", [2, 3, 17, 100])
def test_many_levels_come_to_the_same_as_one(spark, n):
    rows = [(1, i, f"w{i % 5} x{i}") for i in range(n)]
    status, entities, terms, dates, summary = one(spark, rows)[1]
    first = lambda x: list(dict.fromkeys(x))[: maps.MOST_ITEMS]
    assert (status, entities) == ("ok", first(w for _, _, t in rows for w in t.split())) and summary == " ".join(f"w{i % 5}" for i in range(n))
    assert terms == [f"w{i % 5}" for i in range(n)][: maps.MOST_ITEMS] and dates == first(d for i in range(n) for d in (str(i % 5), str(i)))


def test_bounds_hold_over_levels(spark):
    rows = [(1, i, " ".join(f"n{i}_{j}" for j in range(90)) + " " + "z" * 1500) for i in range(6)]
    status, entities, terms, _, summary = one(spark, rows)[1]
    assert len(entities) == maps.MOST_ITEMS and entities[90] == "z" * maps.FIELD_CHARS and entities[91] == "n1_0" and len(terms) == 6


def test_reductions_take_the_place_of_merging_where_they_give_a_map(spark):
    asked = []

    def reduce(rows):
        asked.extend(r["text"] for r in rows.collect())
        return names(rows.where("source_id = 1").select("source_id", "part", F.lit("reduced").alias("text")))

    got = one(spark, [(s, i, f"{c} x") for s in (1, 2) for i, c in enumerate("ab")] + [(3, 0, "alone")], reduce)
    assert got[1] == ("ok", ["reduced"], ["reduced"], [], "reduced") and got[2] == ("ok", ["a", "x", "b"], ["a", "b"], [], "a b") and got[3][1] == ["alone"]
    assert set(asked) == {"Section 1: entities=[a, x]; dates=[]; summary=a\nSection 2: entities=[b, x]; dates=[]; summary=b"}


def test_nulls_and_nothing(spark):
    assert one(spark, [(1, 0, None), (1, 1, "a")])[1][1] == ["", "a"]
    assert one(spark, []) == {}
    bare = lambda rows: rows.selectExpr("source_id", "part", "cast(null as array<string>) entities", "cast(null as array<struct<term:string,text:string>>) definitions", "cast(null as array<string>) dates", "cast(null as string) summary")
    got = maps.structural_map(spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], SHAPE), bare, None, 1).collect()
    assert [tuple(r) for r in got] == [(1, "ok", [], [], [], "")]


def test_the_stand_in(spark):
    text = "Ada Lovelace is a mathematician. She wrote in 1843, on 2020-01-02. Rust means iron oxide!"
    r = maps.phrases(spark.createDataFrame([(1, 0, text)], SHAPE)).first()
    assert r["entities"] == ["Ada", "Lovelace", "She", "Rust"] and r["dates"] == ["1843", "2020-01-02"] and r["summary"] == "Ada Lovelace is a mathematician."
    assert [tuple(d) for d in r["definitions"]] == [("Lovelace", "a mathematician"), ("Rust", "iron oxide")]
