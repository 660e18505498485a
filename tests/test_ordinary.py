"""Ordinary input that once stopped a query or lost text without a word."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from stratum.functions import text
from stratum.operators import answer, search, upkeep, vectors
from stratum.sources import archives, extract
from stratum.sources.batches import by_row, slices


def test_long_numbers_in_brackets_cite_nothing(spark):
    df = spark.createDataFrame([(1, "see [20250101123456] and [2, 99999999999] or [3]"), (2, "none")], "answer_id long, text string")
    assert [r.m for r in df.select(text.markers(F.col("text")).alias("m")).collect()] == [[3], []]
    assert answer.citation_diagnosis(df).where("answer_id = 1").first().n_markers == 1
    units = spark.createDataFrame([(1, 2, 13)], "for_answer long, pos int, unit_id long")
    assert [tuple(r) for r in answer.citations(df, units).collect()] == [(1, 0, 3, 13)]


def test_long_section_numbers_name_no_part(spark):
    q = spark.createDataFrame([(1, 7, "what does section 99999999999 say"), (2, 7, "what does section 2 say"), (3, 7, "chapter " + "m" * 5000)], "query_id long, notebook_id long, text string")
    assert [(r.query_id, r.n) for r in search.targets(q).collect()] == [(2, 2)]


@pytest.mark.parametrize(
    "raw,want",
    [
        ("HTTP://Bob:SeCret@Example.COM", "http://Bob:SeCret@example.com/"),
        ("https://U@X@Example.com:443/A?B", "https://U@X@example.com/A?B"),
        ("http://Example.com:8080/", "http://example.com:8080/"),
    ],
)
def test_users_and_passwords_keep_their_case(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "u string").select(text.normalized_url(F.col("u"))).first()[0] == want


def test_vectors_without_components_are_nobodys_neighbour(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [None, 1.0]), (3, []), (4, None), (5, [0.0, 1.0])], "chunk_id long, vector array<double>")
    asked = rows.withColumnRenamed("chunk_id", "query_id")
    for found in (vectors.knn(rows, asked, 5), vectors.ivf(rows, asked, 5, cells=2)):
        assert sorted((r.query_id, r.chunk_id) for r in found.collect()) == [(1, 1), (1, 5), (5, 1), (5, 5)]
    with pytest.raises(Exception, match="components"):
        vectors.knn(rows.union(spark.createDataFrame([(6, [1.0])], rows.schema)), asked, 5).collect()
    with pytest.raises(Exception, match="components"):
        vectors.knn(rows, spark.createDataFrame([(6, [1.0])], asked.schema), 5).collect()


def test_segments_without_text_take_their_place(spark):
    s = spark.createDataFrame([(1, 0, 0.0, 1.0, "ab"), (1, 1, 1.0, 2.0, None), (1, 2, 2.0, 3.0, "c")], "source_id long, seg_no int, start double, end double, text string")
    assert [(r.byte_start, r.byte_end, r.text) for r in upkeep.transcript_blocks(s).orderBy("seg_no").collect()] == [(0, 2, "ab"), (4, 4, ""), (6, 7, "c")]
    assert "\n\n".join(["ab", "", "c"])[6:7] == "c"


def read(spark, kind, raw):
    out = extract.blocks(spark.createDataFrame([(1, kind, raw)], "source_id long, kind string, raw string")).orderBy("block_no").collect()
    return [(r.block_type, r.section_path, r.text) for r in out if r.error is None], [r.error for r in out if r.error]


def test_xml_keeps_all_direct_text(spark):
    got, errors = read(spark, "xml", "<?xml version='1.0' encoding='latin-1'?><p>one <b a='1'>two</b> three<!-- no --> <![CDATA[four]]></p>")
    assert [(p, t) for _, p, t in got] == [("/p", "one  three four"), ("/p/b", "@a=1 two")] and not errors


def test_xml_that_is_too_deep_says_so(spark):
    deep = lambda n: "<r>top" + "".join(f"<e>{i}" for i in range(n)) + "</e>" * n + " tail</r>"
    got, errors = read(spark, "xml", deep(70))
    assert got[0][2] == "top tail" and len(got) == 65 and errors == ["nested deeper than 64 elements, left out"]
    assert read(spark, "xml", deep(64))[1] == [] and len(read(spark, "xml", deep(64))[0]) == 65
    assert read(spark, "xml", deep(300)) == ([], ["ValueError: nested deeper than 256 elements"])
    bomb = "<!DOCTYPE x [<!ENTITY a 'ha'><!ENTITY b '&a;&a;&a;'>]><x>&b;</x>"
    assert read(spark, "xml", bomb) == ([], ["ValueError: a document type is not read"])


@pytest.mark.parametrize(
    "raw,want",
    [
        (r"{\rtf1\ansi caf\'e9 \{x\}\par next}", ["café {x}", "next"]),
        (r"{\rtf1\ansi\ansicpg1251 \'cf\'f0\'e8\par}", ["При"]),
        (r"{\rtf1\ansi\uc1 a\u8364?b \u-10179?\u-8704? c\par}", ["a€b 😀 c"]),
        (r"{\rtf1{\fonttbl{\f0 Arial;}}{\*\generator x;}{\info{\title no}}\b bold\b0  plain\\ \endash\par}", ["bold plain\\ –"]),
    ],
)
def test_rtf_escapes(spark, raw, want):
    assert [t for _, _, t in read(spark, "rtf", raw)[0]] == want


def test_markdown_quotes_rules_and_continued_items(spark):
    got, _ = read(spark, "markdown", "> quoted\n> on\n\n***\n\n- item\n  goes on\n- next\n\n```\n> code\n***\n```\nTitle\n---\nend\n* * *")
    assert [(k, t) for k, _, t in got] == [("paragraph", "quoted\non"), ("list_item", "item\ngoes on"), ("list_item", "next"), ("code", "> code\n***"), ("heading", "Title"), ("paragraph", "end")]


def sheet(cells: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="s.xml"/></Relationships>')
        z.writestr("xl/s.xml", f"<worksheet><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


def test_cells_without_references(spark):
    rows = "<row><c><v>a</v></c><c><v>b</v></c></row><row><c><v>1</v></c><c r='D2'><v>3</v></c><c><v>4</v></c></row>"
    far = "<row><c r='ZZZZZZ1'><v>a</v></c></row>"
    files = spark.createDataFrame([("x", "xlsx", bytearray(sheet(rows))), ("y", "xlsx", bytearray(sheet(far)))], "source string, kind string, content binary")
    got = {r.source: (r.text, r.error) for r in archives.blocks(files).collect()}
    assert got["x"][0] == "a: 1; b: " and "16384" in got["y"][1]


def test_values_become_objects_a_slice_at_a_time():
    import pyarrow as pa

    seen = []
    texts = pa.array(["x" * 3_000_000, None, "y"] * 6)
    out = by_row((texts,), lambda t: seen.append(t) or len(t or ""), pa.int64())
    assert out.to_pylist() == [3_000_000, 0, 1] * 6 and len(seen) == 18
    assert max(p.num_rows for p in slices(pa.RecordBatch.from_arrays([texts], names=["t"]))) <= 8
