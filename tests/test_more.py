"""Archives, mentions, snippets and the stream redactor."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from stratum.operators import mentions
from stratum.functions.address import is_public
from stratum.functions.embed import embedded
from stratum.operators import answer
from stratum.sources import archives, sinks
from stratum.streaming import redact

W, O = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "urn:oasis:names:tc:opendocument:xmlns:text:1.0"


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


DOCX = zipped(**{"word__document.xml": f'<w:document xmlns:w="{W}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
ODT = zipped(**{"content.xml": f'<o xmlns:text="{O}"><text:h text:outline-level="2">Head</text:h><text:p>a<text:s text:c="3"/>b</text:p><text:p/></o>'})
EPUB = zipped(**{"META-INF__container.xml": '<c><rootfile full-path="x/p.opf"/></c>', "x__p.opf": '<p><item id="i" href="one.html"/><item id="j" href="two.html"/><itemref idref="j"/><itemref idref="i"/></p>', "x__one.html": "<html><h1>One</h1><p>first</p></html>", "x__two.html": "<html><p>sec<b>on</b>d</p></html>"})
XLSX = zipped(**{"xl__workbook.xml": '<w xmlns:r="u"><sheet name="S" r:id="r1"/></w>', "xl___rels__workbook.xml.rels".replace("___rels", "___rels"): "", "xl__sharedStrings.xml": "<s><si><t>Name</t></si><si><t>Ada</t></si></s>", "xl__s1.xml": '<ws><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.0</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>3.5</v></c></row></ws>'})


def xlsx():
    out = io.BytesIO(XLSX)
    with zipfile.ZipFile(out, "a") as z:
        z.writestr("xl/_rels/workbook.xml.rels", '<r><Relationship Id="r1" Target="s1.xml"/></r>')
    return out.getvalue()


@pytest.mark.parametrize("kind,data,want", [
    ("docx", DOCX, [("heading", "Top", "Top", "body/p[1]"), ("paragraph", "Top", "one\ttwo", "body/p[3]"), ("table", "Top", "a  b", "body/tbl[1]")]),
    ("odt", ODT, [("heading", "Head", "Head", "body/text:h[1]"), ("paragraph", "Head", "a   b", "body/text:p[1]")]),
    ("epub", EPUB, [("paragraph", "", "second", "spine[0]"), ("heading", "One", "One", "spine[1]"), ("paragraph", "One", "first", "spine[1]")]),
    ("xlsx", xlsx(), [("table", "S", "Name: Ada; Column 2: ; 2: 3.5", "/S/row[1]")]),
])
def test_archives(spark, kind, data, want):
    out = archives.blocks(spark.createDataFrame([("f", kind, data), ("bad", kind, b"no zip")], "source string, kind string, content binary")).orderBy("block_no").collect()
    assert [(r.block_type, r.section_path, r.text, r.anchor) for r in out if r.source == "f"] == want
    assert [r.error is not None for r in out if r.source == "bad"] == [True]


def test_seeds_take_the_longest_first(spark):
    names = spark.createDataFrame([(1, "Ada Lovelace"), (2, "ada"), (3, "Lovelace prize"), (4, "prize")], "node_id long, name string")
    q = spark.createDataFrame([(1, "Did Ada Lovelace win the prize?"), (2, "nobody")], "query_id long, text string")
    assert {(r.query_id, r.node_id, r.start, r.width) for r in mentions.seeds(names, q).collect()} == {(1, 1, 1, 2), (1, 4, 5, 1)}


def test_snippets_hold_whole_characters(spark):
    text = "é" * 300 + ". Middle ü part here. " + "中" * 300
    at = len(text[:302].encode())
    r = spark.createDataFrame([(text, at + 1, at + 7), (None, 1, 2)], "t string, a int, b int").select(mentions.snippet(F.col("t"), F.col("a"), F.col("b")).alias("s")).select("s.*").collect()
    assert "Middle ü part here." in r[0].text and r[1].text is None
    assert r[0].text[r[0].mark_start : r[0].mark_stop] in text


@pytest.mark.parametrize("deltas,want", [(["a``", "`b", "``", "`c"], "ac"), (["x"], "x"), (["``", "y"], "``y"), (["```s```t`"], "t")])
def test_redactor_steps(deltas, want):
    held, inside, out = "", False, ""
    for d in deltas:
        text, held, inside = redact.step(held, inside, d)
        out += text
    assert out == want


def test_redactor_keeps_state_between_batches(spark, tmp_path):
    for i, rows in enumerate(([(1, 0, "a``"), (2, 0, "x")], [(1, 1, "`secret"), (2, 1, "y")], [(1, 2, "```b")])):
        spark.createDataFrame(rows, "key long, seq long, delta string").coalesce(1).write.parquet(str(tmp_path / f"in/p={i}"))
    stream = spark.readStream.schema("key long, seq long, delta string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = redact.redacted(stream).writeStream.outputMode("append").format("memory").queryName("clean").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {}
    for r in sorted(spark.table("clean").collect(), key=lambda r: r.upto):
        got[r.key] = got.get(r.key, "") + r.text
    assert got == {1: "ab", 2: "xy"}


def test_partitions_are_replaced(spark, tmp_path):
    p = str(tmp_path / "t")
    sinks.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), p, "k")
    sinks.replace_partitions(spark.createDataFrame([(2, "c"), (2, "d")], "k int, v string"), p, "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(p).collect()) == [(1, "a"), (2, "c"), (2, "d")]


def test_generations(spark, tmp_path):
    root, none = str(tmp_path), spark.createDataFrame([], "coordinate string, generation int, status string")
    assert sinks.read_active(spark, none, root, "c") is None
    first = sinks.activate(sinks.new_generation(spark.range(3), none, root, "c"), "c")
    building = sinks.new_generation(spark.range(5), first, root, "c")
    assert sinks.read_active(spark, building, root, "c").count() == 3
    second = sinks.activate(building, "c")
    assert sinks.read_active(spark, second, root, "c").count() == 5
    folders = spark.createDataFrame([("c", 1), ("c", 2)], "coordinate string, generation int")
    assert [r.generation for r in sinks.orphans(second, folders).collect()] == [1]


def test_embedder_is_unit_and_near_for_shared_terms(spark):
    v = [r.v for r in spark.createDataFrame([(0, "red fox runs"), (1, "red fox sleeps"), (2, "green tea"), (3, None)], "i int, t string").orderBy("i").select(embedded(F.col("t")).alias("v")).collect()]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    assert abs(dot(v[0], v[0]) - 1) < 1e-9 and dot(v[0], v[1]) > dot(v[0], v[2]) and not any(v[3])


def test_public_addresses(spark):
    rows = [("http://example.com/x", True), ("https://8.8.8.8", True), ("http://127.0.0.1/", False), ("http://10.0.0.1", False), ("http://[::1]/", False), ("http://[::ffff:192.168.0.1]/", False), ("ftp://example.com", False), ("http://localhost:80", False), ("http://169.254.1.1", False), (None, False), ("http://[bad", False)]
    got = spark.createDataFrame(rows, "u string, want boolean").select("want", is_public(F.col("u")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_prompt_fits(spark):
    units = spark.createDataFrame([(1, 0, 50), (1, 1, 30), (1, 2, 30), (2, 0, 999)], "query_id long, place int, tokens int")
    history = spark.createDataFrame([(1, 0, 20), (1, 1, 20), (1, 2, 10)], "query_id long, place int, tokens int")
    u, h = answer.fitted(units, history, 110)
    assert {(r.query_id, r.place) for r in u.collect()} == {(1, 0), (1, 1), (2, 0)} and {r.place for r in h.collect()} == {1, 2}


def test_missing_index(spark):
    q, some, none = spark.createDataFrame([(1,)], "query_id long"), spark.range(1), spark.range(0)
    reg = lambda *s: spark.createDataFrame([(x,) for x in s], "status string")
    assert [answer.missing_index(q, c, r).first().retry for c, r in ((some, reg("stale")), (some, reg("active")), (none, reg()))] == [True, False, False]


def test_citations_are_read_from_whole_turns(spark, tmp_path):
    from stratum.plans import knowledge

    turns = [(4, 1, "assistant", "x" * 60 + " [4] and [^1] 【2】"), (8, 1, "assistant", "plain")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    cited = {(r.answer_id, r.marker) for r in knowledge.citation_markers(spark, str(tmp_path)).collect()}
    assert cited == {(401, 1), (401, 2), (401, 4), (801, 1), (801, 2)}
    diag = {r.answer_id: (r.wide, r.footnote) for r in knowledge.citation_diag(spark, str(tmp_path)).collect()}
    assert diag == {401: (True, True), 801: (False, False)}


def test_components_take_every_order(spark):
    from stratum.plans import catalog

    d = "/root/testdata/sf0.001"
    o = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_custkey * 2 AS u", "o_orderkey * 2 + 1 AS v")
    least = {r.u: min(r.u, r.v) for r in o.groupBy("u").agg({"v": "min"}).withColumnRenamed("min(v)", "v").collect()}
    want = {r.v: least[r.u] for r in o.collect()} | least
    got = {r.node: r.component for r in catalog.QUERIES["connected_components_orders"](spark, d).collect()}
    assert got == want
