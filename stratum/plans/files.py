"""Files of every kind through their extractors, made of the tables' own rows, and what is written out of them."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.operators import answer, mentions
from stratum.sources import archives, extract
from stratum.sources.tables import load


def _zip(*files: tuple[str, Column]) -> Column:
    """Archive of files by name, their contents columns."""
    names = [n for n, _ in files]

    @F.pandas_udf("binary")
    def made(*texts: pd.Series) -> pd.Series:
        def one(row) -> bytes:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                for name, text in zip(names, row):
                    z.writestr(name, text)
            return out.getvalue()

        return pd.Series([one(r) for r in zip(*texts)])

    return made(*(c for _, c in files))


def _xml(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _nations(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region"))


def _text(n: DataFrame, kind: str, raw: Column) -> DataFrame:
    return extract.blocks(n.select(F.col("id").alias("source_id"), F.lit(kind).alias("kind"), raw.alias("raw"))).where("error is null").select("source_id", "block_no", "block_type", "section_path", "text", "anchor")


def _archive(n: DataFrame, kind: str, content: Column) -> DataFrame:
    return archives.blocks(n.select(F.col("id").cast("string").alias("source"), F.lit(kind).alias("kind"), content.alias("content"))).where("error is null").select("source", "block_no", "block_type", "section_path", "text", "anchor")


def yaml_blocks(spark: SparkSession, d: str) -> DataFrame:
    n = _nations(spark, d)
    return _text(n, "yaml", _xml("region: ", F.col("region"), "\nlist:\n  - \"", F.col("name"), "\"\n  - true\n")).drop("section_path")


def xml_blocks(spark: SparkSession, d: str) -> DataFrame:
    n = _nations(spark, d)
    return _text(n, "xml", _xml("<r><n k=\"", F.col("region"), "\">", F.col("name"), "</n><empty/><m> x </m></r>"))


def rtf_blocks(spark: SparkSession, d: str) -> DataFrame:
    n = _nations(spark, d)
    return _text(n, "rtf", _xml(r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}\f0 ", F.col("name"), r"\par \b Region \b0 ", F.col("region"), r" caf\u233?\par}")).drop("section_path")


def docx_blocks(spark: SparkSession, d: str) -> DataFrame:
    n = _nations(spark, d)
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = _xml(f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>', F.col("name"), "</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Region</w:t><w:tab/><w:t>", F.col("region"), "</w:t></w:r></w:p></w:body></w:document>")
    return _archive(n, "docx", _zip(("word/document.xml", body)))


def odt_blocks(spark: SparkSession, d: str) -> DataFrame:
    n = _nations(spark, d)
    o = "urn:oasis:names:tc:opendocument:xmlns:text:1.0"
    return _archive(n, "odt", _zip(("content.xml", _xml(f'<o xmlns:text="{o}"><text:h text:outline-level="1">', F.col("name"), '</text:h><text:p>Region<text:s text:c="2"/>', F.col("region"), "</text:p></o>")))).drop("anchor")


def epub_blocks(spark: SparkSession, d: str) -> DataFrame:
    n = _nations(spark, d)
    files = [("META-INF/container.xml", F.lit('<c><rootfile full-path="x/p.opf"/></c>')), ("x/p.opf", F.lit('<p><item id="i" href="one.html"/><item id="j" href="two.html"/><itemref idref="j"/><itemref idref="i"/></p>')), ("x/one.html", _xml("<html><p>Region ", F.col("region"), "</p></html>")), ("x/two.html", _xml("<html><h1>", F.col("name"), "</h1></html>"))]
    return _archive(n, "epub", _zip(*files)).drop("section_path")


def xlsx_blocks(spark: SparkSession, d: str) -> DataFrame:
    n = _nations(spark, d)
    files = [("xl/workbook.xml", F.lit('<w xmlns:r="u"><sheet name="S" r:id="r1"/></w>')), ("xl/_rels/workbook.xml.rels", F.lit('<r><Relationship Id="r1" Target="s1.xml"/></r>')), ("xl/sharedStrings.xml", _xml("<s><si><t>Name</t></si><si><t>", F.col("name"), "</t></si></s>")),
             ("xl/s1.xml", _xml('<ws><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.0</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>', F.col("region"), "</v></c></row></ws>"))]
    return _archive(n, "xlsx", _zip(*files))


def extension_errors(spark: SparkSession, d: str) -> DataFrame:
    ext = F.element_at(F.array(*(F.lit(x) for x in ("PDF", "docx", "mdx", "xls", "flac", "exe", "Tar"))), (F.col("page_id") % 7 + 1).cast("int"))
    return load(spark, d, "pages").select("page_id", F.coalesce(extract.kind_of(ext), extract.kind_error(ext)).alias("kind"))


def table_markdown(spark: SparkSession, d: str) -> DataFrame:
    """A nation's suppliers as a Markdown table, with a short row and signs that would break the grid."""
    s = load(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("r"))
    rows = F.transform("r", lambda x: F.when(x["s_suppkey"] % 2 == 0, F.array(x["s_suppkey"].cast("string"))).otherwise(F.array(x["s_suppkey"].cast("string"), F.concat(x["s_name"], F.lit("|a`\\\nb")))))
    return s.select("s_nationkey", extract.table_markdown(F.array(F.lit("Key"), F.lit("Na|me")), rows).alias("markdown"))


def json_arrays(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    return e.select("event_id", mentions.first_json(F.concat(F.lit('Sure: "x] " ['), "props", F.lit(', "]\\"", [1]] done []')), "[").alias("json"))


def notes_document(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as notebooks; assistants' turns cite one of three sources."""
    c = load(spark, d, "conversations")
    cites = F.col("role") == "assistant"
    return mentions.notes_document(c.select(F.col("conv_id").alias("notebook_id"), F.concat(F.lit("Book "), F.col("conv_id").cast("string")).alias("title"), F.col("turn").alias("note_id"), (F.col("turn") % 4 == 2).alias("pinned"), F.col("text").alias("content"), F.when(cites, F.col("turn") % 3).alias("source_id"), F.when(cites & (F.col("turn") % 3 > 0), F.concat(F.lit("S"), (F.col("turn") % 3).cast("string"))).alias("source_title")))


def dialogue_citations(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "conversations")
    live = load(spark, d, "documents").where("doc_id % 11 <> 0").select(F.col("doc_id").alias("source_id"))
    return answer.cited_unknown(c.select("conv_id", F.array("conv_id", F.col("conv_id") + F.col("turn")).alias("source_ids")), live)


QUERIES = {f.__name__: f for f in (yaml_blocks, xml_blocks, rtf_blocks, docx_blocks, odt_blocks, epub_blocks, xlsx_blocks, extension_errors, table_markdown, json_arrays, notes_document, dialogue_citations)}


def _rows(*rows: str) -> str:
    return " UNION ALL ".join(f"SELECT {r} FROM nation" for r in rows)


_ID, _SOURCE = "CAST(n_nationkey AS BIGINT) AS source_id", "CAST(n_nationkey AS VARCHAR) AS source"
ORACLES = {
    "yaml_blocks": _rows(f"{_ID}, 0 AS block_no, 'yaml' AS block_type, '/list/0: ' || n_name AS text, '/list/0' AS anchor", f"{_ID}, 1, 'yaml', '/list/1: true', '/list/1'", f"{_ID}, 2, 'yaml', '/region: ' || n_regionkey, '/region'"),
    "xml_blocks": _rows(f"{_ID}, 0 AS block_no, 'xml' AS block_type, '/r/n' AS section_path, '@k=' || n_regionkey || ' ' || n_name AS text, '/r/n' AS anchor", f"{_ID}, 1, 'xml', '/r/m', 'x', '/r/m'"),
    "rtf_blocks": _rows(f"{_ID}, 0 AS block_no, 'paragraph' AS block_type, n_name AS text, '0' AS anchor", f"{_ID}, 1, 'paragraph', 'Region ' || n_regionkey || ' café', '1'"),
    "docx_blocks": _rows(f"{_SOURCE}, 0 AS block_no, 'heading' AS block_type, n_name AS section_path, n_name AS text, 'body/p[1]' AS anchor", f"{_SOURCE}, 1, 'paragraph', n_name, 'Region' || chr(9) || n_regionkey, 'body/p[3]'"),
    "odt_blocks": _rows(f"{_SOURCE}, 0 AS block_no, 'heading' AS block_type, n_name AS section_path, n_name AS text", f"{_SOURCE}, 1, 'paragraph', n_name, 'Region  ' || n_regionkey"),
    "epub_blocks": _rows(f"{_SOURCE}, 0 AS block_no, 'heading' AS block_type, n_name AS text, 'spine[0]' AS anchor", f"{_SOURCE}, 1, 'paragraph', 'Region ' || n_regionkey, 'spine[1]'"),
    "xlsx_blocks": _rows(f"{_SOURCE}, 0 AS block_no, 'table' AS block_type, 'S' AS section_path, 'Name: ' || n_name || '; Column 2: ; 2: ' || n_regionkey AS text, '/S/row[1]' AS anchor"),
    "extension_errors": "SELECT page_id, ['pdf', 'docx', 'markdown', 'xls', 'audio', 'unsupported file extension exe', 'unsupported file extension Tar'][page_id % 7 + 1] AS kind FROM pages",
    "table_markdown": r"""SELECT s_nationkey, '| Key | Na\|me |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || s_suppkey || ' | ' || CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE s_name || '\|a\`\\ b' END || ' |' || chr(10), '' ORDER BY s_suppkey) AS markdown FROM supplier GROUP BY s_nationkey""",
    "json_arrays": r"""SELECT event_id, '[' || props || ', "]\"", [1]]' AS json FROM events""",
    "notes_document": """WITH c AS (SELECT *, role = 'assistant' AS cites, min(turn) OVER (PARTITION BY conv_id, role = 'assistant', turn % 3) AS first FROM conversations), b AS (SELECT *, trim(text, ' ') || CASE WHEN cites AND turn % 3 > 0 THEN chr(10) || chr(10) || '*Source: S' || (turn % 3) || '*' ELSE '' END AS body FROM c),
p AS (SELECT conv_id, string_agg(body, chr(10) || chr(10) ORDER BY first, turn) FILTER (cites) AS insights, string_agg(body, chr(10) || chr(10) ORDER BY turn % 4 <> 2, turn) FILTER (NOT cites) AS own FROM b GROUP BY conv_id)
SELECT conv_id AS notebook_id, '# Book ' || conv_id || coalesce(chr(10) || chr(10) || '## KEY INSIGHTS' || chr(10) || chr(10) || insights, '') || coalesce(chr(10) || chr(10) || '## PERSONAL NOTES' || chr(10) || chr(10) || own, '') AS markdown FROM p""",
    "dialogue_citations": "WITH l AS (SELECT doc_id FROM documents WHERE doc_id % 11 <> 0), x AS (SELECT conv_id, unnest([conv_id, conv_id + turn]) AS s FROM conversations) SELECT DISTINCT conv_id FROM x WHERE s NOT IN (SELECT doc_id FROM l)",
}
