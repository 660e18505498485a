"""Extractors of zipped documents: DOCX, ODT, EPUB and XLSX, from bytes."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame

from stratum.sources.extract import rows

#: Bounds of an archive's entries and inflated bytes, and columns of a sheet.
ENTRIES, INFLATED, COLUMNS = 10_000, 256 << 20, 16_384

Block = tuple[str, str, str, str]


class Trail:
    """Headings that a block stands under."""

    def __init__(self):
        self.at: list[str | None] = [None] * 6

    def push(self, level: int, title: str) -> None:
        self.at[level - 1 :] = [title] + [None] * (6 - level)

    def __str__(self) -> str:
        return " > ".join(t for t in self.at if t)


def opened(data: bytes) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(data))
    if len(z.infolist()) > ENTRIES or sum(i.file_size for i in z.infolist()) > INFLATED:
        raise ValueError("the archive is over its bounds")
    return z


def local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _attr(e: ET.Element, name: str) -> str:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), "")


def docx(data: bytes) -> Iterator[Block]:
    body = next(e for e in ET.fromstring(opened(data).read("word/document.xml")) if local(e) == "body")
    text = lambda e: "".join({"t": x.text or "", "tab": "\t", "br": "\n"}.get(local(x), "") for x in e.iter())
    trail, n = Trail(), {"p": 0, "tbl": 0}
    for e in body:
        kind = local(e)
        if kind not in n:
            continue
        n[kind] += 1
        anchor = f"body/{kind}[{n[kind]}]"
        if kind == "tbl":
            rows = ["  ".join(text(c).strip() for c in r if local(c) == "tc") for r in e if local(r) == "tr"]
            if any(r.strip() for r in rows):
                yield "table", str(trail), "\n".join(rows), anchor
            continue
        own = text(e).strip()
        if not own:
            continue
        style = next((_attr(x, "val") for x in e.iter() if local(x) == "pStyle"), "")
        if style.startswith("Heading") and style[7:].isdigit() and 1 <= int(style[7:]) <= 6:
            trail.push(int(style[7:]), own)
            yield "heading", str(trail), own, anchor
        else:
            yield "paragraph", str(trail), own, anchor


def odt(data: bytes) -> Iterator[Block]:
    def text(e: ET.Element) -> str:
        own = {"s": " " * min(32, int(_attr(e, "c") or 1)), "tab": "\t", "line-break": "\n"}.get(local(e), e.text or "")
        return own + "".join(text(c) + (c.tail or "") for c in e)

    trail, n = Trail(), {"h": 0, "p": 0}
    for e in ET.fromstring(opened(data).read("content.xml")).iter():
        kind = local(e)
        if kind not in n or "text:1.0" not in e.tag:
            continue
        n[kind] += 1
        own = text(e).strip()
        if not own:
            continue
        if kind == "h":
            trail.push(min(6, max(1, int(_attr(e, "outline-level") or 1))), own)
        yield "heading" if kind == "h" else "paragraph", str(trail), own, f"body/text:{kind}[{n[kind]}]"


def epub(data: bytes) -> Iterator[Block]:
    z = opened(data)
    opf = next(_attr(e, "full-path") for e in ET.fromstring(z.read("META-INF/container.xml")).iter() if local(e) == "rootfile")
    package = ET.fromstring(z.read(opf))
    href = {_attr(e, "id"): _attr(e, "href") for e in package.iter() if local(e) == "item"}
    for at, ref in enumerate(e for e in package.iter() if local(e) == "itemref"):
        trail = Trail()
        for e in ET.fromstring(z.read(posixpath.normpath(posixpath.join(posixpath.dirname(opf), href[_attr(ref, "idref")])))).iter():
            kind = local(e)
            if kind != "p" and not (len(kind) == 2 and kind[0] == "h" and kind[1] in "123456"):
                continue
            own = " ".join("".join(("\n" if local(x) == "br" else x.text or "") + ((x.tail or "") if x is not e else "") for x in e.iter()).split())
            if not own:
                continue
            if kind != "p":
                trail.push(int(kind[1]), own)
            yield "paragraph" if kind == "p" else "heading", str(trail), own, f"spine[{at}]"


def xlsx(data: bytes) -> Iterator[Block]:
    z = opened(data)
    strings = ["".join(t.text or "" for t in s.iter() if local(t) == "t") for s in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    target = {_attr(e, "Id"): _attr(e, "Target") for e in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for sheet in (e for e in ET.fromstring(z.read("xl/workbook.xml")).iter() if local(e) == "sheet"):
        name, path = _attr(sheet, "name"), target[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
        lines = []
        for r in (e for e in ET.fromstring(z.read(posixpath.normpath(posixpath.join("xl", path)).lstrip("/"))).iter() if local(e) == "row"):
            cells: dict[int, str] = {}
            for c in (x for x in r if local(x) == "c"):
                value = "".join(x.text or "" for x in c.iter() if local(x) in ("v", "t"))
                if _attr(c, "t") == "s" and value:
                    value = strings[int(value)]
                elif value.endswith(".0"):
                    value = value[:-2]
                column = 0
                for ch in "".join(x for x in _attr(c, "r") if x.isalpha())[:4].upper():
                    column = column * 26 + ord(ch) - 64
                column = column or max(cells, default=-1) + 2  # a cell may leave out its reference: it follows the one before
                if column > COLUMNS:
                    raise ValueError(f"sheet {name} has a cell beyond column {COLUMNS}")
                cells[column - 1] = value
            lines.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        head = [h.strip() or f"Column {i + 1}" for i, h in enumerate(lines[0])] if lines else []
        for n, row in enumerate(lines[1:], 1):
            yield "table", name, "; ".join(f"{h}: {c}" for h, c in zip(head, [*row, *[""] * len(head)])), f"/{name}/row[{n}]"


READERS: dict[str, Callable[[bytes], Iterator[Block]]] = {"docx": docx, "odt": odt, "epub": epub, "xlsx": xlsx}


def blocks(files: DataFrame) -> DataFrame:
    """source, kind, block_no, block_type, section_path, text, anchor, error over (source, kind, content).

    ``content`` is what the binaryFile source reads. A file that can't be read gives one row with the error.
    """

    def read(source: str, kind: str, content: bytes) -> list[tuple]:
        try:
            return [(source, kind, n, *b, None) for n, b in enumerate(READERS[kind](bytes(content)))]
        except Exception as e:  # noqa: BLE001  one bad file must not stop the others
            return [(source, kind, 0, None, None, None, None, f"{type(e).__name__}: {e}"[:200])]

    return files.select("source", "kind", "content").mapInArrow(lambda batches: rows(batches, read, "source", pa.string()), "source string, kind string, block_no int, block_type string, section_path string, text string, anchor string, error string")
