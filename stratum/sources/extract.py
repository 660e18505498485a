"""Extractors: raw sources to typed blocks, row by row in Arrow batches."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.sources.batches import sliced

#: Bounds of nested values and arrays, and extensions by kind.
DEPTH, ELEMENTS, COLLAPSED, XML_DEPTH = 64, 10_000, 8192, 256
KINDS = {
    "pdf": "pdf", "docx": "docx", "txt": "text", "md": "markdown", "markdown": "markdown", "mdx": "markdown", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "yaml": "yaml", "yml": "yaml", "xml": "xml", "rtf": "rtf",
    "odt": "odt", "epub": "epub", "xlsx": "xlsx", "xls": "xls", "csv": "csv", "html": "html", "htm": "html", "mp3": "audio", "m4a": "audio", "aac": "audio", "wav": "audio", "flac": "audio",
}

Block = tuple[str, str, str, str]  # type, section path, text, anchor; a fifth value is what was left out there


def kind_of(extension):
    """Kind by lower-cased extension; null if unknown."""
    return F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))[F.lower(extension)]


def kind_error(extension):
    """What is wrong with an extension; null where its kind is known."""
    return F.when(kind_of(extension).isNull(), F.concat(F.lit("unsupported file extension "), F.coalesce(extension, F.lit("(none)"))))


def table_markdown(headers, rows):
    """A Markdown table of (array of names, array of arrays of cells): rows as long as the header, cells that can't break the grid."""
    names = F.transform(headers, lambda h, i: F.when(F.forall(headers, lambda x: F.trim(x) == ""), F.concat(F.lit("Column "), (i + 1).cast("string"))).otherwise(h))
    safe = lambda c: F.translate(F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("`"), F.lit("\\`")), "\n\r", "  ")
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |\n"))
    body = F.transform(rows, lambda r: line(F.transform(headers, lambda _, i: safe(F.get(r, i)))))
    return F.concat(line(F.transform(names, safe)), line(F.transform(headers, lambda _: F.lit("---"))), F.array_join(body, ""))


def leaves(value, path: str = "", depth: int = 0) -> Iterator[str]:
    """One line a scalar, keys sorted, with its pointer."""
    if depth > DEPTH:
        yield f"{path or '/'}: {json.dumps(value, ensure_ascii=False)[:COLLAPSED]}"
    elif isinstance(value, dict):
        for k in sorted(value):
            yield from leaves(value[k], f"{path}/{k}", depth + 1)
    elif isinstance(value, list):
        for i, v in enumerate(value[:ELEMENTS]):
            yield from leaves(v, f"{path}/{i}", depth + 1)
        if len(value) > ELEMENTS:
            yield f"{path}: [{len(value) - ELEMENTS} more]"
    else:
        yield f"{path or '/'}: {value if isinstance(value, str) else json.dumps(value)}"


def _json(raw: str) -> Iterator[Block]:
    for line in leaves(json.loads(raw)):
        yield "json", "", line, line.partition(":")[0]


def _jsonl(raw: str) -> Iterator[Block]:
    n = 0
    for line in raw.splitlines():
        try:
            value = json.loads(line)
        except ValueError:
            continue
        for text in leaves(value, f"/{n}"):
            yield "json", f"[{n}]", text, text.partition(":")[0]
        n += 1


def _yaml(raw: str) -> Iterator[Block]:
    import yaml

    docs = list(yaml.safe_load_all(raw))
    for n, doc in enumerate(docs):
        for text in leaves(doc, f"/{n}" if len(docs) > 1 else ""):
            yield "yaml", f"[{n}]" if len(docs) > 1 else "", text, text.partition(":")[0]


def _csv(raw: str) -> Iterator[Block]:
    rows = list(csv.reader(io.StringIO(raw.lstrip("\ufeff"))))
    if not rows:
        return
    head = [h.strip() for h in rows[0]]
    if not any(head):
        head = [f"Column {i + 1}" for i in range(len(head))]
    for n, row in enumerate(rows[1:], 1):
        cells = [*row, *[""] * len(head)][: len(head)]
        yield "table", "", "; ".join(f"{h}: {c}" for h, c in zip(head, cells)), f"/row[{n}]"


def _xml(raw: str) -> Iterator[tuple]:
    """One block an element with text or attributes, in document order, with all text that stands directly in it.

    What is deeper than DEPTH is left out and named in an error row; a document
    deeper than XML_DEPTH, or with a document type (whose entities could grow
    without bound), is refused.
    """
    out: list[tuple | None] = []
    open_: list[tuple[int, str, str, list[str]]] = []

    def start(tag: str, attrs: dict[str, str]) -> None:
        path = f"{open_[-1][1]}/{tag}" if open_ else f"/{tag}"
        if len(open_) >= XML_DEPTH:
            raise ValueError(f"nested deeper than {XML_DEPTH} elements")
        if len(open_) == DEPTH + 1:
            out.append(("xml", None, None, path, f"nested deeper than {DEPTH} elements, left out"))
        open_.append((len(out), path, "".join(f"@{k}={v} " for k, v in attrs.items()), []))
        out.append(None)

    def end(_: str) -> None:
        at, path, attrs, texts = open_.pop()
        own = "".join(texts).strip()
        if len(open_) <= DEPTH and (own or attrs):
            out[at] = ("xml", path, attrs + own, path)

    def refuse(*_) -> None:
        raise ValueError("a document type is not read")

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.StartDoctypeDeclHandler = start, end, refuse
    parser.CharacterDataHandler = lambda text: open_[-1][3].append(text) if len(open_) <= DEPTH + 1 else None
    parser.Parse(re.sub(r"^\ufeff?\s*<\?xml[^>]*\?>", "", raw), True)  # the text is decoded already
    yield from (x for x in out if x is not None)


def _text(raw: str) -> Iterator[Block]:
    for m in re.finditer(r"(?:[^\n]*\S[^\n]*(?:\n|$))+", raw):
        text = m[0].strip()
        at = len(raw[: m.start()].encode()) + len(m[0][: m[0].index(text)].encode())
        yield "paragraph", "", text, f"{at}:{at + len(text.encode())}"


_QUOTE, _RULE = re.compile(r"^(?: {0,3}> ?)+"), re.compile(r" {0,3}(?:(?:\* *){3,}|(?:- *){3,}|(?:_ *){3,})$")
#: What ends a paragraph or list item, at the start of a line.
_BREAK = r" {0,3}(?:#{1,6}\s|```|~~~|</?[A-Za-z])"


def _markdown(raw: str) -> Iterator[Block]:
    """Headings, paragraphs, fenced code, list items, tables and html blocks, with the trail of headings.

    Quote marks are taken off, rules between sections are no blocks, and lines that
    go on with a list item belong to it.
    """
    trail: list[str | None] = [None] * 6
    path = lambda: " > ".join(t for t in trail if t)
    lines, i = raw.split("\n"), 0
    fence = None
    for n, line in enumerate(lines):  # code keeps what looks like a quote
        if fence is None:
            lines[n] = line = _QUOTE.sub("", line)
        if m := re.match(r" {0,3}(```+|~~~+)", line):
            fence = m[1] if fence is None else None if line.strip().startswith(fence) else fence
    while i < len(lines):
        line = lines[i]
        if not line.strip() or _RULE.match(line):
            i += 1
        elif m := re.match(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$", line):
            level = len(m[1])
            trail[level - 1 :] = [(m[2] or "").strip()] + [None] * (6 - level)
            yield "heading", path(), (m[2] or "").strip(), str(i)
            i += 1
        elif m := re.match(r" {0,3}(```+|~~~+)", line):
            stop = next((j for j in range(i + 1, len(lines)) if lines[j].strip().startswith(m[1])), len(lines))
            yield "code", path(), "\n".join(lines[i + 1 : stop]), str(i)
            i = stop + 1
        elif i + 1 < len(lines) and "|" in line and re.match(r"^[ |:-]*-[ |:-]*$", lines[i + 1]) and "|" in lines[i + 1]:
            stop = next((j for j in range(i, len(lines)) if "|" not in lines[j]), len(lines))
            yield "table", path(), "\n".join(lines[i:stop]), str(i)
            i = stop
        elif m := re.match(r"\s*(?:[-*+]|\d+[.)])[ \t]+(.*)$", line):
            stop = i + 1
            while stop < len(lines) and lines[stop].strip() and not _RULE.match(lines[stop]) and not re.match(r"\s*(?:[-*+]|\d+[.)])[ \t]|" + _BREAK, lines[stop]):
                stop += 1
            if item := "\n".join(x for x in (m[1].strip(), *(y.strip() for y in lines[i + 1 : stop])) if x):
                yield "list_item", path(), item, str(i)
            i = stop
        elif re.match(r" {0,3}<(?:[A-Za-z/!?])", line):
            stop = next((j for j in range(i, len(lines)) if not lines[j].strip()), len(lines))
            yield "html", path(), "\n".join(lines[i:stop]), str(i)
            i = stop
        else:
            stop, under = i + 1, None
            while stop < len(lines) and lines[stop].strip() and not re.match(r" {0,3}(?:[-*+]|\d+[.)])\s|" + _BREAK, lines[stop]) and not (_RULE.match(lines[stop]) and not re.match(r" {0,3}-+\s*$", lines[stop])):
                under = re.match(r" {0,3}(=+|-+)\s*$", lines[stop])
                stop += 1
                if under:
                    break
            text = "\n".join(x.strip() for x in lines[i : stop - 1 if under else stop])
            if under:
                level = 1 if under[1][0] == "=" else 2
                trail[level - 1 :] = [text] + [None] * (6 - level)
            yield "heading" if under else "paragraph", path(), text, str(i)
            i = stop


def _html(raw: str) -> Iterator[Block]:
    """Headings, paragraphs, list items and table rows of the page, without scripts, styles, navigation and footers."""
    from html.parser import HTMLParser

    class Page(HTMLParser):
        blocks: list[Block]

        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.blocks, self.held, self.tag, self.off, self.trail = [], [], "", 0, [None] * 6

        def close_block(self):
            text = " ".join("".join(self.held).split())
            if text:
                if self.tag[:1] == "h" and self.tag[1:].isdigit():
                    level = int(self.tag[1:])
                    self.trail[level - 1 :] = [text] + [None] * (6 - level)
                kind = "heading" if self.tag[:1] == "h" else {"li": "list_item", "tr": "table"}.get(self.tag, "paragraph")
                self.blocks.append((kind, " > ".join(t for t in self.trail if t), text, str(len(self.blocks))))
            self.held = []

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style", "nav", "footer", "head"):
                self.off += 1
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "tr", "div", "article", "section", "br"):
                self.close_block()
                self.tag = "p" if tag in ("div", "article", "section", "br") else tag

        def handle_endtag(self, tag):
            if tag in ("script", "style", "nav", "footer", "head"):
                self.off = max(0, self.off - 1)
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "tr", "div", "article", "section"):
                self.close_block()
                self.tag = "p"

        def handle_data(self, data):
            if not self.off:
                self.held.append(data)

    page = Page()
    page.feed(raw)
    page.close_block()
    yield from page.blocks


#: Groups that hold no text of the document, and code pages by the number that a file gives.
_RTF_SKIP = frozenset("fonttbl colortbl stylesheet info pict object themedata datastore generator listtable listoverridetable rsidtbl xmlnstbl latentstyles fldinst header footer headerl headerr footerl footerr".split())
_RTF_SIGNS = {"par": "\n", "line": "\n", "row": "\n", "sect": "\n", "page": "\n", "tab": "\t", "cell": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "~": " ", "_": "-", "-": "", "\\": "\\", "{": "{", "}": "}", "\n": "\n", "\r": "\n"}
_RTF = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-z'])|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.I)


def _rtf(raw: str) -> Iterator[Block]:
    """Paragraphs of the text: escapes by the code page of the file, characters by number with surrogates joined, no groups of settings."""
    page, out, stack, skip, after, hexes = "cp1252", [], [], False, 1, bytearray()
    units: list[int] = []
    drop = 0

    def flush() -> None:
        if hexes:
            out.append(hexes.decode(page, "replace"))
            hexes.clear()
        if units:
            out.append(b"".join(u.to_bytes(2, "little") for u in units).decode("utf-16-le", "replace"))
            units.clear()

    for m in _RTF.finditer(raw):
        word, number, byte, sign, brace, plain = m.groups()
        if not byte and hexes or not (word == "u" and number) and units and not drop:
            flush()
        if brace == "{":
            stack.append((skip, after))
        elif brace == "}":
            flush()
            skip, after = stack.pop() if stack else (False, 1)
            drop = 0
        elif word and word in _RTF_SKIP or sign == "*":
            skip = True
        elif word == "ansicpg" and number:
            page = f"cp{number}" if _known(f"cp{number}") else page
        elif word == "uc" and number:
            after = max(0, int(number[:4]))
        elif skip:
            continue
        elif word == "u" and number:
            units.append(int(number[:7]) % 65536)
            drop = after  # what stands in for the character where a reader doesn't know it
        elif byte:
            if drop:
                drop -= 1
            else:
                hexes.append(int(byte, 16))
        elif word or sign:
            out.append(_RTF_SIGNS.get(word or sign, ""))
            drop = 0
        elif plain:
            out_plain, drop = plain[drop:], max(0, drop - len(plain))
            if out_plain:
                flush()
                out.append(out_plain)
    flush()
    for n, line in enumerate(x.strip() for x in "".join(out).split("\n")):
        if line:
            yield "paragraph", "", line, str(n)


def _known(page: str) -> bool:
    import codecs

    try:
        return bool(codecs.lookup(page))
    except LookupError:
        return False


EXTRACTORS: dict[str, Callable[[str], Iterator[Block]]] = {"text": _text, "markdown": _markdown, "json": _json, "jsonl": _jsonl, "yaml": _yaml, "csv": _csv, "xml": _xml, "html": _html, "rtf": _rtf}


def blocks(raw: DataFrame) -> DataFrame:
    """source_id, kind, block_no, block_type, section_path, text, anchor, error over (source_id, kind, raw).

    A source that can't be read, or is of an unknown kind, gives one row with the
    error; null counts as empty and gives none.
    """

    def read(source: int, kind: str, text: str | None) -> list[tuple]:
        try:
            found = [] if text is None else EXTRACTORS[kind](text)
            return [(source, kind, n, *b[:4], b[4] if len(b) > 4 else None) for n, b in enumerate(found)]
        except Exception as e:  # noqa: BLE001  one bad source must not stop the others
            return [(source, kind, 0, None, None, None, None, f"{type(e).__name__}: {e}"[:200])]

    return raw.select(F.col("source_id").cast("long").alias("source_id"), "kind", "raw").mapInArrow(lambda batches: rows(batches, read, "source_id", pa.int64()), "source_id bigint, kind string, block_no int, block_type string, section_path string, text string, anchor string, error string")


def rows(batches: Iterator[pa.RecordBatch], read: Callable, key: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The blocks that ``read`` makes of each source, a bounded slice of sources at a time."""
    shape = [(key, kind), ("kind", pa.string()), ("block_no", pa.int32()), *((c, pa.string()) for c in ("block_type", "section_path", "text", "anchor", "error"))]
    for part in sliced(batches):
        found = [b for row in zip(*(c.to_pylist() for c in part.columns)) for b in read(*row)]
        columns = list(zip(*found)) if found else [()] * len(shape)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, shape)], names=[n for n, _ in shape])


def json_leaves(raw: DataFrame) -> DataFrame:
    """source_id, leaf_no, text of JSON values."""
    return blocks(raw.select("source_id", F.lit("json").alias("kind"), "raw")).where("error is null").select("source_id", F.col("block_no").alias("leaf_no"), "text")
