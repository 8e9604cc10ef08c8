"""Office files, tables, books and archives as markdown, a file at a time inside tasks.

Defined results: headings, lists, tables, bold and italic text and links of documents are kept; a sheet is a heading and
a table; a slide is its title as a heading, its other text, its tables and its notes; a book is its chapters in reading
order; an archive is its readable members under their names. A file that is damaged, encrypted, larger than MOST_BYTES,
or larger than MOST_INFLATED once unpacked, is null, which readers make a reject. An empty file is empty text.
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta
from urllib.parse import unquote
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.sources.markup import markdown_of

#: Bytes of a file, and of its parts unpacked; archives inside archives that are opened.
MOST_BYTES, MOST_INFLATED, MOST_DEPTH = 128 << 20, 512 << 20, 3
#: Media types by extension.
OFFICE = {
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "csv": "text/csv",
    "tsv": "text/tab-separated-values",
    "json": "application/json",
    "xml": "application/xml",
    "epub": "application/epub+zip",
    "zip": "application/zip",
}
#: Built-in number formats of sheets that show a date or a time.
DATES = {*range(14, 23), *range(45, 48)}
TEXT = {"md", "markdown", "txt"}


class Damaged(ValueError):
    pass


class Parts:
    """The members of a zip file; what is read counts against a budget shared with the archives around it."""

    def __init__(self, content: bytes, budget: list[int]):
        self.zip, self.budget = zipfile.ZipFile(io.BytesIO(content)), budget

    def names(self) -> list[str]:
        return [i.filename for i in self.zip.infolist() if not i.is_dir()]

    def read(self, name: str) -> bytes:
        info = self.zip.getinfo(name)
        self.budget[0] -= info.file_size
        if self.budget[0] < 0 or info.flag_bits & 1:
            raise Damaged(name)
        return self.zip.read(info)

    def tree(self, name: str) -> ET.Element:
        """The XML of a member, its names without namespaces."""
        root = ET.fromstring(self.read(name))
        for e in root.iter():
            e.tag = e.tag.rsplit("}", 1)[-1]
            # a slide has an id and a relation's id: the one with a namespace stays
            e.attrib = {k.rsplit("}", 1)[-1]: v for k, v in sorted(e.attrib.items(), key=lambda x: x[0][0] == "{")}
        return root

    def has(self, name: str) -> bool:
        return name in self.zip.NameToInfo

    def links(self, name: str) -> dict[str, str]:
        """id -> target of a member's relations; inner targets as names of members."""
        folder, file = posixpath.split(name)
        rels = f"{folder}/_rels/{file}.rels".lstrip("/")
        if not self.has(rels):
            return {}
        place = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join(folder, t))
        return {e.get("Id", ""): e.get("Target", "") if e.get("TargetMode") == "External" else place(e.get("Target", "")) for e in self.tree(rels)}


def table_of(rows: list[list[str]]) -> str:
    """A markdown table; the first row is its head."""
    rows = [r for r in rows if any(c.strip() for c in r)]
    width = max(map(len, rows), default=0)
    if not width:
        return ""
    line = lambda cells: "| " + " | ".join(" ".join(c.split()).replace("|", "\\|") for c in [*cells, *[""] * (width - len(cells))]) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * width, *map(line, rows[1:])])


def blocks(parts: Iterator[str] | list[str]) -> str:
    return "\n\n".join(p for p in parts if p.strip())


def decoded(content: bytes) -> str:
    for encoding in ("utf-8-sig", "utf-16") if content[:2] in (b"\xff\xfe", b"\xfe\xff") else ("utf-8-sig", "cp1252"):
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return content.decode("latin-1")


# Documents


def flag(properties: ET.Element | None, name: str) -> bool:
    e = None if properties is None else properties.find(name)
    return e is not None and e.get("val", "true") not in ("0", "false", "none")


def inline(p: ET.Element, links: dict[str, str]) -> str:
    """The text of a paragraph: runs with the same marks are joined before they are marked."""
    runs: list[tuple[str, str]] = []

    def walk(e: ET.Element) -> None:
        for child in e:
            if child.tag == "r":
                props = child.find("rPr")
                mark = "**" * flag(props, "b") + "_" * flag(props, "i")
                text = "".join({"t": x.text or "", "tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}.get(x.tag, "") for x in child)
                if runs and runs[-1][0] == mark:
                    text = runs.pop()[1] + text
                runs.append((mark, text))
            elif child.tag == "hyperlink" and links.get(child.get("id", "")):
                runs.append(("link", f"[{inline(child, links)}]({links[child.get('id', '')]})"))
            elif child.tag not in ("pPr", "del", "moveFrom", "p"):
                walk(child)

    walk(p)
    out = []
    for mark, text in runs:
        inner = text.strip()
        out.append(text if mark in ("", "link") or not inner else text.replace(inner, f"{mark}{inner}{mark[::-1]}", 1))
    return "".join(out).strip()


def docx(parts: Parts) -> str:
    name = next((t for t in parts.links("").values() if t.endswith("document.xml")), "word/document.xml")
    body, links = parts.tree(name).find("body"), parts.links(name)
    folder = posixpath.dirname(name)
    levels, ordered = {}, {}
    if parts.has(f"{folder}/styles.xml"):
        for s in parts.tree(f"{folder}/styles.xml").iter("style"):
            shown = (s.find("name").get("val", "") if s.find("name") is not None else "").lower()
            outline = s.find("pPr/outlineLvl")
            level = int(outline.get("val", "9")) + 1 if outline is not None else int(shown[8:]) if shown.startswith("heading ") and shown[8:].isdigit() else 1 if shown == "title" else 0
            levels[s.get("styleId")] = level if level <= 9 else 0
    if parts.has(f"{folder}/numbering.xml"):
        tree = parts.tree(f"{folder}/numbering.xml")
        kinds = {a.get("abstractNumId"): {x.get("ilvl"): x.find("numFmt").get("val") for x in a.iter("lvl") if x.find("numFmt") is not None} for a in tree.iter("abstractNum")}
        for n in tree.iter("num"):
            ordered[n.get("numId")] = kinds.get(n.find("abstractNumId").get("val") if n.find("abstractNumId") is not None else None, {})
    counts: dict[tuple[str, int], int] = {}

    def paragraph(p: ET.Element) -> tuple[str, bool]:
        """(markdown, whether it is an item of a list)"""
        text, props = inline(p, links), p.find("pPr")
        style, number = (None, None) if props is None else (props.find("pStyle"), props.find("numPr"))
        style_id = "" if style is None else style.get("val", "")
        level = levels.get(style_id, int(style_id[7:]) if style_id.startswith("Heading") and style_id[7:].isdigit() else 0)
        if text and level:
            return "#" * min(level, 6) + " " + " ".join(text.split()), False
        num = None if number is None or number.find("numId") is None else number.find("numId").get("val", "0")
        if text and num not in (None, "0"):
            at = int(number.find("ilvl").get("val", "0")) if number.find("ilvl") is not None else 0
            for key in [k for k in counts if k[0] == num and k[1] > at]:
                del counts[key]
            counts[num, at] = counts.get((num, at), 0) + 1
            bullet = ordered.get(num, {}).get(str(at), "bullet") in ("bullet", "none")
            return "    " * at + ("- " if bullet else f"{counts[num, at]}. ") + text, True
        return text, False

    def content(e: ET.Element) -> str:
        out: list[tuple[str, bool]] = []
        for child in e:
            if child.tag == "p":
                text, item = paragraph(child)
                if item and out and out[-1][1]:
                    text = f"{out.pop()[0]}\n{text}"
                out.append((text, item))
            elif child.tag == "tbl":
                out.append((table_of([[content(c) for c in row.findall("tc")] for row in child.findall("tr")]), False))
            elif child.tag in ("sdt", "sdtContent", "ins", "customXml", "smartTag"):
                out.append((content(child), False))
        return blocks([text for text, _ in out])

    if body is None:
        raise Damaged("no body")
    return content(body)


# Slides


def slide(parts: Parts, name: str) -> str:
    title, out = "", []
    links = parts.links(name)
    for shape in parts.tree(name).iter():
        if shape.tag == "sp":
            place = shape.find("nvSpPr/nvPr/ph")
            text = "\n".join(x for p in shape.iter("p") if (x := "".join(t.text or "" for t in p.iter("t")).strip()))
            if place is not None and place.get("type") in ("title", "ctrTitle") and not title:
                title = " ".join(text.split())
            elif place is None or place.get("type") not in ("sldNum", "dt", "ftr"):
                out.append(text)
        elif shape.tag == "tbl":
            out.append(table_of([["".join(t.text or "" for t in c.iter("t")) for c in row.findall("tc")] for row in shape.findall("tr")]))
    for notes in sorted(t for t in links.values() if "/notesSlides/" in f"/{t}" and parts.has(t)):
        for shape in parts.tree(notes).iter("sp"):
            place = shape.find("nvSpPr/nvPr/ph")
            if place is not None and place.get("type") == "body":
                said = "\n".join(x for p in shape.iter("p") if (x := "".join(t.text or "" for t in p.iter("t")).strip()))
                out.append(f"### Notes\n\n{said}" if said else "")
    return blocks([f"# {title}" if title else "", *out])


def pptx(parts: Parts) -> str:
    links = parts.links("ppt/presentation.xml")
    return blocks([slide(parts, links[s.get("id")]) for s in parts.tree("ppt/presentation.xml").iter("sldId") if s.get("id") in links])


# Sheets


def column_of(place: str) -> int:
    n = 0
    for c in place.rstrip("0123456789"):
        n = n * 26 + ord(c) - 64
    return n - 1


def shown_date(value: float, epoch: datetime) -> str:
    at = epoch + timedelta(seconds=round(value * 86400))
    return f"{at:%H:%M:%S}" if value < 1 else f"{at:%Y-%m-%d}" if value == int(value) else f"{at:%Y-%m-%d %H:%M:%S}"


def xlsx(parts: Parts) -> str:
    book, links = parts.tree("xl/workbook.xml"), parts.links("xl/workbook.xml")
    strings = ["".join(t.text or "" for t in s.iter("t")) for s in parts.tree("xl/sharedStrings.xml").iter("si")] if parts.has("xl/sharedStrings.xml") else []
    dates: list[bool] = []
    if parts.has("xl/styles.xml"):
        styles = parts.tree("xl/styles.xml")
        shows = lambda code: set("ymdhs") & set(re.sub(r'\[[^\]]*\]|"[^"]*"|\\.', "", code).lower())
        own = {f.get("numFmtId"): bool(shows(f.get("formatCode", ""))) and f.get("formatCode", "").lower() != "general" for f in styles.iter("numFmt")}
        found = styles.find("cellXfs")
        dates = [own.get(x.get("numFmtId"), int(x.get("numFmtId", "0")) in DATES) for x in ([] if found is None else found)]
    props = book.find("workbookPr")
    epoch = datetime(1904, 1, 1) if props is not None and props.get("date1904") in ("1", "true") else datetime(1899, 12, 30)

    def shown(c: ET.Element) -> str:
        kind, v = c.get("t", "n"), c.find("v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter("t"))
        if v is None or v.text is None:
            return ""
        if kind == "s":
            return strings[int(v.text)]
        if kind == "b":
            return "TRUE" if v.text == "1" else "FALSE"
        style = int(c.get("s", "0"))
        return shown_date(float(v.text), epoch) if kind == "n" and style < len(dates) and dates[style] else v.text

    out = []
    for sheet in book.iter("sheet"):
        name = links.get(sheet.get("id", ""))
        if not name or not parts.has(name) or sheet.get("state") in ("hidden", "veryHidden"):
            continue
        rows = []
        for row in parts.tree(name).iter("row"):
            cells: dict[int, str] = {}
            for c in row.findall("c"):
                cells[column_of(c.get("r")) if c.get("r") else len(cells)] = shown(c)
            rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        out.append(blocks([f"## {sheet.get('name', '')}", table_of(rows)]))
    return blocks(out)


# Books and archives


def epub(parts: Parts) -> str:
    top = next(parts.tree("META-INF/container.xml").iter("rootfile")).get("full-path", "")
    package = parts.tree(top)
    files = {i.get("id"): posixpath.normpath(posixpath.join(posixpath.dirname(top), unquote(i.get("href", "")))) for i in package.iter("item")}
    title = next((t.text for t in package.iter("title") if t.text), "")
    chapters = [files[i.get("idref")] for i in package.iter("itemref") if i.get("idref") in files]
    return blocks([f"# {title.strip()}" if title.strip() else "", *[markdown_of(decoded(parts.read(c))) for c in chapters if parts.has(c)]])


def archive(parts: Parts, depth: int) -> str:
    out = []
    for name in sorted(parts.names()):
        kind = name.rsplit(".", 1)[-1].lower()
        if kind in OFFICE or kind in TEXT or kind in ("html", "htm"):
            out.append(blocks([f"## {name}", converted(kind, parts.read(name), parts.budget, depth + 1)]))
    return blocks(out)


def converted(kind: str, content: bytes, budget: list[int], depth: int = 0) -> str:
    if not content:
        return ""
    if kind in ("csv", "tsv"):
        csv.field_size_limit(MOST_INFLATED)
        return table_of(list(csv.reader(io.StringIO(decoded(content), newline=""), delimiter="," if kind == "csv" else "\t")))
    if kind in ("html", "htm"):
        return markdown_of(decoded(content))
    if kind in TEXT or kind in ("json", "xml"):
        return decoded(content)
    if depth > MOST_DEPTH:
        raise Damaged("archives inside archives")
    parts = Parts(content, budget)
    return archive(parts, depth) if kind == "zip" else {"docx": docx, "pptx": pptx, "xlsx": xlsx, "epub": epub}[kind](parts)


def markdown_or_none(kind: str | None, content: bytes | None) -> str | None:
    if content is None or kind not in OFFICE:
        return None
    try:
        return converted(kind, bytes(content), [MOST_INFLATED])
    except (ValueError, KeyError, IndexError, AttributeError, StopIteration, OverflowError, EOFError, RuntimeError, NotImplementedError, RecursionError, zipfile.BadZipFile, zlib.error, ET.ParseError, csv.Error):
        return None


def office_markdown(kind: Column, content: Column) -> Column:
    """The markdown of a file from its extension, in lower case, and its bytes. The files of a batch are
    bounded by spark.sql.execution.arrow.maxBytesPerBatch. Not deterministic for Spark: a filter on it doesn't run it twice."""

    @F.pandas_udf("string")
    def run(kinds: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([markdown_or_none(k, c) for k, c in zip(kinds, contents, strict=True)], dtype=object)

    return run.asNondeterministic()(kind, content)


#: Characters that XML can't hold.
NOT_XML = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def text_document(title: Column, text: Column) -> Column:
    """The bytes of a docx file: a title and a paragraph for each line; null text has none. For exports and round trips."""

    def packed(head: str, body: str) -> bytes:
        paragraph = lambda line, style="": f'<w:p>{style}<w:r><w:t xml:space="preserve">{escape(NOT_XML.sub("", line))}</w:t></w:r></w:p>'
        lines = paragraph(head, '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>') + "".join(map(paragraph, body.split("\n")))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{OFFICE["docx"]}.main+xml"/></Types>')
            z.writestr("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
            z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{lines}</w:body></w:document>')
        return out.getvalue()

    @F.pandas_udf("binary")
    def run(heads: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else packed(h or "", b) for h, b in zip(heads, bodies, strict=True)], dtype=object)

    return run(title, text)
