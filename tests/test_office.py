"""Office files, tables, books and archives as markdown: files are made here, part by part."""

from __future__ import annotations

import io
import zipfile

import pytest

from tidemark.sources import office, readers

W = 'xmlns:w="http://w" xmlns:r="http://r"'


def zipped(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def rels(**targets: str) -> str:
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Target="{t}" {"TargetMode=" + chr(34) + "External" + chr(34) if t.startswith("http") else ""}/>' for i, t in targets.items()) + "</Relationships>"


def para(text: str, props: str = "", run: str = "") -> str:
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t>{text}</w:t></w:r></w:p>"


def item(text: str, num: int, level: int = 0) -> str:
    return para(text, f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr>')


def line(*cells: str) -> str:
    return "| " + " | ".join([*cells, *[""] * (27 - len(cells))]) + " |"


DOCX = zipped({
    "word/document.xml": f"<w:document {W}><w:body>" + para("Report", '<w:pStyle w:val="T"/>') + "<w:p><w:r><w:t>Plain </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>er </w:t></w:r>"
    '<w:hyperlink r:id="L"><w:r><w:t>site</w:t></w:r></w:hyperlink><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p>' + para("", "") + item("one", 1) + item("two", 1) + item("in", 1, 1) + item("three", 1) + para("Part", '<w:pStyle w:val="Heading2"/>') + item("dot", 2)
    + "<w:tbl><w:tr><w:tc>" + para("a|b") + "</w:tc><w:tc>" + para("c") + "</w:tc></w:tr><w:tr><w:tc>" + para("1") + para("2") + "</w:tc></w:tr></w:tbl></w:body></w:document>",
    "word/_rels/document.xml.rels": rels(L="http://x.test/"),
    "word/styles.xml": f'<w:styles {W}><w:style w:styleId="T"><w:name w:val="Title"/></w:style></w:styles>',
    "word/numbering.xml": f'<w:numbering {W}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>',
})
XLSX = zipped({
    "xl/workbook.xml": '<workbook xmlns:r="http://r"><sheets><sheet name="Sales" sheetId="1" r:id="b"/><sheet name="Not" state="hidden" sheetId="2" r:id="a"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": rels(a="worksheets/sheet1.xml", b="/xl/worksheets/sheet2.xml"),
    "xl/sharedStrings.xml": "<sst><si><t>day</t></si><si><r><t>am</t></r><r><t>ount</t></r></si></sst>",
    "xl/styles.xml": '<styleSheet><numFmts><numFmt numFmtId="170" formatCode="[$-409]d mmm yy"/><numFmt numFmtId="171" formatCode="0.0 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>',
    "xl/worksheets/sheet1.xml": "<worksheet/>",
    "xl/worksheets/sheet2.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row/><row><c r="A3" s="1"><v>45000</v></c><c r="B3" s="2"><v>45000.5</v></c><c r="C3" s="3"><v>2.5</v></c><c r="AA3" t="b"><v>1</v></c></row></sheetData></worksheet>',
})
PPTX = zipped({
    "ppt/presentation.xml": '<p xmlns:r="http://r"><sldIdLst><sldId r:id="y" id="256"/><sldId id="257" r:id="x"/></sldIdLst></p>',
    "ppt/_rels/presentation.xml.rels": rels(x="slides/slide1.xml", y="slides/slide2.xml"),
    "ppt/slides/slide1.xml": "<sld><sp><txBody><p><r><t>last</t></r></p></txBody></sp></sld>",
    "ppt/slides/slide2.xml": '<sld><sp><nvSpPr><nvPr><ph type="title"/></nvPr></nvSpPr><txBody><p><r><t>Plan</t></r></p></txBody></sp><sp><nvSpPr><nvPr><ph type="sldNum"/></nvPr></nvSpPr><txBody><p><r><t>9</t></r></p></txBody></sp><sp><txBody><p><r><t>do </t></r><r><t>it</t></r></p><p><r><t>now</t></r></p></txBody></sp></sld>',
    "ppt/slides/_rels/slide2.xml.rels": rels(n="../notesSlides/n1.xml"),
    "ppt/notesSlides/n1.xml": '<notes><sp><nvSpPr><nvPr><ph type="body"/></nvPr></nvSpPr><txBody><p><r><t>say hi</t></r></p></txBody></sp></notes>',
})
EPUB = zipped({
    "META-INF/container.xml": '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>',
    "O/c.opf": '<package xmlns:dc="http://d"><metadata><dc:title>Tale</dc:title></metadata><manifest><item id="1" href="b%20b.xhtml"/><item id="2" href="a.xhtml"/></manifest><spine><itemref idref="1"/><itemref idref="2"/></spine></package>',
    "O/a.xhtml": "<html><body><p>end</p></body></html>",
    "O/b b.xhtml": "<html><body><h2>Start</h2><p>once</p></body></html>",
})
CASES = [
    ("docx", DOCX, "# Report\n\nPlain **bolder** [site](http://x.test/)\n\n1. one\n2. two\n    - in\n3. three\n\n## Part\n\n- dot\n\n| a\\|b | c |\n| --- | --- |\n| 1 2 |  |"),
    ("xlsx", XLSX, "\n".join(["## Sales", "", line("day", "", "amount"), "|" + " --- |" * 27, line("2023-03-15", "2023-03-15 12:00:00", "2.5", *[""] * 23, "TRUE")])),
    ("pptx", PPTX, "# Plan\n\ndo it\nnow\n\n### Notes\n\nsay hi\n\nlast"),
    ("epub", EPUB, "# Tale\n\n## Start\n\nonce\n\nend"),
    ("csv", 'a,"b\nc"\n\n1,"x|y",3\n'.encode("utf-16"), "| a | b c |  |\n| --- | --- | --- |\n| 1 | x\\|y | 3 |"),
    ("tsv", "ä\tb\n".encode("cp1252"), "| ä | b |\n| --- | --- |"),
    ("json", b'{"a": 1}', '{"a": 1}'),
    ("zip", zipped({"d/t.csv": "a\n1\n", "n.md": "# hi", "p.png": b"\x89"}), "## d/t.csv\n\n| a |\n| --- |\n| 1 |\n\n## n.md\n\n# hi"),
    ("docx", b"", ""),
    ("docx", b"PK nothing", None),
    ("docx", zipped({"other.xml": "<a/>"}), None),
    ("docx", zipped({"word/document.xml": "<a><b></a>"}), None),
    ("docx", DOCX[:-40], None),
    ("png", b"x", None),
    ("csv", None, None),
]


@pytest.mark.parametrize("kind, content, want", CASES, ids=[f"{i}-{c[0]}" for i, c in enumerate(CASES)])
def test_conversion(kind, content, want):
    assert office.markdown_or_none(kind, content) == want


def test_bounds(monkeypatch):
    """What is unpacked is bounded over all archives inside; so is their depth."""
    inner = zipped({"t.txt": "x" * 1000})
    deep = inner
    for _ in range(office.MOST_DEPTH + 1):
        deep = zipped({"in.zip": deep})
    assert office.markdown_or_none("zip", deep) is None
    assert "x" * 1000 in office.markdown_or_none("zip", zipped({"in.zip": inner}))
    monkeypatch.setattr(office, "MOST_INFLATED", 2000)
    assert office.markdown_or_none("zip", inner) is not None
    assert office.markdown_or_none("zip", zipped({"a.zip": inner, "b.zip": inner})) is None


def test_reader(spark, tmp_path, monkeypatch):
    for name, content in {"a b.docx": DOCX, "x/ü.XLSX": XLSX, "bad.docx": b"no", "t.md": b"# t", "big.csv": b"a,b\n" * 3000, "skip.pdf": b"%PDF"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    monkeypatch.setattr(readers, "MOST_BYTES", 9000)
    items, rejects = readers.files(spark, str(tmp_path), extensions=("md", "docx", "xlsx", "csv"))
    got = {r.source_id: r for r in items.collect()}
    assert set(got) == {"a b.docx", "x/ü.XLSX", "t.md"}
    assert got["a b.docx"].markdown == CASES[0][2] and got["t.md"].markdown == "# t"
    assert office.OFFICE["xlsx"] in got["x/ü.XLSX"].extra_metadata
    assert sorted(r.record.rsplit("/", 1)[-1] for r in rejects.collect()) == ["bad.docx", "big.csv"]
