"""HTML to markdown, tag by tag, with a stack of open elements."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose text isn't shown, those that stand in blocks of their own, and marks around inline text.
HIDDEN = {"script", "style", "head", "title", "template", "noscript"}
BLOCKS = {"p", "div", "section", "article", "header", "footer", "main", "aside", "nav", "form", "figure", "figcaption", "address", "dl", "dt", "dd", "fieldset", "center", "body", "html"}
MARKS = {"b": "**", "strong": "**", "i": "_", "em": "_", "s": "~~", "del": "~~", "strike": "~~", "code": "`", "kbd": "`", "tt": "`"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


class Markdown(HTMLParser):
    """Text goes to the innermost open frame; when an element ends, its frame is made markdown and handed to the one
    around it. A frame is [tag, pieces, attributes, count of items or rows of cells]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.frames, self.hidden, self.pre = [["", [], {}, 0]], [], 0

    # Input

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.hidden.append(tag)
        if self.hidden:
            return
        if tag in VOID:
            self.alone(tag, dict(attrs))
            return
        if tag in ("li", "tr", "td", "th", "p", "dt", "dd", "option"):  # their ends may be left out
            self.closed_by(tag)
        self.pre += tag == "pre"
        self.frames.append([tag, [], dict(attrs), [] if tag == "table" else 0])

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID and not self.hidden:
            self.alone(tag, dict(attrs))
        elif tag not in HIDDEN:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            if tag in self.hidden:
                del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag) :]
            return
        if self.hidden or tag not in (f[0] for f in self.frames):
            return
        while self.frames[-1][0] != tag:
            self.end()
        self.end()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.frames[-1][1].append(data if self.pre else re.sub(r"[ \t\r\n\f]+", " ", data))

    # Output

    def closed_by(self, tag: str) -> None:
        ends = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}[tag]
        stop = {"li": ("ul", "ol"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}.get(tag, ("td", "th", "li", "div", "blockquote"))
        found = 0
        for k in range(len(self.frames) - 1, 0, -1):
            if self.frames[k][0] in stop:
                break
            if self.frames[k][0] in ends:
                found = k
        while found and len(self.frames) > found:
            self.end()

    def alone(self, tag: str, attrs: dict) -> None:
        text = {"br": "\n", "hr": "\n\n* * *\n\n"}.get(tag, "")
        if tag == "img" and attrs.get("src"):
            text = f"![{attrs.get('alt') or ''}]({attrs['src']})"
        self.frames[-1][1].append(text)

    def end(self) -> None:
        tag, pieces, attrs, held = self.frames.pop()
        around, text = self.frames[-1], "".join(pieces)
        if tag in MARKS:
            inner = text.strip()
            blank = lambda x: " " if x else ""
            text = f"{blank(text[: len(text) - len(text.lstrip())])}{MARKS[tag]}{inner}{MARKS[tag]}{blank(text[len(text.rstrip()) :])}" if inner and not self.pre else text
        elif tag == "a":
            text = f"[{' '.join(text.split())}]({attrs['href']})" if attrs.get("href") and text.strip() else text
        elif re.fullmatch("h[1-6]", tag):
            text = f"\n\n{'#' * int(tag[1])} {' '.join(text.split())}\n\n" if text.strip() else ""
        elif tag == "li":
            around[3] = around[3] + 1 if isinstance(around[3], int) else 1
            first = int(around[2].get("start") or 1) if str(around[2].get("start") or "1").isdigit() else 1
            mark = f"{first + around[3] - 1}. " if around[0] == "ol" else "- "
            text = "\n" + mark + settled(text).replace("\n", "\n" + " " * len(mark)) if text.strip() else ""
            text = re.sub(r"\n +(?=\n)", "\n", text)
        elif tag in ("ul", "ol", "menu"):
            nested = any(f[0] == "li" for f in self.frames)
            text = f"\n{text.strip(chr(10))}\n" if nested else f"\n\n{text.strip(chr(10))}\n\n"
        elif tag == "blockquote":
            text = "\n\n" + "\n".join(f"> {x}".rstrip() for x in settled(text).split("\n")) + "\n\n" if text.strip() else ""
        elif tag == "pre":
            self.pre -= 1
            text = "\n\n```\n" + text.strip("\n") + "\n```\n\n"
        elif tag in ("td", "th"):
            cell, row = " ".join(text.split()).replace("|", "\\|"), next((f for f in reversed(self.frames) if f[0] == "tr"), None)
            if row is not None:
                row[3] = [*(row[3] or []), cell]
                return
        elif tag == "tr":
            table = next((f for f in reversed(self.frames) if f[0] == "table"), None)
            if table is not None and held:
                table[3].append(held)
                return
        elif tag == "table":
            wide = max(map(len, held), default=0)
            rows = [f"| {' | '.join([*r, *[''] * (wide - len(r))])} |" for r in held]
            text = "\n\n" + text.strip() + "\n\n" + "\n".join([*rows[:1], "|" + " --- |" * wide, *rows[1:]]) + "\n\n" if held else f"\n\n{text}\n\n"
        elif tag in BLOCKS:
            text = f"\n\n{text}\n\n"
        around[1].append(text)

    def done(self) -> str:
        while len(self.frames) > 1:
            self.end()
        return settled("".join(self.frames[0][1]))


def settled(text: str) -> str:
    """No blanks at the ends of lines, none at the start of those that aren't nested, at most one empty line."""
    out, code = [], False
    for line in text.split("\n"):
        code ^= line.strip() == "```"
        line = re.sub(r"(?<=\S) {2,}(?=\S)", " ", line.rstrip()) if not code else line
        out.append(line if code or re.match(r" +(?:- |\d+\. |\S)", line) and out and re.match(r"\s*(?:- |\d+\. )", next((x for x in reversed(out) if x), "")) else line.lstrip())
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip("\n").strip()


def markdown_of(html: str | None) -> str | None:
    """Nested lists, tables, quotes, code, links, images and emphasis; character references are resolved; comments and
    what isn't shown go. Elements that aren't closed end with what is around them. Null stays null."""
    if html is None:
        return None
    parser = Markdown()
    parser.feed(html)
    parser.close()
    return parser.done()


def html_markdown(html: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(markdown_of)

    return run(html)
