"""HTML pages turned into Markdown in Arrow batches, with the standard library's parser.

Open elements are frames on a stack; a closed frame hands its Markdown to the one below. Elements that are never closed
end with their parent, and a paragraph or item ends where the next one begins.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Elements without an end, without text, and those that end an open one of the same group.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style nav button svg noscript".split())
ENDS = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main ol pre section table ul".split())
#: What holds the text of a page, the first that is there.
ROOTS = ("class:theme-doc-markdown", "tag:article", "class:document", "tag:main", "tag:body")
SCHEMES = ("http", "https", "mailto")


class _Frame:
    __slots__ = ("attrs", "cells", "parts", "rows", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.parts = tag, attrs, []
        self.rows: list[list[str]] = []
        self.cells: list[str] = []


class _Writer(HTMLParser):
    def __init__(self, url: str) -> None:
        super().__init__(convert_charrefs=True)
        self.url = url
        self.stack = [_Frame("", {})]
        self.pre = self.silent = 0
        self.roots: dict[str, str] = {}
        self.title = ""
        self.heading = {root: "" for root in ROOTS}
        self.first_h1 = ""

    def _link(self, ref: str | None) -> str | None:
        if not ref:
            return None
        try:
            whole = urljoin(self.url, ref)
            return whole if urlsplit(whole).scheme in SCHEMES else None
        except ValueError:
            return None

    def handle_starttag(self, tag: str, attrs) -> None:
        own = {k: v or "" for k, v in attrs}
        closing = ENDS.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
        while len(self.stack) > 1 and self.stack[-1].tag in closing:
            self._close()
        if tag == "br":
            self.stack[-1].parts.append("\n")
        elif tag == "img":
            if not self.silent and (src := self._link(own.get("src"))):
                self.stack[-1].parts.append(f"![{own.get('alt', '')}]({src})")
        elif tag not in VOID:
            self.stack.append(_Frame(tag, own))
            self.pre += tag == "pre"
            self.silent += tag in SILENT

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if any(f.tag == tag for f in self.stack[1:]):
            while self.stack[-1].tag != tag:
                self._close()
            self._close()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.stack[-1].parts.append(data if self.pre else re.sub(r"\s+", " ", data))

    def _close(self) -> None:
        frame = self.stack.pop()
        below = self.stack[-1]
        content = "".join(frame.parts)
        inner = content.strip()
        tag = frame.tag
        self.pre -= tag == "pre"
        if tag in SILENT:
            self.silent -= 1
            return
        if tag == "title":
            self.title = self.title or inner
            return
        if tag == "h1" and not self.first_h1:
            self.first_h1 = inner
        classes = frame.attrs.get("class", "").split()
        for root in ROOTS:
            kind, name = root.split(":")
            if root not in self.roots and (name in classes if kind == "class" else tag == name):
                self.roots[root] = inner
        if tag in ("td", "th"):
            holder = next((f for f in reversed(self.stack) if f.tag == "tr"), below)
            holder.cells.append(inner)
            return
        if tag == "tr":
            holder = next((f for f in reversed(self.stack) if f.tag == "table"), below)
            holder.rows.append(frame.cells)
            return
        below.parts.append(self._written(frame, content, inner))

    def _written(self, frame: _Frame, content: str, inner: str) -> str:
        tag, attrs = frame.tag, frame.attrs
        if scope := attrs.get("data-doc-scope"):
            try:
                names = json.loads(scope).get("products")
            except (ValueError, AttributeError):
                names = None
            if isinstance(names, list) and names:
                return f"\n**{' / '.join(map(str, names))}**\n\n{inner}\n\n"
        if tag == "a":
            return f"[{inner}]({href})" if (href := self._link(attrs.get("href"))) else inner
        if tag == "tabitem" or attrs.get("role") == "tabpanel":
            label = attrs.get("label") or attrs.get("value")
            return "\n" + (f"**{label}**\n\n" if label else "") + f"{inner}\n\n"
        if tag in ("h1", "h2", "h3", "h4"):
            return f"\n{'#' * int(tag[1])} {inner}\n\n"
        if tag == "table":
            rows = [f"| {' | '.join(r)} |" for r in frame.rows]
            if rows:
                rows.insert(1, f"| {' | '.join('---' for _ in frame.rows[0])} |")
            return "\n" + "\n".join(rows) + "\n\n"
        if tag == "code" and self.pre:
            return content
        forms = {"pre": f"\n```\n{inner}\n```\n\n", "code": f"`{content}`", "p": f"{inner}\n\n", "li": f"- {inner}\n", "ul": f"\n{inner}\n", "ol": f"\n{inner}\n"}
        return forms.get(tag, content)

    def finish(self) -> None:
        self.close()
        while len(self.stack) > 1:
            self._close()


def clean(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", re.sub("[\x00​]", "", text))).strip()


def html_to_markdown(html: str | None, url: str = "", fragment: bool = False) -> tuple[str, str]:
    """(title, markdown) of a page; of a fragment, all of it counts as the page's text."""
    writer = _Writer(url)
    writer.feed(html or "")
    writer.finish()
    whole = "".join(writer.stack[0].parts)
    root = next((writer.roots[r] for r in ROOTS if r in writer.roots), whole if fragment else "")
    return clean(writer.first_h1 or writer.title or url), clean(whole if fragment else root)


@pandas_udf(StringType())
def markdown_of(html: pd.Series) -> pd.Series:
    """Markdown of HTML fragments; null for null."""
    return html.map(lambda x: None if x is None else html_to_markdown(x, fragment=True)[1])


def is_shell(html: str | None, markdown: str, marker: str = "__docusaurus") -> bool:
    """A page that only scripts would fill: its marker is there, and hardly any text beside a heading."""
    if not html or marker not in html:
        return False
    compact = re.sub(r"\s+", "", markdown)
    body = re.sub(r"(?m)^#{1,6} .*$", "", markdown).strip()
    return len(compact) < 200 and not (re.search(r"(?m)^# \S", markdown) and body)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for url, html in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            title, markdown = html_to_markdown(html, url or "")
            rows.append((title, markdown, is_shell(html, markdown)))
        columns = list(zip(*rows)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.bool_())], names=["page_id", "url", "title", "markdown", "shell"])


def read_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, title, markdown, shell) of HTML pages; a null page has an empty text and its url as title."""
    kind = pages.schema[page_id].dataType.simpleString()
    rows = pages.select(pages[page_id].alias("page_id"), pages[url].alias("url"), pages[html].alias("html"))
    return rows.mapInArrow(_pages, f"page_id {kind}, url string, title string, markdown string, shell boolean")
