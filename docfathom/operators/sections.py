"""Sections of Markdown pages: blocks, pieces, the section asked for, and relevant sections within a budget."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADING = re.compile(r"^(#{1,6})[ \t]+(.+)$", re.M)
SELF_LINK = re.compile(r"\[\]\(([^)]+)\)\s*$")
IMAGE = re.compile(r"!\[[^\]]*\]\(([^)\s]+)\)")
TABLE = re.compile(r"\n\|[^\n]+\|\n\|[\s:|-]+\|")
#: What a page of pin drawings is about, the budgets, and the marks of what is left out.
PIN_TOPIC = re.compile(r"管脚定义|引脚定义|接口定义|pin\s*map|40pin", re.I)
RELEVANT_CAP, OMITTED_CAP, SCORED_CHARS, MATCH = 6000, 800, 2000, 3
OMITTED, MORE, CUT = "… omitted sections: ", " …and {} more", "…[truncated]"
INDEX_INTRO = "No section matched this query. Section index:"


@dataclass
class Piece:
    """A heading with the text up to the next heading; ``start`` is its place in the page."""

    title: str
    level: int
    anchor: str | None
    start: int
    text: str
    index: int
    score: int = 0
    end: int = field(default=0)


def normalised(x: str) -> str:
    return re.sub(r"[^\w]+", "", unquote(x).lower()).replace("_", "")


def pieces_of(markdown: str) -> list[Piece]:
    """The text before the first heading, without title, and a piece for each heading; blank ones are left out."""
    marks = list(HEADING.finditer(markdown))
    edges = [m.start() for m in marks] + [len(markdown)]
    out = []
    if lead := markdown[: edges[0]].strip():
        out.append(Piece("", 0, None, 0, lead, 0, end=edges[0]))
    for m, end in zip(marks, edges[1:]):
        link = SELF_LINK.search(m.group(2))
        anchor = unquote(link.group(1).split("#", 1)[1]) if link and "#" in link.group(1) else None
        out.append(Piece(SELF_LINK.sub("", m.group(2)).strip(), len(m.group(1)), anchor, m.start(), markdown[m.start() : end].strip(), len(out), end=end))
    return out


def section_of(markdown: str, pieces: list[Piece], at: int) -> str:
    """The piece with all deeper ones that follow it."""
    p = pieces[at]
    end = next((q.start for q in pieces[at + 1 :] if q.level <= p.level), len(markdown))
    return markdown[p.start : end].strip()


def query_score(query: str, text: str) -> int:
    """3 for each token of at least four characters in the text, 2 for a shorter one; 1 for a query without tokens."""
    tokens = [x for x in re.split(r"[^\w.-]+", query.lower()) if len(x) >= 2]
    low = text.lower()
    if not tokens:
        return int(query.strip().lower() in low)
    return sum((3 if len(x) >= 4 else 2) for x in tokens if x in low)


def image_notes(markdown: str) -> list[str]:
    """Links to at most six images where a page about pins has images and no table."""
    images = IMAGE.findall(markdown)
    return images[:6] if images and PIN_TOPIC.search(markdown) and not TABLE.search("\n" + markdown) else []


def select_section(markdown: str, section: str | None = None, query: str | None = None, anchor: str | None = None) -> tuple[str, str | None, bool]:
    """(text, title, matched): by anchor, else by section name, else by query, else the whole page.

    Names match by containment once blanks and signs are gone; a name of signs alone matches the first section.
    """
    pieces = [p for p in pieces_of(markdown) if p.level]
    if anchor and len(want := normalised(anchor)) >= 2:
        exact = [p for p in pieces if want in (normalised(p.anchor or ""), normalised(p.title))]
        near = [p for p in pieces for x in (normalised(p.anchor or ""), normalised(p.title)) if len(x) >= 4 and want in x]
        if found := (exact or near)[:1]:
            return found[0].text, found[0].title, True
    if section:
        want = normalised(section)
        for k, p in enumerate(pieces):
            own = normalised(p.title)
            if want in own or own in want or p.anchor and normalised(p.anchor) == want:
                return section_of(markdown, pieces, k), p.title, True
    if query and pieces:
        scores = [query_score(query, p.text[: SCORED_CHARS + len(p.title)]) for p in pieces]
        k = max(range(len(pieces)), key=lambda i: (scores[i], pieces[i].level if scores[i] else 0, -i))
        if scores[k] >= MATCH:
            return section_of(markdown, pieces, k), pieces[k].title, True
    return markdown, None, False


def omitted_line(titles: list[str]) -> str:
    """One line naming the sections left out, as many as fit, and how many more there are."""
    if not titles:
        return ""
    for n in range(len(titles), 0, -1):
        rest = len(titles) - n
        line = OMITTED + ", ".join(titles[:n]) + (MORE.format(rest) if rest else "")
        if len(line) <= OMITTED_CAP:
            return line
    tail = MORE.format(len(titles) - 1) if len(titles) > 1 else ""
    return OMITTED + titles[0][: OMITTED_CAP - len(OMITTED) - len(tail)] + tail


def _within(pieces: list[Piece], budget: int, skip: bool) -> tuple[list[Piece], bool]:
    """Pieces whose texts fit the budget with two characters between: up to the first misfit, or past misfits with ``skip``."""
    kept, used = [], 0
    for p in pieces:
        size = len(p.text) + (2 if kept else 0)
        if used + size <= budget:
            kept.append(p)
            used += size
        elif not kept:
            return [Piece(p.title, p.level, p.anchor, p.start, p.text[:budget].rstrip(), p.index)] if budget > 0 else [], len(p.text) > budget > 0
        elif not skip:
            break
    return kept, False


Ranker = Callable[[list[Piece], str], list[Piece]]


def by_tokens(pieces: list[Piece], query: str) -> list[Piece]:
    """Pieces by the BM25 score of the query's tokens over the page's own pieces, best first; none without a shared token."""
    import math

    tokens = {x for x in re.split(r"[^\w.-]+", query.lower()) if len(x) >= 2}
    tokens |= {q[i : i + 2] for q in re.findall("[一-鿿]+", query) for i in range(len(q) - 1)}
    low = [p.text.lower() for p in pieces]
    mean = sum(map(len, low)) / max(1, len(low)) or 1
    scores = [0.0] * len(pieces)
    for x in tokens:
        tf = [t.count(x) for t in low]
        df = sum(n > 0 for n in tf)
        for k, n in enumerate(tf):
            scores[k] += math.log(1 + (len(low) - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(low[k]) / mean)) if n else 0.0
    return [pieces[k] for k in sorted(range(len(pieces)), key=lambda k: (-scores[k], k)) if scores[k] > 0]


def pack_sections(markdown: str, url: str, query: str | None = None, cap: int = RELEVANT_CAP, ranker: Ranker = by_tokens) -> tuple[str, str | None, bool, bool]:
    """(text, title of the best section, matched, truncated): relevant sections in page order within ``cap`` characters.

    With a query the sections that match it directly, else those ranked by ``ranker``, else an index of headings; without
    one, the leading sections. The list of what is left out comes on top of the budget.
    """
    head = f"Source: {url}"
    budget = max(0, cap - len(head) - 2)
    pieces = pieces_of(markdown)
    chosen, best, matched = pieces, None, False
    body = None
    if query and query.strip() and pieces:
        for p in pieces:
            p.score = query_score(query, f"{p.title}\n{p.text[:SCORED_CHARS]}")
        ranked = sorted((p for p in pieces if p.score >= MATCH), key=lambda p: (-p.score, p.index)) or ranker(pieces, query)
        if ranked:
            matched, best = True, ranked[0].title or None
            chosen = sorted(_within(ranked, budget, skip=True)[0], key=lambda p: p.index)
        elif headed := [p for p in pieces if p.title]:
            lines, used = [], len(INDEX_INTRO)
            for p in headed:
                if used + len(p.title) + 3 > budget:
                    break
                lines.append(f"\n- {p.title}")
                used += len(lines[-1])
            body, truncated = INDEX_INTRO + "".join(lines), len(lines) < len(headed)
            left = [p.title for p in headed[len(lines) :]]
    if body is None:
        kept, cut = _within(chosen, budget, skip=False)
        own = {p.index for p in kept}
        left = [p.title for p in pieces if p.title and p.index not in own]
        truncated = cut or bool(left) or len(kept) < len(pieces)
        body = "\n\n".join(p.text for p in kept)
        left_line = "\n\n".join(x for x in (omitted_line(left), CUT if cut else "") if x)
    else:
        left_line = omitted_line(left)
    return "\n\n".join(x for x in (head, body, left_line) if x), best, matched, truncated


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows = [], []
        for page_id, markdown in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for p in pieces_of(markdown or ""):
                ids.append(page_id)
                rows.append((p.index, p.level, p.title, p.anchor, p.start, p.text))
        columns = list(zip(*rows)) if rows else [()] * 6
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["page_id", "piece", "level", "title", "anchor", "start", "text"])


def page_pieces(pages: DataFrame, page_id: str = "page_id", markdown: str = "markdown") -> DataFrame:
    """(page_id, piece, level, title, anchor, start, text) of all pages; a null or blank page has none."""
    kind = pages.schema[page_id].dataType.simpleString()
    rows = pages.select(pages[page_id].alias("page_id"), pages[markdown].alias("markdown"))
    return rows.mapInArrow(_rows, f"page_id {kind}, piece int, level int, title string, anchor string, start int, text string")


def headings(markdown: Column) -> Column:
    """Heading lines of a page as an array, natively."""
    return F.regexp_extract_all(markdown, F.lit("(?m)^#{1,6}[ \\t]+.+$"), F.lit(0))
