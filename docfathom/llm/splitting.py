"""Oversized rows cut into pieces at natural boundaries (problem 4)."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2000, 200
#: Room that the breadcrumbs leave to the text, in overlaps: with less a piece would hold hardly more than what it shares.
LEAST_ROOM = 2
SEPARATOR = " > "
#: The characters that end an unbroken stretch.
BREAKS = " \t\n.!?;,。！？；，、"

#: Kinds of boundary from strong to weak; a cut lies at the end of the match, for headings before it.
BOUNDARIES = (
    ("heading", re.compile(r"\n(?=#{1,6} |={1,6}[^=\n]|\\(?:sub)*section|\\paragraph|<[hH][1-6][ >])")),
    ("paragraph", re.compile(r"\n[ \t\r]*\n+")),
    ("line", re.compile(r"\n")),
    ("sentence", re.compile(r"[.!?…](?=\s)\s*|[。！？]")),
    ("clause", re.compile(r"[;,:](?=\s)\s*|[；，、：]")),
    ("word", re.compile(r"[ \t]+")),
    ("mark", re.compile(r"[.!?;,]")),
)
_STRETCH = re.compile(f"[^{re.escape(BREAKS)}]+")


def longest_stretch(text: str) -> int:
    """Characters of the longest run without a space, tab, line feed or one of ``. ! ? ; ,`` and their CJK forms."""
    return max((m.end() - m.start() for m in _STRETCH.finditer(text)), default=0)


def _cut_at(text: str, lo: int, hi: int, cuts: list[tuple[str, list[int]]]) -> tuple[int, str]:
    """Where to halve text[lo:hi]: the strongest boundary in the middle half, the one nearest to the midpoint among equals.

    Where the middle half has none, any boundary of the stretch that leaves both sides non-empty is taken; the last
    resort is a cut at the midpoint, not inside a character with its combining marks.
    """
    middle, quarter = (lo + hi) // 2, (hi - lo) // 4
    for near, far in ((lo + quarter, hi - quarter), (lo + 1, hi - 1)):
        for kind, places in cuts:
            a, b = bisect_left(places, near), bisect_right(places, far)
            if a < b:
                k = bisect_left(places, middle, a, b)
                return min(places[max(a, k - 1) : min(b, k + 1)], key=lambda p: (abs(p - middle), p)), kind
    at = middle
    while at > lo + 1 and (unicodedata.combining(text[at]) or text[at] in "\u200d\ufe0f" or text[at - 1] == "\u200d"):
        at -= 1
    return (at if at > lo + 1 else middle), "forced"


def split_text(text: str, room: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(start, own start, end, kind of the cut before) of each piece; text[start:end] has at most ``room`` characters.

    Own parts text[own start:end] follow each other without gap. Halves longer than room - overlap are halved again,
    then each piece but the first is given up to ``overlap`` characters from the end of the one before, from a word's
    start where there is one.
    """
    overlap = min(overlap, room // 2)
    most = room - overlap
    if len(text) <= room:
        return [(0, 0, len(text), "start")]
    cuts = [(kind, [m.end() for m in pattern.finditer(text)]) for kind, pattern in BOUNDARIES]
    own: list[tuple[int, int, str]] = []
    todo = [(0, len(text), "start")]
    while todo:
        lo, hi, kind = todo.pop()
        if hi - lo <= most:
            own.append((lo, hi, kind))
            continue
        at, cut = _cut_at(text, lo, hi, cuts)
        todo += [(at, hi, cut), (lo, at, kind)]
    words = cuts[-2][1]
    sentences = cuts[3][1]
    out = []
    for k, (lo, hi, kind) in enumerate(own):
        start = lo
        if k and overlap:
            least = max(lo - overlap, own[k - 1][0])
            start = least
            for places in (sentences, words):
                i = bisect_left(places, least)
                if i < len(places) and places[i] < lo:
                    start = places[i]
                    break
            while start < lo and unicodedata.combining(text[start]):
                start += 1
        out.append((start, lo, hi, kind))
    return out


def heading_line(breadcrumbs: list[str | None] | None, most: int) -> str:
    """The breadcrumbs as one line, cut short to ``most`` characters; null and empty ones are left out."""
    line = SEPARATOR.join(x for x in breadcrumbs or () if x)
    return line if len(line) <= most else line[: most - 1].rstrip() + "…" if most else ""


def _split_rows(batches: Iterator[pa.RecordBatch], limit: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, pieces = [], []
        for row_id, text, crumbs in zip(*(c.to_pylist() for c in batch.columns)):
            line = heading_line(crumbs, max(0, limit - max(1, LEAST_ROOM * overlap)))
            forced = int(longest_stretch(text) > limit)
            parts = split_text(text, limit - len(line), overlap)
            ids += [row_id] * len(parts)
            pieces += [(k, len(parts), line, text[start:end], own - start, start, kind, forced) for k, (start, own, end, kind) in enumerate(parts)]
        columns = list(zip(*pieces)) if pieces else [()] * 8
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int32()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, batch.schema.field(0).type), *(pa.array(c, t) for c, t in zip(columns, kinds))],
            names=["id", "piece_no", "n_pieces", "heading", "piece", "shared_chars", "start_char", "cut", "forced"],
        )


def split_oversized(df: DataFrame, id_column: str = "row_id", text: str = "text", breadcrumbs: str = "breadcrumbs", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the rows whose text and breadcrumbs together exceed ``limit`` characters, without separators.

    (id, piece_no, n_pieces, heading, piece, shared_chars, start_char, cut, forced): ``heading`` holds the breadcrumbs,
    cut short only where they would leave less room than two overlaps; heading and piece together have at most ``limit`` characters. The piece's first ``shared_chars``
    characters are also the end of the piece before; without these, the pieces in order are the text, letter by letter.
    cut names the boundary before the piece; forced is 1 if the text has a longer unbroken stretch than ``limit``.

    Rows with a null or empty text, or within the limit, have no pieces. Null breadcrumbs count as none. A repeated row
    is cut as often as it is there. Rows are cut one by one: no shuffle, and memory for one batch of oversized rows.
    """
    chars = F.length(df[text]) + F.coalesce(F.aggregate(df[breadcrumbs], F.lit(0), lambda n, x: n + F.coalesce(F.length(x), F.lit(0))), F.lit(0))
    rows = df.where((F.length(df[text]) > 0) & (chars > limit)).select(df[id_column].alias("id"), df[text].alias("text"), df[breadcrumbs].alias("breadcrumbs"))
    kind = df.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, piece_no int, n_pieces int, heading string, piece string, shared_chars int, start_char long, cut string, forced int"
    return rows.mapInArrow(partial(_split_rows, limit=limit, overlap=overlap), schema).withColumnRenamed("id", id_column)
