"""Index-side text analysis in Arrow batches: weighted terms of a text, by the same rules as the expressions in ``analysis``.

A document's counts are made in one pass over its own row; the native form evaluates its patterns once for each kind of
term and needs an aggregation after it, which took 20 times as long.
"""

from __future__ import annotations

import re

from . import wordlists as W

_SCAN = re.compile(r"[0-9A-Za-z._-]+|[一-鿿]+|[^0-9A-Za-z._\-一-鿿]+")
_BREAK = re.compile(W.CJK_BREAK)
_SPLIT = re.compile(r"[-_.]+")
_WORD = re.compile(r"[A-Za-z]{2,}")
_STOP = frozenset(W.EN_STOP)
_FRAGMENT = frozenset(W.FRAGMENT_SKIP)


def weighted_terms(text: str | None, scale: float = 1.0) -> dict[str, float]:
    """Terms of a text with their summed weights: tokens, their joined form and parts, numbers with the word after them, CJK segments and bigrams."""
    out: dict[str, float] = {}

    def add(term: str, weight: float) -> None:
        if len(term) >= 2 and term not in _STOP and (weight >= 1 or term not in _FRAGMENT):
            out[term] = out.get(term, 0.0) + weight

    number = ""
    for run in _SCAN.findall(text or ""):
        first = run[0]
        if "一" <= first <= "鿿":
            number = ""
            for piece in _BREAK.split(run):
                n = len(piece)
                if n < 2:
                    continue
                if 3 <= n <= 8:
                    add(piece, scale)
                for i in range(n - 1):
                    add(piece[i : i + 2], scale)
        elif first.isascii() and (first.isalnum() or first in "._-"):
            low = run.lower()
            add(low, scale)
            if "_" in low or "-" in low or "." in low:
                flat = low.replace("_", "").replace("-", "").replace(".", "")
                if len(flat) >= 6:
                    add(flat, scale)
                for part in _SPLIT.split(low):
                    add(part, 0.5 * scale)
            if run.isdigit():
                number = run
            else:
                if number and _WORD.fullmatch(run):
                    add(number + low, scale)
                number = ""
        elif run.strip(" \t"):
            number = ""
    return out
