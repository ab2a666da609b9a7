"""Evaluation passages that leak into a corpus (problem 7), found by winnowing.

Both sides keep the minimum k-gram hash of every window, so that a shared span of window + k - 1 units shares a
fingerprint. Items are a stated query set: their sorted fingerprints, of a bounded size, are joined with those of the
texts in the tasks that read these. Pairs that share enough fingerprints near one diagonal are aligned exactly.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache, partial
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from docfathom.session import spread

from .lookalikes import LATIN_LIKE

#: Window, and length of a gram by unit (words, or characters in Chinese) and by the least size of an item. Half of an item
#: or more, one unit in eight changed, has an unbroken run of window + length - 1 units: of 4 words in the shortest items of 15
#: words, of 5 from 32 words and of 6 from 48 words on; of 5, 6 and 7 characters from 30, 48 and 112 characters on.
WINDOW = 2
WORDS, CHARS = ((48, 5), (32, 4), (0, 3)), ((112, 6), (48, 5), (0, 4))
#: Length of the grams that show how much of an item a text covers at most.
COVER = 3
LEAST_WORDS, LEAST_CHARS = 15, 30
CHANGED_IN = 8
#: Most characters of passages that are handed to the tasks at once, and most units of texts joined at once in a task.
BLOCK_CHARS, BLOCK_UNITS = 8_000_000, 300_000
#: Places of the same gram so close together count once.
CELL = 4
CJK = re.compile("[㐀-䶿一-鿿豈-﫿]")

_FORMAT = [cp for cp in (*range(0x20000), *range(0xE0000, 0xE1000)) if unicodedata.category(chr(cp)) == "Cf"]
_LIKE = {ord(ch): x for x, like in LATIN_LIKE.items() for ch in like} | dict.fromkeys(_FORMAT)
_UNLIKE = re.compile("[" + "".join(map(re.escape, map(chr, sorted(_LIKE)))) + "]")
_MARKUP = re.compile(r"<!--.*?-->|</?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?>", re.S)
_LINK = re.compile(r"(?<=\])\([^()\s]*\)")
_TOKEN = re.compile(r"[^\W_]+(?:_[^\W_]+)*")
_SPACED = re.compile(r"\S+")


def plain_text(text: str) -> str:
    """Lower case, without tags, link targets and LaTeX emphasis, and with one form for letters that look the same."""
    if "<" in text:
        text = _MARKUP.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "](" in text:
        text = _LINK.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        if _UNLIKE.search(text):
            text = unicodedata.normalize("NFC", text.translate(_LIKE))
    if "\\" in text:
        text = re.sub(r"\\(?:textbf|textit|texttt|emph|underline|text)\{|\\(?=[^\w\s])", "", text)
    return text.lower()


def words_of(plain: str) -> list[str]:
    return _TOKEN.findall(plain)


def chars_of(plain: str) -> str:
    """Letters and digits of a text, one unit each."""
    return "".join(_TOKEN.findall(plain)).replace("_", "")


def weighed(plain: str, by_chars: bool) -> tuple[list[str] | str, np.ndarray]:
    """The units of a text and how much of a counted unit each of them is: the parts of a spaced word share its weight."""
    if by_chars:
        units = chars_of(plain)
        return units, np.ones(len(units))
    units, weights = [], []
    for word in _SPACED.findall(plain):
        own = words_of(word)
        units += own
        weights += [1 / len(own)] * len(own) if own else []
    return units, np.array(weights)


# --- Fingerprints ---------------------------------------------------------------------------------------------------


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = h = xxh3_64_intdigest(word)
        return h


def _ids(units: list[str] | str, held: _Hashes) -> np.ndarray:
    if isinstance(units, str):
        return np.frombuffer(units.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return np.fromiter(map(held.__getitem__, units), np.uint64, len(units))


def fingerprints(ids: np.ndarray, owner: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the kept k-grams of unit sequences laid end to end, ``owner`` telling them apart.

    The minimum of every window is kept, the rightmost one among equals; all grams of a sequence without a full window.
    """
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = (h ^ ids[j : n + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    whole = owner[:n] == owner[k - 1 :]
    kept = np.zeros(n, bool)
    covered = np.zeros(n, bool)
    if n >= window:
        full = owner[: n - window + 1] == owner[k + window - 2 :]
        views = np.lib.stride_tricks.sliding_window_view(h, window)
        at = np.arange(n - window + 1) + (window - 1 - np.argmin(views[:, ::-1], axis=1))
        kept[at[full]] = True
        for j in range(window):
            covered[j : n - window + 1 + j] |= full
    places = np.nonzero(kept | (whole & ~covered))[0]
    return places, h[places]


def _all_grams(ids: np.ndarray, k: int) -> np.ndarray:
    h = np.zeros(max(0, len(ids) - k + 1), np.uint64)
    for j in range(k):
        h = (h ^ ids[j : len(h) + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def winnow(units: list[str] | str, k: int, window: int) -> dict[int, int]:
    """Fingerprints of one unit sequence: the place of each kept k-gram and its hash."""
    places, hashes = fingerprints(_ids(units, _Hashes()), np.zeros(len(units), np.int64), k, window)
    return dict(zip(places.tolist(), hashes.tolist()))


class Sequence:
    """Unit hashes of a text and its grams of COVER units."""

    def __init__(self, ids: np.ndarray) -> None:
        grams = _all_grams(ids, COVER)
        self.ids, self.order = ids, np.argsort(grams, kind="stable")
        self.grams = grams[self.order]


class Item:
    """An evaluation passage: its units, how much of a counted unit each of them is, and its fingerprints."""

    def __init__(self, item_id, passage: str | None, by_chars: bool) -> None:
        self.item_id, self.by_chars = item_id, by_chars
        passage = passage or ""
        self.units, self.weights = weighed(plain_text(passage), by_chars)
        self.size = float(self.weights.sum())
        self.counts = len(self.units) > 0 and (len(re.sub(r"\s", "", passage)) >= LEAST_CHARS if by_chars else len(_SPACED.findall(passage)) >= LEAST_WORDS)
        self.k = next(k for least, k in (CHARS if by_chars else WORDS) if self.size >= least - 1e-9)
        self.prints = winnow(self.units, self.k, WINDOW) if self.counts else {}
        self.sequence, self.covers = Sequence(_ids(self.units, _Hashes())), self.cover()
        self.marks = np.append(self.sequence.grams, np.uint64(0)).astype(np.uint16)  # never empty
        self.left_out = int(np.searchsorted(np.cumsum(np.sort(self.weights)), self.size / CHANGED_IN + 1e-9, "right"))
        #: How far a fitting stretch may drift off a diagonal: each changed unit may put in another, or a word of two parts.
        self.drift = int(self.size / CHANGED_IN) * (1 if by_chars else 2) + CELL

    def without_cjk(self) -> bool:
        """Whether a text without any CJK character can repeat half of the passage: a stretch of it with one such character in eight at most."""
        scores = np.concatenate([[0], np.cumsum([1 - CHANGED_IN if CJK.match(x) else 1 for x in self.units])])
        half = -(-len(self.units) // 2)
        return bool((np.minimum.accumulate(scores[: len(scores) - half]) <= scores[half:]).any())

    def _lengths(self) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.arange(max(1, int(np.ceil(self.size / 2 - 1e-9))), max(2, int(self.size) + 2))
        return lengths, lengths // CHANGED_IN

    def least(self) -> int:
        """How many fingerprints a text that repeats half of the passage or more must at least share, at their places.

        A stretch of L units with c changes lies in at most c + 1 unbroken runs; a run of r units shares at least one in
        WINDOW of its r - k + 1 grams.
        """
        lengths, changes = self._lengths()
        places = int(((lengths - changes - (changes + 1) * (self.k + WINDOW - 2)) // WINDOW).min())
        held: dict[int, list[int]] = {}
        for at, h in self.prints.items():
            held.setdefault(h, []).append(at)
        return _fewest(held, set(held), max(1, places))

    def cover(self) -> int:
        """How many units of it lie at least in grams of COVER units that the text has: in each run all, or fewer than COVER are lost."""
        lengths, changes = self._lengths()
        return max(1, int((lengths - changes - (changes + 1) * (COVER - 1)).min()))


def _fewest(places: dict[int, list[int]], own: set[int], n: int) -> int:
    """How many distinct hashes ``n`` places of an item hold at least, 1 as the floor: those with the most places first."""
    k = 0
    for size in sorted((len(places[h]) for h in own), reverse=True):
        if n <= 0:
            break
        n -= size
        k += 1
    return max(1, k)


# --- Exact alignment ------------------------------------------------------------------------------------------------


def longest_stretch(item: Item, text: Sequence, weights: Callable[[], np.ndarray], share: float = 0.0) -> tuple[float, float]:
    """Share of the item in the longest of its stretches that the text repeats, and the share changed in it; zeros below ``share``.

    A changed or missing unit counts by its weight, and so does a unit put in, by a quarter at least; a changed unit may
    stand for up to one spaced word of the text. A stretch fits if eight times its changed weight is at most its weight.
    No such stretch of at least a half drifts further from its shared grams than its changes allow, and it has at least
    ``item.cover()`` of these: the alignment runs along the diagonals where they are, in a band that grows with the item.
    """
    places, grams = item.sequence.order, item.sequence.grams
    lo = np.searchsorted(text.grams, grams)
    hit = lo < len(text.grams)
    hit[hit] = text.grams[lo[hit]] == grams[hit]
    if np.count_nonzero(hit) < item.covers or not hit.any():
        return 0.0, 0.0
    places, lo = places[hit], lo[hit]
    n = np.searchsorted(text.grams, grams[hit], "right") - lo
    nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    diagonals = np.sort(text.order[np.repeat(lo, n) + nth] - np.repeat(places, n))
    if np.unique(diagonals, return_counts=True)[1].max() == len(grams):
        return 1.0, 0.0  # the whole passage unit by unit
    # Units left out by the weight that may change, those of the least weight first, and units put in.
    drift = item.left_out + int(item.size / CHANGED_IN) * (1 if item.by_chars else 4)
    ends = np.searchsorted(diagonals, diagonals + drift, "right")
    best = (0.0, 0.0)
    bands: list[list[int]] = []
    for k in np.nonzero(ends - np.arange(len(diagonals)) >= item.covers)[0]:
        low, high = int(diagonals[k]), int(diagonals[ends[k] - 1])
        if bands and low <= bands[-1][1] + 2 * drift:
            bands[-1][1] = max(bands[-1][1], high)
        else:
            bands.append([low, high])
    for low, high in bands:
        best = max(best, _along(item.sequence.ids, item.weights, text.ids, np.maximum(weights(), 0.25), low - drift, high + drift, max(share * item.size, best[0])))
    return best[0] / item.size, best[1]


def _along(x: np.ndarray, w: np.ndarray, d: np.ndarray, v: np.ndarray, low: int, high: int, least: float) -> tuple[float, float]:
    """The weight of the longest fitting stretch of at least ``least`` between two diagonals (place in the text less place in the item), and the share changed in it.

    scores[a, c]: the best score of the units from a on, if the text stands at diagonal low + c; a unit that is the
    same adds its weight, a changed one takes seven times as much, one put in eight times its own.
    """
    n, width, pad = len(x), high - low + 1, len(x) + high - low + 2
    left = pad + max(0, -low)
    right = pad + max(0, n + high - len(d))
    outside = np.uint64(0x5BD1E9955BD1E995)  # the hash of no unit
    d = np.concatenate([np.full(left, outside), d, np.full(right, outside)])
    v = np.concatenate([np.ones(left), v, np.ones(right)])
    upto = np.concatenate([[0.0], np.cumsum(v)])
    # Whether k units of the text from a place on make up at most one word.
    spans = []
    for k in range(2, n + 2):
        ok = upto[k:] - upto[:-k] <= 1 + 1e-9
        if not ok.any():
            break
        spans.append((k, ok))
    sums = np.concatenate([[0.0], np.cumsum(w)])
    last = max(1, int(np.count_nonzero(sums[n] - sums[:n] >= least - 1e-9)))
    starts, scores = np.zeros(0, np.int64), np.zeros((0, width))
    best = (0.0, 0.0)
    for i in range(n):
        if i < last:
            # A start is of use only where no earlier one has a score of 0 or more: that one gives a longer stretch.
            free = scores.max(axis=0, initial=-np.inf) < 0
            if free.any():
                starts, scores = np.append(starts, i), np.vstack([scores, np.where(free, 0.0, -np.inf)])
        lost = scores - (CHANGED_IN - 1) * w[i]
        at = left + i + low
        new = np.where(d[at : at + width] == x[i], scores + w[i], lost)
        np.maximum(new[:, :-1], lost[:, 1:], out=new[:, :-1])
        for k, ok in spans:
            if k <= width:
                np.maximum(new[:, k - 1 :], np.where(ok[at : at + width - k + 1], lost[:, : width - k + 1], -np.inf), out=new[:, k - 1 :])
        put_in = CHANGED_IN * upto[at + 1 : at + 1 + width]
        new = np.maximum.accumulate(new + put_in, axis=1) - put_in
        top = new.max(axis=1)
        good = np.nonzero(top >= -1e-6)[0]
        if len(good) and (weight := sums[i + 1] - sums[starts[good[0]]]) > best[0] and weight >= least - 1e-9:
            best = (float(weight), float(max(0.0, (1 - top[good[0]] / weight) / CHANGED_IN)))
        alive = top + (sums[n] - sums[i + 1]) >= -1e-6  # others can't come back to 0
        starts, scores = (starts, new) if alive.all() else (starts[alive], new[alive])
    return best


# --- The join -------------------------------------------------------------------------------------------------------


class Side:
    """Fingerprints of the items of one kind (unit, gram length, and whether texts without CJK can hold them), sorted by hash."""

    def __init__(self, items: list[tuple[int, Item]], k: int, by_chars: bool, any_text: bool) -> None:
        self.k, self.by_chars, self.any_text = k, by_chars, any_text
        prints = np.array([h for _, x in items for h in x.prints.values()], np.uint64)
        number = np.array([n for n, x in items for _ in x.prints], np.int64)
        place = np.array([at for _, x in items for at in x.prints], np.int64)
        order = np.argsort(prints, kind="stable")
        self.prints, self.number, self.place = prints[order], number[order], place[order]
        self.ends = np.searchsorted(self.prints, self.prints, "right")


class Index:
    """A block of items for the tasks: their fingerprints by kind, and what each of them asks of a text."""

    def __init__(self, items: list[Item]) -> None:
        self.items = [x for x in items if x.counts]
        kinds: dict[tuple[int, bool, bool], list[tuple[int, Item]]] = {}
        for n, x in enumerate(self.items):
            kinds.setdefault((x.k, x.by_chars, not x.by_chars or x.without_cjk()), []).append((n, x))
        self.sides = [Side(own, *kind) for kind, own in sorted(kinds.items())]
        self.least = np.array([x.least() for x in self.items], np.int64)
        self.drift = np.array([x.drift for x in self.items], np.int64)
        self.covers = np.array([x.covers for x in self.items], np.int64)

    def pairs(self, texts: list[np.ndarray], cjk: np.ndarray, by_chars: bool) -> np.ndarray:
        """Numbers text * items + item of texts, as unit hashes, that share enough of the item's fingerprints in a band of diagonals, in order."""
        ids = np.concatenate(texts)
        sizes = np.array([len(x) for x in texts], np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        found = []
        for side in self.sides:
            if side.by_chars != by_chars or not len(side.prints):
                continue
            places, h = fingerprints(ids, owner, side.k, WINDOW)
            if not side.any_text:
                own = cjk[owner[places]]
                places, h = places[own], h[own]
            lo = np.searchsorted(side.prints, h)
            hit = lo < len(side.prints)
            hit[hit] = side.prints[lo[hit]] == h[hit]
            if not hit.any():
                continue
            places, lo = places[hit], lo[hit]
            n = side.ends[lo] - lo
            text, at = owner[places], places - first[owner[places]]
            # A gram again and again in the same few places counts once, so that no text is joined with itself over and over.
            _, one = np.unique((text * len(side.prints) + lo << 24) | at // CELL, return_index=True)
            text, at, lo, n = text[one], at[one], lo[one], n[one]
            k = np.repeat(lo, n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
            number = side.number[k]
            pair = np.repeat(text, n) * len(self.items) + number
            off = np.repeat(at, n) - side.place[k] + (1 << 30)
            half = self.drift[number]
            for shift in (0, 1):
                key, shared = np.unique((pair << 32) | ((off + shift * half) // (2 * half)), return_counts=True)
                found.append((key >> 32)[shared >= self.least[(key >> 32) % len(self.items)]])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


    def covered(self, ids: np.ndarray, numbers: list[int]) -> list[int]:
        """Those of the items whose grams a text of these unit hashes seems to have in the number that a fitting stretch has at least."""
        marks = np.zeros(1 << 16, np.int32)
        marks[_all_grams(ids, COVER).astype(np.uint16)] = 1
        own = [self.items[n].marks for n in numbers]
        starts = np.cumsum([0] + [len(x) for x in own[:-1]])
        shared = np.add.reduceat(marks[np.concatenate(own)], starts)
        return [n for n, ok in zip(numbers, shared >= self.covers[numbers]) if ok]


def _search(batches: Iterator[pa.RecordBatch], index: Index, share: float) -> Iterator[pa.RecordBatch]:
    units = sorted({side.by_chars for side in index.sides})
    latin = any(side.by_chars and side.any_text for side in index.sides)
    for batch in batches:
        rows: dict[str, list[int]] = {}  # equal texts are compared once
        for k, text in enumerate(batch.column(1).to_pylist()):
            if text:
                rows.setdefault(text, []).append(k)
        at, numbers, shares, changes = [], [], [], []
        held = _Hashes()
        waiting: list[str] = []
        plains: list[str] = []
        size = 0

        def join() -> None:
            cjk = np.array([bool(CJK.search(x)) for x in plains])
            for by_chars in units:
                own = [i for i in range(len(plains)) if not by_chars or latin or cjk[i]]
                if not own or not index.items:
                    continue
                ids = [_ids(chars_of(plains[i]) if by_chars else words_of(plains[i]), held) for i in own]
                pairs = index.pairs(ids, cjk[own], by_chars)
                for at_text, of_text in groupby(pairs.tolist(), lambda pair: pair // len(index.items)):
                    i, text, weights = own[at_text], None, None
                    for n in index.covered(ids[at_text], [pair % len(index.items) for pair in of_text]):
                        if text is None:
                            text, weights = Sequence(ids[at_text]), cache(lambda i=i: weighed(plains[i], by_chars)[1])
                        part, changed = longest_stretch(index.items[n], text, weights, share)
                        if part > 0 and part >= share - 1e-9:
                            for k in rows[waiting[i]]:
                                at.append(k)
                                numbers.append(index.items[n].item_id)
                                shares.append(part)
                                changes.append(changed)
            waiting.clear()
            plains.clear()

        for text in rows:
            waiting.append(text)
            plains.append(plain_text(text))
            size += len(text) // 4 + 1
            if size > BLOCK_UNITS:
                join()
                size = 0
        if waiting:
            join()
        columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(numbers, pa.int64()), pa.array(shares, pa.float64()), pa.array(changes, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "share", "changed"])


def leaks(documents: DataFrame, items: DataFrame, share: float = 0.5, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, share, changed) of documents that repeat a passage or one stretch of at least ``share`` of it.

    share is the repeated stretch's part of the passage by words, by characters for zh, 0.5 or more; at most one word
    (zh: character) in eight of it is changed. Items that are null or too short never count. Repeated items and
    documents give a line each, null and empty texts none. Other columns are not read.

    Nothing is shuffled: fingerprints of items come to the tasks in blocks of about ``block_chars`` characters of
    passages, and the corpus is read once for each block.
    """
    if share < 0.5:
        raise ValueError("the fingerprints are dense enough for shares of a half and more only")
    total = items.agg(F.sum(F.length("passage"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "passage", F.lower(F.col("lang")).startswith("zh").alias("zh")).where("passage is not null")
    texts = spread(documents.select("doc_id", "text"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    out = None
    for b in range(blocks):
        own = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        index = Index([Item(r.item_id, r.passage, r.zh if r.zh is not None else bool(CJK.search(r.passage))) for r in own.collect()])
        part = texts.mapInArrow(partial(_search, index=index, share=share), f"doc_id {kind}, item_id long, share double, changed double")
        out = part if out is None else out.unionByName(part)
    return out
