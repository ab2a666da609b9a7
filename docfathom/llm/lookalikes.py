"""Text that looks the same brought to one form (problem 1), and the rows that look alike.

Look-alike strings and code points form classes by union-find; the member that the corpus uses most stands for its
class; a multi-pattern automaton rewrites all others, greedily from the left, the longest match first.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfathom.session import spread, written

#: Letters of other scripts drawn like a Latin letter.
LATIN_LIKE = {
    "A": "ΑАᎪ", "B": "ΒВᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ΕЕᎬ", "G": "Ԍ", "H": "ΗНᎻ", "I": "ΙІӀ", "J": "ЈᎫ", "K": "ΚК",
    "L": "Ꮮ", "M": "ΜМϺ", "N": "Ν", "O": "ΟОՕ", "P": "ΡРᏢ", "Q": "Ԛ", "S": "ЅՏ", "T": "ΤТ", "V": "Ѵ", "W": "ԜᎳ",
    "X": "ΧХ", "Y": "ΥҮ", "Z": "ΖᏃ", "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "і", "j": "јϳ",
    "l": "ӏ", "o": "οоօ", "p": "р", "q": "ԛ", "s": "ѕ", "v": "νѵ", "w": "ԝ", "x": "х", "y": "у",
}
#: Signs drawn alike, and code points that are drawn as a line end.
SIGN_LIKE = {"-": "\u2010\u2011", ";": "\u037e", "\n": "\u0085\u2028\u2029"}
LINE_ENDS = ("\r\n",)
#: Kinds of compatibility forms that are drawn as what they stand for.
DRAWN_ALIKE = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<small>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Compatibility forms that are drawn differently.
DRAWN_APART = "ſẛ№ŉϐϑϒϕϖϰϱϲϵ"
#: Strings whose ligature or compatibility form is a single code point; their frequency is counted too.
LIGATURES = ("ffi", "ffl", "ff", "fi", "fl", "st", "...", "..", "!!", "??")
#: Drawn without any width, beside the format characters (Cf) and controls.
WIDTHLESS = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0"


def _widthless(ch: str) -> bool:
    return ch in WIDTHLESS or "\ufe00" <= ch <= "\ufe0f" or "\U000e0100" <= ch <= "\U000e01ef" or unicodedata.category(ch) in ("Cf", "Cc") and ch not in "\t\n\r\u0085"


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.parent:
            out.setdefault(self.find(x), []).append(x)
        return out


def _compat(ch: str) -> str | None:
    """What a compatibility or singleton form is drawn as, or None."""
    parts = unicodedata.decomposition(ch).split()
    if not parts or ch in DRAWN_APART:
        return None
    if parts[0].startswith("<"):
        if parts[0] not in DRAWN_ALIKE:
            return None
        parts = parts[1:]
        if parts[0] == "0020" and len(parts) > 1:
            return None  # a spacing accent, drawn apart from a blank with an accent
    elif len(parts) > 1:
        return None  # an accented letter, see below
    plain = "".join(chr(int(x, 16)) for x in parts)
    return "".join(_compat(x) or x for x in plain)


def look_alike_classes(used: Iterable[str]) -> Classes:
    """Classes of the code points in ``used`` and the strings they are drawn like."""
    used = set(used)
    classes = Classes()
    latin = {ch: x for x, like in LATIN_LIKE.items() for ch in like}
    for x, like in (LATIN_LIKE | SIGN_LIKE).items():
        for ch in like:
            if ch in used:
                classes.union(ch, x)
    for x in LINE_ENDS:
        if x[0] in used:
            classes.union(x, "\n")
    for ch in used:
        if _widthless(ch):
            classes.union(ch, "")
        elif unicodedata.category(ch) == "Zs":
            classes.union(ch, " ")
        elif (plain := _compat(ch)) is not None:
            classes.union(ch, plain)
            for x in plain:
                if x in latin:
                    classes.union(x, latin[x])
    # Accented letters are drawn like their letter followed by the accent, also where the letter is only a look-alike.
    marks = {ch for ch in used if unicodedata.combining(ch)}
    for cp in range(0xC0, 0x2000):
        ch = chr(cp)
        parts = unicodedata.decomposition(ch).split()
        if len(parts) != 2 or parts[0].startswith("<"):
            continue
        base, mark = (chr(int(x, 16)) for x in parts)
        plain = unicodedata.normalize("NFC", latin.get(base, base) + mark)
        if ch in used and plain != ch:
            classes.union(ch, plain)
        if mark in used and (base in used or ch in used):
            classes.union(base + mark, ch)
            if plain != ch:
                classes.union(base + mark, plain)
        if mark in used:
            for like in LATIN_LIKE.get(base, ""):
                if like in used:
                    classes.union(like + mark, ch)
    return classes


def rewrite_rules(frequency: dict[str, int]) -> dict[str, str]:
    """Each look-alike string and what stands for it: the most frequent member of its class, the shorter, lower one in a tie."""
    classes = look_alike_classes(x for x in frequency if len(x) == 1)

    def used(x: str) -> int:
        if x in frequency or len(x) == 1 or any(map(unicodedata.combining, x)):
            return frequency.get(x, 0)
        return min(frequency.get(ch, 0) for ch in x)  # a string that was not counted: at most as often as its rarest sign

    rules = {}
    for members in classes.members().values():
        best = "" if "" in members else max(members, key=lambda x: (used(x), -len(x), [-ord(c) for c in x]))
        rules |= {x: best for x in members if x and x != best}
    return rules


class Rewriter:
    """Applies the rules until nothing changes: zero-width signs may stand between a letter and its accent."""

    def __init__(self, rules: dict[str, str]) -> None:
        import ahocorasick

        self.rules = rules
        self.automaton = ahocorasick.Automaton()
        for x, to in rules.items():
            self.automaton.add_word(x, (len(x), to))
        self.automaton.make_automaton()
        # A text without any of these holds no pattern: the last sign of a pattern is its accent, if it has one.
        self.needed = frozenset(x[-1] for x in rules if not x.isascii())
        self.ascii = [x for x in rules if x.isascii()]

    def once(self, text: str) -> str:
        out, done = [], 0
        for end, (n, to) in self.automaton.iter_long(text):
            out += (text[done : end + 1 - n], to)
            done = end + 1
        out.append(text[done:])
        return "".join(out)

    def __call__(self, text: str) -> str:
        while not ((text.isascii() or self.needed.isdisjoint(text)) and not any(x in text for x in self.ascii)) and (new := self.once(text)) != text:
            text = new
        return unicodedata.normalize("NFC", text)


def _count_characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: Counter[str] = Counter()
    accented = re.compile("[^\u0300-\u036f][\u0300-\u036f]").findall
    for batch in batches:
        for column in batch.columns:
            whole = "\x00".join(x for x in column.to_pylist() if x)
            n.update(whole)
            for x in LIGATURES:
                n[x] += whole.count(x)
            if not whole.isascii():
                n.update(accented(whole))
    n.pop("\x00", None)
    yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["sign", "n"])


def sign_frequencies(df: DataFrame, *columns: str) -> DataFrame:
    """(sign, n): how often each code point, and each string that a single code point may stand for, occurs in the columns."""
    counted = spread(df.select(*(df[c] for c in columns))).mapInArrow(_count_characters, "sign string, n long")
    return counted.groupBy("sign").agg(F.sum("n").alias("n")).where("n > 0")


def learn_rules(df: DataFrame, *columns: str) -> dict[str, str]:
    """The rewrite rules of a corpus. To the driver come counts of distinct code points, of which Unicode has 1.1 million."""
    return rewrite_rules({r.sign: r.n for r in sign_frequencies(df, *columns).collect()})


def _rewrite(batches: Iterator[pa.RecordBatch], rules: dict[str, str]) -> Iterator[pa.RecordBatch]:
    rewriter = Rewriter(rules)
    for batch in batches:
        forms = [pa.array([x if x is None else rewriter(x) for x in c.to_pylist()], pa.string()) for c in batch.columns[1:]]
        yield pa.RecordBatch.from_arrays([batch.column(0), *forms], names=batch.schema.names)


def uniform_text(df: DataFrame, id_column: str, *columns: str, rules: dict[str, str] | None = None) -> DataFrame:
    """(id, <column>_form ...): the texts in one form, equal exactly where they look the same.

    Nulls stay null and empty texts empty; a text of widthless signs alone becomes empty. No shuffle; the rules are
    learnt over all rows where none are given. Other columns of ``df`` are not read.
    """
    rules = learn_rules(df, *columns) if rules is None else rules
    kind = df.schema[id_column].dataType.simpleString()
    schema = ", ".join([f"`{id_column}` {kind}", *(f"`{c}_form` string" for c in columns)])
    rows = df.select(df[id_column], *(df[c].alias(f"{c}_form") for c in columns))
    return rows.mapInArrow(partial(_rewrite, rules=rules), schema)


def _variants(batches: Iterator[pa.RecordBatch], rules: dict[str, str], fields: list[str]) -> Iterator[pa.RecordBatch]:
    rewriter = Rewriter(rules)
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        names, forms, hashes, counts = [], [], [], []
        for k, field in enumerate(fields):
            seen: dict[bytes, list] = {}
            for text, own in zip(batch.column(2 * k).to_pylist(), batch.column(2 * k + 1).to_pylist()):
                if text is None:
                    continue
                if own in seen:
                    seen[own][1] += 1
                else:
                    seen[own] = [digest(rewriter(text)), 1]
            names += [field] * len(seen)
            hashes += seen
            forms += [x[0] for x in seen.values()]
            counts += [x[1] for x in seen.values()]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(forms, pa.binary()), pa.array(hashes, pa.binary()), pa.array(counts, pa.int64())], names=["field_name", "form", "own", "n"])


def _string(c: Column) -> Column:
    """The identity of a stored string: 128 bits, as forms have."""
    return F.unhex(F.md5(c))


def look_alike_strings(df: DataFrame, *columns: str, rules: dict[str, str] | None = None) -> DataFrame:
    """(field_name, form, own, n, n_rows): strings that some other string of the field looks like, by digests of 128 bits.

    form is the class: what the strings of it are rewritten to; n rows hold the string, n_rows any string of the class.
    Equal strings are counted together before the shuffle, so that a class is a group of distinct strings only.
    """
    rules = learn_rules(df, *columns) if rules is None else rules
    texts = df.select(*(x for c in columns for x in (df[c].alias(f"{c}_text"), _string(df[c]).alias(f"{c}_own"))))
    strings = spread(texts).mapInArrow(partial(_variants, rules=rules, fields=list(columns)), "field_name string, form binary, own binary, n long")
    strings = strings.groupBy("field_name", "form", "own").agg(F.sum("n").alias("n"))
    # Sums of a class, combined in each task, meet its strings again in a join: a class of very many strings is no group of one task.
    groups = strings.groupBy("field_name", "form").agg(F.count("*").alias("strings"), F.sum("n").alias("n_rows")).where("strings > 1").drop("strings")
    return written(strings.join(groups, ["field_name", "form"]).select("field_name", "form", "own", "n", "n_rows"))


def _rows_of(df: DataFrame, id_column: str, columns: tuple[str, ...]) -> DataFrame:
    """(field_name, own, id) of every field that is not null, by one scan."""
    fields = F.array(*(F.struct(F.lit(c).alias("field_name"), _string(df[c]).alias("own"), df[id_column].alias("id")) for c in columns))
    return df.select(F.inline(fields)).where("own is not null")


def look_alike_rows(df: DataFrame, id_column: str, *columns: str, rules: dict[str, str] | None = None, strings: DataFrame | None = None) -> DataFrame:
    """(field_name, id, class_id, string_id, n_rows, n_links): the rows of every class, one line each.

    n_links is the number of rows whose field looks the same and is another string. Nulls are in no class; a string that
    nothing else looks like is in none either. No pair of rows is made, so the result is never larger than the table.
    """
    strings = look_alike_strings(df, *columns, rules=rules) if strings is None else strings
    rows = _rows_of(df, id_column, columns).join(strings, ["field_name", "own"])
    return rows.select("field_name", F.col("id").alias(id_column), F.lower(F.hex("form")).alias("class_id"), F.lower(F.hex("own")).alias("string_id"), "n_rows", (F.col("n_rows") - F.col("n")).alias("n_links"))


def look_alike_pairs(df: DataFrame, id_column: str, *columns: str, rules: dict[str, str] | None = None, hot_rows: int = 100_000) -> DataFrame:
    """(field_name, id_a, id_b), id_a < id_b: rows whose field looks the same and is not the same string.

    Derived from the classes: strings of a class are paired, then the rows of both, a string of more than ``hot_rows``
    rows spread over several tasks. Copies of one string are no pair. Nulls look like nothing. Rows that repeat an id pair
    with other ids only. The result is as large as the pairs asked for; ``look_alike_rows`` has the same in a line a row.
    """
    alike = look_alike_strings(df, *columns, rules=rules).withColumn("parts", F.ceil(F.col("n") / hot_rows).cast("int"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
    rows = _rows_of(df, id_column, columns).join(alike.select("field_name", "own", "parts"), ["field_name", "own"]).select("field_name", "own", "id", part)
    rows = written(rows)
    all_parts = lambda x: F.explode(F.sequence(F.lit(0), F.col(x) - 1))
    a, b = (alike.select("field_name", "form", F.col("own").alias(f"own_{s}"), F.col("parts").alias(f"parts_{s}")) for s in "ab")
    pairs = a.join(b, ["field_name", "form"]).where("own_a < own_b").drop("form")
    pairs = pairs.withColumn("part_a", all_parts("parts_a")).withColumn("part_b", all_parts("parts_b"))
    side = lambda s: rows.select("field_name", F.col("own").alias(f"own_{s}"), F.col("part").alias(f"part_{s}"), F.col("id").alias(f"id_{s}"))
    out = pairs.join(side("a"), ["field_name", "own_a", "part_a"]).join(side("b"), ["field_name", "own_b", "part_b"]).where("id_a <> id_b")
    return out.select("field_name", F.least("id_a", "id_b").alias(f"{id_column}_a"), F.greatest("id_a", "id_b").alias(f"{id_column}_b"))
