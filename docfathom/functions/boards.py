"""Product names in free text, by rules given as a parameter: spaced, glued and listed forms."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BoardRule:
    """One product: its id as it stands in text, and brand words that may come before it, glued or spaced."""

    board: str
    brands: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()

    def pattern(self) -> str:
        ids = re.escape(self.board)
        own = f"(?<![a-z0-9_]){ids}(?:{'|'.join(map(re.escape, self.suffixes))})?(?![a-z0-9_])" if self.suffixes else f"(?<![a-z0-9_]){ids}(?![a-z0-9_])"
        spaced = r"[\s_-]*".join(map(re.escape, self.board))
        return "|".join([own, *(f"{re.escape(x)}[\\s_-]*{spaced}(?![0-9])" for x in self.brands)])


#: The boards of the test tables.
TEST_BOARDS = (BoardRule("t5", ("tavrix",)), BoardRule("t2", ("tavrix",)), BoardRule("s6", ("orlo",)), BoardRule("s1", ("orlo",)))


def board_text(x: Column, rules: Sequence[BoardRule]) -> Column:
    """Lower-cased text with list signs and path signs as spaces, and glued names taken apart."""
    x = F.regexp_replace(F.lower(x), "[\\u3001\\uff0c,;；]+|[_./#+-]+", " ")
    for rule in sorted(rules, key=lambda r: -len(r.board)):
        ids = re.escape(rule.board)
        for brand in rule.brands:
            x = F.regexp_replace(x, f"{re.escape(brand)}(?={ids}(?![0-9a-z]))", f"{brand} ")
        x = F.regexp_replace(x, f"(?<![a-z0-9_]){ids}(?=[a-z]{{1,2}}(?![a-z0-9_]))", f"{rule.board} ")
    return x


def mentioned_boards(x: Column, rules: Sequence[BoardRule] = TEST_BOARDS) -> Column:
    """The boards a text names, in the order of the rules; an empty array for null."""
    raw, loose = F.lower(F.coalesce(x, F.lit(""))), board_text(F.coalesce(x, F.lit("")), rules)
    return F.array_compact(F.array(*(F.when(raw.rlike(r.pattern()) | loose.rlike(r.pattern()), r.board) for r in rules)))


def sole_board(x: Column, rules: Sequence[BoardRule] = TEST_BOARDS) -> Column:
    boards = mentioned_boards(x, rules)
    return F.when(F.size(boards) == 1, F.element_at(boards, 1))


def hit_board(x: Column, rules: Sequence[BoardRule] = TEST_BOARDS) -> Column:
    """The board, 'multiple' or null."""
    boards = mentioned_boards(x, rules)
    return F.when(F.size(boards) == 1, F.element_at(boards, 1)).when(F.size(boards) > 1, "multiple")


def url_of_board(url: Column, board: str) -> Column:
    """Whether a url has the board as a part of its own, its signs as they are or taken as spaces."""
    low = F.lower(url)
    both = F.concat(low, F.lit("\n"), F.regexp_replace(low, "[_./#+-]+", " "))
    ids = re.escape(board)
    return both.rlike(f"(?<![a-z0-9_]){ids}(?![a-z0-9_])|/{ids}[_/-]|/{ids}$")


def board_scale(doc_boards: Column, query_boards: Column, option_only: Column) -> Column:
    """A document of other boards than the query's counts a little less."""
    other = (F.size(doc_boards) > 0) & (F.size(query_boards) > 0) & ~F.arrays_overlap(doc_boards, query_boards)
    return F.when(other, F.when(option_only, 0.92).otherwise(0.85)).otherwise(1.0)
