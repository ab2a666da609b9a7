"""Text expressions: cleaning, excerpts, windows with a content hash, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks of all scripts, as in the trimming of the sources' own tools.
BLANK = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, f"^{BLANK}+|{BLANK}+$", "")


def cleaned(x: Column) -> Column:
    """Without NUL and zero-width spaces, blanks at line ends and more than two line feeds in a row."""
    x = F.regexp_replace(x, "[\\x00\\u200b]", "")
    return trimmed(F.regexp_replace(F.regexp_replace(x, "[ \\t]+\\n", "\n"), "\\n{3,}", "\n\n"))


def excerpt(markdown: Column, most: int = 280) -> Column:
    """One line of at most ``most`` characters without heading marks; an ellipsis where it is cut."""
    line = trimmed(F.regexp_replace(F.regexp_replace(markdown, "(?m)^#{1,6}\\s+", ""), "\\s+", " "))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


def title_or_fallback(section: Column, title: Column, breadcrumbs: Column, url: Column) -> Column:
    """The first that is not blank: section, title, last breadcrumb, last part of the url, url."""
    from .urls import last_segment

    filled = lambda x: F.nullif(trimmed(x), F.lit(""))
    last = F.when(F.size(breadcrumbs) > 0, F.element_at(breadcrumbs, -1))
    return F.coalesce(filled(section), filled(title), filled(last), filled(last_segment(url)), url)


def hit_snippet(snippet: Column, answer: Column, text: Column, breadcrumbs: Column, url: Column, most: int = 240) -> Column:
    """What a hit shows: snippet, answer, text or breadcrumbs, the first that is not empty, else the url's last part."""
    from .urls import last_segment

    filled = lambda x: F.nullif(x, F.lit(""))
    crumbs = F.array_join(breadcrumbs, " / ")
    shown = F.coalesce(filled(snippet), filled(F.substring(answer, 1, 180)), filled(F.substring(text, 1, 180)), filled(crumbs), last_segment(url))
    return F.substring(shown, 1, most)


def content_hash(x: Column) -> Column:
    return F.sha2(x, 256)


def window(x: Column, offset: Column, most: Column) -> Column:
    """(chunk, offset, next_offset, total_chars, content_hash, truncated) of a text from ``offset`` on, in characters.

    An offset beyond the text gives an empty chunk without a next one.
    """
    total = F.length(x)
    end = F.least(total, offset + most)
    return F.struct(
        F.when(offset < total, x.substr(offset + 1, most)).otherwise("").alias("chunk"), offset.alias("offset"), F.when(end < total, end).alias("next_offset"),
        total.alias("total_chars"), content_hash(x).alias("content_hash"), (end < total).alias("truncated"),
    )


def shell_quoted(x: Column) -> Column:
    return F.concat(F.lit("'"), F.regexp_replace(x, "'", "'\"'\"'"), F.lit("'"))


def has_prose(markdown: Column, least: int = 1) -> Column:
    """Whether anything is left without headings, links and images."""
    rest = F.regexp_replace(F.regexp_replace(markdown, "(?m)^#{1,6}\\s.*$", ""), "!?\\[[^\\]]*\\]\\([^)]*\\)", "")
    return F.length(trimmed(F.regexp_replace(rest, "[\\s\\p{P}]+", " "))) >= least
