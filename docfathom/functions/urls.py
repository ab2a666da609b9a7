"""Url expressions: page of a chunk, canonical form, allow-list, path of a document."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def page_url(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def anchor(url: Column) -> Column:
    """The part after the first ``#``, or null."""
    return F.when(F.instr(url, "#") > 0, F.regexp_extract(url, "#(.*)$", 1))


def canonical(url: Column, moved: Mapping[str, str] | None = None) -> Column:
    """The url with retired prefixes replaced; the first prefix that fits counts."""
    out = url
    for old, new in reversed(list((moved or {}).items())):
        out = F.when(F.startswith(url, F.lit(old)), F.concat(F.lit(new), F.substring(url, len(old) + 1, 1 << 20))).otherwise(out)
    return out


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1))


def allowed(url: Column, hosts: Sequence[str]) -> Column:
    """Web urls of the given hosts; null urls are not allowed."""
    return F.coalesce(url.rlike("^(?i)https?://") & host(url).isin(*hosts), F.lit(False))


def included(url: Column, pattern: str | None) -> Column:
    """Whether a url belongs to a manual that shares its index with others; all do where it has no pattern."""
    return F.lit(True) if pattern is None else F.coalesce(url.rlike(pattern), F.lit(False))


def resolved(ref: Column, origin: str) -> Column:
    """A relative reference on the origin; absolute ones stay."""
    return F.when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), ref).otherwise(F.concat(F.lit(origin.rstrip("/") + "/"), F.regexp_replace(ref, "^/+", "")))


def document_path(url: Column) -> Column:
    """The path without origin, ``/index.html``, ``.html`` and a slash at the end."""
    path = F.regexp_replace(page_url(url), "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    for pattern in ("[?].*$", "/index\\.html$", "\\.html$", "/+$"):
        path = F.regexp_replace(path, pattern, "")
    return path


def slash_variant(url: Column) -> Column:
    """The same page with or without a slash at the end."""
    return F.when(F.endswith(url, F.lit("/")), F.regexp_replace(url, "/+$", "")).otherwise(F.concat(url, F.lit("/")))


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(document_path(url), "/+$", ""), "/", -1), -1)
