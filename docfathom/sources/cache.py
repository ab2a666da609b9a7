"""Freshness of fetched pages: the time to live by kind of url, and a strict check of stored envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds until a fetched page expires.
INDEX_TTL, LATEST_TTL, FORUM_TTL, PAGE_TTL = 15 * 60, 15 * 60, 60 * 60, 24 * 60 * 60
ENVELOPE_VERSION = 2


def ttl_of(url: Column, forum_host: str) -> Column:
    index = url.rlike("(?i)(search-index|searchindex|search_index)[^/]*\\.(json|js)(\\?|$)")
    forum = F.contains(F.lower(url), F.lit(forum_host.lower()))
    return F.when(index, INDEX_TTL).when(forum & url.rlike("/(search|latest)(\\.json|\\?|/|$)"), LATEST_TTL).when(forum, FORUM_TTL).otherwise(PAGE_TTL)


def is_fresh(fetched_at: Column, ttl_seconds: Column, now: Column) -> Column:
    """Whether a page fetched then is still fresh; a time to live of 0 is always over."""
    return (ttl_seconds > 0) & (F.unix_micros(fetched_at) + ttl_seconds * F.lit(1_000_000) > F.unix_micros(now))


def valid_envelopes(rows: DataFrame) -> DataFrame:
    """Stored envelopes (version, url, fetched_at, body) of the current version with a url, a body and a time not in the future."""
    return rows.where((F.col("version") == ENVELOPE_VERSION) & (F.length("url") > 0) & F.col("body").isNotNull() & (F.col("fetched_at") <= F.current_timestamp()))
