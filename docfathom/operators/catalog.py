"""Integrity of catalogues: shapes of records, unique keys, references, reviewed metadata and their health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shapes of names, references and relative paths.
NAME, REF = "^[A-Za-z0-9_][A-Za-z0-9._-]*$", "^[A-Za-z0-9][A-Za-z0-9._/-]*$"


def safe_path(x: Column, prefix: str = "") -> Column:
    """A relative path without blanks, escapes, control characters, empty parts or steps upwards; false for null."""
    plain = x.rlike("^[^\\s%\\\\\\x00-\\x1f\\x7f]+$") & ~x.rlike("(^|/)(\\.{0,2})(/|$)")
    return F.coalesce(plain & F.startswith(x, F.lit(prefix)) & (F.length(x) > len(prefix)), F.lit(False))


def record_issues(records: DataFrame) -> DataFrame:
    """(name, issue) of records (name, description, pack, repo, catalog_path, install_type) whose fields are not as they must be."""
    checks = {
        "name": F.col("name").rlike(NAME), "description": F.length("description") > 0, "pack": F.length("pack") > 0, "repo": F.col("repo").rlike("^[A-Za-z0-9._-]+/[A-Za-z0-9][A-Za-z0-9._-]*$"),
        "catalog_path": safe_path(F.col("catalog_path"), "skills/"), "install_type": F.col("install_type").isin("flat", "workspace"),
    }
    issues = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), field) for field, ok in checks.items())))
    return records.select("name", F.explode(issues).alias("issue"))


def duplicates(rows: DataFrame, key: str, kind: str) -> DataFrame:
    return rows.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(kind).alias("issue"), "key", "n")


def missing_references(rows: DataFrame, key: str, known: DataFrame, known_key: str, kind: str) -> DataFrame:
    """Values of ``key`` that the known rows lack, with their number; nulls refer to nothing. Counted before the join."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n"))
    return counts.join(known.select(F.col(known_key).cast("string").alias("key")), "key", "left_anti").select(F.lit(kind).alias("issue"), "key", "n")


def integrity(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def fingerprint(*fields: str) -> Column:
    """A hash of the fields in order of their names, so that the order of columns does not matter."""
    return F.sha2(F.to_json(F.struct(*(F.col(x) for x in sorted(fields))), {"ignoreNullFields": "false"}), 256)


def resolved_metadata(records: DataFrame, overlay: DataFrame, *fields: str) -> DataFrame:
    """Records with status and origin of their classification: their own, else a reviewed one of the same name.

    status: 'classified', 'missing' without either, 'stale' if the record has changed since its review, 'invalid' if
    the review is of another path. overlay: (name, fingerprint, source, tasks).
    """
    own = records.withColumn("own_print", fingerprint(*fields))
    reviewed = overlay.select("name", F.col("fingerprint").alias("seen_print"), F.col("source").alias("seen_source"), F.col("tasks").alias("seen_tasks"), F.lit(True).alias("reviewed"))
    rows = own.join(reviewed, "name", "left")
    declared = F.size(F.coalesce("tasks", F.array().cast("array<string>"))) > 0
    status = F.when(declared, "classified").when(F.col("reviewed").isNull(), "missing").when(F.col("seen_print") != F.col("own_print"), "stale").when(~F.endswith("seen_source", F.concat("catalog_path", F.lit("/SKILL.md"))), "invalid").otherwise("classified")
    origin = F.when(declared, "catalog").when(F.col("reviewed").isNotNull(), "reviewed")
    kept = F.when(declared, F.col("tasks")).when(status == "classified", F.col("seen_tasks"))
    return rows.select(*records.drop("tasks").columns, status.alias("status"), origin.alias("origin"), kept.alias("tasks"))


def metadata_health(resolved: DataFrame) -> DataFrame:
    """One row: how many records there are, and of each status."""
    return resolved.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("classified", "missing", "stale", "invalid")))


def display_name(x: Column) -> Column:
    """``__SKILL_<a>-__<b>`` is shown as ``<a>-<b>``."""
    return F.regexp_replace(x, "^__SKILL_(.+?)-__(.+)$", "$1-$2")


def text_score(name: Column, description: Column, tokens: Column) -> Column:
    """4 for each query token in the name and 2 for each of at most eight in name or description."""
    low, whole = F.lower(name), F.lower(F.concat_ws(" ", name, description))
    hits = F.size(F.filter(tokens, lambda t: F.contains(whole, t)))
    return 2 * F.least(hits, F.lit(8)) + 4 * F.size(F.filter(tokens, lambda t: F.contains(low, t)))
