"""Search over catalogue records (name, path, pack, description): tokens, statements that deny, scores, filters and order."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfathom.functions import wordlists as W

#: What begins a sentence that says what a record is not for, and where sentences part.
NEGATION = "(?i)拒绝|不处理|不支持|不接受|不使用|不执行|不把|不要|不用于|不是用于|排除|不自动|(?<![a-z0-9_])not(?![a-z0-9_])|do not|don't"
SENTENCES = "[。；;！？!?\\n]|(?<=\\.)\\s+"
#: Points of a task token and of a model token by field, the share of tokens met, and all model tokens met.
TASK_POINTS = {"name": 12, "path": 7, "pack": 3, "description": 2}
MODEL_POINTS = {"name": 4, "path": 3, "description": 1}
COVERED, ALIGNED, EXACT = 10, 3, 1000
#: Stems that variants of a word are brought to, by their beginning.
STEMS = {"quant": "quant", "deploy": "deploy", "diagno": "diagnostic", "train": "training", "calibrat": "calibration"}
#: Stop words and stop characters of CJK runs in questions about records.
CJK_STOP = (*W.LEXICAL_CJK_STOP_WORDS, "找一下", "找个")
CJK_STOP_CHARS = "的了吗呢啊吧把是有个和或在给去到用要"
_WORDS = re.compile(r"[a-z][a-z0-9_.-]*|\d+[a-z][a-z0-9_.-]*|\d+")
_GLUED = re.compile(r"(\d+)[\s-]+([a-z][a-z0-9_.-]*)")
#: What begins a denial in a question, what ends it, and what is none.
DENIAL = re.compile(r"(?i)\b(?:not|no|without|avoid|exclude|excluding|don't|do not)\b|不要|不用|不做|不需要|不想|不是|无需|排除|拒绝|避免|没有|别")
CONTRAST, NO_DENIAL, SPAN = re.compile(r"(?i)\bbut\b|\binstead\b|而是|但是|改用|而"), re.compile("有没有"), 24


def stemmed(token: str) -> str:
    return next((to for start, to in STEMS.items() if token.startswith(start)), token)


def record_tokens(query: str, synonyms: Mapping[str, Sequence[str]] | None = None) -> list[str]:
    """Tokens of a question about records in order: words by their stem, glued numbers, CJK bigrams, synonyms; plain numbers are none."""
    low = query.strip().lower()
    found = [*_WORDS.findall(low), *("".join(m.groups()) for m in _GLUED.finditer(low))]
    stop = re.compile("|".join(map(re.escape, sorted(CJK_STOP, key=len, reverse=True))) + "|[" + CJK_STOP_CHARS + "]")
    for run in re.findall("[一-鿿]+", low):
        found += [x[i : i + 2] for x in stop.split(run) for i in range(len(x) - 1)]
    kept = list(dict.fromkeys(map(stemmed, found)))
    kept += [stemmed(y) for x in kept for y in (synonyms or {}).get(x, ())]
    return [x for x in dict.fromkeys(kept) if not x.isdigit()]


def denied_spans(query: str) -> list[tuple[int, int]]:
    """Stretches of a question that are denied: from a denying word on, one word or CJK run, at most SPAN characters, up to a contrast."""
    out = []
    exempt = [m.span() for m in NO_DENIAL.finditer(query)]
    for m in DENIAL.finditer(query):
        if any(a <= m.start() < b for a, b in exempt):
            continue
        rest = query[m.end() : m.end() + SPAN]
        if cut := CONTRAST.search(rest):
            rest = rest[: cut.start()]
        if word := re.match(r"\s*(?:[A-Za-z0-9_.-]+|[一-鿿]+)", rest):
            out.append((m.end(), m.end() + word.end()))
    return out


def is_denied(query: str, token: str) -> bool:
    """Whether a token stands in the question, and in denied stretches only."""
    spans = denied_spans(query.lower())
    places = [m.start() for m in re.finditer(re.escape(token), query.lower())]
    return bool(places) and all(any(a <= p and p + len(token) <= b for a, b in spans) for p in places)


def positive_text(description: Column) -> Column:
    """The sentences of a description that do not say what it is not for, a line each; empty for null."""
    parts = F.transform(F.split(F.coalesce(description, F.lit("")), SENTENCES, -1), lambda x: F.trim(x))
    return F.array_join(F.filter(parts, lambda x: (F.length(x) > 0) & ~x.rlike(NEGATION)), "\n")


def record_scores(records: DataFrame, questions: Sequence[tuple[int, str]], models: Sequence[str] = (), synonyms: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(query_id, name, score, matched): records against the tokens of each question, those with none of its task tokens left out.

    records: (name, path, pack, description); questions: (query_id, query) of one batch; ``models`` are tokens that only
    name a model. A token in a name, path, pack and description counts for each, in a description only outside sentences that
    deny. The share of task tokens met adds up to COVERED, all model tokens met ALIGNED, the name itself as question EXACT.
    The batch's tokens go through each record in one scan; records and questions then meet on those that stand in it.
    """
    from docfathom.operators.ranking import matcher_pattern

    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    own = records.select("name", low("name").alias("f_name"), low("path").alias("f_path"), low("pack").alias("f_pack"), F.lower(positive_text(F.col("description"))).alias("f_description"))
    asked_for = [(k, q, t, t in models) for k, q in questions for t in record_tokens(q, synonyms) if not is_denied(q, t)]
    tokens = records.sparkSession.createDataFrame(asked_for, "query_id long, query string, token string, model boolean")
    words = F.array(*map(F.lit, sorted({t for _, _, t, _ in asked_for}))).cast("array<string>")
    fields = {f: F.contains(F.col(f"f_{f}"), F.col("token")) & F.regexp_like(F.col(f"f_{f}"), F.col("pattern")) for f in TASK_POINTS}
    whole = F.concat_ws("\n", "f_name", "f_path", "f_pack", "f_description")
    there = own.withColumn("token", F.explode(F.filter(words, lambda t: F.contains(whole, t)))).withColumn("pattern", matcher_pattern(F.col("token")))
    found = there.select("name", "f_name", "token", *(x.alias(f"in_{f}") for f, x in fields.items())).where(" or ".join(f"in_{f}" for f in fields))
    rows = tokens.join(found, "token")
    points = lambda table: sum((F.when(F.col(f"in_{f}"), n).otherwise(0) for f, n in table.items()), F.lit(0))
    met_model = F.col("model") & (F.col("in_name") | F.col("in_path") | F.col("in_description"))
    asked = tokens.groupBy("query_id").agg(F.count_if(~F.col("model")).alias("n_task"), F.count_if("model").alias("n_model"), F.first("query").alias("asked"))
    sums = rows.groupBy("query_id", "name").agg(F.sum(F.when(F.col("model"), points(MODEL_POINTS)).otherwise(points(TASK_POINTS))).alias("points"), F.count_if(~F.col("model")).alias("task"), F.count_if(met_model).alias("models"), F.first("f_name").alias("f_name"))
    rows = sums.join(asked, "query_id").where("(n_task > 0 and task > 0) or (n_task = 0 and models > 0)")
    cover = F.when(F.col("n_task") > 0, F.floor(COVERED * F.col("task") / F.col("n_task") + 0.5)).otherwise(0)
    aligned = F.when((F.col("n_model") > 0) & (F.col("models") == F.col("n_model")), ALIGNED).otherwise(0)
    exact = F.when(F.lower(F.trim("asked")) == F.col("f_name"), EXACT).otherwise(0)
    return rows.select("query_id", "name", (F.col("points") + cover + aligned + exact).cast("long").alias("score"), (F.col("task") + F.col("models")).alias("matched"))


def best_records(scores: DataFrame, limit: int = 5) -> DataFrame:
    """The ``limit`` best records of each question with their place: by score, then by name."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "name"))
    return scores.where("score > 0").withColumn("place", place).where(F.col("place") <= limit)


def eligible(task: str, platform: Column | None = None, excluded: Sequence[str] = (), every: Sequence[str] = (), role: str | None = None, pack: str | None = None) -> Column:
    """Whether a record (tasks, platforms, role, pack) may be shown: the task is its own, its platforms meet those allowed or are unknown.

    Allowed are ``platform``, or ``every`` platform, without those excluded; with none left nothing is eligible.
    """
    allowed = F.array_except(F.array(platform) if platform is not None else F.array(*map(F.lit, every)).cast("array<string>"), F.array(*map(F.lit, excluded)).cast("array<string>"))
    fits = F.coalesce(F.array_contains("tasks", task), F.lit(False)) & (F.size(allowed) > 0) & (F.col("platforms").isNull() | F.coalesce(F.arrays_overlap("platforms", allowed), F.lit(False)))
    if role is not None:
        fits &= F.col("role").eqNullSafe(role)
    if pack is not None:
        fits &= F.lower(F.coalesce("pack", F.lit(""))) == pack.strip().lower()
    return fits


def structured_score(query: str, tokens: Sequence[str]) -> Column:
    """100 for the name itself, 3 for an entry and 2 for a workflow, 2 for each token in name or description up to eight, 4 for each in the name."""
    name, whole = F.lower("name"), F.lower(F.concat_ws(" ", "name", "description"))
    own = F.array(*map(F.lit, tokens)).cast("array<string>")
    hits, in_name = F.size(F.filter(own, lambda t: F.contains(whole, t))), F.size(F.filter(own, lambda t: F.contains(name, t)))
    return F.when(name == query.strip().lower(), 100).otherwise(0) + F.when(F.col("role") == "entry", 3).when(F.col("role") == "workflow", 2).otherwise(0) + 2 * F.least(hits, F.lit(8)) + 4 * in_name


def put_behind(scores: DataFrame, behind: Column) -> DataFrame:
    """Scores with those that ``behind`` marks lowered so far that all others of their question come first, in an unchanged order.

    Nothing changes for a question of which all records or none are marked.
    """
    by_query = Window.partitionBy("query_id")
    worst = F.min(F.when(~behind, F.col("score"))).over(by_query)
    best = F.max(F.when(behind, F.col("score"))).over(by_query)
    lower = F.coalesce(F.greatest(F.lit(0), best - worst + 1), F.lit(0))
    return scores.withColumn("lower", lower).withColumn("score", F.when(behind, F.col("score") - F.col("lower")).otherwise(F.col("score"))).drop("lower")


def overlay_issues(records: DataFrame, overlay: DataFrame) -> DataFrame:
    """(name, issue) of reviewed entries (name, fingerprint, source): repeated, of no record, of another path, or of a record changed since.

    records: (name, catalog_path, own_print).
    """
    again = overlay.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name", F.lit("duplicate").alias("issue"))
    both = overlay.join(records.select("name", "catalog_path", "own_print", F.lit(True).alias("known")), "name", "left")
    issue = F.when(F.col("known").isNull(), "missing record").when(~F.coalesce(F.endswith("source", F.concat("catalog_path", F.lit("/SKILL.md"))), F.lit(False)), "source mismatch").when(~F.col("fingerprint").eqNullSafe(F.col("own_print")), "stale fingerprint")
    return again.unionByName(both.select("name", issue.alias("issue")).where("issue is not null"))


def schema_verdict(version: Column, known: int = 1) -> Column:
    """Whether a catalogue of a schema version can be read: null is none at all, another number is one not known here."""
    return F.when(version.isNull(), "invalid_catalog").when(version != known, "unsupported_schema").otherwise("ok")


def families_of(pack: Column, names: Mapping[str, Sequence[str]], suffixes: Mapping[str, Sequence[str]]) -> Column:
    """The board families of a pack: those of its name, else of the first suffix that fits, else null."""
    as_array = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    out = F.lit(None).cast("array<string>")
    for end, boards in reversed(list(suffixes.items())):
        out = F.when(F.endswith(F.lower(pack), F.lit(end)), as_array(boards)).otherwise(out)
    for name, boards in reversed(list(names.items())):
        out = F.when(F.lower(pack) == name, as_array(boards)).otherwise(out)
    return out
