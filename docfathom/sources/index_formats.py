"""Search indexes of documentation sites, in three formats, as rows of the index."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfathom.functions.text import excerpt, title_or_fallback

SHARDS = "array<struct<documents:array<struct<i:int,t:string,u:string,b:array<string>,h:string,s:string,p:int>>>>"
PAGES = "array<struct<title:string,content:string,routePath:string,lang:string,toc:array<struct<text:string,id:string>>>>"
#: Places kept free for the contents of a page.
PER_PAGE = 1_000_000_000
ROW = ("manual_id", "doc_ord", "title", "url", "snippet", "text", "answer", "breadcrumbs", "kind")


def _filled(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def absolute(origin: str, ref: Column) -> Column:
    return F.when(ref.rlike("^https?://"), ref).otherwise(F.concat(F.lit(origin.rstrip("/") + "/"), F.regexp_replace(ref, "^/+", "")))


def read_shards(raw: DataFrame, origin: str, column: str = "body") -> DataFrame:
    """Rows from sharded indexes (manual_id, body): shard 0 holds pages, rows with a hash are headings, others snippets.

    Headings of the same page and hash become one: the longest section, the later in a tie, gives the title; distinct
    texts that are not part of what came before make the answer. Snippets also make up the text of their page, and a
    heading without any text shows its page's title or its breadcrumbs. A body that is no such index has no rows.
    """
    shards = raw.select("manual_id", F.posexplode(F.from_json(column, SHARDS)).alias("shard", "x"))
    rows = shards.select("manual_id", "shard", F.posexplode("x.documents").alias("pos", "r")).select("manual_id", "shard", "pos", "r.*").where("length(u) > 0")
    rows = rows.withColumn("ord", F.col("shard").cast("long") * 1_000_000_000 + F.col("pos"))
    hashed, page = F.coalesce("h", F.lit("")), F.regexp_replace("u", "#.*$", "")
    rows = rows.withColumns({"url": absolute(origin, F.concat(page, F.when(F.length(hashed) > 0, F.concat(F.lit("#"), F.regexp_replace(hashed, "^#", ""))).otherwise(""))), "page": absolute(origin, page), "b": F.coalesce("b", F.array().cast("array<string>"))})
    kind = F.when((F.col("shard") == 0) & (F.length(hashed) == 0), "page").when(F.length(hashed) > 0, "heading").otherwise("snippet")
    rows = rows.withColumn("kind", kind)
    order = F.array_sort(F.collect_list(F.struct("ord", "s", "t", "b")))
    heads = rows.where("kind = 'heading'").groupBy("manual_id", "page", "url").agg(F.min("ord").alias("ord"), order.alias("xs"))
    best = F.aggregate("xs", F.struct(F.lit("").alias("title"), F.array().cast("array<string>").alias("b")), lambda a, x: F.when((F.length(F.coalesce(x["s"], F.lit(""))) > 0) & (F.length(x["s"]) >= F.length(a["title"])), F.struct(x["s"].alias("title"), F.when(F.size(a["b"]) > 0, a["b"]).otherwise(x["b"]).alias("b"))).otherwise(a))
    answer = F.aggregate("xs", F.lit(""), lambda a, x: F.when((F.length(F.coalesce(x["s"], F.lit(""))) == 0) | (F.length(F.coalesce(x["t"], F.lit(""))) == 0) | (x["s"] == x["t"]) | F.contains(a, x["t"]), a).when(a == "", x["t"]).otherwise(F.concat(a, F.lit("\n"), x["t"])))
    heads = heads.withColumn("best", best).select("manual_id", "page", "url", "ord", title_or_fallback(F.col("best.title"), F.get("xs", 0)["t"], F.col("best.b"), F.col("url")).alias("title"), _filled(answer).alias("answer"), F.when(F.size("best.b") > 0, F.col("best.b")).otherwise(F.get("xs", 0)["b"]).alias("breadcrumbs"))
    snippets = rows.where("kind = 'snippet'")
    texts = snippets.groupBy("manual_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "t"))), lambda x: x["t"]), "\n").alias("text"))
    pages = rows.where("kind = 'page'").withColumn("nth", F.row_number().over(Window.partitionBy("manual_id", "page").orderBy(F.desc("ord")))).where("nth = 1")
    pages = pages.join(texts, ["manual_id", "page"], "left").select("manual_id", "page", "url", "ord", title_or_fallback(F.col("s"), F.col("t"), F.col("b"), F.col("url")).alias("title"), "text", F.col("b").alias("breadcrumbs"))
    named = pages.select("manual_id", "page", F.col("title").alias("page_title"))
    shown = F.when(F.col("answer").isNull(), F.coalesce(_filled(F.col("page_title")), _filled(F.array_join("breadcrumbs", " / "))))
    heads = heads.join(named, ["manual_id", "page"], "left").withColumn("snippet", shown)
    none = F.lit(None).cast("string")
    parts = (
        pages.select("manual_id", F.col("ord").alias("doc_ord"), "title", "url", none.alias("snippet"), "text", none.alias("answer"), "breadcrumbs", F.lit("page").alias("kind")),
        heads.select("manual_id", F.col("ord").alias("doc_ord"), "title", "url", "snippet", none.alias("text"), "answer", "breadcrumbs", F.lit("heading").alias("kind")),
        snippets.select("manual_id", F.col("ord").alias("doc_ord"), title_or_fallback(F.col("s"), none, F.col("b"), F.col("url")).alias("title"), "url", F.col("t").alias("snippet"), none.alias("text"), none.alias("answer"), F.col("b").alias("breadcrumbs"), F.lit("snippet").alias("kind")),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def read_page_index(raw: DataFrame, origin: str, column: str = "body") -> DataFrame:
    """Rows from page indexes (manual_id, body): a page with its text and an excerpt, and a heading for each entry of its contents."""
    rows = raw.select("manual_id", F.posexplode(F.from_json(column, PAGES)).alias("pos", "x")).select("manual_id", "pos", "x.*").where("length(routePath) > 0")
    url = absolute(origin, F.col("routePath"))
    none, crumbs = F.lit(None).cast("string"), F.array().cast("array<string>")
    pages = rows.select("manual_id", (F.col("pos").cast("long") * PER_PAGE).alias("doc_ord"), "title", url.alias("url"), excerpt(F.col("content")).alias("snippet"), F.col("content").alias("text"), none.alias("answer"), crumbs.alias("breadcrumbs"), F.lit("page").alias("kind"))
    toc = rows.select("manual_id", "pos", "title", url.alias("url"), F.posexplode("toc").alias("n", "h"))
    heads = toc.select("manual_id", (F.col("pos").cast("long") * PER_PAGE + F.col("n") + 1).alias("doc_ord"), F.col("h.text").alias("title"), F.concat("url", F.lit("#"), "h.id").alias("url"), F.col("title").alias("snippet"), none.alias("text"), none.alias("answer"), F.array("title").alias("breadcrumbs"), F.lit("heading").alias("kind"))
    return pages.unionByName(heads)


def index_groups(bundle: Column) -> Column:
    """The version###language names and hashes of an index bundle, as structs."""
    pairs = F.regexp_extract_all(bundle, F.lit('"([^"#]*###[^"]*)"\\s*:\\s*"([0-9a-z]+)"'), F.lit(0))
    part = lambda x, k: F.regexp_extract(x, '"([^"#]*)###([^"]*)"\\s*:\\s*"([0-9a-z]+)"', k)
    return F.transform(pairs, lambda x: F.struct(part(x, 1).alias("version"), part(x, 2).alias("lang"), part(x, 3).alias("hash")))


def newest_versions(rows: DataFrame) -> DataFrame:
    """Rows of the newest version where all versions are numbers with dots, else all rows."""
    number = F.when(F.col("version").rlike("^v?\\d+(\\.\\d+)*$"), F.transform(F.split(F.regexp_replace("version", "^v", ""), "\\."), lambda x: x.cast("int")))
    own = rows.withColumn("number", number)
    sums = own.agg(F.max("number").alias("newest"), F.count_if(F.col("number").isNull()).alias("others")).first()
    if sums is None or sums.others or sums.newest is None:
        return rows
    return own.where(F.col("number") == F.array(*map(F.lit, sums.newest))).drop("number")


#: Bounds of the terms taken from a term index.
TERM_LEAST, TERM_MOST, TERM_LONG, TERMS_PER_DOC = 4, 64, 10, 80


def _balanced(text: str, at: int) -> str:
    """The bracketed value that begins at ``at``, strings read over."""
    depth, i, quote = 0, at, ""
    while i < len(text):
        ch = text[i]
        if quote:
            i += ch == "\\"
            quote = "" if ch == quote else quote
        elif ch in "\"'":
            quote = ch
        elif ch in "[{":
            depth += 1
        elif ch in "]}":
            depth -= 1
            if not depth:
                return text[at : i + 1]
        i += 1
    return ""


def _value(text: str, name: str):
    m = re.search(rf"[{{,]\s*[\"']?{name}[\"']?\s*:\s*(?=[\[{{])", text)
    if not m:
        return None
    raw = _balanced(text, m.end())
    parts = re.split(r"(\"(?:[^\"\\]|\\.)*\")", raw)
    quoted = "".join(x if k % 2 else re.sub(r"([{,]\s*)([A-Za-z_$][\w$]*|\d+)(\s*:)", r'\1"\2"\3', x) for k, x in enumerate(parts))
    try:
        return json.loads(quoted)
    except ValueError:
        return None


def useful_terms(terms: dict, n_docs: int) -> list[list[str]]:
    """Identifier-like terms of each document, those with an underscore first, at most 80."""
    out: list[list[str]] = [[] for _ in range(n_docs)]
    kept = [x for x in terms if TERM_LEAST <= len(x) <= TERM_MOST and re.search("[A-Za-z]", x) and (re.search(r"[\d_]", x) or len(x) >= TERM_LONG)]
    for x in sorted(kept, key=lambda x: "_" not in x):
        where = terms[x] if isinstance(terms[x], list) else [terms[x]]
        for k in where:
            if isinstance(k, int) and 0 <= k < n_docs and len(out[k]) < TERMS_PER_DOC:
                out[k].append(x)
    return out


def _term_rows(batches: Iterator[pa.RecordBatch], base: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for manual_id, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            names = _value(source or "", "docnames") or []
            titles = _value(source or "", "titles") or {}
            terms = _value(source or "", "terms") or {}
            words = useful_terms(terms, len(names))
            for k, name in enumerate(names):
                title = titles[k] if isinstance(titles, list) and k < len(titles) else titles.get(name) if isinstance(titles, dict) else None
                page = "" if name == "index" else re.sub(r"(^|/)index$", r"\1", name)
                url = base.rstrip("/") + "/" + (page if not page or page.endswith("/") else page + ".html")
                rows.append((manual_id, k, title or name.rsplit("/", 1)[-1], url, " ".join(words[k]) or None))
        columns = list(zip(*rows)) if rows else [()] * 5
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["manual_id", "doc_ord", "title", "url", "text"])


def read_term_index(raw: DataFrame, base: str, column: str = "body") -> DataFrame:
    """Rows from term indexes (manual_id, body), scripts that set an object with docnames, titles and terms.

    Keys may be unquoted, titles a list or an object, a term's places a number or a list. Text holds identifier-like terms.
    """
    rows = raw.select(F.col("manual_id").cast("string"), F.col(column).cast("string")).mapInArrow(lambda it: _term_rows(it, base), "manual_id string, doc_ord long, title string, url string, text string")
    none = F.lit(None).cast("string")
    return rows.select("manual_id", "doc_ord", "title", "url", none.alias("snippet"), "text", none.alias("answer"), F.array().cast("array<string>").alias("breadcrumbs"), F.lit("page").alias("kind"))
