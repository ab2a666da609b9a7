"""The engine: an index of documents, batches of queries against it, pages, contents and forum lists."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Mapping, Sequence
from copy import deepcopy
from itertools import chain
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from docfathom.functions import text as T
from docfathom.functions import urls
from docfathom.functions import wordlists as W
from docfathom.functions.boards import TEST_BOARDS, BoardRule, board_scale, mentioned_boards
from docfathom.operators import hits, index, ranking, results, sections
from docfathom.plans import planner
from docfathom.session import ensure_checkpoint_dir, written

DEFAULT_LIMIT, MOST_LIMIT, LONGEST_QUERY = 8, 20, 500


def _part(r: Row) -> str:
    """What a row adds to the text of its page."""
    body = "\n\n".join(x for x in (r.text, r.answer) if x) or r.snippet or ""
    return (f"## {r.title}\n\n{body}" if r.kind == "heading" and r.title else body).strip()


class Engine:
    """Search over documents (doc_id, manual_id, title, url, snippet, text, answer, breadcrumbs, kind).

    ``without`` names stages left out, of those of the planner and of: structure, breadth, landing, board, phrase,
    coverage, fusion, page.
    """

    def __init__(self, docs: DataFrame, manuals: DataFrame, boards: Sequence[BoardRule] = TEST_BOARDS, synonyms: Mapping[str, list[str]] = W.SYNONYMS, without: Iterable[str] = (), kept: index.Index | None = None) -> None:
        self.spark: SparkSession = docs.sparkSession
        self.docs, self.boards, self.synonyms, self.without = docs, tuple(boards), synonyms, frozenset(without)
        self.manual_rows = sorted(manuals.collect(), key=lambda r: r.manual_id)  # a fixed dimension: one row for each manual
        self.manual_table = manuals
        kept = kept or index.write_index(docs, f"{ensure_checkpoint_dir(self.spark)}/index-{uuid.uuid4().hex}")
        self.kept, self.post, self.lengths, self.sums, self.frequencies = kept, kept.post, kept.lengths, kept.sums, kept.frequencies
        self.n_docs = self.sums.agg(F.sum("n_docs")).first()[0] or 0

    # --- What there is ----------------------------------------------------------------------------------------------

    def status(self) -> dict[str, Any]:
        return {"documents": self.n_docs, "manuals": len(self.manual_rows), "searchable": sum(bool(r.searchable) for r in self.manual_rows), "boards": [b.board for b in self.boards], "without": sorted(self.without)}

    def manuals(self) -> DataFrame:
        return self.manual_table.select("manual_id", "title", "category", "description", "home_url", "aliases", "searchable")

    def resolve_manual(self, name: str | None) -> str | None:
        """The manual of an id or alias, whatever the case, the first one in order."""
        want = (name or "").strip().lower()
        return next((r.manual_id for r in self.manual_rows if want and (want == r.manual_id.lower() or want in {a.lower() for a in r.aliases or () if a})), None)

    def toc(self, manual: str, query: str | None = None) -> DataFrame:
        own = self.docs.where((F.col("manual_id") == self.resolve_manual(manual)) & (F.col("kind") == "page"))
        own = own.where(F.contains(F.lower("title"), F.lit(query.lower()))) if query else own
        return own.select(urls.page_url(F.col("url")).alias("url"), "title").distinct().orderBy("url")

    # --- Search -----------------------------------------------------------------------------------------------------

    def _frequencies_of(self, terms: Iterable[str]) -> dict[str, tuple[int, int]]:
        """Document frequencies, all and outside answers, of the terms of a batch of queries, by one join; terms nobody has are left out."""
        wanted = sorted(set(terms))
        if not wanted:
            return {}
        asked = self.spark.createDataFrame([(x,) for x in wanted], "term string")
        found = self.frequencies.join(asked, "term").groupBy("term").agg(F.sum("df").alias("df"), F.sum("df_outside_answers").alias("outside"))
        return {r.term: (r.df, r.outside) for r in found.collect()}

    def _longer_terms(self, terms: Iterable[str], most: int = 16) -> dict[str, list[str]]:
        """Terms of the corpus that begin with a given one followed by a number, by an equi join on four letters."""
        wanted = sorted({x for x in terms if 4 <= len(x) <= 8})
        if not wanted:
            return {}
        asked = self.spark.createDataFrame([(x, x[:4]) for x in wanted], "stem string, start string")
        vocabulary = self.frequencies.groupBy("term").agg(F.sum("df").alias("df")).withColumn("start", F.substring("term", 1, 4))
        rows = asked.join(vocabulary, "start").where("startswith(term, stem) and length(term) > length(stem)").where("substring(term, length(stem) + 1) rlike '^v?[0-9]'")
        nth = F.row_number().over(Window.partitionBy("stem").orderBy(F.desc("df"), "term"))
        out: dict[str, list[str]] = {}
        for r in rows.withColumn("nth", nth).where(F.col("nth") <= most).orderBy("stem", "nth").collect():
            out.setdefault(r.stem, []).append(r.term)
        return out

    def plan(self, queries: Sequence[Mapping[str, Any]]) -> list[planner.Plan]:
        return self._planned(queries)[0]

    def _planned(self, queries: Sequence[Mapping[str, Any]]) -> tuple[list[planner.Plan], list[bool]]:
        """The plans of a batch, and whether the corpus does not cover each query."""
        aliases = {a.lower(): r.manual_id for r in self.manual_rows for a in r.aliases or () if a}
        if long := [q["query_id"] for q in queries if len(str(q["query"])) > LONGEST_QUERY]:
            raise ValueError(f"queries of over {LONGEST_QUERY} characters: {long[:5]}")
        plans = [planner.analyse(str(q["query"]), self.synonyms, aliases, self.without) for q in queries]
        df: dict[str, int] = {}
        outside: dict[str, int] = {}

        def ask(terms: Iterable[str]) -> None:
            found = self._frequencies_of(set(terms) - df.keys())
            df.update({t: n for t, (n, _) in found.items()})
            outside.update({t: n for t, (_, n) in found.items()})

        ask(t for p in plans for t in [*p.terms, *(t for c in p.concepts for t in c.terms)])
        # What occurs in answers only is unseen to abstention, and gets its variants there.
        ask(t for p in plans for t in planner.candidates(p, outside))
        longer = self._longer_terms(x for p in plans for x in planner.unseen(p, outside))
        ask(x for xs in longer.values() for x in xs)
        ask(m for p in plans for x in planner.unseen(p, outside) for m in planner.named_by_edit(x, aliases))
        abstaining = deepcopy(plans)
        for p, q in zip(plans, abstaining):
            planner.adapt(p, df, self.n_docs, longer, self.synonyms, self.without, aliases)
            planner.adapt(q, outside, self.n_docs, longer, self.synonyms, self.without, aliases)
        return plans, [planner.abstains(q, outside, self.n_docs) for q in abstaining]

    def search(self, queries: Sequence[Mapping[str, Any]]) -> DataFrame:
        """Ranked pages of a batch of queries, each a mapping with query_id, query and, if wanted, manual, board and limit.

        (query_id, place, page, title, manual_id, score, n_chunks, snippet, board, confidence, coverage, quality).
        quality is 'weak' where the corpus does not cover the query. The whole batch is one job over the postings.
        """
        queries = [q for q in queries if q.get("query") and str(q["query"]).strip()]
        if not queries:
            return self.spark.createDataFrame([], "query_id long, place int, page string, title string, manual_id string, score double, n_chunks long, snippet string, board string, confidence double, coverage double, quality string")
        plans, uncovered = self._planned(queries)
        ids = [q["query_id"] for q in queries]
        frame = self.spark.createDataFrame
        allowed = []
        for q in queries:
            named = self.resolve_manual(q.get("manual"))
            allowed += [(q["query_id"], r.manual_id) for r in self.manual_rows if (r.manual_id == named if named else r.searchable) and not (q.get("board") and r.no_board)]
        allowed_df = frame(allowed or [(ids[0], None)], "query_id long, manual_id string")
        terms = frame([(i, t, float(w)) for i, p in zip(ids, plans) for t, w in p.terms.items()] or [(ids[0], "", 0.0)], "query_id long, term string, qtf double")
        concepts = frame([(i, k, c.min_hits, t, planner.looks_like_content(t)) for i, p in zip(ids, plans) for k, c in enumerate(p.concepts) for t in set(c.terms)] or [(ids[0], 0, 1, "", False)], "query_id long, concept_id int, min_hits int, term string, content boolean")
        weak = dict(zip(ids, uncovered))
        options = frame([(q["query_id"], q["query"], q.get("board"), int(min(MOST_LIMIT, max(1, q.get("limit") or DEFAULT_LIMIT))), p.needles, weak[q["query_id"]], len(p.concepts)) for q, p in zip(queries, plans)], "query_id long, query string, option string, most int, needles array<string>, weak boolean, n_concepts int")
        named = mentioned_boards(F.col("query"), self.boards)
        options = options.withColumn("query_boards", F.when(F.size(named) > 0, named).when(F.col("option").isNotNull(), F.array(F.lower("option"))).otherwise(F.array().cast("array<string>"))).withColumn("option_only", F.size(named) == 0)
        matchers = frame([(i, t) for i, p in zip(ids, plans) for t in p.matchers] or [(ids[0], "\x00")], "query_id long, token string")

        stats = allowed_df.join(self.sums, "manual_id").groupBy("query_id").agg(F.sum("n_docs").alias("n"), *(F.sum(f"sum_{x}").alias(f"all_{x}") for x in ("title", "url", "body")))
        df = terms.join(self.frequencies, "term").join(allowed_df, ["query_id", "manual_id"]).groupBy("query_id", "term", "qtf").agg(F.sum("df").alias("df"))
        wanted = df.join(stats, "query_id")
        rows = self.post.join(wanted, "term").join(allowed_df, ["query_id", "manual_id"])
        raw_idf = ranking.idf(F.col("n"), F.col("df"))
        fields = sum(w * ranking.saturated(F.col(f"tf_{x}"), F.col(f"len_{x}"), F.col(f"all_{x}") / F.col("n")) for x, w in (("title", W.TITLE_WEIGHT), ("url", W.URL_WEIGHT), ("body", W.BODY_WEIGHT)))
        scores = rows.select("query_id", "manual_id", "doc_id", (fields * ranking.damped(raw_idf) * F.col("qtf")).alias("score"))
        pool = written(ranking.candidate_pool(ranking.bm25(scores)))

        # The terms of concepts that the manuals of the query have, with their frequencies there.
        known = concepts.join(self.frequencies, "term").join(allowed_df, ["query_id", "manual_id"]).groupBy("query_id", "concept_id", "min_hits", "term", "content").agg(F.sum("df").alias("df")).join(stats.select("query_id", "n"), "query_id")
        known = written(known)
        distinctive = ranking.distinctive_concepts(known)
        available = distinctive.groupBy("query_id").agg(F.count("*").alias("available"))
        found = ranking.concept_hits(ranking.useful_terms(known).select("query_id", "concept_id", "min_hits", "term"), self.post.join(pool.select("doc_id").distinct(), "doc_id", "left_semi"))
        found = found.join(distinctive.withColumn("distinctive", F.lit(1)), ["query_id", "concept_id"], "left")
        cover = found.groupBy("query_id", "doc_id").agg(F.count("*").alias("hits"), F.count("distinctive").alias("sure_hits"))
        mass = wanted.groupBy("query_id").agg(F.sum(raw_idf * F.col("qtf")).alias("idf_mass"), (F.first("all_body") / F.first("n")).alias("mean_body"))
        full = pool.join(self.docs.drop("manual_id"), "doc_id").join(self.lengths.select("doc_id", "len_body"), "doc_id").join(options, "query_id").join(mass, "query_id").join(cover, ["query_id", "doc_id"], "left").join(available, "query_id", "left").fillna(0, ["hits", "sure_hits", "available"]).withColumn("coverage", F.when(F.col("n_concepts") > 0, F.col("hits") / F.col("n_concepts")).otherwise(0.0))
        on = lambda name, x: F.lit(1.0) if name in self.without else x
        doc_boards = mentioned_boards(F.concat_ws(" ", "title", urls.page_url(F.col("url"))), self.boards)
        scale = (
            on("structure", ranking.structure_scale(F.col("title"), F.col("text")))
            * on("breadth", ranking.breadth_scale(F.col("text"), F.col("len_body"), F.col("mean_body")))
            * on("landing", F.when(ranking.thin_landing(F.col("title"), F.col("text"), F.col("answer")) & (F.col("n_concepts") > 0), 0.34).otherwise(1.0))
            * on("board", board_scale(doc_boards, F.col("query_boards"), F.col("option_only")))
            * on("phrase", ranking.phrase_scale(F.col("needles"), *map(F.col, ("title", "snippet", "text", "answer"))))
        )
        scaled = F.col("raw") * scale
        blended = scaled if "coverage" in self.without else ranking.coverage_blend(scaled, F.col("coverage"))
        sure = ranking.confidence(F.col("raw"), F.col("idf_mass"), F.col("sure_hits"), F.col("available"))
        full = full.withColumn("blended", F.round(blended, 9)).withColumn("confidence", sure).withColumn("rank", F.row_number().over(ranking.by_rank("blended", "manual_id", "doc_id")) - 1)
        if "fusion" in self.without:
            chunks = full.withColumn("score", F.col("blended"))
        else:
            common = ranking.common_title_terms(wanted).select("query_id", F.col("term").alias("token"), F.lit(True).alias("common"))
            fields = pool.select("query_id", "doc_id").join(ranking.lexical_fields(self.docs), "doc_id")
            lexical = ranking.lexical_scores(fields, matchers.join(common, ["query_id", "token"], "left").fillna(False, ["common"]))
            full = full.join(lexical, ["query_id", "doc_id"], "left").fillna(0, ["lexical"])
            full = full.withColumn("lexical_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lexical"), "rank")) - 1)
            chunks = full.withColumn("score", ranking.fused(F.col("rank"), F.col("lexical_rank")))
        chunks = chunks.withColumn("page", urls.page_url(F.col("url")) if "page" not in self.without else F.col("url"))
        pages = ranking.pages_of_chunks(chunks.select("query_id", "page", "doc_id", "score"))
        best = chunks.select("query_id", "doc_id", "manual_id", "title", "most", "weak", "confidence", "coverage", T.hit_snippet(*map(F.col, ("snippet", "answer", "text", "breadcrumbs", "url"))).alias("snippet"), F.when(F.size(doc_boards) == 1, F.get(doc_boards, F.lit(0))).when(F.size(doc_boards) > 1, "multiple").alias("board"))
        out = pages.join(best, ["query_id", "doc_id"]).withColumn("place", F.row_number().over(ranking.by_rank("score", "page"))).where("place <= most")
        return out.select("query_id", "place", "page", "title", "manual_id", "score", "n_chunks", "snippet", "board", "confidence", F.round("coverage", 6).alias("coverage"), F.when(F.col("weak"), "weak").otherwise("good").alias("quality"))

    def answers(self, queries: Sequence[Mapping[str, Any]], forum: DataFrame | None = None, rules: Sequence[results.PageRule] = (), board_pattern: str | None = None) -> DataFrame:
        """What a user is shown for a batch of queries: (query_id, place, page, source, title, snippet, board, quality, warning).

        From ``search``, in this order: pages that a rule pins to the query come first, then those of the query's one
        board and of none before other boards; forum hits (query_id, page, rank from 0) take up to a quarter of the places,
        where the query asks for them (source 'all' or 'forum') or names no manual; what is missing to the limit is filled up
        with further pages. ``warning`` names a board that is missing, for queries that fit ``board_pattern``, or in conflict.
        """
        frame = self.spark.createDataFrame
        asked = [{**q, "limit": MOST_LIMIT} for q in queries]
        found = self.search(asked)
        found = written(found)
        kinds = "query_id long, query string, manual string, option string, source string, most int"
        rows = frame([(q["query_id"], str(q.get("query") or ""), self.resolve_manual(q.get("manual")), q.get("board"), q.get("source"), int(min(MOST_LIMIT, max(1, q.get("limit") or DEFAULT_LIMIT)))) for q in queries], kinds)
        named = mentioned_boards(F.col("query"), self.boards)
        rows = rows.withColumn("named", named).withColumn("board", F.when(F.size("named") == 1, F.get("named", F.lit(0))).when(F.size("named") == 0, F.lower("option")))
        rows = rows.withColumn("source", hits.resolved_source(F.coalesce("source", F.when(F.col("manual").isNull(), "all")), F.col("manual"), ("forum",)))
        conflict = (F.size("named") > 0) & F.col("option").isNotNull() & ~F.array_contains("named", F.lower("option"))
        missing = hits.board_missing(F.col("query"), F.col("named"), F.col("manual"), F.col("option"), board_pattern) if board_pattern else F.lit(False)
        rows = rows.withColumn("pin", results.ruled_page(F.col("query"), F.col("board"), F.col("manual"), rules)).withColumn("warning", F.when(conflict, "board conflict").when(missing, "board missing"))
        pages = self.docs.select(urls.page_url(F.col("url")).alias("page")).distinct()
        first = results.pinned(found, rows.select("query_id", F.col("pin").alias("page")), pages)
        first = first.join(found.select("query_id", "page", F.col("board").alias("of_board")), ["query_id", "page"], "left").join(rows.select("query_id", "board", "most", "source"), "query_id").where("source <> 'forum'")
        fits = (F.col("score") >= results.PIN_SCORE) | F.col("board").isNull() | F.col("of_board").isNull() | (F.col("of_board") == F.col("board"))
        ordered = results.board_first(first, fits)
        docs = ordered.select("query_id", F.col("page").alias("url"), (F.col("place") - 1).alias("rank"))
        own = frame([], "query_id long, url string, rank int") if forum is None else forum.join(rows.where("source <> 'docs'").select("query_id"), "query_id", "left_semi").select("query_id", F.col("page").alias("url"), "rank")
        merged = ranking.merged_with_quota(docs, own, MOST_LIMIT).join(rows.select("query_id", "most", "warning"), "query_id")
        # Within a query's limit, forum hits keep the quarter that its limit gives them.
        nth = F.row_number().over(Window.partitionBy("query_id", "source").orderBy("place"))
        n_forum = F.count_if(F.col("source") == "forum").over(Window.partitionBy("query_id"))
        n_docs = F.count_if(F.col("source") == "docs").over(Window.partitionBy("query_id"))
        quota = F.least(n_forum, F.greatest(F.floor(F.col("most") / 4), F.lit(1), F.col("most") - n_docs))
        kept = merged.withColumn("nth", nth).withColumn("quota", quota).where(F.when(F.col("source") == "forum", F.col("nth") <= F.col("quota")).otherwise(F.col("nth") <= F.col("most") - F.col("quota")))
        placed = kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).select("query_id", F.col("url").alias("page"), "source", "place", "warning")
        shown = found.select("query_id", "page", "title", "snippet", "board", "quality")
        return placed.join(shown, ["query_id", "page"], "left").select("query_id", "place", "page", "source", "title", "snippet", "board", F.coalesce("quality", F.lit("good")).alias("quality"), "warning")

    def search_alternates(self, query_id: int, query: str, others: Iterable[str], **options: Any) -> DataFrame:
        """Pages of one query and up to three other wordings of it, fused by rank."""
        kept, _ = planner.distinct_alternates(query, others)
        wordings = [query, *kept]
        found = self.search([{"query_id": k, "query": x, **options, "limit": MOST_LIMIT} for k, x in enumerate(wordings)])
        lists = found.select(F.lit(query_id).cast("long").alias("query_id"), F.col("query_id").alias("list_id"), "page", F.col("place").alias("rank"))
        fused = ranking.fuse_lists(lists).withColumn("place", F.row_number().over(ranking.by_rank("score", "page")))
        return fused.where(F.col("place") <= int(options.get("limit") or DEFAULT_LIMIT))

    # --- Pages ------------------------------------------------------------------------------------------------------

    def page(self, url: str, section: str | None = None, query: str | None = None, most: int = sections.RELEVANT_CAP, offset: int = 0, expected_hash: str | None = None, full: bool = False) -> dict[str, Any]:
        """The text of one page: a named section, relevant sections for a query, or a window from ``offset`` on.

        The text is that of the page's rows in order. A window beyond the first needs the hash of the first, and an
        unequal one is an error, as the page has changed.
        """
        page = url.split("#", 1)[0]
        rows = self.docs.where(urls.page_url(F.col("url")) == page).select("doc_ord", "doc_id", "kind", "title", "text", "answer", "snippet").orderBy("doc_ord", "doc_id")
        # All rows are read, one partition at a time; of a window only its own characters are kept.
        stream = rows.drop("doc_id").toLocalIterator()
        first = next(stream, None)
        if first is None:
            raise LookupError(f"no page {page}")
        windowed = bool(full or offset or expected_hash)
        hashed, total, kept, tail, images, pins, tables = hashlib.sha256(), 0, [], "", [], False, False
        for part in chain([f"# {first.title or page}"], map(_part, chain([first], stream))):
            if not part:
                continue
            piece = "\n\n" + part if total else part
            hashed.update(piece.encode())
            own = piece[max(0, offset - total) : max(0, offset + most - total)] if windowed else piece
            if own:
                kept.append(own)
            total += len(piece)
            images += sections.IMAGE.findall(part)[: 6 - len(images)]
            pins = pins or bool(sections.PIN_TOPIC.search(tail + piece))
            tables = tables or bool(sections.TABLE.search("\n" + part))
            tail = piece[-16:]
        markdown, digest = "".join(kept), hashed.hexdigest()
        if offset < 0 or offset > total:
            raise ValueError(f"offset {offset} is not within the {total} characters of the page")
        if offset and not expected_hash:
            raise ValueError("a window beyond the first needs expected_hash")
        if expected_hash and expected_hash != digest:
            raise ValueError("the page has changed; begin again at offset 0")
        out = {"url": page, "title": first.title, "content_hash": digest, "total_chars": total, "images": images if pins and not tables else []}
        if windowed:
            end = min(total, offset + most)
            return out | {"text": markdown, "next_offset": end if end < total else None, "truncated": end < total}
        if section:
            text, title, matched = sections.select_section(markdown, section=section, anchor=url.split("#", 1)[1] if "#" in url else None)
            return out | {"text": text[:most], "section": title, "matched": matched, "next_offset": None, "truncated": len(text) > most}
        text, title, matched, truncated = sections.pack_sections(markdown, page, query, most)
        return out | {"text": text, "section": title, "matched": matched, "next_offset": None, "truncated": truncated}
