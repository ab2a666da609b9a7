"""Forum sources: search answers, topic lists and topics, as rows of the index and as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfathom.functions.text import cleaned, trimmed

SEARCH_SCHEMA = "topics array<struct<id:bigint,title:string,slug:string,tags:array<string>,pinned:boolean,excerpt:string>>, posts array<struct<topic_id:bigint,username:string,blurb:string>>"


def topic_url(base: str, topic_id: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/t/"), topic_id.cast("string"))


def read_search(answers: DataFrame, base: str, column: str = "body") -> DataFrame:
    """Rows of the index from search answers: each topic with the first blurb that names it, tags as breadcrumbs.

    An answer that is no JSON or lacks the lists has no topics.
    """
    parsed = answers.select(F.from_json(column, SEARCH_SCHEMA).alias("x"))
    topics = parsed.select(F.posexplode("x.topics").alias("ord", "t")).select("ord", "t.*").where("id is not null")
    posts = parsed.select(F.posexplode("x.posts").alias("ord", "p"))
    blurbs = posts.groupBy(F.col("p.topic_id").alias("id")).agg(F.min_by("p.blurb", "ord").alias("snippet"))
    rows = topics.join(blurbs, "id", "left")
    return rows.select(F.lit("forum").alias("manual_id"), F.col("ord").cast("long").alias("doc_ord"), "title", topic_url(base, F.col("id")).alias("url"), "snippet", F.coalesce("tags", F.array().cast("array<string>")).alias("breadcrumbs"), F.lit("page").alias("kind"))


def read_listing(answers: DataFrame, base: str, board: str, column: str = "body") -> DataFrame:
    """Rows of the index from a board's latest topics: pinned introductions are skipped, excerpts lose their tags."""
    topics = answers.select(F.from_json(column, SEARCH_SCHEMA).alias("x")).select(F.posexplode("x.topics").alias("ord", "t")).select("ord", "t.*")
    rows = topics.where("id is not null and not coalesce(pinned, false)")
    crumbs = F.concat(F.array(F.lit(board)), F.coalesce("tags", F.array().cast("array<string>")))
    return rows.select(F.lit("forum").alias("manual_id"), F.col("ord").cast("long").alias("doc_ord"), "title", topic_url(base, F.col("id")).alias("url"), trimmed(F.regexp_replace("excerpt", "<[^>]+>", "")).alias("snippet"), crumbs.alias("breadcrumbs"), F.lit("page").alias("kind"))


def first_posts(posts: DataFrame) -> DataFrame:
    """(topic_id, title, username, cooked, first_post, n_posts): the lowest post of each topic; aggregates only."""
    order = F.struct("post_number", F.coalesce("username", F.lit("")), F.coalesce("cooked", F.lit("")), "title")
    first = F.min_by(F.struct("title", "username", "cooked"), order).alias("p")
    return posts.groupBy("topic_id").agg(first, F.min("post_number").alias("first_post"), F.count("*").alias("n_posts")).select("topic_id", "p.*", "first_post", "n_posts")


def listing(posts: DataFrame, needle: str | None) -> DataFrame:
    """Topics whose title or a tag contains ``needle``, whatever the case."""
    rows = posts.select("topic_id", "title", "slug", "tags").distinct()
    if needle is None:
        return rows
    low = F.lit(needle.lower())
    return rows.where(F.contains(F.lower("title"), low) | F.coalesce(F.exists("tags", lambda t: F.contains(F.lower(t), low)), F.lit(False)))


def topics_to_markdown(posts: DataFrame, chunk: int = 500) -> DataFrame:
    """(topic_id, part, markdown): title, tags and, under ``## @user``, each distinct post as Markdown.

    A topic of very many posts comes in parts of ``chunk`` posts each, so that no task holds all of a hot topic; its
    posts are numbered by their own number, which bounds the part without sorting the topic.
    """
    from .html_pages import markdown_of

    once = posts.where("cooked is not null").groupBy("topic_id", "post_number").agg(F.min_by(F.struct("title", "tags", "username", "cooked"), F.struct("cooked", "username")).alias("p"))
    rows = once.select("topic_id", "post_number", "p.*").withColumn("part", F.floor(F.col("post_number") / chunk)).withColumn("markdown", markdown_of("cooked"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("post_number", F.coalesce("username", F.lit("?")).alias("username"), "markdown"))), lambda x: F.concat(F.lit("## @"), x["username"], F.lit("\n\n"), x["markdown"])), "\n\n")
    parts = rows.groupBy("topic_id", "part").agg(F.min_by("title", "post_number").alias("title"), F.min_by("tags", "post_number").alias("tags"), body.alias("body"))
    head = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.when(F.size("tags") > 0, F.concat(F.lit("\n\nTags: "), F.array_join("tags", ", "))).otherwise(""))
    return parts.select("topic_id", "part", cleaned(F.concat(head, F.lit("\n\n"), "body")).alias("markdown"))
