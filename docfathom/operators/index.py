"""The fielded inverted index as tables: postings with a weighted count by field, document lengths and corpus sums.

Documents are rows of (doc_id, manual_id, title, url, snippet, text, answer, breadcrumbs). ``write_index`` keeps them as
segments sorted by term: queries read the row groups of their terms only.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfathom.functions import analysis
from docfathom.functions import wordlists as W
from docfathom.functions.tokenizer import weighted_terms
from docfathom.session import ensure_checkpoint_dir, spread


def latest_documents(docs: DataFrame) -> DataFrame:
    """One row of each (manual_id, doc_ord): the one ingested last, the highest row_id in a tie; nulls are a key like others.

    Keys are counted first, combined in each task. Only the rows of keys that were delivered more than once are grouped
    then; all others keep their place, and no text of theirs is shuffled where the repeated keys are few.
    """
    keys = ("manual_id", "doc_ord")
    again = docs.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*(F.col(k).alias(f"again_{k}") for k in keys))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"again_{k}")) for k in keys))
    rest = [c for c in docs.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct("ingested_at", "row_id")).alias("last")
    repeated = docs.join(again, same, "left_semi").groupBy(*keys).agg(last).select(*keys, "last.*")
    return docs.join(again, same, "left_anti").select(*keys, *rest).unionByName(repeated)


def _post(batches: Iterator[pa.RecordBatch], lengths: bool) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "manual_id", "term", "tf_title", "tf_url", "tf_body"] + (["len_title", "len_url", "len_body", "first"] if lengths else [])
    for batch in batches:
        places, terms, counts, sums, sizes = [], [], ([], [], []), ([], [], []), []
        for k, (title, path, body, answer) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(2, 6)))):
            title, path, body = weighted_terms(title), weighted_terms(path), weighted_terms(body)
            for x, n in weighted_terms(answer, W.ANSWER_WEIGHT).items():
                own = body.get(x, 0.0)
                if own < W.ANSWER_WEIGHT:
                    body[x] = min(W.ANSWER_WEIGHT, own + n)
            every = title.keys() | path.keys() | body.keys()
            if not every:
                continue
            places += [k] * len(every)
            terms += every
            sizes.append(len(every))
            for to, total, field in zip(counts, sums, (title, path, body)):
                to += [field.get(x, 0.0) for x in every]
                total.append(sum(field.values()))
        at = pa.array(places, pa.int64())
        columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(terms, pa.string()), *(pa.array(c, pa.float64()) for c in counts)]
        if lengths:
            columns += [pa.array(np.repeat(np.array(x, np.float64), sizes)) for x in sums]
            first = np.zeros(len(terms), bool)
            first[np.cumsum([0, *sizes[:-1]])[: len(sizes)]] = True
            columns.append(pa.array(first))
        yield pa.RecordBatch.from_arrays(columns, names=names)


def postings(docs: DataFrame, lengths: bool = False) -> DataFrame:
    """(doc_id, manual_id, term, tf_title, tf_url, tf_body): weighted counts of each term of a document by field.

    Answers count for half in the body and never lift a term above 0.5. All terms of a document come from its own row:
    no shuffle. Documents of null or empty fields have no terms in these. With ``lengths`` each posting also has the
    three lengths of its document, so that scoring needs no join, and tells whether it is the document's first.
    """
    body = analysis.body_text(F.col("snippet"), F.col("text"), F.col("breadcrumbs"))
    rows = docs.select("doc_id", "manual_id", "title", analysis.url_path(F.col("url")).alias("path"), body.alias("body"), F.substring(F.coalesce("answer", F.lit("")), 1, W.BODY_CAP).alias("answer"))
    kind = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", "manual_id")}
    schema = f"doc_id {kind['doc_id']}, manual_id {kind['manual_id']}, term string, tf_title double, tf_url double, tf_body double"
    return spread(rows).mapInArrow(partial(_post, lengths=lengths), schema + (", len_title double, len_url double, len_body double, first boolean" if lengths else ""))


def document_lengths(post: DataFrame) -> DataFrame:
    """(manual_id, doc_id, len_title, len_url, len_body): taken from the first posting of each document where postings have it."""
    if "first" in post.columns:
        return post.where("first").select("manual_id", "doc_id", "len_title", "len_url", "len_body")
    return post.groupBy("manual_id", "doc_id").agg(*(F.sum(f"tf_{x}").alias(f"len_{x}") for x in ("title", "url", "body")))


def corpus_sums(docs: DataFrame, lengths: DataFrame) -> DataFrame:
    """(manual_id, n_docs, sum_title, sum_url, sum_body); documents without terms count in n_docs."""
    n = docs.groupBy("manual_id").agg(F.count("*").alias("n_docs"))
    sums = lengths.groupBy("manual_id").agg(*(F.sum(f"len_{x}").alias(f"sum_{x}") for x in ("title", "url", "body")))
    return n.join(sums, "manual_id", "left").fillna(0.0)


def document_frequencies(post: DataFrame) -> DataFrame:
    """(manual_id, term, df, df_outside_answers) by manual; sums over the manuals of a query give its statistics."""
    outside = F.count_if((F.col("tf_title") > 0) | (F.col("tf_url") > 0) | (F.col("tf_body") > W.ANSWER_WEIGHT))
    return post.groupBy("manual_id", "term").agg(F.count("*").alias("df"), outside.alias("df_outside_answers"))


def _weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [weighted_terms(x) for x in batch.column(1).to_pylist()]
        at = pa.array([k for k, terms in enumerate(own) for _ in terms], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([x for terms in own for x in terms], pa.string()), pa.array([n for terms in own for n in terms.values()], pa.float64())], names=["id", "term", "weight"])


def analysed(rows: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, term, weight) of one text column, a line for each distinct term of a row."""
    kind = rows.schema[id_column].dataType.simpleString()
    return spread(rows.select(rows[id_column].alias("id"), rows[text].alias("text"))).mapInArrow(_weighted, f"id {kind}, term string, weight double")


@dataclass(frozen=True)
class Index:
    """The four tables of an index: postings with lengths, document lengths, frequencies and sums, the last three by manual."""

    post: DataFrame
    lengths: DataFrame
    frequencies: DataFrame
    sums: DataFrame


TABLES = ("postings", "lengths", "frequencies", "sums")


def write_index(docs: DataFrame, path: str, merged: bool = False) -> Index:
    """The index of ``docs`` as Parquet under ``path``, read again.

    Each task writes a segment of the postings of its documents, sorted by term: nothing is shuffled, and the row groups
    of a term are found by their bounds and bloom filter. ``merged`` brings the postings of a term together instead, by
    one shuffle that splits a term with very many postings over several tasks; do so for an index that is read often.
    """
    spark = docs.sparkSession
    post = postings(docs, lengths=True)
    if merged:
        view = f"docfathom_postings_{uuid.uuid4().hex}"
        post.createOrReplaceTempView(view)
        post = spark.sql(f"SELECT /*+ REBALANCE(term) */ * FROM {view}")
    post.sortWithinPartitions("term").write.mode("overwrite").option("parquet.bloom.filter.enabled#term", "true").option("parquet.block.size", str(32 << 20)).parquet(f"{path}/postings")
    _write_statistics(docs, path, "overwrite")
    return read_index(spark, path)


def _write_statistics(docs: DataFrame, path: str, mode: str, manuals: DataFrame | None = None) -> None:
    spark = docs.sparkSession
    post = spark.read.parquet(f"{path}/postings")
    post = post if manuals is None else post.join(manuals, "manual_id", "left_semi")
    lengths = document_lengths(post)
    lengths.write.mode(mode).parquet(f"{path}/lengths")
    document_frequencies(post).write.mode(mode).parquet(f"{path}/frequencies")
    corpus_sums(docs, document_lengths(post)).write.mode(mode).parquet(f"{path}/sums")


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{x}") for x in TABLES))


def reindex(docs: DataFrame, path: str) -> Index:
    """The index under ``path`` with the manuals of ``docs`` written anew in all four tables, others unchanged.

    The tables are written beside the old ones and take their place as a whole: a reader sees the old index or the
    new one, and a run broken off leaves the old one.
    """
    spark = docs.sparkSession
    touched = docs.select("manual_id").distinct()
    new = f"{path.rstrip('/')}-new-{uuid.uuid4().hex}"
    if not _exists(spark, path):
        write_index(docs, new)
    else:
        write_index(docs, f"{new}/touched")
        for x in TABLES:
            kept = spark.read.parquet(f"{path}/{x}").join(touched, "manual_id", "left_anti")
            both = kept.unionByName(spark.read.parquet(f"{new}/touched/{x}"))
            (both.sortWithinPartitions("term") if x == "postings" else both).write.parquet(f"{new}/{x}")
        _delete(spark, f"{new}/touched")
    _delete(spark, path)
    _rename(spark, new, path)
    return read_index(spark, path)


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    fs, where = _path(spark, path)
    return bool(fs.exists(where))


def _delete(spark: SparkSession, path: str) -> None:
    fs, where = _path(spark, path)
    fs.delete(where, True)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    fs, where = _path(spark, old)
    if not fs.rename(where, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"{old} could not be moved to {new}")


_kept: dict[str, str] = {}


def kept_index(docs: DataFrame) -> Index:
    """The index of ``docs``, written once in a session to the shared checkpoint folder and read from then on.

    It is known by the files that ``docs`` reads and when their folder was changed last: other files give another index.
    """
    spark = docs.sparkSession
    files = sorted(docs.inputFiles())
    changed = []
    for folder in sorted({x.rsplit("/", 1)[0] for x in files}):
        fs, where = _path(spark, folder)
        changed.append(str(fs.getFileStatus(where).getModificationTime()))
    key = hashlib.sha256("\n".join([spark.sparkContext.applicationId, *files, *changed]).encode()).hexdigest()[:32]
    if key not in _kept:
        path = f"{ensure_checkpoint_dir(spark)}/index-{key}"
        write_index(docs, path)
        _kept[key] = path
    return read_index(spark, _kept[key])
