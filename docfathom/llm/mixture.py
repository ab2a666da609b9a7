"""Sources mixed to target shares of a token budget (problem 8).

Per source the documents are counted by exact token length; whole passes come first, the rest of a source's budget is
filled by a bounded knapsack over these counts, and the documents of each length are picked by a seeded hash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfathom.session import spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that parts texts before byte pairs are merged; a public one that goes with the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Budgets of up to so many tokens are filled by the knapsack; beyond, lengths are first taken in seeded proportion.
EXACT_TOKENS = 16_384
BUCKETS = 1024


def load_tokenizer(path: str, pattern: str = PATTERN):
    """The tokenizer of a vocabulary file, kept for later tasks of the same worker."""
    import tiktoken

    held = tiktoken.__dict__.setdefault("_held_by_path", {})
    if path not in held:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        held[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return held[path]


def _count_tokens(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tokens_of = load_tokenizer(path).encode_ordinary
    for batch in batches:
        counts = [len(tokens_of(x)) if x else 0 for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "source", "tokens"])


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of every document; null and empty texts have none."""
    kinds = documents.schema
    schema = f"doc_id {kinds['doc_id'].dataType.simpleString()}, source string, tokens long"
    return spread(documents.select("doc_id", "source", "text")).mapInArrow(partial(_count_tokens, path=tokenizer), schema)


def fill_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, exact: int = EXACT_TOKENS) -> np.ndarray:
    """How many documents of each length to take so that their tokens come as near to ``budget`` from below as can be.

    A bounded knapsack by binary splitting of the counts fills up to ``exact`` tokens. A larger budget is first taken
    down to half of that, or four times the longest length, in proportion to the counts, which keeps the source's mix of
    lengths. ``lengths`` ascend: what rounding down a running sum of counts leaves is at most the longest of them, so
    that the knapsack is left with at most five times the longest or exact / 2 and the longest, and nothing is cut off.
    """
    taken = np.zeros(len(lengths), dtype=np.int64)
    budget = int(budget)
    have = int((lengths * counts).sum())
    if have <= budget:
        return counts.astype(np.int64)
    longest = int(lengths.max(initial=0))
    room = max(exact // 2, 4 * longest)  # a few of the longest have to fit for sums to come out
    if budget > 2 * room and have:
        upto = np.floor(np.cumsum(counts) * ((budget - room) / have)).astype(np.int64)  # lengths seen once are taken in proportion too
        taken = np.diff(upto, prepend=0)
        while (over := int((lengths * taken).sum()) - budget) > 0:  # rounding may take a long document too many
            k = np.nonzero(taken)[0]
            k = k[np.argmin(np.abs(lengths[k] - over))]
            taken[k] -= 1
        budget -= int((lengths * taken).sum())
    left = counts - taken
    if budget > 2 * room:
        raise ArithmeticError(f"{budget} tokens are left to the knapsack; the lengths must ascend")
    reached = np.full(budget + 1, -1, dtype=np.int64)  # the item by which a sum was reached first
    reached[0] = -2
    items: list[tuple[int, int]] = []
    for k in np.argsort(-lengths, kind="stable"):
        size, n = int(lengths[k]), int(min(left[k], budget // lengths[k])) if lengths[k] > 0 else 0
        step = 1
        while n > 0 and size <= budget:
            use = min(step, n)
            n -= use
            step *= 2
            weight = use * size
            if weight > budget:
                break
            before = reached[: budget + 1 - weight] != -1
            new = before & (reached[weight:] == -1)
            if new.any():
                reached[weight:][new] = len(items)
            items.append((int(k), use))
            if reached[budget] != -1:
                break
        if reached[budget] != -1:
            break
    at = int(np.max(np.nonzero(reached != -1)[0]))
    while at > 0:
        k, use = items[reached[at]]
        taken[k] += use
        at -= use * int(lengths[k])
    return taken


def _plan(key, pdf: pd.DataFrame, exact: int) -> pd.DataFrame:
    pdf = pdf.sort_values("tokens", kind="stable")
    lengths, counts = pdf["tokens"].to_numpy(np.int64), pdf["n_docs"].to_numpy(np.int64)
    some = lengths > 0
    taken = np.zeros(len(lengths), dtype=np.int64)
    taken[some] = fill_budget(lengths[some], counts[some], int(pdf["rest"].iloc[0]), exact)
    return pd.DataFrame({"source": pdf["source"], "tokens": lengths, "n_docs": counts, "full_passes": pdf["full_passes"], "extra_docs": taken})


def source_budgets(sizes: DataFrame, targets: DataFrame, total_share: float = 0.5) -> DataFrame:
    """(source, target_share, max_repeats, available, budget, full_passes, rest, reachable) of every target source.

    The mixture is to hold ``total_share`` of the tokens of all documents whose source is a target. A source is
    reachable if max_repeats passes over it hold its share of that; one without documents is reachable only at share 0.
    ``rest`` is what is to be filled after full_passes whole passes. Documents of other or null sources take no part.
    """
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("available"))
    rows = targets.where("source is not null").groupBy("source").agg(F.first("target_share").alias("target_share"), F.first("max_repeats").alias("max_repeats"))
    rows = rows.join(have, "source", "left").fillna(0, ["available", "target_share", "max_repeats"])
    total = rows.agg(F.sum("available")).first()[0] or 0
    budget = F.col("target_share") * F.lit(total_share * total)
    rows = rows.withColumn("budget", budget).withColumn("reachable", F.col("available") * F.col("max_repeats") >= F.col("budget"))
    passes = F.when(F.col("available") > 0, F.least(F.floor(F.col("budget") / F.col("available")), F.col("max_repeats").cast("long"))).otherwise(0)
    rest = F.when(F.col("full_passes") < F.col("max_repeats"), F.floor(F.col("budget") - F.col("full_passes") * F.col("available"))).otherwise(0)
    return rows.withColumn("full_passes", passes.cast("long")).withColumn("rest", rest.cast("long"))


def _rank(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id")


def mixture(sizes: DataFrame, budgets: DataFrame, seed: int = 0, exact: int = EXACT_TOKENS) -> DataFrame:
    """(doc_id, source, tokens, repeats) of the documents in the mixture, repeats at least 1.

    The plan goes by (source, token length) with the number of documents: a source of T tokens has at most
    sqrt(2 T) different lengths, which bounds what one task holds. Which documents of a length are taken goes by a
    seeded hash: its buckets are counted first, so that only the bucket at the edge is sorted, never all documents of a
    length. Documents with a null or repeated id are picked like all others; documents without tokens are left out.
    """
    targets = budgets.select("source", "full_passes", "rest")
    counts = sizes.where("tokens > 0").groupBy("source", "tokens").agg(F.count("*").alias("n_docs")).join(targets, "source")

    def planned(key, pdf):
        return _plan(key, pdf, exact)

    plan = counts.groupBy("source").applyInPandas(planned, "source string, tokens long, n_docs long, full_passes long, extra_docs long")
    docs = sizes.where("tokens > 0").withColumn("order", _rank(seed)).withColumn("bucket", F.pmod(F.col("order"), F.lit(BUCKETS)).cast("int"))
    by_bucket = docs.groupBy("source", "tokens", "bucket").agg(F.count("*").alias("n"))
    running = Window.partitionBy("source", "tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = by_bucket.join(plan.where("full_passes > 0 or extra_docs > 0").drop("n_docs"), ["source", "tokens"]).withColumn("upto", F.sum("n").over(running))
    take = F.greatest(F.lit(0), F.least("n", F.col("extra_docs") - (F.col("upto") - F.col("n"))))
    edges = edges.withColumn("take", take).where("full_passes > 0 or take > 0").select("source", "tokens", "bucket", "full_passes", "n", "take")
    picked = docs.join(edges, ["source", "tokens", "bucket"])
    whole = picked.where("take = 0 or take = n").withColumn("extra", F.when(F.col("take") > 0, 1).otherwise(0))
    within = Window.partitionBy("source", "tokens", "bucket").orderBy("order", "doc_id")
    edge = picked.where("take > 0 and take < n").withColumn("extra", F.when(F.row_number().over(within) <= F.col("take"), 1).otherwise(0))
    repeats = (F.col("full_passes") + F.col("extra")).alias("repeats")
    return whole.unionByName(edge).select("doc_id", "source", "tokens", repeats).where("repeats > 0")


def reached_shares(budgets: DataFrame, mixed: DataFrame) -> DataFrame:
    """(source, target_share, reached_share, target_tokens, mixed_tokens, mixed_docs, reachable, short), a line for every target source.

    short: the mixture holds every document of the source as often as it may, and still less than its budget.
    """
    own = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"), F.sum("repeats").alias("mixed_docs"))
    rows = budgets.join(own, "source", "left").fillna(0, ["mixed_tokens", "mixed_docs"])
    total = rows.agg(F.sum("mixed_tokens").alias("all_tokens"))
    # One row with the total joins all rows on a constant: no product of tables.
    both = rows.withColumn("one", F.lit(1)).join(F.broadcast(total.withColumn("one", F.lit(1))), "one")
    short = (F.col("mixed_tokens") >= F.col("available") * F.col("max_repeats")) & (F.col("mixed_tokens") < F.col("budget"))
    share = F.when(F.col("all_tokens") > 0, F.col("mixed_tokens") / F.col("all_tokens")).otherwise(0.0)
    return both.select("source", "target_share", F.round(share, 6).alias("reached_share"), F.floor("budget").alias("target_tokens"), "mixed_tokens", "mixed_docs", "reachable", short.alias("short"))
