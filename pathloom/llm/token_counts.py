"""Exact histogram of encoded lengths and what its suffix sums answer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.common import table, texts
from pathloom.llm.pieces import encoder, slices, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
SPAN = 1024  # lengths summed up together in the first step


def lengths(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n): number of ids of each whole text; a missing one has none."""
    def run(batches):
        for pdf in batches:
            n = []
            for part in slices(pdf["text"].tolist()):
                n += [len(raw) // 4 for raw in encoder(vocabulary).encode(part)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n": n})
    return texts(docs).mapInPandas(run, "doc_id long, n long")


def histogram(counted: DataFrame) -> DataFrame:
    """(n, docs): documents of each length; counts add up before the shuffle."""
    return counted.groupBy("n").agg(F.count(F.lit(1)).alias("docs"))


def with_suffix_sums(hist: DataFrame) -> DataFrame:
    """One row per length n: docs, docs_from and tokens_from (documents of at least n ids and
    their ids), all_docs, all_tokens, truncated_tokens (ids left when all texts are cut to n)
    and share_up_to (of the documents with at most n ids).

    Sums run inside spans of ``SPAN`` lengths and over the spans' totals, so the longest
    text, not the number of documents, bounds both steps.
    """
    hist = hist.withColumn("span", F.floor(F.col("n") / SPAN)).withColumn("tokens", F.col("n") * F.col("docs"))
    spans = hist.groupBy("span").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spans = spans.select("span", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_later"),
                         F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_later"),
                         F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("all_tokens"))
    inside = Window.partitionBy("span").orderBy(F.desc("n"))
    out = hist.withColumn("docs_from", F.sum("docs").over(inside)).withColumn("tokens_from", F.sum("tokens").over(inside))
    out = out.join(spans, "span").select(
        "n", "docs", (F.col("docs_from") + F.col("d_later")).alias("docs_from"),
        (F.col("tokens_from") + F.col("t_later")).alias("tokens_from"), "all_docs", "all_tokens")
    return out.select("*", (F.col("all_tokens") - F.col("tokens_from") + F.col("n") * F.col("docs_from")).alias("truncated_tokens"),
                      ((F.col("all_docs") - F.col("docs_from") + F.col("docs")) / F.col("all_docs")).alias("share_up_to"))


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context, tokens): ids left when every text is cut to each of ``limits``: those of the
    shorter texts, and the limit itself for each of the others."""
    out = [sums.agg(F.coalesce(F.max("all_tokens"), F.lit(0)).alias("a"),
                    F.max(F.when(F.col("n") > c, F.struct("docs_from", "tokens_from"))).alias("x")).select(
        F.lit(c).cast("long").alias("context"),
        (F.col("a") - F.coalesce("x.tokens_from", F.lit(0)) + c * F.coalesce("x.docs_from", F.lit(0))).alias("tokens"))
        for c in limits]
    total = out[0]
    for o in out[1:]:
        total = total.unionByName(o)
    return total


def quantile(sums: DataFrame, share: float) -> int | None:
    """Least length that at least ``share`` of the documents don't exceed; None without any."""
    return sums.where(F.col("share_up_to") >= share).agg(F.min("n")).first()[0]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Histogram of the encoded lengths of ``docs`` (doc_id, text) with its suffix sums.

    A missing or empty text has length 0 and counts; repeated rows count each; doc_id may be
    missing; an empty table gives no rows; other columns go.
    """
    return with_suffix_sums(histogram(lengths(docs, vocabulary)))


def op5_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY))


QUERIES = {"op5_token_counts": op5_token_counts}
