"""A training corpus from raw documents: quality, language, exact and near copies, packing.

Each stage takes (spark, docs, sf_dir) and gives a frame that is written as Parquet and read
again as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import exact_dedup, language_id, ngram_join, packing, quality
from pathloom.llm.common import table, written
from pathloom.llm.pieces import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


# bytes of an Arrow batch, unless the session names them itself: 64 MB of whole texts, Spark's
# default, are held several times over by an executor and its Python workers
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def _small_batches(spark: SparkSession) -> None:
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)


def _only(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is among ``keep`` (doc_id), the rows themselves unchanged."""
    return docs.join(keep.withColumnRenamed("doc_id", "kept_id"), F.col("doc_id").eqNullSafe(F.col("kept_id")),
                     "left_semi").select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good; rows pass through the scorer whole."""
    _small_batches(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.with_scores(docs.select(*COLUMNS), model).where(F.col("score") >= quality.ACCEPT).select(*COLUMNS)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the network knows with a score of ``LEAST_SCORE`` at least."""
    _small_batches(spark)
    net = language_id.train(docs)
    return language_id.with_language(docs.select(*COLUMNS), net).where(
        (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= language_id.LEAST_SCORE)).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id; of rows repeated whole, one."""
    found = exact_dedup.dedup(docs)
    kept = written(found.where("kept").select("doc_id"), "kept")
    out = _only(docs, kept)
    return out if kept.groupBy("doc_id").count().where("count > 1").isEmpty() else out.dropDuplicates(["doc_id", "text"])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that similarity links join, the one with the least doc_id."""
    _small_batches(spark)
    found = ngram_join.similarity_join(docs)
    return _only(docs, found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left in windows of 2048 tokens."""
    _small_batches(spark)
    return packing.pack(docs, tokenizer_path(packing.VOCABULARY)).drop("ids")


STAGES = [("quality", keep_good), ("language", keep_known_language), ("exact_dedup", drop_copies),
          ("near_dedup", drop_near_copies), ("packing", pack_windows)]

ORACLE_SQL = None  # compression, a network and MinHash bands are beyond SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
