"""Exact deduplication by a stream with keyed state on disk."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import scratch_dir, table

FEED_SCHEMA = "digest binary, doc_id long, file string, n_bytes long, call string"
CONTENT_SCHEMA = "digest binary, text string, doc_id long, n long"
BROADCAST_DIGESTS = 100_000  # some 5 MB; more digests than this are joined by a shuffle
STATE = "spark.sql.streaming.stateStore."
ON_DISK = {  # RocksDB, its memory bounded for an executor however many state partitions it holds
    STATE + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    STATE + "rocksdb.boundedMemoryUsage": "true",
    STATE + "rocksdb.maxMemoryUsageMB": "256",
    STATE + "rocksdb.writeBufferSizeMB": "8",
    STATE + "rocksdb.blockCacheSizeMB": "8",
    STATE + "rocksdb.allowFAllocate": "false",  # else each partition takes 4 MB of disk ahead
}


def digest(text="text"):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


@contextmanager
def state_on_disk(spark: SparkSession):
    """The session's state store is RocksDB meanwhile."""
    before = {k: spark.conf.get(k, None) for k in ON_DISK}
    for k, v in ON_DISK.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(digest().alias("digest"), F.coalesce("text", F.lit("")).alias("text"),
                       F.col("doc_id").cast("long").alias("doc_id"), F.lit(1).cast("long").alias("n"))


def grouped(texts: DataFrame) -> DataFrame:
    return texts.groupBy("digest", "text").agg(F.max("doc_id").alias("doc_id"), F.sum("n").alias("n"))


class DedupState:
    """Digests seen so far, under one shared folder: ``inbox`` takes arrivals as small rows,
    ``state`` is the checkpoint of the stream that folds them into keyed state.  The state
    has no expiry; each key keeps how many rows came, the largest doc_id and where its
    content lies.  ``content`` holds the texts of every call once with their rows, for the byte
    check of later calls, whatever becomes of the files they came from; a folder for a single
    call does without."""

    def __init__(self, spark: SparkSession, folder: str, single: bool = False):
        self.spark, self.inbox, self.folder = spark, f"{folder}/inbox", f"{folder}/state"
        self.content, self.call = None if single else f"{folder}/content", None

    def add(self, docs: DataFrame) -> None:
        """Take in ``docs`` (doc_id, text) and run the stream until the inbox is read."""
        self.call = uuid.uuid4().hex
        if self.content:
            grouped(texts_of(docs)).write.mode("append").option("compression", "zstd").parquet(self.content)
        docs.select(digest().alias("digest"), F.col("doc_id").cast("long").alias("doc_id"),
                    F.input_file_name().alias("file"),
                    F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
                    F.lit(self.call).alias("call")).write.mode("append").parquet(self.inbox)
        arrivals = self.spark.readStream.schema(FEED_SCHEMA).parquet(self.inbox)
        kept = arrivals.groupBy("digest").agg(
            F.count(F.lit(1)).alias("rows"), F.max(F.struct("doc_id", "file", "n_bytes")).alias("place"))
        with state_on_disk(self.spark):
            kept.writeStream.format("noop").outputMode("update").option(
                "checkpointLocation", self.folder).trigger(availableNow=True).start().awaitTermination()

    def arrivals(self) -> DataFrame:
        """What the last call brought."""
        return self.spark.read.schema(FEED_SCHEMA).parquet(self.inbox).where(F.col("call") == self.call)

    def keys(self) -> DataFrame:
        """The keyed state: digest, rows, place (doc_id, file, n_bytes)."""
        return self.spark.read.format("statestore").load(self.folder).select(
            "key.digest", F.col("value.count").alias("rows"), F.col("value.max").alias("place"))


def checked_groups(docs: DataFrame, state: DedupState) -> DataFrame:
    """digest, text, keep_id, group_size of every digest with hits, by full bytes, earlier
    calls' rows included.

    Texts of one digest are grouped by their bytes; equal ones add up before the shuffle, so a
    text that holds much of the corpus moves once a task."""
    hit = state.keys().where("rows > 1").select("digest")
    if state.content:  # of all calls' digests those of this one
        hit = hit.join(state.arrivals().select("digest").distinct(), "digest", "left_semi")
        texts = state.spark.read.schema(CONTENT_SCHEMA).parquet(state.content)
    else:
        texts = texts_of(docs)
    if hit.count() <= BROADCAST_DIGESTS:
        hit = F.broadcast(hit)
    return grouped(texts.join(hit, "digest")).select(
        "digest", "text", F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"))


def dedup(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs``.

    Texts are equal when their bytes are; a missing one counts as empty.  The row with the
    largest doc_id of equal texts stays; rows without doc_id come last and among themselves
    all stay.  Rows repeated with one doc_id carry one verdict.  An empty table gives no rows.
    ``folder`` (shared) keeps the state for later calls with new rows; verdicts then cover
    what this call brought, against all that came.  Other columns go.
    """
    spark = docs.sparkSession
    state = DedupState(spark, folder or scratch_dir(spark, "dedup"), single=folder is None)
    state.add(docs)
    groups = checked_groups(docs, state)
    single = state.keys().where("rows = 1").select(
        "digest", F.col("place.doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    rows = state.arrivals().select("digest", "doc_id")
    by_digest = groups.select("digest", "keep_id", "group_size").unionByName(single)
    collided = groups.groupBy("digest").count().where("count > 1")
    if collided.isEmpty():
        out = rows.join(by_digest, "digest")
    else:  # two texts of one digest: the bytes take part in the join
        texts = texts_of(docs).drop("n")
        out = texts.join(groups, ["digest", "text"]).select(
            "digest", "doc_id", "keep_id", "group_size").unionByName(
            rows.join(single, "digest").select("digest", "doc_id", "keep_id", "group_size"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      F.lower(F.hex("digest")).alias("text_sha256"))


def op8_exact_dedup(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents"))


SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id is not distinct from max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""

QUERIES = {"op8_exact_dedup": op8_exact_dedup}
ORACLES = {"op8_exact_dedup": SQL}
