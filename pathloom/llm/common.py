"""Helpers shared by the operators: reading tables, scratch tables, held-out rows."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.session import ensure_checkpoint_dir

PART_BYTES = 2_000_000  # of texts that a kernel takes together, one text at least
HOLD_OUT = "pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read back: the copy has no
    lineage, survives lost executors and serves several branches.  The session's checkpoint
    folder owns the files."""
    path = scratch_dir(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a missing text as the empty one; other columns go."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def held_out(df: DataFrame) -> DataFrame:
    return df.withColumn("held_out", F.expr(f"coalesce({HOLD_OUT}, false)"))


def give_back() -> None:
    """Memory that this Python worker has freed goes back to the system.  Workers are used again,
    and what one operator leaves in the heap would count against the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim:
        trim(0)


def lean(run):
    """The kernel ``run`` over batches, with freed memory given back before and after it.  What the
    task before held is only freed when its worker has ended it, so the next one gives that back."""
    def whole(batches):
        give_back()
        yield from run(batches)
        give_back()
    return whole


def parts(sizes: np.ndarray, most: int = PART_BYTES):
    """(first, rows) of consecutive rows of at most ``most`` in all, one row at least."""
    first, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and held + n > most:
            yield first, i - first
            first, held = i, 0
        held += n
    if len(sizes) > first:
        yield first, len(sizes) - first


def text_parts(batches):
    """Arrow ``batches`` in slices of at most ``PART_BYTES`` of text, one row at least."""
    for batch in batches:
        for at, n in parts(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)):
            yield batch.slice(at, n)
