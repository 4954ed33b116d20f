"""Session helpers: building a session, cutting lineage, checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a frame may hold and still be hinted for broadcast.  At the widest row
# used here (about 150 bytes) this is some 30 MB per executor.
BROADCAST_ROW_LIMIT = 200_000


def local_session(cpus: int | str = "*", app: str = "pathloom") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Directory for reliable checkpoints.

    The shared folder named by ``spark.checkpoint.dir`` wins.  Only a local
    master without that setting gets a temporary folder; a cluster without it is
    an error, because executors would not see a machine-local path.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="pathloom-ckpt-")
    sc.setCheckpointDir(shared)
    return shared


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder once and continue from the copy.

    Used where a frame feeds several branches or a loop; the copy survives the
    loss of executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def is_small(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> bool:
    """True when ``df`` holds at most ``limit`` rows.

    Every partition stops at the limit and only a count reaches the driver.
    """
    return df.select(F.lit(1)).limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast hint behind a row count; beyond the limit the join shuffles."""
    return F.broadcast(df) if is_small(df, limit) else df


def side_table(df: DataFrame) -> DataFrame:
    """A derived table expected to be short (one row per class, repeat, fold or length):
    written once, counted, and broadcast only if it is short indeed."""
    return broadcast_if_small(materialize(df))
