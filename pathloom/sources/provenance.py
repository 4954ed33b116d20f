"""Stages keyed by the content of their inputs, with stated conditions on what they give."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from pathloom.sources.sinks import exists

FIELD, MISSING = "\x1f", "\x1e"  # between two fields; in place of a null
WORDS = 4                        # 32-bit words of the digest of a row
MODULUS = 2 ** 61


def row_text(df: DataFrame) -> Column:
    """Text of a row: columns in name order, times as microseconds."""
    def text(field):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (TimestampType, TimestampNTZType)):
            c = F.unix_micros(c.cast("timestamp"))
        elif field.dataType.typeName() in ("array", "map", "struct"):
            c = F.to_json(c)
        return F.coalesce(c.cast("string"), F.lit(MISSING))
    return F.concat_ws(FIELD, *[text(f) for f in sorted(df.schema.fields, key=lambda f: f.name)])


def content_sums(df: DataFrame) -> DataFrame:
    """One row: n_rows and the sums w0 to w3 of the words of all row digests modulo 2^61.

    Sums don't depend on order, partitioning or lost tasks, repeated rows count, and all is
    added up map-side.  An empty table has zeros.
    """
    h = df.select(F.md5(row_text(df).cast("binary")).alias("h"))
    word = lambda i: F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")
    return h.agg(F.count(F.lit(1)).alias("n_rows"), *[
        F.coalesce(F.sum(word(i)) % F.lit(MODULUS), F.lit(0)).cast("bigint").alias(f"w{i}") for i in range(WORDS)])


def content_key(name: str, version: str, inputs: dict[str, DataFrame]) -> str:
    """Key of a stage: its name, the version of its code, columns and content of its inputs."""
    parts = [[n, df.schema.simpleString(), list(content_sums(df).first())] for n, df in sorted(inputs.items())]
    return hashlib.sha256(json.dumps([name, version, parts]).encode()).hexdigest()[:32]


def failed_conditions(df: DataFrame, conditions: dict[str, Column]) -> list[str]:
    """Names of the conditions (aggregates that must be true) that ``df`` doesn't meet, found in
    one aggregation; an aggregate without a value fails."""
    if not conditions:
        return []
    names = list(conditions)
    got = df.agg(*[conditions[n].alias(f"c{i}") for i, n in enumerate(names)]).first()
    return [n for n, ok in zip(names, got) if ok is not True]


def keyed_stage(spark: SparkSession, base: str, name: str, build, inputs: dict[str, DataFrame],
                conditions: dict[str, Column] | None = None, version: str = "1") -> DataFrame:
    """The stage ``name`` below ``base``, built only if no finished one has these very inputs.

    Equal inputs in any order of rows use it again; another input or version has a folder of
    its own, so nothing finished is overwritten.  What a lost run left unfinished is written
    anew.  The conditions are checked on the stored rows each time; a failing one raises.
    """
    path = f"{base.rstrip('/')}/{name}-{content_key(name, version, inputs)}"
    if not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    failed = failed_conditions(out, conditions or {})
    if failed:
        raise ValueError(f"stage {name} at {path} fails: {', '.join(failed)}")
    return out
