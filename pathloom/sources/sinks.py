"""Writers: write-once tables, fixed-format matrices, stage reuse, reports."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_once(df: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    """Refuses to overwrite an existing output."""
    w = df.write.mode("errorifexists").options(**options)
    if fmt == "csv":
        w = w.option("header", options.get("header", True))
    w.format(fmt).save(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished output is there, on any file system Spark can reach."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def stage(spark: SparkSession, path: str, build) -> DataFrame:
    """Read a finished stage, or build and write it first."""
    if not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def matrix_lines(df: DataFrame, row: str, col: str, value: str, columns: list) -> DataFrame:
    """One text line per matrix row: '%.6f' values in the stated column order, 'nan' for gaps."""
    x = F.max(value)  # one value per cell
    cell = F.when(x.isNotNull() & ~F.isnan(x), F.format_string("%.6f", x)).otherwise("nan")
    wide = df.groupBy(row).pivot(col, columns).agg(cell)
    parts = [F.coalesce(F.col(f"`{c}`"), F.lit("nan")) for c in columns]
    return wide.select(row, F.concat_ws(" ", *parts).alias("line"))


def write_matrix(df: DataFrame, row: str, col: str, value: str, columns: list, path: str) -> None:
    """Matrix text in row order; the sort is a range partition, not one task."""
    lines = matrix_lines(df, row, col, value, columns)
    lines.orderBy(row).select("line").write.mode("errorifexists").text(path)


def row_fingerprints(df: DataFrame, keys: list[str]) -> DataFrame:
    """SHA-256 of every row's JSON, columns in name order."""
    return df.select(*keys, F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("sha256"))


def table_fingerprint(df: DataFrame) -> str:
    """Order-free digest of a table, folded on the executors."""
    h = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    word = lambda i: F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("bigint")
    r = df.agg(F.count(F.lit(1)).alias("n"),
               *[F.sum(word(i)).cast("decimal(38,0)").alias(f"s{i}") for i in range(8)]).first()
    return hashlib.sha256("|".join(str(x) for x in r).encode()).hexdigest()


def file_fingerprint(path: str) -> str:
    """SHA-256 of one small local file (configuration, report)."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def write_json_report(report: dict, path: str) -> None:
    target = Path(path)
    if target.exists():
        raise FileExistsError(path)
    target.write_text(json.dumps(report, indent=2, sort_keys=True, default=str))


def markdown_table(df: DataFrame, limit: int = 200) -> str:
    """A summary table as Markdown; larger frames are refused, not cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: write a table instead")
    head = "| " + " | ".join(df.columns) + " |"
    rule = "|" + " --- |" * len(df.columns)
    body = ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]
    return "\n".join([head, rule, *body])
