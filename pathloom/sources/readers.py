"""Readers for tables, matrices, lists, signal cubes and file collections."""

from __future__ import annotations

import io
import json
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pathloom.functions.columns import null_if_not_finite

# Schemas of the exchanged tables
SCHEMAS = {
    "cell": "sample_id string, seed_roi string, endpoint_roi string, path_length_edges int, "
            "y_endpoint double",
    "folds": "repeat int, sample_id string, seed_roi string, test_fold int",
    "attrition": "sample_id string, n_candidate int, n_accepted int, in_support boolean, L int, "
                 "seed_roi string, endpoint_roi string",
    "path_set": "sample_id string, path_index int, L int, roi_id_sequence string",
    "registry": "sample_id string, path_id long, path_rank int, roi_sequence string, "
                "roi_id_sequence string, edge_set string, L int, accepted boolean, "
                "reject_reason string, screen_id string",
    "whitelist": "circuit_name string, roi_id int, role string",
    "network_map": "MMP_Label string, Yeo7_Network_Label string",
    "oof": "sample_id string, repeat int, outer_fold int, y_true double, y_pred double",
}


def read_csv(spark: SparkSession, path: str, schema: str | StructType, columns: list[str] | None = None,
             sep: str = ",") -> DataFrame:
    """Header CSV with a stated schema; ``columns`` prunes inside the reader."""
    df = spark.read.option("header", True).option("sep", sep).option("enforceSchema", False).schema(
        schema).csv(path)
    return df.select(*columns) if columns else df


def read_tsv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return read_csv(spark, path, schema, sep="\t")


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None,
                 where: str | Column | None = None) -> DataFrame:
    """Columns and filter reach the scan."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def _matrix_rows(spark: SparkSession, path: str) -> DataFrame:
    """(u, line) of every non-blank line; a matrix file is one small document."""
    doc = spark.read.text(path, wholetext=True)
    lines = F.filter(F.split("value", r"\r?\n"), lambda s: F.trim(s) != "")
    return doc.select(F.posexplode(lines).alias("u", "line"))


def _cells(rows: DataFrame, parts: Column) -> DataFrame:
    return rows.select("u", F.posexplode(parts).alias("v", "s")).select(
        "u", "v", null_if_not_finite(F.expr("try_cast(trim(s) as double)")).alias("value"))


def read_matrix(spark: SparkSession, path: str, indexed: bool = False) -> DataFrame:
    """Comma-separated matrix as long rows (u, v, value); NaN and text become NULL.

    ``indexed`` files carry a header line and a row name in the first column.
    """
    rows = _matrix_rows(spark, path)
    parts = F.split("line", ",")
    if indexed:
        rows = rows.where("u > 0").withColumn("u", F.col("u") - 1)
        parts = F.slice(parts, 2, F.size(parts) - 1)
    return _cells(rows, parts)


def read_text_matrix(spark: SparkSession, path: str, negative_is_missing: bool = False) -> DataFrame:
    """Whitespace-separated matrix; negative entries may mean missing."""
    m = _cells(_matrix_rows(spark, path), F.split(F.trim("line"), r"\s+"))
    if negative_is_missing:
        m = m.withColumn("value", F.when(F.col("value") >= 0, F.col("value")))
    return m


def read_list(spark: SparkSession, path: str, name: str = "name") -> DataFrame:
    """(id, name): one entry per non-blank line, its position as id."""
    rows = _matrix_rows(spark, path)
    return rows.select(F.col("u").alias("id"), F.trim("line").alias(name))


def read_config(path: str, required: tuple[str, ...] = ()) -> dict:
    cfg = json.loads(Path(path).read_text())
    missing = sorted(set(required) - set(cfg))
    if missing:
        raise ValueError(f"{path}: missing keys {missing}")
    return cfg


def discover(spark: SparkSession, pattern: str, regex: str, names: list[str]) -> DataFrame:
    """Files of a glob with the groups of ``regex`` as columns; contents are not read."""
    files = spark.read.format("binaryFile").load(pattern).select("path")
    base = F.regexp_extract("path", r"([^/]+)$", 1)
    hit = files.where(base.rlike(f"^(?:{regex})$"))
    return hit.select("path", *[F.regexp_extract(base, regex, i + 1).alias(n)
                                for i, n in enumerate(names)])


def read_signal_cubes(spark: SparkSession, pattern: str) -> DataFrame:
    """``.npy`` cubes (trial, channel, time) as (path, trial, channel, samples).

    Files are parsed where they are read, one row per trial and channel.
    """
    files = spark.read.format("binaryFile").load(pattern).select("path", "content")

    def parse(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                cube = np.load(io.BytesIO(content), allow_pickle=False)
                for trial in range(cube.shape[0]):
                    yield pd.DataFrame({
                        "path": path, "trial": trial, "channel": range(cube.shape[1]),
                        "samples": [row.astype(float) for row in cube[trial]]})

    return files.mapInPandas(parse, "path string, trial int, channel int, samples array<double>")


def signal_long(cubes: DataFrame, start: float = -300.0, stop: float = 700.0) -> DataFrame:
    """(path, trial, channel, t, value) with evenly spaced times from ``start`` to ``stop``."""
    n = F.size("samples")
    x = cubes.select("path", "trial", "channel", n.alias("n"), F.posexplode("samples").alias("i", "value"))
    return x.select("path", "trial", "channel", (F.lit(start) + F.col("i") * (stop - start)
                                                 / (F.col("n") - 1)).alias("t"), "value")


# ---- path sets ----------------------------------------------------------------------------


def path_set_rows(paths: DataFrame) -> DataFrame:
    """Node arrays to the exchanged text form, path_index by node order within a cell."""
    from pathloom.operators.ordered import row_position

    p = paths.select("sample_id", F.col("L").cast("int").alias("L"),
                     F.array_join("nodes", "|").alias("roi_id_sequence"), "nodes")
    return row_position(p, ["sample_id"], ["nodes"], "pos").select(
        "sample_id", (F.col("pos") - 1).cast("int").alias("path_index"), "L", "roi_id_sequence")


def path_set_nodes(rows: DataFrame) -> DataFrame:
    return rows.withColumn("nodes", F.transform(
        F.split("roi_id_sequence", r"\|"), lambda s: s.cast("int")))


def node_list(text: str | Column) -> Column:
    """JSON list of node ids as an array."""
    return F.from_json(text, "array<int>")
