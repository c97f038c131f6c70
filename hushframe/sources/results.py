"""Result tables: read, union, append, and the per-dataset report folders."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.functions.scalars import col

# Layout of the long result table and the resource columns of an export.
LONG_SCHEMA = (
    "Dataset string, Task_Type string, Model string, Method string, Epsilon double, Data_Norm double, "
    "K int, Metric string, Value double, Error string"
)
KEYS = ("Dataset", "Model", "Method", "Epsilon", "Data_Norm", "K")
# What names a grid point inside a dataset, in any of the result tables.
POINT = ("Model", "Method", "Strategy", "Epsilon", "Data_Norm", "K")
MEMBERSHIP_SCHEMA = "Dataset string, Model string, Strategy string, Epsilon double, Data_Norm double, MI_AttackAccuracy double, Error string"
RESOURCE_COLUMNS = (
    "Dataset", "Model", "Type", "Epsilon", "Data_Norm", "Task_Type",
    "CPU_Baseline", "RAM_Baseline", "Time_Baseline", "CPU_DP", "RAM_DP", "Time_DP",
    "CPU_PHE", "RAM_PHE", "Time_PHE", "CPU_FHE", "RAM_FHE", "Time_FHE",
    "CPU_ConcreteW", "RAM_ConcreteW", "Time_ConcreteW",
)


def results_union(*parts: DataFrame) -> DataFrame:
    """Union by name of rows that need not share all columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def project_present(df: DataFrame, cols: Sequence[str] = RESOURCE_COLUMNS) -> DataFrame:
    """Those of ``cols`` the table has, in the listed order."""
    return df.select(*[col(c) for c in cols if c in df.columns])


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Wide results, CSV with header or parquet.  Wide metric names are only known from the header."""
    if path.rstrip("/").endswith(".csv"):
        return spark.read.option("header", True).csv(path)
    return spark.read.parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if path.rstrip("/").endswith(".csv") else writer.parquet(path)


def save_results(df: DataFrame, path: str) -> None:
    """Save the rows of finished grid points; saving a point again is harmless.

    A save is an attempt with a folder of its own, in it one file per dataset and point
    that appears whole or not at all.  So one that was cut off, repeated or made by two
    sweeps at once cannot mix with another; ``finished_results`` reads one attempt of
    each point.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in POINT if c in df.columns]
    rows = df.withColumns({"Point": F.concat_ws("|", *named), "Saved": F.lit(time.time_ns())})
    rows.coalesce(1).write.partitionBy("Dataset", "Point").parquet(f"{path.rstrip('/')}/Attempt=a{uuid.uuid4().hex}")


def finished_results(spark: SparkSession, path: str, schema: str = LONG_SCHEMA) -> DataFrame:
    """Rows saved so far, none before the first save.

    Of several attempts at a point the last one that succeeded counts, else the last one.
    """
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("Dataset", "Point")})
    last = rows.groupBy("Dataset", "Point").agg(F.max(F.struct(F.col("Error").isNull(), "Saved", "Attempt")).alias("_last"))
    kept = rows.join(F.broadcast(last), ["Dataset", "Point"]).filter(F.col("Attempt") == F.col("_last.Attempt"))
    return kept.select(*[c for c in spark.createDataFrame([], schema).columns if c in rows.columns])


def write_report(df: DataFrame, folder: str, by: Sequence[str] = ("Task_Type", "Dataset")) -> None:
    """One CSV folder per task and dataset; a report is small, one file per folder is enough."""
    present = [c for c in by if c in df.columns]
    writer = df.repartition(*[F.col(c) for c in present]) if present else df.coalesce(1)
    out = writer.write.mode("overwrite").option("header", True)
    (out.partitionBy(*present) if present else out).csv(folder)
