"""Session settings and lineage cutting shared by every operator."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the results rely on (time zone) or the plans count on (AQE).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Row-group bytes of staged tables: small, so that a table written by few tasks is still read by many.
STAGE_BLOCK = 8 << 20


def get_spark(app: str = "hushframe", **conf: str) -> SparkSession:
    """Session with the library's settings; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts that the session names; there is no fallback."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder all executors can reach")
    sc.setCheckpointDir(shared)
    return shared


def local_checkpoint_dir(spark: SparkSession, folder: str) -> None:
    """Sets ``folder`` for a session on one machine that names none, as tests and benches do."""
    sc = spark.sparkContext
    unset = sc.getCheckpointDir() is None and spark.conf.get("spark.checkpoint.dir", None) is None
    if unset and re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        sc.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and forget its plan.

    Used for small per-node, per-class or per-bracket tables that several later
    jobs read; survives executor loss because the files are on shared storage.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as parquet in the checkpoint folder and scan it from there.

    For row tables that many jobs read: a costly input runs once, and each job
    still reads only the columns it needs.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", STAGE_BLOCK).parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged._staged_path = path
    return staged


def release(*staged: DataFrame) -> None:
    """Delete the files of frames from ``stage`` that no later job reads, not even to recompute."""
    for df in staged:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._staged_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
