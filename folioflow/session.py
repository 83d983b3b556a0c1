"""SparkSession factory and the few session facts operators need."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "folioflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and Arrow; callers may override any setting."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app).config(map=settings)
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in spark.checkpoint.dir.

    Where that setting is unset a temporary folder is made, which only a session in one
    JVM may have: on a cluster the tasks of other machines could not reach it.
    """
    if spark.sparkContext.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="folioflow-ckpt-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise df in the reliable checkpoint folder (survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a parquet table in the shared checkpoint folder, read back with an empty lineage.

    Like checkpoint() it survives lost executors, but columns are compressed and a
    reader takes only those it needs. The folder belongs to the cluster, which also
    decides how long such tables stay.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def default_parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, at_least: int | None = None) -> DataFrame:
    """Repartition only when a scan yields fewer partitions than there are cores.

    Python stages over one small file would otherwise run in a single task. Asked of
    scans and what is made of them row by row: counting the partitions of an adaptive
    join or aggregation would run its shuffles, so those are left as they are.
    """
    want = at_least or default_parallelism(df.sparkSession)
    if df._jdf.queryExecution().executedPlan().toString().startswith("AdaptiveSparkPlan"):
        return df
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def env_cpus(default: int = 8) -> int:
    return int(os.environ.get("BENCH_CPUS", default))
