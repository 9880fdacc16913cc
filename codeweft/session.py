"""Session set-up and the two ways this library cuts lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = 8, partitions: int = 8, memory: str = "8g", app: str = "codeweft") -> SparkSession:
    """A session for tests and the bench; on a cluster pass the cluster's own session instead."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=DEFAULTS)
    return (
        builder.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory).getOrCreate()
    )


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the reliable checkpoint folder, with its lineage cut.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only where that is unset (tests, a bench on
    one machine) a private folder is made; a cluster without the setting is refused, as a machine's own folder would lose
    what its loss takes. Reliable checkpoints survive the loss of any executor.
    """
    spark = df.sparkSession
    ctx = spark.sparkContext
    if ctx._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None) or ctx.getConf().get("spark.checkpoint.dir")
        if not shared and not ctx.master.startswith("local[") and ctx.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        ctx.setCheckpointDir(shared or tempfile.mkdtemp(prefix="codeweft-"))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
