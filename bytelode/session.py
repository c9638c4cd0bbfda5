"""The session that the engine expects."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def durable(df: DataFrame) -> DataFrame:
    """The rows as they are now, checkpointed in the folder that spark.checkpoint.dir names: what is read twice is then the same, and lost
    executors take nothing. Where no folder is set, a temporary one, on a single machine only."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(root or "file://" + os.path.join(tempfile.gettempdir(), "bytelode-checkpoints"))
    return df.checkpoint()


def session(master: str = "local[*]", partitions: str | int = 8, **more: str) -> SparkSession:
    """UTC, adaptive plans, Arrow. On a cluster, set the partitions to some hundred MB of input each and spark.checkpoint.dir to a shared
    folder."""
    conf = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
    }
    spark = SparkSession.builder.master(master).appName("bytelode").config(map=conf | more).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
