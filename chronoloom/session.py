"""A session with the settings that the plans are written for."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("chronoloom")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CHRONOLOOM_DRIVER_MEMORY", "6g"))
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .getOrCreate()
    )


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and kept in spark.checkpoint.dir, which driver and executors
    share; where that is unset on one machine (tests), a local folder is set."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not where and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(where or "file://" + tempfile.mkdtemp(prefix="chronoloom-"))
    return df.checkpoint()


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of work dealt out by keys over all shuffle partitions.

    Few bytes can be much work, so adaptive execution must not merge the partitions; a
    digest of the keys keeps Spark from reusing an exchange by the keys themselves, which it may merge."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))
