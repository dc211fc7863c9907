"""Session building and the one place where lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("spanforge")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def durable(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it back, so that a lost executor
    costs a read and not a recomputation. The folder is the session's spark.checkpoint.dir;
    only where that is unset and all runs on one machine a temporary one is made. What is written is as large as
    df; spark.cleaner.referenceTracking.cleanCheckpoints lets Spark delete it when df is gone."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spanforge-"))
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, key: str, waves: int = 4) -> DataFrame:
    """df, hashed by key over `waves` partitions a core if it is read in fewer than two a core.

    A table may come as one file with one row group: work that costs much more than moving the
    row would then run in one task. A table that is read in enough partitions, as any large one
    is, is left where it is. Only plans without a shuffle are looked at; behind a shuffle the rows
    are spread already."""
    execution = df._jdf.queryExecution()
    if any(word in execution.sparkPlan().toString() for word in ("Exchange", "Join", "Aggregate", "Window", "Sort")):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if execution.toRdd().getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(waves * cores, key)
