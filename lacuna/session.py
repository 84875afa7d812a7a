"""Sessions with the settings the library's plans are made for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get(app: str = "lacuna", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | extra).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Shuffles of a write are removed at its end, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows of a task where sets and joins hold them all, about.
ROWS = 1 << 19


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` for a job over so many rows: partitions grow in number with the rows, never in size.

    Partitions of a number that is asked for stay as they are; others are put
    together by adaptive execution up to its advisory size, which counts
    compressed bytes and can be many times as much in a join or an aggregation.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-rows // ROWS)), *keys)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a temporary one in-process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lacuna-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def settled(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written to the shared folder and reread: a stage boundary.

    Later plans reuse the result (and prune its partitions), and a lost executor
    costs a reread instead of a recomputation.  What was shuffled for it is
    removed as soon as it is written, so disk holds the shuffles of one stage.
    """
    path = f"{new_folder(df.sparkSession)}.parquet"
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path, compression="zstd")
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
