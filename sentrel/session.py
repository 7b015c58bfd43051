"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def build_session(app: str = "sentrel", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; cluster settings win over these defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder the cluster names.

    A temporary folder is used only when nothing is set and the job runs in local mode.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get(CHECKPOINT_SETTING, None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError(f"set {CHECKPOINT_SETTING} to a shared folder to run on a cluster")
            folder = tempfile.mkdtemp(prefix="sentrel-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder; a temporary one only where none is set in local mode."""
    base = spark.conf.get(CHECKPOINT_SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a shared folder to run on a cluster")
        base = tempfile.mkdtemp(prefix="sentrel-")
    return f"{base.rstrip('/')}/{name}-{os.urandom(6).hex()}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet to the shared folder; later steps read only the columns they need."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The same rows, written in buckets of ``keys``, so that joins on these need no exchange of this side.

    A bucket is one sorted file; there are as many as shuffle partitions.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_folder(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    writer = df.repartition(n, *keys).write.option("path", path).option("compression", "zstd").format("parquet")
    writer.bucketBy(n, *keys).sortBy(*keys).saveAsTable(table)
    return spark.table(table)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a small input that arrives in fewer splits than there are cores.

    Inputs with enough splits, which is every large one, pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
