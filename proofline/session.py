"""Session settings and the one place that decides where intermediate data may live."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "proofline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; any of them can be overridden."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, else the context's checkpoint folder, else one beside the
    warehouse's tables. A warehouse on local disks is refused unless the session itself is local."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured:
        root = configured
    elif context.getCheckpointDir():
        root = context.getCheckpointDir()
    else:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if warehouse.startswith(("file:", "/")) and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{warehouse.rstrip('/')}/_scratch"
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write to the shared folder and read back.

    It drops the lineage, survives lost executors and gives the optimiser true sizes, so that what follows is
    broadcast only where it is known to be small.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, *keys: str, n: int | None = None, sort: bool = True) -> DataFrame:
    """Write to the shared folder in buckets of the keys, as many as there are shuffle partitions if ``n`` is not given, and read back.

    A join or aggregate on just these keys then needs no exchange of this side. The table is known to the session's catalog only
    while it is written.
    """
    spark = df.sparkSession
    name, n = f"buckets_{uuid.uuid4().hex}", n or int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.bucketBy(n, *keys)
    (writer.sortBy(*keys) if sort else writer).option("path", scratch_path(spark, "buckets")).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved, so that the name is no longer needed
    spark.sql(f"DROP TABLE {name}")
    return out
