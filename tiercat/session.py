"""Spark session defaults used by tests, bench and examples."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tiercat", driver_memory: str | None = "8g") -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    On a cluster the master, memory and ``spark.checkpoint.dir`` come from the cluster's
    own configuration; this helper only fills in what is unset.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local") and driver_memory:
        # local mode runs every task in the driver JVM
        builder = builder.config("spark.driver.memory", driver_memory)
    builder = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only in local mode, where all tasks share one machine,
    a private folder is created when nothing is configured; on a cluster that would scatter
    the files over the executors, so it is an error.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="tiercat-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(conf)
    return conf


def materialize(spark: SparkSession, df: DataFrame, name: str = "stage", by: str | None = None,
                codec: str | None = None) -> DataFrame:
    """Write ``df`` once as a parquet table in the shared checkpoint folder and read it
    back: the plan runs once, lineage is cut, a lost executor's partitions are re-read
    from files, and later readers get column pruning, filter pushdown and real sizes (a small
    table is then broadcast by the planner's own check). ``by`` names a column whose values get folders of their own,
    ``codec`` another compression than the session's, for large tables."""
    path = scratch_path(spark, f"{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}")
    writer = df.write.mode("overwrite")
    writer = writer.option("compression", codec) if codec else writer
    writer = writer.partitionBy(by) if by else writer
    writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    return table.select(*df.columns) if by else table


def materialize_bucketed(spark: SparkSession, df: DataFrame, key: str, name: str = "stage",
                         buckets: int | None = None) -> DataFrame:
    """Like :func:`materialize`, as a table bucketed by ``key``: later joins, aggregations and windows by the key
    read it without an exchange. Rows are dealt by the key first, so a bucket is one file."""
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"tiercat_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = scratch_path(spark, f"{spark.sparkContext.applicationId}/{table}")
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder, for tables written to cut lineage."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "tiercat", name)
