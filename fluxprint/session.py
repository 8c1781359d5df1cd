"""Session settings shared by tests, the benchmark and the query registry."""

from __future__ import annotations

import gc
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def build(master: str = "local[*]", name: str = "fluxprint", shuffle_partitions: int = 8,
          **extra: str) -> SparkSession:
    """Session for local runs; on a cluster the caller brings its own session."""
    builder = (
        SparkSession.builder.master(master).appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("FLUXPRINT_DRIVER_MEMORY", "8g"))
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Make results independent of the session: epochs and hours are UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor sees: ``spark.checkpoint.dir`` of the session.

    A session on one machine (``local[...]``) that names none uses Spark's own local
    folder; any other has to name one, as files of one executor would be missing to the rest.
    Tables of a run lie in a folder of its own, which :func:`clear` deletes.
    """
    context = spark.sparkContext
    chosen = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not chosen:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        chosen = context.getConf().get("spark.local.dir") or spark.sparkContext._jvm.System.getProperty("java.io.tmpdir")
    return f"{chosen.rstrip('/')}/fluxprint-{context.applicationId}"


def clear(spark: SparkSession) -> bool:
    """Delete all tables that this application has stored; frames that read them can't be used afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps; they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a reused table once to the shared folder and go on from the files.

    A lost executor then costs a re-read, not the whole lineage, and the next
    joins see the table's real size when they choose between broadcast and shuffle.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
