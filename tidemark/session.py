"""A session with the settings that exact results rely on, and folders for tables of one application."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(app: str = "tidemark", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map=SETTINGS)
    for name, value in extra.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share, deleted when the application ends.

    It lies in spark.checkpoint.dir. Where that is not set a local master takes the warehouse; a cluster has no folder
    that is known to be shared then, and raises.
    """
    base, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not base:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def unused(rows: DataFrame, name: str, *others: str) -> str:
    """``name``, or it with underscores behind that no column of ``rows`` has."""
    while name in rows.columns or name in others:
        name += "_"
    return name
