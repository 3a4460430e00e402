"""The shared folder, and lineage cut in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Only a local session may go without: it gets a temporary one."""
    sc = spark.sparkContext
    given = sc._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    at = spark.conf.get("spark.checkpoint.dir", None) or ""
    if not at:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tripleframe-")
    sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """`df` computed, written to the shared folder, without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
