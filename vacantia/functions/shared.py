"""Cutting lineage where driver and executors can both read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where the setting is missing, a local session (tests, a laptop) uses a temporary folder; any other one is an error,
    since executors would write where nobody else can read.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if held.isDefined():
            path = held.get()
        elif context.master == "local" or context.master.startswith("local["):
            path = "file://" + tempfile.mkdtemp(prefix="vacantia-")
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not held.isDefined():
        context.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
