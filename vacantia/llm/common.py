"""Helpers shared by the corpus operators."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import cut, shared_dir

__all__ = ["count_space_words", "cut", "literal_rows", "lower_ascii", "release", "shared_dir", "spread_join", "table", "whole", "write_shared"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A key of more than one in so many rows is hot; there are fewer hot keys than this.
HOT_SHARE = 1000
_WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone, whatever the locale."""
    return F.translate(text, UPPER, LOWER)


def count_space_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs as long; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def whole(df: DataFrame) -> Column:
    """All columns of a row as one struct: whatever their names, no working column can clash with them."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of the driver as a literal of the plan, read by the JVM alone. ``schema``: ``name:type,...``."""
    held = json.dumps(rows, ensure_ascii=False)
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(held), f"array<struct<{schema}>>")))


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder as Parquet and read back: a compressed, column-pruned cut."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove what this session cut and wrote in the shared folder; results that are still to be read need it, so call it last."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    for path in [*_WRITTEN, *([held.get()] if held.isDefined() else [])]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(context._jsc.hadoopConfiguration())
        if files.exists(at):
            for child in files.listStatus(at) if path not in _WRITTEN else [None]:
                files.delete(child.getPath() if child else at, True)
    _WRITTEN.clear()


def spread_join(many: DataFrame, one: DataFrame, key: str, total: int) -> DataFrame:
    """``many`` joined with ``one``, which has one row a key and its number of rows in ``many`` (of ``total``) as ``n``.

    Hot keys are fewer than ``HOT_SHARE`` whatever the size, so their rows of ``one`` are broadcast and those of ``many``
    stay where they are; only the others are shuffled. ``one`` is used several times: cut it before.
    """
    hot = one.where(F.col("n") > total / HOT_SHARE)
    if hot.isEmpty():
        return many.join(one, key).drop("n")
    cold = many.join(F.broadcast(hot.select(key)), key, "left_anti").join(one.where(F.col("n") <= total / HOT_SHARE), key)
    return many.join(F.broadcast(hot), key).drop("n").unionByName(cold.drop("n"))
