"""Connected groups over shared keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def connected(rows: DataFrame, id_: str, keys: str) -> DataFrame:
    """Add ``component``, the smallest id reachable over shared keys (an array column).

    Every round takes the smallest label over a row's keys and then the label of that label, so chains shorten by
    half and more; rounds go on until nothing changes. Rows without keys are components by themselves.
    """
    pairs = cut(rows.select(F.col(id_).alias("id"), F.explode(keys).alias("key")).distinct())
    label = pairs.select("id", F.col("id").alias("component")).distinct()
    while True:
        by_key = pairs.join(label, "id").groupBy("key").agg(F.min("component").alias("component"))
        near = pairs.join(by_key, "key").groupBy("id").agg(F.min("component").alias("component"))
        further = near.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = cut(near.join(further, "component").select("id", F.least("component", "further").alias("component")))
        if new.join(label.withColumnRenamed("component", "old"), "id").where("component < old").isEmpty():
            break
        label = new
    found = rows.join(label.withColumnRenamed("id", "_id"), rows[id_] == F.col("_id"), "left")
    return found.withColumn("component", F.coalesce("component", F.col(id_))).drop("_id")
