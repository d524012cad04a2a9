"""Streams: the rolling market, seen sets, partition replacement, index pages, usage batches.

Every sink that keeps state commits by batch id, so a batch that runs twice leaves the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import urls


def rolling_postings(posts: DataFrame, id_: str, employer: str, created: str, days: int = 30, slide: str = "1 day") -> DataFrame:
    """Postings per employer in sliding windows of event time; an id counts once within the watermark.

    The batch form (``operators.market.rolling_market``) evicts by a clock; a stream evicts by the watermark, so
    rows later than it are dropped. ``created`` is cast, for a watermark needs a timestamp with a zone.
    """
    timed = posts.withColumn(created, F.col(created).cast("timestamp")).withWatermark(created, f"{days} days")
    once = timed.dropDuplicatesWithinWatermark([id_])
    return once.groupBy(F.window(created, f"{days} days", slide), employer).agg(F.count(F.lit(1)).alias("postings"), F.max(created).alias("last_seen"))


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def new_since_stream(found: DataFrame, seen_path: str, out_path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Rows of a stream that no earlier batch had; the seen set is a table, a folder a batch."""

    def each(batch: DataFrame, number: int) -> None:
        seen = _read_or_none(batch.sparkSession, seen_path)
        rows = batch.dropDuplicates(keys)
        fresh = rows if seen is None else rows.join(seen.where(F.col("batch") < number).select(keys), keys, "left_anti")
        fresh = fresh.withColumn("batch", F.lit(number)).persist()
        try:
            for path in (out_path, seen_path):
                fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        finally:
            fresh.unpersist()

    return found.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replace_partitions_stream(jobs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Fetched partitions replace theirs; the last fetch of a source in a batch wins, other sources stay."""

    def each(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("source_slug").agg(F.max("fetched_at").alias("fetched_at"))
        rows = batch.join(last, ["source_slug", "fetched_at"], "left_semi")
        rows.repartition("source_slug").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_slug").parquet(path)

    return jobs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_pages_stream(spark: SparkSession, path: str, out: str, checkpoint: str, pages_per_batch: int = 80) -> StreamingQuery:
    """Crawl-index pages as they arrive: boards and cursor commit together, a restart goes on where it stopped."""
    lines = spark.readStream.option("maxFilesPerTrigger", pages_per_batch).text(path)
    boards = lines.withColumn("url", F.get_json_object("value", "$.url")).withColumn("board", urls.resolve(F.col("url"))).where("board IS NOT NULL")
    return boards.select("url", "board.ats", "board.token").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_stream(events: DataFrame, send: Callable[[list[dict]], None], checkpoint: str, flush: int = 25, backlog: int = 200) -> StreamingQuery:
    """Usage events in small posts; a batch keeps its last ``backlog`` events, loss of posts is accepted."""

    def each(batch: DataFrame, number: int) -> None:
        rows = [r.asDict() for r in batch.orderBy(F.desc("ts")).limit(backlog).collect()][::-1]
        for k in range(0, len(rows), flush):
            try:
                send(rows[k : k + flush])
            except OSError:
                return

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
