"""Sharding by sampled splitters, near-equal in bytes; DataFrame functions alone.

A record's key is the hash of its text, so equal texts stand together. Steps:

1. Keys are counted exactly, rows and bytes. A key of more than ``most_rows`` rows, or of more than a
   sixteenth of a range's bytes, is a heavy group, be its texts long, short or empty.
2. Of the other keys a sample is drawn, each record with odds as its size (the smallest
   ``-ln(u) / size``, u a seeded hash: the same records in every run); it gives quantile boundaries.
3. Records fall into ranges between the boundaries, every heavy group into a range of its own.
   Ranges with more than ``most_rows`` rows are subdivided (by the key; a heavy group by its rows).
4. The exact bytes of the ranges lay all records along a line: heavy groups are given to shards
   largest first, the ranges fill what room the shards have left. A group of equal texts stays whole
   in one shard unless it is larger than a shard; then it is cut at the exact byte.
5. Slots number a shard's records from 0 without gaps, by running counts over the ranges.

Only the sample (``SAMPLE`` keys) and the heavy groups (at most ``16 * RANGES`` by bytes and one for
every ``most_rows`` rows) reach the driver. A task holds a subdivided range: ``most_rows`` rows on
average, and as no key in it has more than that, seldom over twice as many.

Defined results: null text has size 1 and CRC 0 and is a group by itself, as the empty text is;
repeated rows each get a slot; rows without a doc_id are sharded like others; an empty table gives no
rows; other columns are ignored (``write_shards`` carries them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, literal_rows, write_shared

SHARDS = 8
SAMPLE = 8192
RANGES = 64
#: A key of more than this part of a range's bytes is a heavy group.
HEAVY_PART = 16
MOST_ROWS = 500_000
SEED = 20


def _unit(*cols: Column) -> Column:
    """A seeded hash in (0, 1)."""
    return (F.shiftrightunsigned(F.xxhash64(*cols, F.lit(SEED)), 11).cast("double") + 0.5) / float(1 << 53)


def _measured(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        # rows without an id are told apart by where they stand; kept by the cut
        F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("spread"),
    )


def _fill(heavy: list[tuple[int, int]], cold: int, shards: int) -> tuple[dict[int, list[tuple[int, int]]], list[tuple[int, int]]]:
    """Cuts along each heavy group's bytes and along the cold line, as (end, shard)."""
    total = cold + sum(size for _, size in heavy)
    target = -(-total // shards)
    load, cuts = [0] * shards, {}
    for key, size in heavy:  # largest first
        cuts[key], at = [], 0
        while at < size:
            shard = min(range(shards), key=lambda k: (load[k], k))
            room = target - load[shard]
            rest = size - at
            take = rest if size <= target or rest <= room else max(1, room)
            at += take
            load[shard] += take
            cuts[key].append((at, shard))
    line, at = [], 0
    room_all = sum(max(0, target - x) for x in load)
    for k in range(shards):
        at += max(0, target - load[k])
        line.append((at * cold // max(1, room_all), k))
    line[-1] = (cold, line[-1][1])
    return cuts, line


def _shard_at(position: Column, cuts: Column) -> Column:
    """Shard of the first cut that ends beyond the position."""
    beyond = F.filter(cuts, lambda c: c["end"] > position)
    return F.when(F.size(beyond) > 0, beyond[0]["shard"]).otherwise(F.element_at(cuts, -1)["shard"])


def assign_shards(docs: DataFrame, shards: int = SHARDS, most_rows: int = MOST_ROWS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row."""
    spark = docs.sparkSession
    rows = cut(_measured(docs))
    n_rows, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    most_rows = max(1, min(most_rows, n_rows // 256))

    # hash aggregation before the shuffle: a hot key is one row a task there
    counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    likely = sorted(r["key"] for r in counted.where((F.col("n") > most_rows) | (F.col("bytes") > max(1, total // (RANGES * HEAVY_PART)))).select("key").collect())
    is_heavy = rows.join(F.broadcast(literal_rows(spark, [{"key": k, "heavy": True} for k in likely], "key:long,heavy:boolean")), "key", "left")
    is_heavy = is_heavy.withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    drawn = is_heavy.where("NOT heavy").select("key", (-F.log(_unit(F.col("key"), F.col("doc_id"))) / F.col("size")).alias("turn")).orderBy("turn", "key").limit(SAMPLE)
    # distinct before it is collected: a limit that is collected itself would send every task's share to the driver
    calm = sorted(r["key"] for r in drawn.select("key").distinct().collect())
    bounds = sorted({calm[k * len(calm) // RANGES] for k in range(1, RANGES)}) if calm else []

    below = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("key"))) if bounds else F.lit(0)
    ranged = is_heavy.select("doc_id", "spread", "size", "text_crc32", "key", "heavy", F.when(F.col("heavy"), F.lit(-1)).otherwise(below).alias("range"))

    ranges = ranged.groupBy("heavy", "range", F.when(F.col("heavy"), F.col("key")).alias("group")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
    heavy = sorted(((r["group"], r["bytes"]) for r in ranges if r["heavy"]), key=lambda x: (-x[1], x[0]))
    cuts, line = _fill(heavy, sum(r["bytes"] for r in ranges if not r["heavy"]), shards)
    place = {key: k for k, (key, _) in enumerate(heavy)}  # a heavy range's number: after the cold ones
    table = [
        {"range": r["range"], "group": r["group"], "place": RANGES + place[r["group"]] if r["heavy"] else r["range"], "parts": -(-r["n"] // most_rows)}
        | {"low": float(r["low"]), "width": max(1.0, float(r["high"]) - float(r["low"])), "cuts": [{"end": e, "shard": k} for e, k in (cuts[r["group"]] if r["heavy"] else line)]}
        for r in ranges
    ]
    plan = F.broadcast(literal_rows(spark, table, "range:int,group:long,place:int,parts:long,low:double,width:double,cuts:array<struct<end:long,shard:int>>"))
    on = (ranged["range"] == plan["range"]) & F.when(ranged["heavy"], ranged["key"]).eqNullSafe(plan["group"])
    by_key = F.least(F.floor((F.col("key").cast("double") - F.col("low")) / F.col("width") * F.col("parts")), F.col("parts") - 1)
    by_row = F.pmod(F.xxhash64(F.coalesce("doc_id", "spread"), F.lit(SEED)), F.col("parts"))
    placed = ranged.join(plan, on).select("doc_id", "size", "text_crc32", "key", "heavy", "place", F.when(F.col("heavy"), by_row).otherwise(by_key).cast("long").alias("part"), "cuts")

    part = Window.partitionBy("place", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("place", "part", "key")
    inside = placed.withColumn("before", F.coalesce(F.sum("size").over(part), F.lit(0))).withColumn("group_before", F.min("before").over(own))
    # bytes before each part: of the whole cold line, and of each heavy group
    sums = placed.groupBy("heavy", "place", "part").agg(F.sum("size").alias("bytes"))
    lines = Window.partitionBy("heavy", F.when(F.col("heavy"), F.col("place"))).orderBy("place", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("place", "part", F.coalesce(F.sum("bytes").over(lines), F.lit(0)).alias("start"))
    at = F.col("start") + F.when(F.col("heavy"), F.col("before")).otherwise(F.col("group_before"))
    sharded = cut(inside.join(starts, ["place", "part"]).select("doc_id", "size", "text_crc32", "key", "place", "part", _shard_at(at, F.col("cuts")).alias("shard")))

    counts = sharded.groupBy("shard", "place", "part").count()
    shard_line = Window.partitionBy("shard").orderBy("place", "part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "place", "part", F.coalesce(F.sum("count").over(shard_line), F.lit(0)).alias("first"))
    row = Window.partitionBy("shard", "place", "part").orderBy("key", "doc_id", "size")
    numbered = sharded.withColumn("row", F.row_number().over(row)).join(firsts, ["shard", "place", "part"])
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.col("row") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write the records themselves with all their columns, a folder a shard, in slot order inside files."""
    held = write_shared(docs.drop("shard", "slot").withColumn("_row", F.monotonically_increasing_id()), "records")
    spots = assign_shards(held.select(F.col("_row").alias("doc_id"), "text"), shards).select(F.col("doc_id").alias("_row"), "shard", "slot")
    found = held.join(spots, "_row").drop("_row")
    files = F.floor(F.col("slot") / F.lit(MOST_ROWS))
    found.repartition("shard", files).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
