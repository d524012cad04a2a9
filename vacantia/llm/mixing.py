"""Mixing sources to target weights by Sainte-Laguë apportionment; DataFrame functions alone.

Targets: sources in code point order (null last) weigh 3, 1, 2 in turn and share ``share`` times all
words; a target stops at ``cap`` times its source's words and the excess goes to the others by
weight (water filling: one level L, target = min(cap * size, L * weight)).

The mix is made of equal blocks of words. Blocks go to the sources one by one, each to the highest
quotient target / (2 * blocks so far + 1); the order of the seats fills the shards one after the
other, so every shard has an integer quota of each source. A block grows with the corpus, so sources
whose target is under ``FEW`` blocks have no seats among these: they take their target rounded to a
word (the same rule at a divisor of one word) and give each shard an equal part; none is rounded away,
and the others share the remaining seats.

Within a source the documents stand in a seeded order, cut into blocks; blocks are selected from a
seeded start block onward, around the end, first as many as shard 0 has seats, then shard 1, and so on.
So the blocks of a shard are a seeded choice, and only the documents at the ends of a shard's run are
cut between shards. A source taken more than once over goes around again. ``shard`` is the shard that
takes a document's first taken word (null if none is taken).

Words before a document are counted in two steps (hash ranges of a source, then within a range), so
no task holds a whole source. The driver holds two numbers.

Defined results: null or blank text has size 0 and is never taken; a null source is a source of its
own; repeated rows are laid out one by one; an empty table gives no rows; sources without words have
target 0; other columns are ignored, and ``apply_mix`` carries them whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_space_words, cut, whole

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
#: Blocks that the whole mix is made of, about.
BLOCKS = 65_536
#: Sources of fewer blocks take their target to the word.
FEW = 64
SHARDS = 8
SEED = 17
#: Plans of up to this number of sources (some hundred bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 50_000
#: Hash ranges of a source, as bits.
RANGE_BITS = 12


def _hash60(*parts: Column) -> Column:
    """A seeded non-negative hash of 60 bits that other SQL engines have too."""
    text = F.concat_ws(":", F.lit(str(SEED)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``source, source_size`` to these and ``at`` (its place), ``weight, target``. One row a source."""
    everyone = Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    placed = sizes.withColumn("at", F.row_number().over(everyone))
    weighed = placed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("at") - 1) % len(weights) + 1).cast("int")))
    ratio = cap * F.col("source_size") / F.col("weight")
    by_ratio = Window.partitionBy(F.lit(1)).orderBy("ratio", "at")
    before, rest, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(1))
    level = (share * F.sum("source_size").over(whole) - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0))) / F.sum("weight").over(rest)
    levelled = weighed.withColumn("ratio", ratio).withColumn("level", level).withColumn("fits", F.col("level") <= F.col("ratio"))
    first = F.min(F.when(F.col("fits"), F.struct("ratio", "at", "level"))).over(whole)["level"]
    found = levelled.withColumn("found", first)
    full = (cap * F.col("source_size")).cast("double")
    return found.select("source", "source_size", "at", "weight", F.coalesce(F.least(full, F.col("found") * F.col("weight")), full).alias("target"))


def quotas(wanted: DataFrame, block: int, seats: int, shards: int = SHARDS) -> DataFrame:
    """``at, shard, blocks``: the integer quota of each source in each shard, by highest quotients."""
    tries = wanted.where("target > 0").select("at", "target", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("target") / block) + 2)).alias("k"))
    ranked = tries.select("at", (F.col("target") / (2 * F.col("k") + 1)).alias("quotient")).orderBy(F.desc("quotient"), "at").limit(seats)
    turn = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("quotient"), "at")) - 1
    return ranked.select("at", F.floor(turn * shards / F.lit(max(1, seats))).cast("int").alias("shard")).groupBy("at", "shard").agg(F.count(F.lit(1)).alias("blocks"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, blocks: int = BLOCKS, shards: int = SHARDS) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, shard`` of every row."""
    # rows without an id stand where their text's hash says, so that they are spread as others are
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    rows = cut(docs.select("doc_id", "source", count_space_words(F.col("text")).alias("size"), _hash60(name).alias("turn")))
    sizes = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    wanted = targets(sizes, weights, share, cap)
    total = wanted.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    block = max(1, int(total // blocks))
    # sources of few blocks are measured in words
    unit = F.when(F.lit(block > 1) & (F.col("target") < FEW * block), 1).otherwise(block)
    wanted = wanted.withColumn("unit", unit)
    large = wanted.where(F.col("unit") == block)
    seats = int(large.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0] / block + 0.5)
    upto = [F.sum(F.when(F.col("shard") <= k, F.col("blocks")).otherwise(0)) for k in range(shards)]
    given = quotas(large, block, seats, shards).groupBy("at").agg(F.sum("blocks").alias("blocks"), F.array(*upto).alias("upto"))
    size = F.col("source_size")
    seated = F.col("unit") == block
    blocks_of = F.when(seated, F.coalesce("blocks", F.lit(0))).otherwise(F.floor(F.col("target") + 0.5))
    words = F.least(blocks_of * F.col("unit"), cap * size)
    start = F.when(size > 0, F.floor((_hash60(F.col("source")) % size) / F.col("unit")) * F.col("unit")).otherwise(0).cast("long")
    # where each shard's part of the run ends, in words
    ends = F.when(seated, F.transform("upto", lambda e: e * F.col("unit"))).otherwise(F.array(*[F.floor(words * (k + 1) / shards) for k in range(shards)]))
    plan = cut(wanted.join(given, "at", "left").select("at", F.col("source").alias("own"), "source_size", "target", words.alias("words"), start.alias("start"), ends.alias("ends")))
    if plan.count() <= BROADCAST_ROWS:
        plan = F.broadcast(plan)

    laid = rows.join(plan, rows["source"].eqNullSafe(plan["own"]))
    laid = laid.withColumn("range", F.shiftright("turn", 60 - RANGE_BITS))
    inside = Window.partitionBy("at", "range").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranges = laid.groupBy("at", "range").agg(F.sum("size").alias("held"))
    along = Window.partitionBy("at").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = ranges.select("at", "range", F.coalesce(F.sum("held").over(along), F.lit(0)).alias("first"))
    counted = laid.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(firsts, ["at", "range"])
    begin = F.col("first") + F.col("inner")
    end = begin + F.col("size")
    rounds = F.when(size > 0, F.floor(F.col("words") / size)).otherwise(0)
    stop = F.col("start") + F.col("words") - rounds * size
    run = F.greatest(F.lit(0), F.least(end, stop) - F.greatest(begin, F.col("start"))) + F.greatest(F.lit(0), F.least(end, stop - size) - begin)
    first = F.when(end > F.col("start"), F.greatest(begin, F.col("start")) - F.col("start")).otherwise(begin + size - F.col("start"))
    taken = counted.withColumns({"taken": (rounds * F.col("size") + run).cast("long"), "offset": first})
    shard = F.when(F.col("taken") > 0, F.size(F.filter("ends", lambda e: e <= F.col("offset"))))
    return taken.select("doc_id", "source", "size", "source_size", "target", "taken", shard.alias("shard"))


def apply_mix(docs: DataFrame) -> DataFrame:
    """The mix as whole documents: each as often as the mix takes its words, rounded.

    Documents without words cost nothing and stay once. Repeated rows of one id, source and size share
    their copies evenly, rounded.
    """
    plan = mix(docs).groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("n"))
    copies = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / (F.col("size") * F.col("n")) + 0.5)).cast("int")
    plan = plan.select(F.col("doc_id").alias("id"), F.col("source").alias("from"), F.col("size").alias("of"), copies.alias("copies")).where("copies > 0")
    carried = docs.select(whole(docs).alias("doc"), "doc_id", "source", count_space_words(docs["text"]).alias("size"))
    same = carried["doc_id"].eqNullSafe(plan["id"]) & carried["source"].eqNullSafe(plan["from"]) & (carried["size"] == plan["of"])
    return carried.join(plan, same).select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
