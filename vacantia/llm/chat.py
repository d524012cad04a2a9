"""Cumulative-snapshot collapse of logged conversations, then chat formatting; DataFrame functions alone.

Chat logs often hold a conversation once for every turn it had so far. Each turn gets a position and
a 128-bit hash of position, role and text; the running XOR of these is the hash of the turn prefix
that ends there (two prefixes of one length agree in it only if all their turns do). A conversation
whose whole hash is a proper prefix hash of a longer one is dropped by an anti-join; of equal ones
the smallest conv_id stays. What is left is rendered.

Positions and hashes run on hashes only; text moves once, for the kept conversations. Running
values go by blocks of 256 turn numbers and then within a block, and rendering gives a row a
block, so that no task or row holds an unbounded conversation (nearly all have one block). Blocks of
more than ``BLOCK_TURNS`` turns (rows without ids, many turns under one number) are divided further, by
turn number and by ranges of the first hash, which keeps the order; each division is a ``part``.

Defined results: a turn logged twice (same conversation, turn, role and text) counts once; turns
with one number stand in the order of their hashes; null turn numbers come first; null role or text
differs from the empty one and is rendered as empty; a null conv_id is a conversation of its own,
and counts as the smallest; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BLOCK_BITS = 8  # 256 turn numbers a block
BLOCK_TURNS = 4096
#: Divided blocks up to this number are broadcast (32 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 100_000
BEGIN, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
#: Null ids and turn numbers sort and join as the smallest long.
LEAST = -(1 << 63)


def _keyed(turns: DataFrame) -> DataFrame:
    """``conv`` and ``at`` (ids and turn numbers without nulls), ``block``, two hashes of the turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    nulls = (F.col("role").isNull().cast("int") + 2 * F.col("text").isNull().cast("int")).alias("nulls")
    at = F.coalesce(F.col("turn").cast("long"), F.lit(LEAST))
    return turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(LEAST)).alias("conv"),
        at.alias("at"),
        F.shiftright(at, BLOCK_BITS).alias("block"),
        F.xxhash64(nulls, F.length(role), role, text).alias("h1"),
        F.xxhash64(F.lit("second"), text, role, F.length(text), nulls).alias("h2"),
        role.alias("role"),
        text.alias("text"),
    )


def _parted(turns: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Keyed turns with their ``part`` of a block (0 unless the block is full), and the distinct turns' hashes alike."""
    keyed = _keyed(turns)
    full = cut(keyed.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > most).select("conv", "block", F.ceil(F.col("held") / most).alias("parts")))
    n = full.count()
    if not n:
        parted = keyed.withColumn("part", F.lit(0).cast("long"))
    else:
        # ranges of an even hash: (turn number, range of the hash) is the order of (turn number, hash) made coarse
        spot = F.least(F.floor((F.col("h1").cast("double") / 2.0**64 + 0.5) * F.col("parts")), F.col("parts") - 1)
        held = keyed.join(F.broadcast(full) if n <= BROADCAST_ROWS else full, ["conv", "block"], "left")
        parted = held.withColumn("part", F.coalesce(F.pmod("at", F.lit(1 << BLOCK_BITS)) * F.col("parts") + spot, F.lit(0)).cast("long")).drop("parts")
    return parted, parted.select("conv", "block", "part", "at", "h1", "h2").distinct()


def prefixes(once: DataFrame) -> DataFrame:
    """``conv, n, h1, h2``: the hash of every turn prefix, by its length."""
    spot = ["conv", "block", "part"]
    inside = Window.partitionBy(*spot).orderBy("at", "h1", "h2")
    sizes = once.groupBy(*spot).agg(F.count(F.lit(1)).alias("held"))
    along = Window.partitionBy("conv").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(*spot, F.coalesce(F.sum("held").over(along), F.lit(0)).alias("first"))
    placed = once.withColumn("row", F.row_number().over(inside)).join(firsts, spot).withColumn("n", F.col("first") + F.col("row"))
    mixed = placed.select(*spot, "n", F.xxhash64("n", "h1", "h2").alias("m1"), F.xxhash64("h2", "n", "h1").alias("m2"))
    whole = mixed.groupBy(*spot).agg(F.bit_xor("m1").alias("b1"), F.bit_xor("m2").alias("b2"))
    zero = F.lit(0).cast("long")
    before = whole.select(*spot, F.coalesce(F.bit_xor("b1").over(along), zero).alias("b1"), F.coalesce(F.bit_xor("b2").over(along), zero).alias("b2"))
    run = Window.partitionBy(*spot).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = mixed.withColumn("r1", F.bit_xor("m1").over(run)).withColumn("r2", F.bit_xor("m2").over(run)).join(before, spot)
    return running.select("conv", "n", F.col("r1").bitwiseXOR(F.col("b1")).alias("h1"), F.col("r2").bitwiseXOR(F.col("b2")).alias("h2"))


def maximal(once: DataFrame) -> DataFrame:
    """``conv, n_turns, n_logged`` of the conversations that stay; n_logged counts the equal ones."""
    every = prefixes(once)
    last = every.groupBy("conv").agg(F.max(F.struct("n", "h1", "h2")).alias("whole"))
    whole = last.groupBy("whole.n", "whole.h1", "whole.h2").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_logged"))
    lengths = last.select("conv", F.col("whole.n").alias("of"))
    proper = every.join(lengths, "conv").where("n < of").select("n", "h1", "h2").distinct()
    return whole.join(proper, ["n", "h1", "h2"], "left_anti").select("conv", F.col("n").alias("n_turns"), "n_logged")


def _render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(BEGIN), role, F.lit(MIDDLE), text, F.lit(END))


def format_chats(turns: DataFrame, most: int = BLOCK_TURNS) -> DataFrame:
    """``conv_id, chunk, part, n_turns, n_logged, chunk_turns, text``: rendered maximal conversations, in order of chunk and part."""
    keyed, once = _parted(turns, most)
    rows = keyed.join(maximal(once), "conv")
    turn = F.struct("at", "h1", "h2", "role", "text")
    gathered = rows.groupBy("conv", "block", "part").agg(F.sort_array(F.collect_set(turn)).alias("turns"), F.first("n_turns").alias("n_turns"), F.first("n_logged").alias("n_logged"))
    return gathered.select(
        F.when(F.col("conv") != LEAST, F.col("conv")).alias("conv_id"),
        F.col("block").alias("chunk"),
        "part",
        "n_turns",
        "n_logged",
        F.size("turns").cast("long").alias("chunk_turns"),
        F.concat_ws("", F.transform("turns", lambda t: _render(t["role"], t["text"]))).alias("text"),
    )
