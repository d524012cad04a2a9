"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits come from the XXH64 of word shingles. Only distinct fingerprints are
compared. They are cut into m segments; with a limit of r differing bits, some segment of two linked
fingerprints differs in at most floor(r / m) bits (in one less beyond the first r mod m + 1
segments). Each fingerprint stands in one table bucket a segment, and asks the buckets of the small
Hamming ball around its own segment; complete distances decide. m is chosen from the number of
distinct fingerprints, weighing a shuffled row against a comparison in numpy: more, narrower segments
mean fewer rows (24 a fingerprint at m = 4, 50 at m = 3), but fuller buckets; m never exceeds r, so
that some balls are enumerated. With r = 4, m is 4 up to some 40 million and 3 up to 14 billion.

Buckets above ``BUCKET`` fingerprints are dealt in pieces to several tasks, with the questions sent
to each piece. A task compares numpy blocks and gives back only the edges that join something new,
so a dense group of n fingerprints gives about n edges a bucket, never all pairs; no link between
components is lost. Components then grow by repeated hooking to the smallest neighbour and pointer
jumping, distributed, each round written to the shared folder.

``keep_first``, the pipeline's stage, has a bar of its own: sets of five-word shingles of which two
texts share 0.8. Its fingerprints are longer, since at that bar every bit differs with a chance of
``acos(8/9) / pi``, 0.152: of 64 bits some ten, beyond any ball. They are cut into so many segments that
two texts at the bar share one unless by a chance stated below, each segment asks its own bucket alone
(a ball of radius 0 gives most pairs a row), and the distance over ``CHECK`` further words decides which
are linked (``long_links``). Components of the links are candidates; within them the texts themselves
decide (``near_copies``), and groups grow in the same way.

Defined results: null or blank text has fingerprint zero, linked like any other; repeated rows and
equal texts share fingerprint and component; a null doc_id counts as no smallest id unless a
component has no other; other columns are ignored; the whole text is used whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join, whole, write_shared

SHINGLE = 4
BITS = 64
RADIUS = 4
SEED = 42
#: Fingerprints of a bucket that one task takes at once.
BUCKET = 4096
#: Full buckets up to this number are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Buckets with a table of so many fingerprints or fewer are compared all together.
SMALL = 16
#: Cost of a comparison (some 4 ns in numpy) against that of a row shuffled to a bucket (some 2 microseconds); weighs the choice of m.
TEST_COST = 0.002
#: Near copies: words of a shingle and percent of shingles to share, of all that either text has.
WORDS = 5
LIKE = 80
#: Bits of a segment of the long fingerprints, at least; a bit more each time their buckets exceed ``BUCKET`` on average.
WIDTH = 12
#: Chance that a bit differs at the bar, the worst of all sizes of sets (of four shingles and five; 0.152 for large ones), and that no segment is shared then.
APART, MISS = 0.1875, 1e-4
#: Words of the long fingerprints whose bits make the distance, and how many may differ: 29 do at the bar, with a deviation of 5, and 96 of unlike texts.
CHECK, FAR = 3, 60
#: Long fingerprints of a bucket that one task holds at once; buckets up to ``FEW`` are compared all together.
HELD = 1 << 16
FEW = 64
#: Texts of a group that one task holds at once.
PIECE = 2048

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined shingles, repeats included."""
    words = (text or "").encode().translate(_FOLD).split()
    if not words:
        return np.zeros(0, np.uint64)
    one = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([one(b" ".join(words), SEED)], np.uint64)
    line = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-size])).tolist()
    ends = (ends[size - 1 :] - 1).tolist()
    return np.fromiter((one(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(ends))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit k is 1 if over half the hashes have it; no hashes give 0."""
    total = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        some = hashes[k : k + (1 << 15)].astype(">u8").view(np.uint8)
        total += np.unpackbits(some).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint as a signed long."""
    schema = docs.select(*keep, F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(shingle_hashes(x.as_py(), shingle)) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.array(fps, np.uint64).view(np.int64))], names=[*keep, "fp"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def segments(n: int, radius: int = RADIUS) -> list[tuple[int, int, int]]:
    """(shift, width, radius of the ball) of each segment, for n distinct fingerprints."""
    from math import comb

    best: tuple[float, list[tuple[int, int, int]]] | None = None
    for m in range(1, max(1, radius) + 1):
        near, first = radius // m, radius % m + 1
        balls = [near if k < first else near - 1 for k in range(m)]
        wide = [max(0, b) for b in balls]
        # wider segments where the balls are larger
        weight = [1.0 + 0.1 * b for b in wide]
        widths = [int(BITS * w / sum(weight)) for w in weight]
        for k in range(BITS - sum(widths)):
            widths[k % m] += 1
        questions = sum(sum(comb(w, d) for d in range(b + 1)) for w, b in zip(widths, balls, strict=True) if b >= 0)
        tests = sum(n * sum(comb(w, d) for d in range(b + 1)) / 2.0**w for w, b in zip(widths, balls, strict=True) if b >= 0)
        cost = m + questions + TEST_COST * tests
        if best is None or cost < best[0]:
            shifts = [BITS - sum(widths[: k + 1]) for k in range(m)]
            best = (cost, [(s, w, b) for s, w, b in zip(shifts, widths, balls, strict=True) if b >= 0])
    return best[1]


def _ball(width: int, radius: int) -> list[int]:
    """Masks of at most radius bits."""
    from itertools import combinations

    return [sum(1 << k for k in bits) for d in range(radius + 1) for bits in combinations(range(width), d)]


class _Forest:
    """Labels of the fingerprints of one bucket; ``join`` gives an edge only where it joins two labels."""

    def __init__(self, held: np.ndarray):
        self.held = held
        self.label = np.arange(len(held))

    def join(self, asked: np.ndarray, radius: int) -> list[tuple[int, int]]:
        edges, step = [], max(1, (1 << 22) // len(self.held))
        for k in range(0, len(asked), step):
            some = asked[k : k + step]
            near = np.bitwise_count(some[:, None] ^ self.held[None, :]) <= radius
            near &= some[:, None] != self.held[None, :]
            for x in np.flatnonzero(near.any(axis=1)):
                at = np.flatnonzero(near[x])
                found, first = np.unique(self.label[at], return_index=True)
                edges.append((int(some[x]), int(self.held[at[first[0]]])))
                for j in first[1:]:
                    edges.append((int(some[x]), int(self.held[at[j]])))
                if len(found) > 1:
                    self.label[np.isin(self.label, found[1:])] = found[0]
        return edges


def _edges(radius: int):
    """Rows come sorted by bucket, the table's rows first: (bucket, piece, asks, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, forest = None, [], None
        out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            if not batch.num_rows:
                continue
            spot = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])
            asks = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            fps = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
            change = np.flatnonzero(np.any(spot[:, 1:] != spot[:, :-1], axis=0)) + 1
            begins = np.concatenate(([0], change))
            ends = np.concatenate((change, [len(fps)]))
            tables = np.add.reduceat((~asks).astype(np.int64), begins)
            inner = np.ones(len(begins), bool)  # buckets that lie in this batch alone
            inner[[0, -1]] = False
            # questions of small buckets meet their tables at once, over all such buckets
            small = inner & (tables <= SMALL)
            bucket = np.repeat(np.arange(len(begins)), ends - begins)
            asking = np.flatnonzero(small[bucket] & asks)
            times = tables[bucket[asking]]
            place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            one, other = fps[np.repeat(begins[bucket[asking]], times) + place], np.repeat(fps[asking], times)
            near = (np.bitwise_count(one ^ other) <= radius) & (one != other)
            edges = np.stack((other[near], one[near]), axis=1).tolist()
            rest = ~small & (~inner | (tables < ends - begins))
            for a, b, n in zip(begins[rest].tolist(), ends[rest].tolist(), tables[rest].tolist(), strict=True):
                here = (int(spot[0, a]), int(spot[1, a]), int(spot[2, a]))
                if here != key:
                    key, held, forest = here, [], None
                if n:
                    held.append(fps[a : a + n])
                if n < b - a and held:
                    if forest is None:
                        forest = _Forest(np.concatenate(held))
                    edges += forest.join(fps[a + n : b], radius)
            if edges:
                pairs = np.array(edges, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], schema=out)

    return run


def links(fps: DataFrame, n: int, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints (column ``fp``) that connect all that lie within the radius."""
    parts = segments(n, radius)
    table = None
    for k, (shift, width, ball) in enumerate(parts):
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
        own = fps.select(F.lit(k).alias("segment"), value.alias("value"), "fp")
        asked = own.select("segment", F.explode(F.array(*(F.lit(x) for x in _ball(width, ball)))).alias("mask"), "value", "fp").select("segment", F.col("value").bitwiseXOR(F.col("mask")).alias("value"), "fp")
        rows = own.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)))
        table = rows if table is None else table.unionByName(rows)
    # pieces of full buckets: a table row goes to one piece, a question to all
    full = cut(table.where(~F.col("asks")).groupBy("segment", "value").count().where(F.col("count") > bucket).select("segment", "value", F.ceil(F.col("count") / bucket).cast("int").alias("pieces")))
    n_full = full.count()
    if not n_full:
        wide = table.withColumn("pieces", F.lit(1))
    else:
        wide = table.join(F.broadcast(full) if n_full <= BROADCAST_ROWS else full, ["segment", "value"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    every = F.sequence(F.lit(0), F.col("pieces") - 1)
    piece = F.when(F.col("asks"), every).otherwise(F.array(F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")))
    dealt = wide.select("segment", "value", F.explode(piece).alias("piece"), "asks", "fp").repartition("segment", "value", "piece").sortWithinPartitions("segment", "value", "piece", "asks")
    return dealt.mapInArrow(_edges(radius), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of each connected component, for nodes with edges.

    Alternating large-star and small-star rounds until nothing changes. Neighbour lists are never
    collected: a star is an aggregate and a join. Every round's edges are written and read again: a
    checkpoint keeps the planner's estimate of its size, for a join the product of both sides, which
    would grow to some four times the digits a round and fill the driver.
    """
    both = lambda e: e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = write_shared(edges.where("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).select("a", "b").distinct(), "edges")
    seen, size = None, now.count()
    while True:
        # large star: larger neighbours of a node hang on the smallest of the node and its neighbours
        around = both(now)
        low = cut(around.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n"))
        large = cut(spread_join(around.where("b > a"), low, "a", 2 * size).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # small star: a node and its smaller neighbours hang on the smallest of them
        least = cut(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
        small = spread_join(large, least, "a", size).select(F.col("b").alias("x"), "m").unionAll(least.select(F.col("a").alias("x"), "m"))
        now = write_shared(small.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, size = mark, mark[0]


def near_duplicates(docs: DataFrame, keep: list[str] | None = None, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``keep`` columns (default doc_id), ``fp`` and ``component_id``, the smallest doc_id reachable by links."""
    keep = keep or ["doc_id"]
    if taken := sorted({"fp", "component_id", "n"} & {*keep}):
        raise ValueError(f"columns of these names are added or used: {', '.join(taken)}")
    marked = cut(fingerprints(docs, keep, shingle))
    known = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")))
    n = known.count()
    edges = links(known.select("fp"), n, radius)
    # the smallest doc_id of a component, then of every fingerprint in it
    named = cut(known.join(components(edges).withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "rows", F.coalesce("root", "fp").alias("root")))
    owner = cut(named.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n")))
    owners = cut(spread_join(named, owner, "root", n).select("fp", "component_id", F.col("rows").alias("n")))
    return spread_join(marked, owners, "fp", marked.count()).select(*keep, "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs ``a, b`` of ``a, b, left, right`` whose texts share ``LIKE`` of their shingles; empty sets are equal."""
    seen: dict[int, np.ndarray] = {}

    def shingles(node: int, text: str | None) -> np.ndarray:
        if node not in seen:
            if len(seen) >= 256:
                seen.clear()
            seen[node] = np.unique(shingle_hashes(text, WORDS))
        return seen[node]

    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        near = []
        for x, y, left, right in zip(a, b, batch.column("left"), batch.column("right"), strict=True):
            one, other = shingles(x, left.as_py()), shingles(y, right.as_py())
            both = len(np.intersect1d(one, other, assume_unique=True))
            near.append(100 * both >= LIKE * (len(one) + len(other) - both))
        yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))


def _common(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``one`` shares with each of ``other``."""
    out = np.zeros((len(one), len(other)), np.int64)
    flat = np.concatenate([*one, *other])
    rows = np.repeat(np.arange(len(one) + len(other)), [len(s) for s in (*one, *other)])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    rows, column = rows[count[column] > 1], column[count[column] > 1]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, (k, k + 4096))
        has = np.zeros((len(one) + len(other), 4096), np.float32)
        has[rows[a:b], column[a:b] - k] = 1
        out += (has[: len(one)] @ has[len(one) :].T).astype(np.int64)
    return out


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges ``a, b`` that join roots within a bucket's piece; rows come sorted by key, piece, asks."""
    spot, held, asks = None, [], []
    over: dict[int, int] = {}
    edges: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while over.get(x, x) != x:
            over[x] = over.get(over[x], over[x])
            x = over[x]
        return x

    def compare(left: list, right: list) -> None:
        if not left or not right:
            return
        both = _common([s for *_, s in left], [s for *_, s in right])
        sizes = [np.array([len(s) for *_, s in side]) for side in (left, right)]
        near = 100 * both >= LIKE * (sizes[0][:, None] + sizes[1][None, :] - both)
        near &= np.array([r for _, r, _ in left])[:, None] != np.array([r for _, r, _ in right])[None, :]
        for i, j in np.argwhere(near):
            x, y = find(left[i][1]), find(right[j][1])
            if x != y:
                over[max(x, y)] = min(x, y)
                edges.append((left[i][0], right[j][0]))

    def done() -> list[pa.RecordBatch]:
        nonlocal asks, edges
        compare(held, asks)
        found, asks, edges = edges, [], []
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return [pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])] if found else []

    own = False
    for batch in batches:
        for key, piece, ask, node, root, text in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if (key, piece) != spot or (ask and not own):
                if not own:
                    compare(held, held)
                if (key, piece) != spot:
                    yield from done()
                    spot, held, own = (key, piece), [], False
                    over.clear()
                own = ask
            (asks if ask else held).append((node, root, np.unique(shingle_hashes(text, WORDS))))
            if len(asks) >= PIECE:
                yield from done()
    if not own:
        compare(held, held)
    yield from done()


def long_segments(n: int) -> tuple[int, int]:
    """Bits of a segment and number of segments of the long fingerprints, for n texts."""
    from math import ceil, log, log2

    width = max(WIDTH, ceil(log2(max(1, n) / BUCKET)))
    return width, ceil(log(MISS) / log(1 - (1 - APART) ** width))


def long_words(n: int) -> int:
    """Words of a long fingerprint: those of the distance, then the segments, as many as fit in each word."""
    width, number = long_segments(n)
    return CHECK - -number // (BITS // width)


@cache
def _mixers(words: int) -> np.ndarray:
    masks, odds, more = np.random.default_rng(SEED).integers(0, 1 << 64, (words, 3), np.uint64).T
    return np.stack((masks, odds | np.uint64(1), more | np.uint64(1)))


def _mixed(hashes: np.ndarray, words: int) -> np.ndarray:
    """So many independent words a hash."""
    masks, odds, more = _mixers(words)
    out = (hashes[:, None] ^ masks) * odds
    out ^= out >> np.uint64(32)
    out *= more
    return out ^ (out >> np.uint64(32))


def long_fingerprint(shingles: np.ndarray, words: int) -> np.ndarray:
    """A bit is 1 if over half the distinct shingles have it; the least shingle decides a tie. No shingles give 0."""
    total = np.zeros(BITS * words, np.int64)
    for k in range(0, len(shingles), 255):
        total += np.unpackbits(_mixed(shingles[k : k + 255], words).view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    if len(shingles):
        total = 2 * total + np.unpackbits(_mixed(shingles[:1], words).view(np.uint8))
    return np.packbits(total > len(shingles)).view(np.uint64)


def _identity(fps: np.ndarray) -> np.ndarray:
    """One word for the words of the distance."""
    return (fps * np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)).sum(axis=1, dtype=np.uint64)


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(x.as_py(), WORDS)) for x in batch.column("text")]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            fps = np.array([long_fingerprint(s, words) for s in sets], np.uint64).reshape(-1, words)
            held = pa.array(list(fps.view(np.int64)), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), pa.array(_identity(fps[:, :CHECK]).view(np.int64)), held], names=["row", "node", "size", "fp", "words"])

    return run


class _Span:
    """Labels of the long fingerprints that a task holds of one bucket; ``join`` gives an edge only where it joins two labels."""

    def __init__(self, fps: np.ndarray):
        self.fps, self.ids, self.label = fps, _identity(fps), np.arange(len(fps))

    def join(self, fps: np.ndarray, own: bool = False) -> list[tuple[int, int]]:
        """Edges of ``fps`` to those held; ``own``: of those held among each other."""
        edges, ids, label, step = [], _identity(fps), self.label, max(1, (1 << 16) // len(self.fps))
        for k in range(0, len(fps), step):
            begin = k if own else 0
            some, held = fps[k : k + step], self.fps[begin:]
            apart = sum(np.bitwise_count(some[:, None, w] ^ held[None, :, w]) for w in range(CHECK))
            near = (apart <= FAR) & (ids[k : k + step, None] != self.ids[None, begin:])
            for x in np.flatnonzero(near.any(axis=1)).tolist():
                at = begin + np.flatnonzero(near[x])
                mine = label[k + x] if own else None
                at = at[label[at] != mine] if own else at
                while len(at):
                    met = label[at[0]]
                    edges.append((int(ids[k + x]), int(self.ids[at[0]])))
                    if mine is None:
                        mine = met
                    label[label == met] = mine
                    at = at[label[at] != mine]
        return edges


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by ``spot``, twice the bucket's piece and one more for a question to it; edges between identities."""
    here, held, span = None, [], None

    def packed(edges: list) -> Iterator[pa.RecordBatch]:
        if edges:
            pairs = np.array(edges, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        spot = batch.column(0).to_numpy(zero_copy_only=False)
        fps = np.stack([batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(1, 1 + CHECK)], axis=1)
        begins = np.concatenate(([0], np.flatnonzero(spot[1:] != spot[:-1]) + 1))
        ends = np.append(begins[1:], len(spot))
        # small buckets that lie in this batch alone, without questions, are compared at once
        small = (spot[begins] % 2 == 0) & (ends - begins <= FEW)
        small[[0, -1]] = False
        small[:-1] &= spot[begins[1:]] // 2 != spot[begins[:-1]] // 2
        small_row = np.repeat(small, ends - begins)
        times = np.where(small_row, np.repeat(ends, ends - begins) - np.arange(len(spot)) - 1, 0)
        one = np.repeat(np.arange(len(spot)), times)
        other = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(times) - times, times)
        apart = sum(np.bitwise_count(fps[one, w] ^ fps[other, w]) for w in range(CHECK))
        near = apart <= FAR
        edges = np.stack((_identity(fps[one[near]]), _identity(fps[other[near]])), axis=1)
        edges = edges[edges[:, 0] != edges[:, 1]].tolist()
        for a, b in zip(begins[~small].tolist(), ends[~small].tolist(), strict=True):
            bucket, asks = int(spot[a]) // 2, int(spot[a]) % 2
            if held and span is None and (bucket != here or asks):
                span = _Span(np.concatenate(held))
                edges += span.join(span.fps, own=True)
            if bucket != here:
                here, held, span = bucket, [], None
            if not asks:
                held.append(fps[a:b])
            elif span is not None:
                edges += span.join(fps[a:b])
        yield from packed(edges)
    if held and span is None:
        span = _Span(np.concatenate(held))
        yield from packed(span.join(span.fps, own=True))


def long_links(nodes: DataFrame, n: int, held: int | None = None) -> DataFrame:
    """Edges ``a, b`` between identities of long fingerprints (column ``words``, for n texts) that share a segment and differ in at most ``FAR`` bits.

    A bucket of more than ``held`` is dealt in pieces: a fingerprint is held in one and asks those after it. Which
    are so full is told from one in 16 fingerprints, which decides the number of pieces alone.
    """
    held = held or HELD
    width, number = long_segments(n)
    per = BITS // width
    value = f"shiftrightunsigned(words[{CHECK} + cast(floor(s / {per}) as int)], cast(s % {per} as int) * {width}) & {(1 << width) - 1}L"
    table = nodes.select("words", F.explode(F.sequence(F.lit(0), F.lit(number - 1))).alias("s")).select(F.expr(f"s * {1 << width}L + ({value})").alias("key"), *(F.col("words")[k].alias(f"f{k}") for k in range(CHECK)))
    mark = F.xxhash64(*(f"f{k}" for k in range(CHECK)))
    full = cut(table.where(F.pmod(mark, F.lit(16)) == 0).groupBy("key").count().where(F.col("count") > held / 16).select("key", F.ceil(16 * F.col("count") / held).cast("int").alias("pieces")))
    n_full = full.count()
    if not n_full:
        dealt = table.withColumn("spot", F.col("key") * (1 << 17))
    else:
        wide = table.join(F.broadcast(full) if n_full <= BROADCAST_ROWS else full, "key", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
        wide = wide.withColumn("own", F.pmod(F.shiftright(mark, 8), F.col("pieces")).cast("int")).withColumn("piece", F.explode(F.sequence("own", F.col("pieces") - 1)))
        dealt = wide.withColumn("spot", F.col("key") * (1 << 17) + F.col("piece") * 2 + (F.col("own") != F.col("piece")).cast("int"))
    dealt = dealt.select("spot", *(f"f{k}" for k in range(CHECK))).repartition(F.shiftright("spot", 1)).sortWithinPartitions("spot")
    return dealt.mapInArrow(_close, "a long, b long")


def near_copies(rows: DataFrame) -> DataFrame:
    """``row, root`` of rows (``row``, ``text``): one root for texts joined by shares of ``LIKE`` percent and more.

    Texts with one set of shingles are one node. Nodes whose long fingerprints are linked, over others too, are
    one group of candidates. Every node is held against the least of its group, and those of a group that are
    then still apart against each other, within the task that holds the group or a piece of it:
    texts decide, not fingerprints, and a task returns spanning edges only.
    """
    count = rows.count()
    marked = write_shared(rows.select("row", "text").mapInArrow(_sketches(long_words(count)), "row long, node long, size long, fp long, words array<long>"), "sketches")
    nodes = cut(marked.groupBy("node").agg(F.min("row").alias("row"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("words").alias("words")))
    group = components(long_links(nodes, count)).select(F.col("node").alias("fp"), F.col("root").alias("key"))
    dealt = cut(nodes.select("node", "row", "size", "fp").join(group, "fp", "left").select("node", "row", "size", F.coalesce("key", "fp").alias("key")))
    kinds = cut(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "size")).alias("low")).where("n > 1").select("key", "n", F.col("low.node").alias("low"), F.col("low.size").alias("m")))
    members = cut(spread_join(dealt, kinds, "key", count))
    texts = write_shared(members.select("node", "row").join(rows.select("row", "text"), "row").select("node", "text"), "candidates")
    # a node is first held against the least of its group alone, so roots follow without rounds
    ends = members.where("node <> low").where(100 * F.least("size", "m") >= LIKE * F.greatest("size", "m")).select(F.col("low").alias("b"), F.col("node").alias("a"))
    right, left = texts.select(F.col("node").alias("b"), F.col("text").alias("right")), texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    edges = cut(ends.join(right, "b").join(left, "a").select("a", "b", "left", "right").mapInArrow(_similar, "a long, b long"))
    near = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    placed = cut(members.select("key", "node").join(near, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")))
    apart = cut(placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y").select("key", F.ceil(F.col("n") / PIECE).cast("int").alias("pieces"), "n"))
    found = placed.select("node", "root")
    # a node is held in one piece of its group and asks those after it
    placed = spread_join(placed, apart, "key", placed.count()).withColumn("own", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    placed = placed.select("key", "node", "root", "own", F.explode(F.sequence("own", F.col("pieces") - 1)).alias("piece"))
    placed = placed.join(texts, "node").select("key", "piece", (F.col("own") != F.col("piece")).alias("asks"), "node", "root", "text")
    more = cut(placed.repartition("key", "piece").sortWithinPartitions("key", "piece", "asks").mapInArrow(_alike, "a long, b long"))
    root = found if more.isEmpty() else components(edges.unionAll(more))
    return marked.select("row", "node").join(root, "node", "left").select("row", F.coalesce("root", "node").alias("root"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: the one with the smallest doc_id (null last); of several with that id the smallest row."""
    held = write_shared(docs.select(whole(docs).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    rows = held.select("row", F.col("doc.doc_id").alias("id"), F.col("doc.text").alias("text"))
    placed = cut(near_copies(rows).join(rows.select("row", "id"), "row"))
    least = cut(placed.groupBy("root").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    firsts = cut(spread_join(placed, least, "root", placed.count()).where(F.col("id").eqNullSafe(F.col("least"))).select("root", "row"))
    counts = firsts.groupBy("root").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n"))
    once = held.join(counts.where("n = 1").select("row"), "row", "left_semi").select("doc")
    often = firsts.join(counts.where("n > 1").select("root"), "root").join(held, "row").groupBy("root").agg(F.min("doc").alias("doc")).select("doc")
    return once.unionByName(often).select("doc.*")
