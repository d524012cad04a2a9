"""Benchmark decontamination with one FM-index per training shard.

A shard is a run of documents of one partition, up to ``shard_bytes`` of text (a longer document is
a shard by itself). Its words become symbols of the benchmark's vocabulary; runs of words that the
benchmark never uses, and runs shorter than the shortest window, cannot hold an occurrence and are
left out of the index. Every distinct benchmark window is searched backwards through the ranks of a
wavelet matrix, occurrences are located by sampled suffix positions, and overlapping ones are merged
into removal spans. No shuffle: documents never move.

Defined results: null and word-free texts have no words, spans or items and stay as they are; null
or word-free benchmark texts have no windows; repeated document rows are judged row by row; repeated
or equal benchmark items all count, each item id once; other columns of the input are ignored, and
``drop_contaminated`` carries them whatever their names.

Most words of most texts belong to no such run and are never indexed (README has the share): that
changes no result, as an occurrence of a window is a run of the benchmark's words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import whole
from .fm_index import FMIndex

WINDOW = 13
SHARD_BYTES = 4_000_000
#: Words of benchmark text sent to the executors at once; more go in further blocks.
BLOCK_WORDS = 2_000_000

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Columns that the scan adds.
N_WORDS, SPANS, ITEMS = "_bench_words", "_bench_spans", "_bench_items"
SPAN_TYPE = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 text."""
    return text.translate(_FOLD).split()


class Queries:
    """The distinct windows of a block of benchmark items, as symbols of its vocabulary."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words_of((text or "").encode())]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[k : k + window]), set()).add(item)
        by_length: dict[int, list[tuple[int, ...]]] = {}
        for key in owners:
            by_length.setdefault(len(key), []).append(key)
        self.groups = [(np.array(keys, np.int64), [sorted(owners[k]) for k in keys]) for keys in by_length.values()]
        self.shortest = min(by_length, default=0)
        self.sigma = len(self.vocabulary) + 1

    def scan(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """Per text: number of words, merged spans of words, sorted item ids."""
        seen: dict[bytes, int] = {}
        place = [seen.setdefault(t, len(seen)) for t in texts]
        symbols, lengths = [], []
        get = self.vocabulary.get
        for text in seen:
            found = words_of(text)
            lengths.append(len(found))
            symbols.append(np.fromiter((get(w, 0) for w in found), np.int64, len(found)))
        stream = np.concatenate([*symbols, np.zeros(0, np.int64)])
        ends = np.cumsum(lengths, dtype=np.int64)
        spans: list[list[tuple[int, int]]] = [[] for _ in lengths]
        items: list[set[str]] = [set() for _ in lengths]
        at = self._candidates(stream, ends)
        if len(at):
            self._search(stream, at, ends, spans, items)
        return [(lengths[k], spans[k], sorted(items[k])) for k in place]

    def _candidates(self, stream: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Positions in runs of known words, inside one text, that can hold the shortest window."""
        if not self.shortest or not len(stream):
            return np.zeros(0, np.int64)
        known = np.flatnonzero(stream)
        if not len(known):
            return known
        text = np.searchsorted(ends, known, side="right")
        first = np.concatenate(([True], (np.diff(known) > 1) | (np.diff(text) > 0)))
        run = np.cumsum(first) - 1
        return known[np.bincount(run)[run] >= self.shortest]

    def _search(self, stream, at, ends, spans, items) -> None:
        text = np.searchsorted(ends, at, side="right")
        first = np.concatenate(([False], (np.diff(at) > 1) | (np.diff(text) > 0)))
        place = np.arange(len(at)) + np.cumsum(first)  # a separator (symbol 1) before each further run
        joined = np.ones(place[-1] + 1, np.int64)
        joined[place] = stream[at]
        origin = np.zeros(len(joined), np.int64)
        origin[place] = at
        index = FMIndex(joined, self.sigma)
        cover = np.zeros(len(stream) + 1, np.int64)
        for patterns, owners in self.groups:
            hit, low, high = index.search(patterns)
            if not len(hit):
                continue
            size = high - low
            rows = np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            where = origin[index.locate(rows)]
            np.add.at(cover, where, 1)
            np.add.at(cover, where + patterns.shape[1], -1)
            pairs = np.unique(np.stack((np.searchsorted(ends, where, side="right"), np.repeat(hit, size))), axis=1)
            for k, window in pairs.T.tolist():
                items[k].update(owners[window])
        covered = np.concatenate(([0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0]))
        edges = np.flatnonzero(np.diff(covered)).reshape(-1, 2)
        begins = np.concatenate(([0], ends[:-1]))
        for start, end in edges.tolist():
            k = int(np.searchsorted(ends, start, side="right"))
            while start < end:  # neighbouring texts may both be covered at their border
                stop = min(end, int(ends[k]))
                if stop > start:
                    spans[k].append((start - int(begins[k]), stop - int(begins[k])))
                start, k = stop, k + 1


def shards(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > most:
            yield begin, k
            begin, size = k, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _scan(df: DataFrame, queries: Queries, keep: list[str], shard_bytes: int, again: bool) -> DataFrame:
    """Scan ``text`` for a block of windows; pass ``keep`` on; ``again``: merge with what earlier blocks found."""
    held = df.sparkSession.sparkContext.broadcast(queries)
    names = [*keep, N_WORDS, SPANS, ITEMS]
    own = names[len(keep) - 1]
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x or "").encode() for x in batch.column(own).to_pylist()]
            found = [r for a, b in shards(texts, shard_bytes) for r in held.value.scan(texts[a:b])]
            spans, items = [s for _, s, _ in found], [i for _, _, i in found]
            if again:
                spans = [_merge([(x["start"], x["end"]) for x in old] + s) for old, s in zip(batch.column(SPANS).to_pylist(), spans, strict=True)]
                items = [sorted({*old, *i}) for old, i in zip(batch.column(ITEMS).to_pylist(), items, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in keep),
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], span_type),
                    pa.array(items, pa.list_(pa.string())),
                ],
                names=names,
            )

    fields = [df.schema[n] for n in keep]
    return df.mapInArrow(run, StructType([*fields, StructField(N_WORDS, LongType()), StructField(SPANS, SPAN_TYPE), StructField(ITEMS, ArrayType(StringType()))]))


def blocks_of(benchmark: DataFrame, most: int) -> Iterator[list[tuple[str, str | None]]]:
    """Items as text ids, in blocks of about ``most`` words, read one by one; rows without an id count as id ''."""
    block, room = [], most
    for item, text in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").toLocalIterator():
        size = len(text or "") // 2
        if block and size > room:
            yield block
            block, room = [], most
        room -= size
        block.append((item, text))
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``keep`` (default: all columns), number of words, merged word spans of benchmark windows, their item ids.

    The benchmark is a stated query set: it goes to the executors in blocks of at most ``block_words``
    words (one block unless it is very large), each block against all documents; the driver holds one
    block at a time. Columns to keep must not have the names of the three that are added.
    """
    keep = docs.columns if keep is None else keep
    if taken := sorted({N_WORDS, SPANS, ITEMS} & {*keep}):
        raise ValueError(f"columns of these names are added: {', '.join(taken)}")
    own = "_bench_text"
    while own in keep:
        own += "_"
    out = docs.select(*keep, F.col("text").alias(own))
    scanned = False
    for block in blocks_of(benchmark, block_words):
        out = _scan(out, Queries(block, window), [*keep, own], shard_bytes, scanned)
        scanned = True
    return out.drop(own)


def n_hit(spans: str = SPANS) -> Column:
    """Words inside spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))


def is_contaminated() -> Column:
    """The rule: any hit, and at least a twentieth of the words."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col(N_WORDS))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """Text without the words numbered in spans; what follows the last removed word of a span stays."""
    raw = text.encode()
    starts, ends, inside = [], [], False
    for k, c in enumerate(raw.translate(_FOLD) + b" "):
        if (c != 32) != inside:
            (ends if inside else starts).append(k)
            inside = not inside
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, raw[at:]]).decode()


def remove_spans(found: DataFrame) -> DataFrame:
    """Replace ``text`` by the text without its removal spans."""
    schema = found.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            pairs = zip(batch.column(at).to_pylist(), batch.column(SPANS).to_pylist(), strict=True)
            out = [cut_words(text, [(s["start"], s["end"]) for s in spans]) if spans else text for text, spans in pairs]
            yield batch.set_column(at, "text", pa.array(out, pa.string()))

    return found.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        F.col(N_WORDS).alias("n_words"),
        n_hit().alias("n_hit"),
        F.size(ITEMS).cast("long").alias("n_items"),
        F.sha2(F.array_join(ITEMS, ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents, with all their columns, that the rule does not call contaminated; decided row by row."""
    carried = docs.select(whole(docs).alias("doc"), "text")
    return contamination(carried, benchmark, ["doc"]).where(~is_contaminated()).select("doc.*")
