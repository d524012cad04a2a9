"""Token counts by way of distinct pre-tokens; no token id is ever made for a document.

1. Texts are cut at the tokenizer's special strings, as the library does, and then into the
   library's own pre-tokens. Documents of one partition form blocks of up to ``block_bytes`` of text;
   a block becomes one row: its distinct pre-tokens, dealt to buckets by hash, and per document their
   numbers and frequencies.
2. All blocks' pre-tokens of a bucket meet in one task (a row a block, its strings compressed);
   the pieces of each distinct one are counted once.
3. The counts are joined back to the blocks' frequencies and summed per document.

A pre-token of every document is one entry a block, not one a document, so frequent ones make no hot
key; a task remembers the distinct pre-tokens of one bucket at a time. Blocks are made once and written
to the shared folder, from where both sides of the join read them: whatever order a repeated task
reads its documents in, both sides see the same blocks.
Defined results: null counts as empty (0 bytes, 0 tokens); repeated documents are counted row
by row; equal blocks share their counts; a doc_id is a long; other columns are ignored; any length is counted whole
(a document longer than a block is a block by itself).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_shared

BLOCK_BYTES = 8_000_000
LIMIT = 1024
LEAST_BUCKETS = 64


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    stand = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [stand[b] for b in range(256)]


#: Letters up to U+024F; texts of these, printable ASCII and line feeds need no Unicode tables.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_SAFE = re.compile(rf"[\n -~{_LETTERS}]*").fullmatch
_SPLIT = re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+").findall


class PreTokens:
    """Pre-tokens of texts, and their pieces, for a byte-level tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.alphabet = byte_alphabet()

    def split(self, text: str) -> list[str]:
        """As the library cuts; plain texts by an equal pattern that is faster."""
        if _SAFE(text):
            return _SPLIT(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def frequencies(self, text: str) -> tuple[Counter[str], int]:
        """Pre-token frequencies of one text, and its number of special strings."""
        parts = self.special.split(text) if self.special else [text]
        out = Counter(self.split(parts[0]))
        for part in parts[1:]:
            out.update(self.split(part))
        return out, len(parts) - 1

    def pieces(self, pretoken: str) -> int:
        return len(self.tokenizer.model.tokenize("".join(self.alphabet[b] for b in pretoken.encode())))


@lru_cache(1)
def pre_tokens(path: str) -> PreTokens:
    return PreTokens(path)


def _pack(parts: list[np.ndarray]) -> bytes:
    return zlib.compress(np.concatenate([*parts, np.zeros(0, np.int32)]).astype(np.int32).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.int32)


def _block(docs: list[int | None], texts: list[str], path: str, buckets: int) -> dict:
    """One row: the distinct pre-tokens dealt to buckets, numbered through; per document their numbers (as steps) and frequencies."""
    pre, place, key = pre_tokens(path), defaultdict(count().__next__), hashlib.blake2b(digest_size=16)
    numbers, counts, sizes, specials, n_bytes = [], [], [], [], []
    for doc, text in zip(docs, texts, strict=True):
        raw = text.encode()
        key.update(f"{doc}:{len(raw)}:".encode() + raw)
        freq, special = pre.frequencies(text)
        numbers.append(np.fromiter(map(place.__getitem__, freq), np.int32, len(freq)))
        counts.append(np.fromiter(freq.values(), np.int32, len(freq)))
        sizes.append(len(freq))
        specials.append(special)
        n_bytes.append(len(raw))
    tokens = [t.encode() for t in place]
    bucket = np.fromiter((zlib.crc32(t) % buckets for t in tokens), np.int32, len(tokens))
    order = np.argsort(bucket, kind="stable")
    number = np.empty(len(tokens), np.int32)
    number[order] = np.arange(len(tokens), dtype=np.int32)
    for k, own in enumerate(numbers):
        own = number[own]
        turn = own.argsort()
        numbers[k] = np.diff(own[turn], prepend=0)
        counts[k] = counts[k][turn]
    dealt, at = [], 0
    for k, n in zip(*np.unique(bucket, return_counts=True), strict=True):
        dealt.append({"bucket": int(k), "tokens": zlib.compress(GAP.join(tokens[j] for j in order[at : at + n]), 1)})
        at += n
    return {"block": key.hexdigest(), "docs": docs, "n_bytes": n_bytes, "specials": specials, "dealt": dealt, "n_pretokens": len(tokens)} | {
        "sizes": _pack([np.array(sizes)]),
        "numbers": _pack(numbers),
        "counts": _pack(counts),
    }


#: Stands between the pre-tokens of a bucket; no byte of UTF-8.
GAP = b"\xff"
BLOCKS = "block string, docs array<long>, n_bytes array<long>, specials array<int>, dealt array<struct<bucket:int,tokens:binary>>, n_pretokens int, sizes binary, numbers binary, counts binary"
_BLOCK_TYPES = pa.schema(
    [("block", pa.string()), ("docs", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("specials", pa.list_(pa.int32()))]
    + [("dealt", pa.list_(pa.struct([("bucket", pa.int32()), ("tokens", pa.binary())]))), ("n_pretokens", pa.int32())]
    + [("sizes", pa.binary()), ("numbers", pa.binary()), ("counts", pa.binary())]
)


def blocks(docs: DataFrame, path: str, block_bytes: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                if texts and size + len(text) > block_bytes:
                    yield pa.RecordBatch.from_pylist([_block(ids, texts, path, buckets)], _BLOCK_TYPES)
                    ids, texts, size = [], [], 0
                ids.append(doc.as_py())
                texts.append(text)
                size += len(text)
            if texts:
                yield pa.RecordBatch.from_pylist([_block(ids, texts, path, buckets)], _BLOCK_TYPES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, BLOCKS)


def _count(path: str):
    """Pieces of each pre-token; rows come sorted by bucket, and a pre-token has one bucket: each is counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count_one = pre_tokens(path).pieces
        bucket, known = None, {}
        for batch in batches:
            out = []
            for own, tokens in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if own != bucket:
                    bucket, known = own, {}
                found = []
                for t in zlib.decompress(tokens).split(GAP):
                    n = known.get(t)
                    if n is None:
                        n = known[t] = count_one(t.decode())
                    found.append(n)
                out.append(_pack([np.array(found, np.int32)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["block", "bucket", "pieces"])

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            sizes, counts = _unpack(row["sizes"]), _unpack(row["counts"]).astype(np.int64)
            pieces = np.concatenate([np.zeros(0, np.int64), *(_unpack(x["pieces"]) for x in row["found"] or [])])
            if len(pieces) != row["n_pretokens"]:
                raise RuntimeError(f"block {row['block']} has lost counts")
            # numbers are steps inside a document: running sums, less what stood before it
            steps = np.cumsum(_unpack(row["numbers"]), dtype=np.int64)
            ends = np.cumsum(sizes)
            before = np.concatenate(([0], steps))[ends - sizes]
            number = steps - np.repeat(before, sizes)
            sums = np.concatenate(([0], np.cumsum(pieces[number].astype(np.int64) * counts)))
            n = sums[ends] - sums[ends - sizes] + np.array(row["specials"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(row["docs"], pa.int64()), pa.array(row["n_bytes"], pa.int64()), pa.array(n.astype(np.int64))], names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str | None = None, block_bytes: int = BLOCK_BYTES, buckets: int | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every document. More data wants more buckets: 4 a shuffle partition unless given."""
    path = path or tokenizer_path()
    buckets = buckets or max(LEAST_BUCKETS, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = write_shared(blocks(docs, path, block_bytes, buckets), "token-blocks")
    asked = rows.select("block", F.explode("dealt").alias("d")).select("block", "d.bucket", "d.tokens")
    counted = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count(path), "block string, bucket int, pieces binary")
    # equal blocks (repeated rows) ask alike and are answered alike
    found = counted.groupBy("block").agg(F.sort_array(F.collect_set(F.struct("bucket", "pieces"))).alias("found"))
    return rows.drop("dealt").join(found, "block", "left").mapInArrow(_totals, "doc_id long, n_bytes long, n_tokens long")
