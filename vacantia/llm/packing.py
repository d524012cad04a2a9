"""Token ids packed into rows of one length, best fit decreasing.

Every document becomes its ids and one end-of-text id. Documents of one partition form blocks of up
to ``block_bytes`` of text; each block is packed by itself, so nothing is shuffled and memory is
bounded by a block. Ids beyond a row's length are split losslessly: whole rows first, the rest is a
piece of its own. Pieces go, largest first, to the open row with the least room that still holds
them, found in a segment tree over capacities.

A row of the result is a row of the id matrix: ids (int32, little endian, end-of-text as padding),
cumulative segment lengths from 0 to the ids in use, positions that start at 0 with every segment
(int32; 0 in the padding), and where each segment comes from (document, first id in it).

Defined results: null counts as empty, and an empty text is its end-of-text id alone; special
strings in texts are ordinary text; repeated rows are packed each; an empty table gives no rows;
a doc_id is a long; other columns are ignored; any length is packed whole. Which documents share a
row depends on the blocks, and so on how the input's files are split; every id comes out once anyhow.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = 2048
BLOCK_BYTES = 8_000_000
#: Characters that are tokenized in one call; longer texts are cut before a word.
CALL = 1_000_000


def ranks_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(1)
def encoding(path: str):
    """The tokenizer of a rank file; its free next id ends texts."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), len(ranks)


def _cuts(text: str, most: int) -> Iterator[str]:
    """Parts cut before a single space between two other characters, where a pre-token always begins."""
    at = 0
    while len(text) - at > most:
        end = at + most
        while end < len(text) - 1 and not (text[end] == " " and not text[end - 1].isspace() and not text[end + 1].isspace()):
            end += 1
        if end >= len(text) - 1:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def encode(text: str, path: str) -> np.ndarray:
    """Ids of a text and the end-of-text id."""
    bpe, end = encoding(path)
    ids = [bpe.encode_to_numpy(part, disallowed_special=()) for part in _cuts(text, CALL)]
    return np.concatenate([*ids, [end]]).astype(np.int32)


class CapacityTree:
    """Open rows by the room they have left; finds the least room that is enough."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def _add(self, room: int, n: int) -> None:
        k = room + self.leaves
        while k:
            self.count[k] += n
            k >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """A row with the smallest room of at least ``least``, and its room; it leaves the tree."""
        k = least + self.leaves
        if not self.count[k]:
            while k > 1 and (k & 1 or not self.count[k + 1]):  # up to where a right neighbour holds rows
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        room = k - self.leaves
        self._add(room, -1)
        return self.rows[room].pop(), room


def pack(lengths: list[int], row: int = ROW) -> list[list[tuple[int, int, int]]]:
    """Rows of segments (document, first id, ids); whole rows of overlong documents first."""
    rows: list[list[tuple[int, int, int]]] = []
    pieces = []
    for doc, n in enumerate(lengths):
        rows += [[(doc, at, row)] for at in range(0, n - row + 1, row)]
        if n % row:
            pieces.append((n % row, doc, n - n % row))
    tree = CapacityTree(row)
    for n, doc, at in sorted(pieces, key=lambda p: (-p[0], p[1])):
        found = tree.take(n)
        if found is None:
            rows.append([])
            found = len(rows) - 1, row
        rows[found[0]].append((doc, at, n))
        if found[1] > n:
            tree.put(found[0], found[1] - n)
    return rows


FIELDS = "block string, row int, n_tokens int, n_segments int, doc_ids array<long>, doc_starts array<int>, cu_seqlens array<int>, input_ids binary, position_ids binary"
_TYPES = pa.schema(
    [("block", pa.string()), ("row", pa.int32()), ("n_tokens", pa.int32()), ("n_segments", pa.int32()), ("doc_ids", pa.list_(pa.int64()))]
    + [("doc_starts", pa.list_(pa.int32())), ("cu_seqlens", pa.list_(pa.int32())), ("input_ids", pa.binary()), ("position_ids", pa.binary())]
)


def _packed(docs: list[int | None], ids: list[np.ndarray], row: int, end: int) -> Iterator[pa.RecordBatch]:
    key = hashlib.blake2b(digest_size=8)
    for doc, x in zip(docs, ids, strict=True):
        key.update(f"{doc}:{len(x)};".encode() + x.tobytes())
    out: list[dict] = []
    steps = np.arange(row, dtype=np.int32)
    for k, segments in enumerate(pack([len(x) for x in ids], row)):
        line, place, cu = np.full(row, end, np.int32), np.zeros(row, np.int32), [0]
        for doc, at, n in segments:
            line[cu[-1] : cu[-1] + n] = ids[doc][at : at + n]
            place[cu[-1] : cu[-1] + n] = steps[:n]
            cu.append(cu[-1] + n)
        out.append(
            {"block": key.hexdigest(), "row": k, "n_tokens": cu[-1], "n_segments": len(segments), "doc_ids": [docs[d] for d, _, _ in segments], "doc_starts": [at for _, at, _ in segments]}
            | {"cu_seqlens": cu, "input_ids": line.tobytes(), "position_ids": place.tobytes()}
        )
        if len(out) == 1000:
            yield pa.RecordBatch.from_pylist(out, _TYPES)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, _TYPES)


def pack_documents(docs: DataFrame, path: str | None = None, row: int = ROW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The packed rows of all documents."""
    path = path or ranks_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = encoding(path)[1]
        names, ids, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                if names and size + len(text) > block_bytes:
                    yield from _packed(names, ids, row, end)
                    names, ids, size = [], [], 0
                names.append(doc.as_py())
                ids.append(encode(text, path))
                size += len(text)
        if names:
            yield from _packed(names, ids, row, end)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FIELDS)


def write_packed(docs: DataFrame, out: str, row: int = ROW) -> None:
    """Write the matrices as Parquet: a row group line a matrix row."""
    pack_documents(docs, row=row).write.parquet(out)
