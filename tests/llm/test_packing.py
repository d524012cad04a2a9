import random

import numpy as np
from vacantia.llm import packing

from .conftest import rows_of


def unpack(rows, row):
    """Ids by block and document, put together from all rows."""
    out = {}
    for r in rows:
        ids, place = np.frombuffer(bytes(r.input_ids), np.int32), np.frombuffer(bytes(r.position_ids), np.int32)
        assert len(ids) == len(place) == row and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= row
        assert len(r.cu_seqlens) == r.n_segments + 1 == len(r.doc_ids) + 1
        for k, (a, b) in enumerate(zip(r.cu_seqlens, r.cu_seqlens[1:], strict=False)):
            assert place[a:b].tolist() == list(range(b - a)) and b > a
            out.setdefault((r.block, r.doc_ids[k]), []).append((r.doc_starts[k], ids[a:b].tolist()))
        assert not place[r.n_tokens :].any()
    return out


def test_all_ids_come_back(docs):
    path = packing.ranks_path()
    bpe, end = packing.encoding(path)
    unique = docs.where("doc_id is not null and doc_id <> 3")
    back = {}
    for (_, doc), parts in unpack(packing.pack_documents(unique, row=64).collect(), 64).items():
        back[doc] = [x for _, ids in sorted(parts) for x in ids]
    for r in unique.collect():
        assert back[r.doc_id] == [*bpe.encode_ordinary(r.text or ""), end]
    assert sum(r.n_tokens for r in packing.pack_documents(docs).collect()) == sum(len(bpe.encode_ordinary(r.text or "")) + 1 for r in docs.collect())


def test_best_fit_against_brute_force():
    rnd = random.Random(2)
    for _ in range(50):
        lengths = [rnd.randint(1, 40) for _ in range(rnd.randint(1, 60))]
        rows, row = [], 16
        pieces = []
        for d, n in enumerate(lengths):
            rows += [[(d, a, row)] for a in range(0, n - row + 1, row)]
            if n % row:
                pieces.append((n % row, d, n - n % row))
        room = [0] * len(rows)
        for n, _, _ in sorted(pieces, key=lambda p: (-p[0], p[1])):
            fits = [(room[k], k) for k in range(len(room)) if room[k] >= n]
            if fits:
                room[min(fits)[1]] -= n
            else:
                room.append(row - n)
        got = packing.pack(lengths, row)
        assert sorted(row - sum(n for *_, n in r) for r in got) == sorted(room)
        assert sorted((d, a) for r in got for d, a, _ in r) == sorted((d, a) for d, n in enumerate(lengths) for a in range(0, n, row))


def test_capacity_tree():
    tree = packing.CapacityTree(10)
    for row, room in enumerate([3, 7, 7, 10]):
        tree.put(row, room)
    assert [tree.take(4)[1], tree.take(8)[1], tree.take(8), tree.take(1)[1], tree.take(1)[1], tree.take(1)] == [7, 10, None, 3, 7, None]


def test_long_texts_are_cut_before_words():
    text = "word  and\nmore " * 300
    bpe, end = packing.encoding(packing.ranks_path())
    parts = list(packing._cuts(text, 100))
    assert "".join(parts) == text and len(parts) > 10
    assert [x for p in parts for x in bpe.encode_ordinary(p)] == bpe.encode_ordinary(text)


def test_empty_and_clashing(docs, empty, clashing):
    assert packing.pack_documents(empty).count() == 0
    assert rows_of(packing.pack_documents(clashing)) == rows_of(packing.pack_documents(docs))
