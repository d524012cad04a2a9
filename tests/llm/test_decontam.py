import random
import re

import numpy as np
import pytest
from vacantia.llm import decontam
from vacantia.llm.fm_index import FMIndex, suffix_array

from .conftest import rows_of

BENCH = "item_id long, text string"


def brute(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for item, body in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), body or ""))
        size = min(13, len(own))
        for k in range(len(own) - size + 1 if own else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == own[k : k + size]:
                    hit.update(range(j, j + size))
                    found.add(str(item))
    return len(words), len(hit), len(found), sorted(found)


def test_suffix_array_and_index_against_brute_force():
    rnd = random.Random(1)
    for _ in range(30):
        text = np.array([rnd.randint(1, 3) for _ in range(rnd.randint(1, 60))])
        closed = [*text.tolist(), 0]
        assert suffix_array(np.array(closed)).tolist() == sorted(range(len(closed)), key=lambda k: closed[k:])
        index = FMIndex(text, 4, sample=3)
        patterns = np.array([[rnd.randint(1, 4) for _ in range(3)] for _ in range(10)])
        found, low, high = index.search(patterns)
        got = {int(p): sorted(index.locate(np.arange(a, b)).tolist()) for p, a, b in zip(found, low, high, strict=True)}
        for k, p in enumerate(patterns.tolist()):
            assert got.get(k, []) == [j for j in range(len(text) - 2) if text[j : j + 3].tolist() == p]


def test_query_against_brute_force(spark, docs):
    texts = [r.text for r in docs.collect()]
    items = [(0, " ".join(texts[60].split()[100:130])), (1, texts[7]), (2, texts[7]), (10, "One Two"), (3, None), (4, "!!"), (5, " ".join(texts[61].split()[-20:])), (1, "kolo")]
    bench = spark.createDataFrame(items, BENCH)
    got = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.digest(decontam.contamination(docs, bench)).collect()}
    import hashlib

    for r in docs.collect():
        n, hit, n_items, ids = brute(r.text, items)
        assert (r.doc_id, n, hit, n_items, hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0 and 20 * hit >= n) in got
    blocked = decontam.contamination(docs, bench, shard_bytes=500, block_words=10)
    assert rows_of(decontam.digest(blocked)) == rows_of(decontam.digest(decontam.contamination(docs, bench)))


def test_removal_and_filter(spark, docs):
    bench = spark.createDataFrame([(0, "a b c")], BENCH)
    some = spark.createDataFrame([(1, "x, A b! c. y"), (2, "clean"), (3, None)], "doc_id long, text string")
    found = decontam.remove_spans(decontam.contamination(some, bench))
    assert {r.doc_id: r.text for r in found.collect()} == {1: "x, . y", 2: "clean", 3: None}
    assert {r.doc_id for r in decontam.drop_contaminated(some, bench).collect()} == {2, 3}


def test_empty_and_clashing(spark, docs, empty, clashing):
    bench = spark.createDataFrame([(0, "kolo ban"), (None, "bast")], BENCH)
    none = spark.createDataFrame([], BENCH)
    assert decontam.contamination(empty, bench).count() == 0
    assert decontam.digest(decontam.contamination(docs, none)).where("n_hit > 0 or contaminated").count() == 0
    own = [c for c in clashing.columns if c not in (decontam.N_WORDS, decontam.SPANS, decontam.ITEMS)]
    assert rows_of(decontam.digest(decontam.contamination(clashing.select(own), bench))) == rows_of(decontam.digest(decontam.contamination(docs, bench)))
    with pytest.raises(ValueError, match="_bench_spans"):
        decontam.contamination(clashing, bench)
    for blocks in (decontam.BLOCK_WORDS, 2):
        kept = decontam.drop_contaminated(clashing, bench)
        assert kept.columns == clashing.columns and rows_of(kept.select(docs.columns)) == rows_of(decontam.drop_contaminated(docs, bench))
