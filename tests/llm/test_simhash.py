import random
import re
import time

import numpy as np
import xxhash
from pyspark.sql import functions as F
from vacantia.llm import simhash

from .conftest import rows_of


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(fps))]


def test_query_against_brute_force(docs):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    roots = brute_components([i for i, _ in rows], [f for _, f in rows])
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(rows, roots, strict=True)), key=repr)
    assert rows_of(simhash.digest(simhash.near_duplicates(docs))) == want


def test_links_connect_all_within_the_radius(spark):
    rnd = random.Random(4)
    fps = {rnd.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:12]:  # chains and dense families
        for _ in range(25):
            for _ in range(rnd.randint(1, 4)):
                f ^= 1 << rnd.randrange(64)
            fps.add(f)
    dense = rnd.getrandbits(64)
    fps |= {dense ^ rnd.getrandbits(6) for _ in range(60)}
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    known = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = brute_components(signed, fps)
    for n, bucket in ((len(fps), 4096), (len(fps), 7), (10**9, 4096), (10**11, 4096)):
        root = {r.node: r.root for r in simhash.components(simhash.links(known, n, bucket=bucket)).collect()}
        assert [root.get(s, s) for s in signed] == want
    edges = simhash.links(known, len(fps))
    assert edges.count() < 40 * len(fps)


def test_rounds_do_not_add_up_in_the_plan(spark, monkeypatch):
    """Over the rounds of a chain, the planner's estimates stay those of one round: they hold the driver's memory."""
    bits, cut = [], simhash.cut

    def noted(df):
        out = cut(df)
        bits.append(out._jdf.queryExecution().analyzed().stats().sizeInBytes().bit_length())
        return out

    monkeypatch.setattr(simhash, "cut", noted)
    edges = spark.range(32).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = simhash.components(edges)
    assert sorted(map(tuple, found.collect())) == [(k, 0) for k in range(1, 33)]
    assert len(bits) > 12 and max(bits) < 100


def test_segments_cover_the_radius():
    for n in (10, 10**5, 10**7, 10**9):
        parts = simhash.segments(n)
        assert sum(w for _, w, _ in parts) == 64 and max(b for *_, b in parts) >= 1
        assert sum(b + 1 for *_, b in parts) > simhash.RADIUS
        assert len(parts) + sum(len(simhash._ball(w, b)) for _, w, b in parts) < 60  # rows a fingerprint sends to buckets


def test_one_of_each_group_stays(docs, clashing):
    kept = simhash.keep_first(docs)
    firsts = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(f for f in firsts if f is not None)
    assert kept.columns == docs.columns and simhash.keep_first(clashing).columns == clashing.columns


def test_empty_and_clashing(docs, empty, clashing):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0
    assert rows_of(simhash.near_duplicates(clashing)) == rows_of(simhash.near_duplicates(docs))


def test_native_hash_is_the_same(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("a b c dé"))).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest("a b c dé".encode(), 42)


def test_near_copies_share_their_shingles(spark):
    """Pairs planted about the bar, against brute force; most are too far apart for op5's four bits."""
    rnd = random.Random(8)
    texts = []
    for _ in range(120):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(60, 240))]
        other = list(words)
        for at in rnd.sample(range(len(words)), max(1, round(len(words) * rnd.uniform(0.005, 0.035)))):
            other[at] = "changed"
        texts += [" ".join(words), " ".join(other)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    like = [len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1]) for k in range(0, len(sets), 2)]
    assert sum(0.8 <= x < 0.95 for x in like) > 20 and sum(0.5 < x < 0.8 for x in like) > 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {k for k in range(len(texts)) if k % 2 == 0 or like[k // 2] < 0.8}
    assert {r.doc_id for r in simhash.keep_first(docs).collect()} == want


def test_near_copies_within_one_bucket(spark):
    """A chain whose ends are below the bar is one group, though neighbours alone reach it."""
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join(words[k : k + 150]) for k in range(0, 50, 10)] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in simhash.keep_first(docs).collect()] == [0]


def test_near_copies_of_one_template(spark, monkeypatch):
    """A group of near copies, of which many pairs are below the bar, in whole buckets and in pieces."""
    rnd = random.Random(3)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for _ in range(150):
        words = list(base)
        for at in rnd.sample(range(150), rnd.randint(2, 5)):
            words[at] = f"x{rnd.randrange(9)}"
        texts.append(" ".join(words))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    first = {}
    for k, g in enumerate(group):
        first.setdefault(g, k)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for piece in (simhash.PIECE, 16):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert {r.doc_id for r in simhash.keep_first(docs).collect()} == set(first.values())


def at_the_bar(rnd, size):
    """Two sets of shingle hashes that share just 0.8 of their union, or the next more."""
    both = rnd.integers(0, 1 << 63, size).astype(np.uint64)
    apart = rnd.integers(0, 1 << 63, size // 4).astype(np.uint64)
    cut = int(rnd.integers(0, len(apart) + 1))
    return np.unique(np.append(both, apart[:cut])), np.unique(np.append(both, apart[cut:]))


def test_long_fingerprints_reach_the_bar():
    """Pairs at the bar share segments and lie within the distance; unlike ones do not."""
    rnd = np.random.default_rng(2)
    width, number = simhash.long_segments(10**6)
    per, words = 64 // width, simhash.long_words(10**6)
    assert words == simhash.CHECK + -(-number // per)
    shared, far, unlike = [], [], []
    for size in (4, 8, 20, 60, 300):
        for _ in range(60):
            x, y = (simhash.long_fingerprint(s, words) for s in at_the_bar(rnd, size))
            cut = lambda f: [int(f[simhash.CHECK + k // per]) >> k % per * width & (1 << width) - 1 for k in range(number)]
            shared.append(sum(a == b for a, b in zip(cut(x), cut(y), strict=True)))
            far.append(int(np.bitwise_count(x[: simhash.CHECK] ^ y[: simhash.CHECK]).sum()))
            other = simhash.long_fingerprint(at_the_bar(rnd, size)[0], words)
            unlike.append(int(np.bitwise_count(x[: simhash.CHECK] ^ other[: simhash.CHECK]).sum()))
    assert min(shared) > 0 and np.mean(shared) > 10 and max(far) <= simhash.FAR < min(unlike)


def test_long_links_connect_what_shares_a_segment(spark):
    """Against all pairs, in whole buckets and in pieces: a dense family, chains and unlike fingerprints."""
    rnd = random.Random(6)
    width, number = simhash.long_segments(100)
    per, words = 64 // width, simhash.long_words(100)
    fps = [[rnd.getrandbits(64) for _ in range(words)] for _ in range(40)]
    for base, n, most in ((fps[0], 150, 1), (fps[1], 30, 4), (fps[2], 30, 8)):
        for _ in range(n):
            base = [w ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, most))) for w in (base if most > 1 else fps[0])]
            fps.append(base)
    held = np.array(fps, np.uint64)
    ids = simhash._identity(held[:, : simhash.CHECK])
    cut = np.stack([held[:, simhash.CHECK + k // per] >> np.uint64(k % per * width) & np.uint64((1 << width) - 1) for k in range(number)], axis=1)
    root = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (cut[a] == cut[b]).any() and np.bitwise_count(held[a, : simhash.CHECK] ^ held[b, : simhash.CHECK]).sum() <= simhash.FAR:
                root = [root[b] if r == root[a] else r for r in root]
    docs = spark.createDataFrame([(w.tolist(),) for w in held.view(np.int64)], "words array<long>")
    for piece in (None, 16):
        got = {r.node: r.root for r in simhash.components(simhash.long_links(docs, 100, piece)).collect()}
        named = [got.get(i, i) for i in ids.view(np.int64).tolist()]
        assert len({*zip(root, named, strict=True)}) == len({*root}) == len({*named})


def test_candidates_come_by_fingerprints(spark, monkeypatch):
    """Near copies meet by linked fingerprints alone: without any link each stays."""
    words = [f"w{k}" for k in range(90)]
    docs = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(words[:-1]))], "doc_id long, text string")
    assert [r.doc_id for r in simhash.keep_first(docs).collect()] == [0]
    monkeypatch.setattr(simhash, "long_links", lambda *_: spark.createDataFrame([], "a long, b long"), raising=False)
    assert sorted(r.doc_id for r in simhash.keep_first(docs).collect()) == [0, 1]


def test_rows_stay_whatever_their_ids(spark):
    """Groups count, not ids: null ids with several texts, one id with two texts, one of them a copy."""
    words = [" ".join(f"{a}{k}" for k in range(40)) for a in "abcdef"]
    rows = [(None, words[0]), (None, words[1]), (None, words[1]), (4, words[2]), (4, words[3]), (5, words[3]), (2, words[4]), (9, words[4]), (9, words[5]), (None, words[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(None, words[0]), (None, words[1]), (4, words[2]), (4, words[3]), (2, words[4]), (9, words[5])]
    assert rows_of(simhash.keep_first(docs)) == sorted(want, key=repr)


def test_hot_groups(spark):
    """A third of all texts blank, a third a family of one centre: roots and fingerprints of a third of all rows."""
    rnd = random.Random(12)
    words = [f"w{k}" for k in range(300)]
    family = " ".join(words)
    rows = [(k, " " if k % 3 == 0 else family + " x" * (k % 5) if k % 3 == 1 else " ".join(rnd.sample(words, 40))) for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    want = {}
    for group in ([k for k in range(6000) if k % 3 == 0], [k for k in range(6000) if k % 3 == 1]):
        want |= dict.fromkeys(group, group[0])
    assert {k: got[k] for k in want} == want and {got[k] for k in range(2, 6000, 3)} == set(range(2, 6000, 3))


def test_cost_of_a_comparison():
    """The weight in the choice of segments: a comparison costs nanoseconds."""
    rnd = np.random.default_rng(1)
    forest = simhash._Forest(rnd.integers(0, 1 << 63, 4096).astype(np.uint64))
    asked = rnd.integers(0, 1 << 63, 20_000).astype(np.uint64)
    begin = time.perf_counter()
    forest.join(asked, 4)
    assert (time.perf_counter() - begin) / (4096 * 20_000) < 50e-9
