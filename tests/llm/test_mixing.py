import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from vacantia.llm import mixing

from . import brute
from .conftest import rows_of


def test_whole_result_against_brute_force(spark, docs):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    more = [(k, "w " * (k % 60), f"s{k % 5}" if k % 9 else "rare") for k in range(400)]
    for some, blocks in ((rows, mixing.BLOCKS), (more, 700), (more + [(900, "a b", "x")], 900)):
        got = mixing.mix(spark.createDataFrame(some, "doc_id long, text string, source string"), blocks=blocks)
        want = brute.mixed(some, blocks=blocks)
        assert rows_of(got.select("doc_id", "size", "source_size", F.round("target", 6), "taken", "shard")) == sorted(((a, b, c, round(t, 6), n, s) for a, b, c, t, n, s in want), key=repr)
    assert {s for *_, s in want} >= set(range(8))


def filled(sizes):
    """Targets by resharing until none is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, out = 1.5 * sum(sizes.values()), {}
    free = dict(weight)
    while free:
        level = left / sum(free.values())
        over = [s for s in free if level * free[s] > 2 * sizes[s]]
        if not over:
            return out | {s: level * free[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            del free[s]
    return out


def test_targets_taken_and_limits(docs):
    got = mixing.mix(docs).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in docs.collect():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
    want = filled(dict(sizes))
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert len(got) == docs.count()
    assert rows_of(mixing.mix(docs.repartition(5))) == rows_of(mixing.mix(docs))


def test_quotas_are_sainte_lague(spark):
    votes = [53.0, 24.0, 23.0, 0.5, 0.0]
    wanted = spark.createDataFrame([(k + 1, v) for k, v in enumerate(votes)], "at int, target double")
    seats = 40
    got = mixing.quotas(wanted, 2, seats, 4).collect()
    held = [0] * len(votes)
    by_shard = defaultdict(int)
    for seat in range(seats):
        k = max((k for k in range(len(votes)) if votes[k]), key=lambda k: (votes[k] / (2 * held[k] + 1), -k))
        held[k] += 1
        by_shard[k + 1, seat * 4 // seats] += 1
    assert {(r.at, r.shard): r.blocks for r in got} == dict(by_shard)


def test_whole_documents(docs, empty, clashing):
    got = mixing.apply_mix(docs)
    assert got.columns == docs.columns
    plan = {(r.doc_id, r.source): r for r in mixing.mix(docs).collect() if r.doc_id != 3}
    count = defaultdict(int)
    for r in got.collect():
        count[r.doc_id, r.source] += 1
    for key, r in plan.items():
        assert count[key] == (1 if r.size == 0 else int(r.taken / r.size + 0.5))
    assert mixing.apply_mix(empty).count() == 0 and mixing.apply_mix(clashing).columns == clashing.columns


def test_empty_clashing_and_wordless(docs, empty, clashing):
    assert mixing.mix(empty).count() == 0
    assert rows_of(mixing.mix(clashing)) == rows_of(mixing.mix(docs))
    blank = docs.withColumn("text", F.lit(" "))
    assert {(r.size, r.target, r.taken) for r in mixing.mix(blank).collect()} == {(0, 0.0, 0)}


def test_one_source(spark):
    one = spark.createDataFrame([(k, "w " * (k % 7), "s") for k in range(200)], "doc_id long, text string, source string")
    got = mixing.mix(one).collect()
    assert sum(r.taken for r in got) == pytest.approx(1.5 * sum(r.size for r in got), abs=1) and all(r.size <= r.taken <= 2 * r.size for r in got)


def test_tiny_sources_beside_huge_ones(spark):
    """Blocks of over a hundred words: sources below and about one block come near their targets, too."""
    rows = [(k, " ".join(["w"] * 500), f"big{k % 3}") for k in range(3000)]
    rows += [(5000, "w " * 7, "tiny"), (5001, "w " * 90, "zsmall"), (5002, "w " * 110, "zsmall"), (5003, "w", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, blocks=2_000).collect()
    taken, target = defaultdict(int), {r.source: r.target for r in got}
    for r in got:
        taken[r.source] += r.taken
    block = int(sum(target.values()) // 2_000)
    assert block > 1000 and target["tiny"] == 14 and target["zsmall"] == 400 and target[None] == 2
    assert all(abs(taken[s] - target[s]) <= (0.5 if target[s] < block else block) for s in target)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
