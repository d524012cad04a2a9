import zlib
from collections import Counter, defaultdict

from vacantia.llm import sharding

from . import brute
from .conftest import rows_of


def test_whole_result_against_brute_force(spark):
    rows = [(k, None if k % 50 == 0 else "" if k % 3 == 0 else f"text {k % 400} " * (k % 30)) for k in range(2500)]
    size, keys, shard, spans, held, most = brute.sharded(rows)
    got = {r.doc_id: r for r in sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows) and any(len(s) > 1 for s in spans.values()) is (max(held.values()) > -(-sum(size) // 8))
    for n, (doc, text) in enumerate(rows):
        r = got[doc]
        assert (r.size, r.text_crc32) == (size[n], brute.crc(text))
        assert r.shard == shard[n] if n in shard else r.shard in {s for _, s in spans[keys[n]]}
    for key, cuts in spans.items():  # a heavy group's rows fill its spans to the row
        begin = 0
        for end, s in cuts:
            own = sum(size[n] for n in range(len(rows)) if keys[n] == key and got[rows[n][0]].shard == s)
            assert abs(own - (end - begin)) < max(size)
            begin = end
    # slots run along the ranges, in order of the key inside the calm ones
    for s in range(8):
        line = sorted((r for r in got.values() if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in line] == list(range(len(line)))
        calm = [keys[r.doc_id] for r in line if keys[r.doc_id] not in spans]
        assert calm == sorted(calm)


def test_short_hot_groups_are_found(spark, monkeypatch):
    """Three tenths of all rows are empty: many rows, few bytes; no task may hold them all."""
    docs = spark.range(60_000).selectExpr("IF(id % 7 = 0, NULL, id) AS doc_id", "CASE WHEN id % 10 < 3 THEN '' ELSE concat('text ', id, repeat(' word', CAST(id % 20 AS INT))) END AS text")
    seen = []
    cut = sharding.cut
    monkeypatch.setattr(sharding, "cut", lambda df: seen.append(cut(df)) or seen[-1])
    assert sharding.assign_shards(docs).count() == 60_000
    parts = seen[-1].groupBy("place", "part").count().agg({"count": "max"}).first()[0]
    assert parts <= 2 * (60_000 // 256)


def test_shards_slots_and_groups(docs):
    got = sharding.assign_shards(docs, most_rows=20).collect()
    texts = defaultdict(set)
    by_id = {r.doc_id: r.text for r in docs.collect()}
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    for r in got:
        raw = (by_id[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        texts[by_id[r.doc_id]].add(r.shard)
    held = Counter()
    for r in got:
        held[by_id[r.doc_id]] += r.size
    target = sum(held.values()) / sharding.SHARDS
    assert all(len(s) == 1 for t, s in texts.items() if held[t] <= target)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_near_equal_sizes_with_a_hot_group(spark):
    rows = [(k, "same text " * 20 if k % 3 == 0 else f"text {k} " * (k % 40)) for k in range(3000)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sums = Counter()
    for r in got:
        sums[r.shard] += r.size
    assert set(sums) == set(range(8)) and max(sums.values()) < 1.02 * min(sums.values())
    again = sharding.assign_shards(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(7)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_one_group_alone_is_cut(spark):
    got = sharding.assign_shards(spark.createDataFrame([(k, "one") for k in range(800)], "doc_id long, text string")).collect()
    assert sorted(Counter(r.shard for r in got).values()) == [100] * 8


def test_empty_and_clashing(docs, empty, clashing):
    assert sharding.assign_shards(empty).count() == 0
    assert rows_of(sharding.assign_shards(clashing)) == rows_of(sharding.assign_shards(docs))


def test_written_shards(spark, docs, tmp_path):
    unique = docs.where("doc_id is not null and doc_id <> 3")
    sharding.write_shards(unique, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == unique.count()


def test_written_rows_keep_all_columns(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a", 1, 7), (None, "b", 2, 8), (3, "b", 3, 9), (3, "b", 3, 9)], "doc_id long, text string, more int, slot int")
    sharding.write_shards(docs, f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert rows_of(got.select("doc_id", "text", "more")) == rows_of(docs.select("doc_id", "text", "more"))
