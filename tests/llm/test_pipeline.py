import random
import shutil
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from . import brute


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abdeilnorst") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    docs, labels = [], []
    for k in range(300):
        text = say(rnd.randint(30, 90))
        if k % 5 == 0:
            text = "vermin " + text + " cretin"
        docs.append((k, text, "en", f"src{k % 3}", len(text)))
        labels.append((k, 1, int(k % 5 == 0)))
    passage = say(30)
    for k in range(2000, 2012):  # near copies of the first texts: one word of some sixty is another
        words_of = docs[5 * (k - 2000) + 3][1].split()
        words_of[k % 7] = "other"
        docs.append((k, " ".join(words_of), "de", f"src{k % 3}", 1))
    docs += [(1000, say(20) + " " + passage + " " + say(20), "en", "src0", 1), (1001, docs[1][1], "en", "src2", 1), (1002, None, None, None, None), (1003, docs[2][1].upper(), "en", None, 1)]
    out = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    yield str(out)
    shutil.rmtree(out)


def test_stages_take_effect(spark, corpus):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    clean = p.drop_toxic(spark, docs, corpus)
    assert ids(docs) - ids(clean) == {k for k in range(300) if k % 5 == 0}
    single = p.drop_near_duplicates(spark, clean, corpus)
    texts = {r.doc_id: r.text for r in clean.collect()}
    group = dict(zip(texts, brute.near_groups(list(texts.values())), strict=True))
    assert ids(single) == {min(d for d in group if group[d] == g) for g in group.values()} and not ids(single) & {1001, 1003}
    tested = p.drop_contaminated(spark, single, corpus)
    assert ids(single) - ids(tested) == {1000}
    mixed = p.mix_sources(spark, tested, corpus)
    assert ids(mixed) <= ids(tested) and clean.columns == single.columns == tested.columns == mixed.columns == docs.columns
    assert p.shard(spark, mixed, corpus).count() == mixed.count()


def test_run_is_the_stages_in_a_row(spark, corpus):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for _, stage in p.STAGES:
        docs = stage(spark, docs, corpus)
    assert sorted(map(tuple, p.run(spark, corpus).collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)


def test_empty_tables(spark, corpus, tmp_path):
    import corpus_pipeline as p

    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus}/{name}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_run_against_brute_force(spark, corpus):
    """run() against plain Python: planted terms, all pairs of shingle sets, windows, the mix word by word, bytes along a line."""
    import corpus_pipeline as p

    rows = [tuple(r) for r in spark.read.parquet(f"{corpus}/documents.parquet").collect()]
    clean = [r for r in rows if not {"vermin", "cretin"} & {*brute.lower(r[1]).split()}]
    group = brute.near_groups([r[1] for r in clean])
    single = [min((r for r, g in zip(clean, group, strict=True) if g == k), key=lambda r: r[0]) for k in sorted({*group})]
    items = [r.text for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    tested = [r for r in single if not brute.contaminated(r[1], items)]
    mix = brute.mixed([(r[0], r[1], r[3]) for r in tested])
    final = [(r[0], r[1]) for r, m in zip(tested, mix, strict=True) for _ in range(1 if not m[1] else int(m[4] / m[1] + 0.5))]
    size, keys, shard, spans, held, most = brute.sharded(final)
    got = p.run(spark, corpus).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, s, brute.crc(t)) for (d, t), s in zip(final, size, strict=True))
    where = defaultdict(Counter)
    for n, (doc, _) in enumerate(final):
        if n in shard:
            where[doc][shard[n]] += 1
    for doc, counts in where.items():
        assert Counter(r.shard for r in got if r.doc_id == doc) == counts
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    loads = Counter()
    for r in got:
        loads[r.shard] += r.size
    assert max(loads.values()) - min(loads.values()) <= 2 * max(held.values())
