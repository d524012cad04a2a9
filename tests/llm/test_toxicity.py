import random
import zlib

import pytest
from vacantia.llm import toxicity
from vacantia.llm.toxicity import Lexicon, LexiconAutomaton

from .conftest import rows_of


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_edit_distance():
    rnd = random.Random(3)
    terms = {"grumble": 2.0, "bad": 1.0, "nastiness!!"[:9]: 3.0, "abcdefghijkl": 4.0, "grumbly": 2.5}
    automaton = LexiconAutomaton(Lexicon(words=terms))
    words = list(terms) + ["".join(rnd.choice("abgrumlen") for _ in range(rnd.randint(1, 9))) for _ in range(200)]
    for term in terms:
        for _ in range(60):
            w = list(term)
            for _ in range(rnd.randint(0, 3)):
                k = rnd.randrange(len(w))
                w[k : k + rnd.randint(0, 1)] = rnd.choice(["", "x", "a", "gg"])
                w = w or ["a"]
            words.append("".join(w))
    for w in words:
        allowed = {t: 2 if len(t) >= toxicity.FUZZIER else 1 if len(t) >= toxicity.FUZZY else 0 for t in terms}
        near = [(distance(w, t) == 0, v) for t, v in terms.items() if distance(w, t) <= allowed[t]]
        want = (max(near)[1], max(near)[0]) if near else None
        assert automaton.find(w) == want, w


def test_stems_match_what_begins_with_them():
    automaton = LexiconAutomaton(Lexicon(stems={"lowei": 3.0, "veq": 2.0}))
    assert automaton.find("loweischaft") == (3.0, True) and automaton.find("lowxischaft") == (3.0, False)
    assert automaton.find("veqa") == (2.0, True) and automaton.find("vxqa") is None and automaton.find("aveq") is None


def test_quotation_is_told_from_abuse():
    automaton = LexiconAutomaton(Lexicon(words={"scoundrel": 1.0}))
    plain = toxicity.features("you scoundrel you", automaton)
    quoted = toxicity.features('he wrote the word "scoundrel" there', automaton)
    wrong = toxicity.features("you scoundrol you", automaton)
    assert plain[0] > 0 == plain[1] and quoted[1] > 0 == quoted[0] and wrong[2] > 0 == wrong[0]


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abdeilnorst") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for k in range(700):
        text = [rnd.choice(words) for _ in range(rnd.randint(5, 60))]
        if k % 6 == 0:
            for _ in range(rnd.randint(1, 4)):
                text.insert(rnd.randrange(len(text)), rnd.choice(["vermin", "Cretin", "zwefel" + rnd.choice(["ung", "er", "lich"])]))
        docs.append((k, " ".join(text)))
        if k % 2 == 0:
            labels.append((k, int(k % 6 == 0)))
    docs += [(None, "x"), (5000, None), (5001, ""), (3, docs[3][1])]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    got = toxicity.digest(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    own = [r for r in got if r.doc_id is not None and r.doc_id < 700]
    assert sum(r.predicted == int(r.doc_id % 6 == 0) for r in own) >= 0.97 * len(own)
    assert {r.predicted for r in got if r.doc_id in (None, 5000, 5001)} == {0}
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)


def test_held_out_labels_are_never_read(labelled):
    from pyspark.sql import functions as F

    docs, labels = labelled
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert rows_of(toxicity.digest(docs, turned)) == rows_of(toxicity.digest(docs, labels))


def test_without_labels_empty_and_clashing(spark, labelled, docs, empty, clashing):
    some, labels = labelled
    none = labels.limit(0)
    assert {r.score for r in toxicity.digest(docs, none).collect()} == {0.0}
    assert toxicity.digest(some.limit(0), labels).count() == 0 and toxicity.digest(empty, none).count() == 0
    model = toxicity.train(some, labels)
    assert rows_of(toxicity.score(clashing, model, ["doc_id"])) == rows_of(toxicity.score(docs, model, ["doc_id"]))
    assert toxicity.drop_toxic(clashing, labels).columns == clashing.columns


def test_features_by_hand():
    """Weights by exact or misspelled, abuse or quoted, their density, whether any is exact; word by word, without an automaton."""
    import math
    import re

    terms = {"scoundrel": 1.5, "grumbler": 0.5, "bad": 2.0}
    automaton = LexiconAutomaton(Lexicon(words=terms))
    rnd = random.Random(9)
    for _ in range(150):
        words = [rnd.choice(["scoundrel", "Scoundrl", "grumblr", "bad", "bda", "he", "wrote", '"', "„", "plain", "word,", "x"]) for _ in range(rnd.randint(0, 60))]
        text = " ".join(words).lower()
        found = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
        sums, weight, exact = [0.0] * 4, 0.0, False
        for k, (w, a, b) in enumerate(found):
            near = [(distance(w, t) == 0, v) for t, v in terms.items() if distance(w, t) <= (1 if 5 <= len(t) < 10 else 2 if len(t) >= 10 else 0)]
            if near:
                same, v = max(near)
                left, right = text[found[max(0, k - 8)][1] : a], text[b : found[min(len(found) - 1, k + 8)][2]]
                marks = any(c in left for c in '"„') and any(c in right for c in '"„')
                said = any(x in toxicity.SAYING for x, _, _ in found[max(0, k - 8) : k])
                sums[(0 if same else 2) + (marks or said)] += v
                weight, exact = weight + v, exact or same
        want = [math.log1p(x) for x in [*sums, 1000 * weight / max(50, len(found))]] + [float(exact)]
        assert toxicity.features(" ".join(words), automaton) == pytest.approx(want)


def test_a_labelled_id_in_many_rows_is_one_sample(spark, labelled, monkeypatch):
    docs, labels = labelled
    again = docs.unionByName(docs.where("doc_id = 12").crossJoin(spark.range(500)).select("doc_id", "text")).unionByName(spark.createDataFrame([(12, "zz other text")], "doc_id long, text string"))
    sizes = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda x, y: sizes.append(len(x)) or fit(x, y))
    model = toxicity.train(again, labels)
    assert model.weights and sizes == [labels.where(~toxicity.held_out()).count()]
    assert toxicity.train(again, labels.unionByName(labels).unionByName(labels)) == model
