"""Toxicity by a learned lexicon, met through Levenshtein automata, and its context.

Fitting, on a bounded sample of labelled documents (``TRAIN_DOCS``, one text each; never on the
held-out fifth): words and word stems that toxic texts use far more often than others make the
lexicon. The model's size is bounded, too: the lexicon has at most ``TERMS`` terms, those that most
toxic texts of the sample hold first, chosen from at most ``CANDIDATES``. A small logistic model then
weighs what the lexicon finds in the sample's texts. These bounds concern the classifier alone: every
document is scored whole.

Scoring, on every whole text: the lexicon is a trie; its product with Levenshtein automata (one
error for terms of ``FUZZY`` letters and more, two from ``FUZZIER``) is made deterministic state by
state as words ask for it, so a word costs a few table steps and most die within their first letters.
Around each find a window of words decides whether it is quoted (inside quotation marks, or near a
verb of saying) or abuse. Exact and misspelled finds, quoted and not, count apart.

Defined results: null counts as empty; a text without finds, the empty one too, gets the model's
base score; without labelled rows of both kinds all scores are 0; a null doc_id counts as the empty
string for the held-out rule; repeated rows are scored row by row; of a labelled id with several
texts the smallest is learned from, once; the labels of one document with different marks count
toxic; other columns are ignored, and ``drop_toxic`` carries them whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from .common import whole

#: Labelled rows that the classifier is fitted on, at most (the smallest seeded hashes).
TRAIN_DOCS = 8_000
FOLDS = 5
#: Terms of the lexicon, and candidates for them, at most.
TERMS = 400
CANDIDATES = 20_000
#: Toxic texts of the sample that hold a term: at least this many, and this share of them.
MIN_TOXIC, MIN_SHARE = 4, 0.015
#: A term's share of toxic texts is at least this many times its share of the others.
MIN_RATIO = 12.0
STEMS = (4, 5, 6, 7, 8)
FUZZY, FUZZIER = 5, 10
WINDOW = 8
SEED = 29
#: States of a worker's automaton; it starts anew when full.
STATES = 200_000
WORDS = 300_000
#: Columns that scoring adds for itself.
FEATURES, SCORE = "_toxic_features", "_toxic_score"

#: Fixed word list: verbs of saying, in the languages of the corpus.
SAYING = "said says wrote writes quote quoted quotes called calling sagte schrieb nannte zitat dit écrit appelle citation dijo escribió llamó cita".split()
_WORD = re.compile(r"[^\W_]+")
_MARKS = "\"“”„«»"


def held_out() -> Column:
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS) == 0


@dataclass
class Lexicon:
    """Terms with weights; stems match any word that begins with them."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)


class LexiconAutomaton:
    """The trie of a lexicon under edit distance, determinised lazily.

    A non-deterministic state is (trie node, errors left); a missing letter is followed at once.
    ``find`` gives (weight, exact) of the best term, or None.
    """

    def __init__(self, lexicon: Lexicon):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[float, bool, int]]] = [[]]  # (weight, is stem, errors allowed)
        for terms, stem in ((lexicon.words, False), (lexicon.stems, True)):
            for term, weight in sorted(terms.items()):
                node = 0
                for c in term:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                        self.ends.append([])
                    node = self.next[node][c]
                self.ends[node].append((weight, stem, 2 if len(term) >= FUZZIER else 1 if len(term) >= FUZZY else 0))
        # errors that any term below a node allows: others need not be followed
        self.allow = [0] * len(self.next)
        for node in range(len(self.next) - 1, -1, -1):
            self.allow[node] = max([e[2] for e in self.ends[node]] + [self.allow[k] for k in self.next[node].values()], default=0)
        self.known: dict[str, tuple[float, bool] | None] = {}
        self._restart()

    def _restart(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.finds: list[tuple[tuple[float, bool] | None, tuple[float, bool] | None]] = []
        self.start = self._state({(0, 0)})

    def _state(self, items: set[tuple[int, int]]) -> int:
        """Number of a state set, closed under missing letters; -1 if nothing is left."""
        least: dict[int, int] = {}
        todo = list(items)
        while todo:
            node, used = todo.pop()
            if used > self.allow[node] or least.get(node, 99) <= used:
                continue
            least[node] = used
            todo += [(k, used + 1) for k in self.next[node].values()]
        if not least:
            return -1
        key = frozenset(least.items())
        if key not in self.states:
            self.states[key] = len(self.steps)
            self.steps.append({})
            self.finds.append((self._best(least, False), self._best(least, True)))
            self.sets = getattr(self, "sets", {})
            self.sets[self.states[key]] = least
        return self.states[key]

    def _best(self, least: dict[int, int], stem: bool) -> tuple[float, bool] | None:
        found = [(used == 0, weight) for node, used in least.items() for weight, is_stem, errors in self.ends[node] if is_stem == stem and used <= errors]
        return (max(found)[1], max(found)[0]) if found else None

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, used in self.sets[state].items():
            for letter, child in self.next[node].items():
                out.add((child, used if letter == c else used + 1))
            out.add((node, used + 1))
        return self._state(out)

    def find(self, word: str) -> tuple[float, bool] | None:
        if len(self.steps) > STATES:
            self.sets = {}
            self._restart()
        state, best = self.start, None
        for c in word:
            to = self.steps[state].get(c)
            if to is None:
                to = self.steps[state][c] = self._step(state, c)
            if to < 0:
                return best
            state = to
            stem = self.finds[state][1]
            if stem and (best is None or stem[::-1] > best[::-1]):
                best = stem
        whole = self.finds[state][0]
        return whole if whole and (best is None or whole[::-1] >= best[::-1]) else best

    def lookup(self, words: list[str]) -> list[tuple[int, float, bool]]:
        """(place, weight, exact) of the words that match."""
        known, out = self.known, []
        if len(known) > WORDS:
            known.clear()
        for k, word in enumerate(words):
            try:
                found = known[word]
            except KeyError:
                found = known[word] = self.find(word)
            if found:
                out.append((k, *found))
        return out


def features(text: str, lexicon: LexiconAutomaton) -> list[float]:
    """Finds of a whole text: weights by exact or misspelled, abuse or quoted; and how dense they are."""
    low = text.lower()
    words = _WORD.findall(low)
    finds = lexicon.lookup(words)
    out = [0.0] * 6
    if finds:
        spans = [m.span() for m in _WORD.finditer(low)]
        saying = {k for k, w in enumerate(words) if w in _SAYING}
        for k, weight, exact in finds:
            a, b = spans[max(0, k - WINDOW)][0], spans[min(len(words) - 1, k + WINDOW)][1]
            before, after = low[a : spans[k][0]], low[spans[k][1] : b]
            quoted = any(m in before for m in _MARKS) and any(m in after for m in _MARKS) or any(j in saying for j in range(k - WINDOW, k))
            out[(0 if exact else 2) + quoted] += weight
        out[4] = 1000.0 * sum(w for _, w, _ in finds) / max(50, len(words))
        out[5] = float(any(exact for _, _, exact in finds))
    return [math.log1p(x) for x in out[:5]] + out[5:]


_SAYING = frozenset(SAYING)


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Terms of the sample (``text, toxic``) that mark toxic texts; counted in Spark, chosen here from bounded lists."""
    sample = sample.dropDuplicates(["text", "toxic"])  # copies say nothing new
    by = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_other = by.get(1, 0), by.get(0, 0)
    if not n_toxic or not n_other:
        return Lexicon()
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    stems = F.flatten(F.transform(words, lambda w: F.transform(F.array(*map(F.lit, STEMS)), lambda n: F.when(F.length(w) > n, F.substring(w, F.lit(1), n)))))
    kinds = F.explode(F.array(F.struct(F.lit(False).alias("stem"), words.alias("terms")), F.struct(F.lit(True).alias("stem"), F.array_distinct(F.concat(F.filter(stems, lambda s: s.isNotNull()), F.filter(words, lambda w: F.length(w).between(STEMS[0], STEMS[-1])))).alias("terms"))))
    terms = sample.select("toxic", kinds.alias("k")).select("toxic", "k.stem", F.explode("k.terms").alias("term"))
    counted = terms.groupBy("stem", "term").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
    ratio = ((F.col("t") + 0.5) / (n_toxic + 1)) / ((F.col("o") + 0.5) / (n_other + 1))
    rows = counted.where(F.col("t") >= max(MIN_TOXIC, MIN_SHARE * n_toxic)).withColumn("ratio", ratio).where(F.col("ratio") >= MIN_RATIO).orderBy(F.desc("t"), "term", "stem").limit(CANDIDATES).collect()
    out = Lexicon()
    # most frequent first; of equal ones the longer term, a whole word before a stem
    for r in sorted(rows, key=lambda r: (-r["t"], -len(r["term"]), r["stem"], r["term"])):
        if len(out.words) + len(out.stems) >= TERMS:
            break
        term = r["term"]
        if any(term.startswith(s) for s in out.stems) or any(s.startswith(term) for s in (*out.words, *out.stems)) or len(term) < 3:
            continue
        (out.stems if r["stem"] else out.words)[term] = min(6.0, math.log(r["ratio"]))
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the base."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(x.shape[1])
    hold = np.diag([ridge] * (x.shape[1] - 1) + [1e-6]) * len(x) / 100
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + hold, x.T @ (y - p) - hold @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _features(df: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    schema = StructType([df.schema[c] for c in keep]).add(FEATURES, ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LexiconAutomaton(lexicon)
        for batch in batches:
            x = [features(t.as_py() or "", automaton) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(x, pa.list_(pa.float64()))], names=[*keep, FEATURES])

    return df.mapInArrow(run, schema)


@dataclass
class Model:
    lexicon: Lexicon
    weights: list[float] | None


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Lexicon and weights from at most ``train_docs`` labelled documents outside the held-out fold."""
    marks = labels.where(~held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = marks.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(train_docs)
    held = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # one text an id: however often an id stands in the table, the sample has train_docs rows at most
    sample = held.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic").persist()
    try:
        lexicon = learn_lexicon(sample)
        if not lexicon.words and not lexicon.stems:
            return Model(lexicon, None)
        rows = _features(sample, lexicon, ["toxic"]).collect()
    finally:
        sample.unpersist()
    return Model(lexicon, fit(np.array([r[FEATURES] for r in rows]), np.array([float(r["toxic"]) for r in rows])).tolist())


def score(docs: DataFrame, model: Model, keep: list[str], name: str = "score") -> DataFrame:
    """``keep`` columns and the score under ``name``."""
    if model.weights is None:
        return docs.select(*keep, F.lit(0.0).alias(name))
    *weights, base = model.weights
    found = _features(docs.select(*dict.fromkeys([*keep, "text"])), model.lexicon, keep)
    z = F.lit(base)
    for k, w in enumerate(weights):
        z = z + F.col(FEATURES)[k] * w
    return found.select(*keep, (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias(name))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, train(docs, labels), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, with all their columns, that score under 0.5."""
    carried = docs.select(whole(docs).alias("doc"), "text")
    return score(carried, train(docs, labels), ["doc"], SCORE).where(F.col(SCORE) < 0.5).select("doc.*")
