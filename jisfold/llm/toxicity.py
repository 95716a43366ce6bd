"""Toxic passages by maximum-scoring segments.

Each word has a score: how much more often it is found in toxic documents, as
a log-odds ratio under Dirichlet priors, less its uncertainty and a constant,
so that ordinary text scores below zero.  A linear-time scan finds all maximal
segments of positive score.  Their significance comes from the extreme-value
law of such scores, P(S >= x) = 1 - exp(-K n exp(-lambda x)), with lambda from
the scores of clean text and K from its best segments.  A document's evidence,
the logarithm of its best and of its other passages' significance, is
calibrated on the training documents to the chance of label 1.

Word scores come from at most ``TRAIN_ROWS`` labelled documents; the lexicon
that is sent to all tasks holds words of that sample only.

Defined results: null text counts as empty; empty text has no passage; with no
labels of both kinds to learn from there is no passage, and the score is the
share of label 1 (0 without any label); an id with as many labels 1 as 0
counts as 1; words of equal score extend a segment only if its sum grows;
repeated rows give repeated results; an empty table gives an empty result;
texts of any length are read whole; extra columns are ignored and stay, but
those of the results' names are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from jisfold.llm import common
from jisfold.llm.common import Remembered
from jisfold.llm.labelled import sample

#: Labelled documents to train from, at most.
TRAIN_ROWS = 8_000
#: Each word's prior number of documents, of either kind, beyond its share.
PRIOR = 0.5
#: Standard errors taken off a word's log-odds.
CAUTION = 1.64
#: Taken off every word's score.
DRIFT = 1.0
#: Passages above this chance under clean text are not reported.
SIGNIFICANT = 0.01
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def token(word: bytes) -> str:
    """The word in lower case, without punctuation around it."""
    return word.decode("utf-8", "replace").lower().strip(_PUNCTUATION)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal segments (begin, end, score) of positive score, by position.

    >>> segments(np.array([1.0, -2.0, 3.0, -1.0, 2.0]))
    [(0, 1, 1.0), (2, 5, 4.0)]
    """
    total = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    found: list[list] = []  # begin, end, sum before, sum at the end
    before: list[int] = []  # for each, the last one whose sum before is less
    for at in np.flatnonzero(scores > 0).tolist():
        new = [at, at + 1, total[at], total[at + 1]]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = before[j]
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                before.append(j)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:], before[j:]
    return [(b, e, float(y - x)) for b, e, x, y in found]


@dataclass
class Detector:
    """The trained lexicon, extreme-value law and calibration."""

    scores: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0  # lambda
    k: float = 1.0
    weights: tuple[float, float, float] = (0.0, 0.0, -30.0)

    def chance(self, score: float, n: int) -> float:
        """Of a segment at least so good in n words of clean text."""
        return -math.expm1(-self.k * max(1, n) * math.exp(-self.rate * score))

    def word(self, word: bytes) -> float:
        return self.scores.get(token(word), -DRIFT)

    def passages(self, words: list[bytes], scored: Remembered | None = None) -> list[tuple[int, int, float, float, bool]]:
        """All maximal segments: first word, end, score, chance under clean
        text, and whether it repeats an earlier segment's words."""
        get = scored.__getitem__ if scored is not None else self.word
        s = np.fromiter(map(get, words), np.float64, len(words))
        out, seen = [], set()
        for begin, end, score in segments(s):
            own = b" ".join(words[begin:end])
            out.append((begin, end, score, self.chance(score, len(words)), own in seen))
            seen.add(own)
        return out

    def evidence(self, found: list[tuple[int, int, float, float, bool]]) -> tuple[float, float]:
        """Of the best segment and of the others: -log10 of their chances,
        damped.  A repeated segment counts once."""
        strength = sorted((math.log1p(min(300.0, -math.log10(min(1.0, max(p, 1e-300))))) for *_, p, again in found if not again), reverse=True)
        return (strength[0], math.log1p(sum(strength[1:]))) if strength else (0.0, 0.0)

    def score(self, found: list[tuple[int, int, float, float, bool]]) -> float:
        a, b = self.evidence(found)
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, self.weights[0] * a + self.weights[1] * b + self.weights[2]))))


def train(rows: list[tuple[bytes, int]]) -> Detector:
    """A detector from (text, label) rows."""
    texts = [(data.split(), y) for data, y in rows]
    kinds: tuple[Counter, Counter] = (Counter(), Counter())
    n = [0, 0]
    for words, y in texts:
        kinds[y].update(set(map(token, set(words))) - {""})
        n[y] += 1
    if not n[0] or not n[1]:
        return Detector(weights=(0.0, 0.0, 30.0 if n[1] else -30.0))
    both = kinds[0] + kinds[1]
    scores = {}
    for word, seen in both.items():
        # Dirichlet prior: the word's overall share of documents, and PRIOR more
        share = seen / (n[0] + n[1])
        t, c = kinds[1][word] + PRIOR * (1 + share), kinds[0][word] + PRIOR * (1 + share)
        odds = math.log(t / (n[1] + 1 - min(t, n[1]) + PRIOR)) - math.log(c / (n[0] + 1 - min(c, n[0]) + PRIOR))
        sure = abs(odds) - CAUTION * math.sqrt(1 / t + 1 / c)
        if sure > 0:
            scores[word] = math.copysign(sure, odds) - DRIFT
    own = Detector(scores)
    scored = Remembered(own.word, 100_000)
    # lambda: where the mean of exp(lambda * score) over clean words is 1
    clean = Counter()
    for words, y in texts:
        if not y:
            clean.update(round(scored[w], 3) for w in words)
    values = np.array([-DRIFT, *clean.keys()])
    shares = np.array([1, *clean.values()], float)
    shares /= shares.sum()
    low, high = 1e-3, 8.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (shares * np.exp(np.minimum(600, middle * values))).sum() < 1 else (low, middle)
    own.rate = low
    # K: clean documents' best segments have the mean (log(K n) + gamma) / lambda
    best = []
    for words, y in texts:
        if not y and words:
            s = np.fromiter(map(scored.__getitem__, words), np.float64, len(words))
            best.append((max([0.0, *(x for _, _, x in segments(s))]), len(words)))
    own.k = float(np.clip(np.exp(np.mean([own.rate * x - 0.5772 - math.log(m) for x, m in best])) if best else 1.0, 1e-6, 1.0))
    # calibration: logistic regression on the evidence, lightly regularised
    x = np.array([[*own.evidence(own.passages(words, scored)), 1.0] for words, _ in texts])
    y = np.array([y for _, y in texts], float)
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.1, 0.1, 0.01])
        step = np.linalg.solve(hessian, x.T @ (y - p) - np.array([0.1, 0.1, 0.01]) * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    own.weights = tuple(map(float, w))
    return own


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", bound: int = TRAIN_ROWS) -> Detector:
    """Trains from a bounded sample of the labelled documents.

    The training runs in one task, which gets the sample; what comes to the
    driver is the lexicon.
    """
    chosen = sample(docs, labels.select(doc_id, label), label, learn, bound, doc_id, text).repartition(1)
    schema = T.StructType([T.StructField("model", T.BinaryType())])

    def run(batches):
        import pickle

        rows = []
        for batch in batches:
            rows += list(zip(batch.column("doc_id").to_pylist(), common.raw_texts(batch, "text"), batch.column("label").to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([(t, y) for _, t, y in sorted(rows, key=lambda r: (r[0], r[2]))]))], pa.binary())], names=["model"])

    import pickle

    found = common.map_batches(chosen, run, schema).collect()
    return pickle.loads(found[0].model) if found else Detector()


PASSAGE = T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("chance", T.DoubleType())])


def detect(docs: DataFrame, detector: Detector, text: str = "text", out: str = "score", passages: str = "passages") -> DataFrame:
    """Adds the chance of label 1 and the significant passages (word numbers,
    score, chance under clean text).  No shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(detector)

    def make():
        own = sent.value
        scored = Remembered(own.word, 100_000)

        def work(batch: pa.RecordBatch) -> list:
            found = [own.passages(x.split(), scored) for x in common.raw_texts(batch, text)]
            return [[own.score(x) for x in found], [[dict(zip(("begin", "end", "score", "chance"), p[:4], strict=True)) for p in x if p[3] <= SIGNIFICANT] for x in found]]

        return work

    return common.append_columns(docs, T.StructType([T.StructField(out, T.DoubleType()), T.StructField(passages, T.ArrayType(PASSAGE))]), make)
