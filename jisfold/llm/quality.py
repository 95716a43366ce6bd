"""Quality by a factorisation machine.

Features are hashed words, structure statistics and metadata of the text's
size, each statistic in bins.  A document's score is

    w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2],

which has all pairwise interactions in time linear in the features.  The
machine is trained on the driver from the features (not the texts) of at most
``TRAIN_ROWS`` labelled documents; scoring is one pass over the texts with the
trained arrays, whose size is fixed, sent to all tasks.

Defined results: null text counts as empty; empty text has the bins of an
empty text and is scored by them; texts of any length are read whole; with no
labels of both kinds to learn from, every score is the share of label 1
(0.5 without any label); a score equal to the threshold is kept; an id with as
many labels 1 as 0 counts as 1; repeated rows give repeated results; an empty
table gives an empty result; extra columns are ignored and stay, but ``scores``
replaces one of its result's name; ``keep`` keeps all, of any name.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jisfold.llm import common
from jisfold.llm.common import Remembered
from jisfold.llm.labelled import sample

#: Labelled documents to train from, at most.
TRAIN_ROWS = 6_000
WORD_BITS = 16
BINS = 12
STATISTICS = 16
FACTORS = 8
EPOCHS = 6
THRESHOLD = 0.7
_WORDS = 1 << WORD_BITS
SIZE = _WORDS + STATISTICS * (BINS + 1)
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _bucket(word: bytes) -> int:
    return zlib.crc32(word.lower().strip(_PUNCTUATION)) & (_WORDS - 1)


class Features:
    """Sparse features of texts; one for a Python worker."""

    def __init__(self):
        self.bucket = Remembered(_bucket, 100_000)
        kinds = np.zeros((256, 7))
        for b in range(256):
            c = chr(b)
            kinds[b] = [b < 128 and c.isupper(), b < 128 and c.islower(), b >= 128, b < 128 and c.isdigit(), bytes([b]) in _PUNCTUATION.replace(b",", b"").replace(b".", b""), c in ".,", b < 32]
        self.kinds = kinds

    def statistics(self, data: bytes, words: list[bytes], ids: np.ndarray, counts: np.ndarray) -> list[float]:
        """Numbers in [0, 1], each to be put in a bin."""
        n, size = max(1, len(words)), max(1, len(data))
        shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ self.kinds / size
        lines = data.split(b"\n")
        letters = max(1e-9, float(shares[0] + shares[1] + shares[2]))
        same = float((ids[1:] == ids[:-1]).sum()) if len(ids) > 1 else 0.0
        return [
            min(1.0, np.log2(1 + len(words)) / 16),
            min(1.0, np.log2(1 + len(data)) / 20),
            min(1.0, np.log2(len(lines)) / 10),
            float(shares[0]) / letters,
            float(shares[2]) / letters,
            min(1.0, 4 * float(shares[3])),
            min(1.0, 3 * float(shares[4])),
            min(1.0, 8 * float(shares[5])),
            min(1.0, 20 * float(shares[6])),
            same / n,
            min(1.0, 10 * same / n),
            len(counts) / n,
            float(counts.max()) / n if len(counts) else 0.0,
            1 - len(set(lines)) / len(lines),
            min(1.0, sum(map(len, words)) / n / 20),
            min(1.0, n / len(lines) / 64),
        ]

    def of(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(indexes, values); the words' part has length 1/2, each statistic's bin 1/4."""
        words = data.split()
        ids = np.fromiter(map(self.bucket.__getitem__, words), np.int64, len(words))
        found, counts = np.unique(ids, return_counts=True)
        bins = np.array([min(BINS, int(x * BINS) + (x > 0)) for x in self.statistics(data, words, ids, counts)])
        x = np.log1p(counts)
        if len(x):
            x *= 0.5 / np.sqrt((x * x).sum())
        index = np.concatenate([found, _WORDS + np.arange(STATISTICS) * (BINS + 1) + bins])
        return index, np.concatenate([x, np.full(STATISTICS, 0.25)])


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, index: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[index]
        s = x @ v
        return float(self.bias + x @ self.linear[index] + 0.5 * (s @ s - ((x * x) @ (v * v)).sum()))


def _chance(score: float) -> float:
    return float(1 / (1 + np.exp(-min(30.0, max(-30.0, score)))))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7, rate: float = 0.3, decay: float = 1e-5) -> Machine:
    """Adagrad on the logistic loss; rows: (indexes, values, label)."""
    rng = np.random.default_rng(seed)
    labels = [y for _, _, y in rows]
    linear = np.zeros(SIZE)
    factors = rng.normal(0, 0.05, (SIZE, FACTORS))
    share = sum(labels) / len(labels) if labels else 0.5
    if not labels or share in (0.0, 1.0):
        share = min(0.999, max(0.001, share))
        return Machine(float(np.log(share / (1 - share))), linear.astype(np.float32), np.zeros((SIZE, FACTORS), np.float32))
    bias, seen_b = float(np.log(share / (1 - share))), 1e-6
    seen_l, seen_f = np.full(SIZE, 1e-6), np.full((SIZE, FACTORS), 1e-6)
    for epoch in range(EPOCHS):
        for r in rng.permutation(len(rows)):
            index, x, y = rows[r]
            v = factors[index]
            s = x @ v
            g = _chance(bias + x @ linear[index] + 0.5 * (s @ s - ((x * x) @ (v * v)).sum())) - y
            seen_b += g * g
            bias -= 0.1 * g / np.sqrt(seen_b)
            gl = g * x + decay * linear[index]
            seen_l[index] += gl * gl
            linear[index] -= rate * gl / np.sqrt(seen_l[index])
            gf = g * (x[:, None] * s - v * (x * x)[:, None]) + decay * v
            seen_f[index] += gf * gf
            factors[index] -= 0.2 * rate * gf / np.sqrt(seen_f[index])
    return Machine(bias, linear.astype(np.float32), factors.astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", doc_id: str = "doc_id", text: str = "text", bound: int = TRAIN_ROWS) -> Machine:
    """Trains a machine from a bounded sample of the labelled documents."""
    chosen = sample(docs, labels.select(doc_id, label), label, learn, bound, doc_id, text)
    schema = T.StructType([T.StructField("index", T.ArrayType(T.IntegerType())), T.StructField("x", T.ArrayType(T.FloatType()))])

    def make():
        features = Features()

        def work(batch: pa.RecordBatch) -> list:
            found = [features.of(x) for x in common.raw_texts(batch, "text")]
            return [[i.tolist() for i, _ in found], [x.tolist() for _, x in found]]

        return work

    table = common.append_columns(chosen, schema, make).select("doc_id", "label", "index", "x").toArrow()
    ids, ys = table.column("doc_id").to_pylist(), table.column("label").to_pylist()
    rows = [(np.array(i, np.int64), np.array(x), y) for i, x, y in zip(table.column("index").to_pylist(), table.column("x").to_pylist(), ys, strict=True)]
    return train([rows[i] for i in sorted(range(len(rows)), key=lambda i: (ids[i], ys[i]))])


def scores(docs: DataFrame, machine: Machine, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the chance of label 1, from 0 to 1.  No shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        features, own = Features(), sent.value
        return lambda batch: [[_chance(own.score(*features.of(x))) for x in common.raw_texts(batch, text)]]

    return common.append_columns(docs, T.StructType([T.StructField(out, T.DoubleType())]), make)


def keep(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The documents whose score reaches the threshold; all columns stay, of any name."""
    score = common.unused(docs, "score")
    return scores(docs, machine, text, score).where(F.col(score) >= threshold).drop(score)
