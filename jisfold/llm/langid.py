"""Language of text, also code-switched, by a linear-chain CRF over words.

Each word's features (beginnings and endings of one to three characters,
three-character sequences, and the word itself as its entry in a hashed
lexicon) give a score for each language; learned transitions between the
languages of neighbouring words join them.  Forward and backward passes give
each word's chances; a document's language is the one with the largest sum
over its words that have letters, and its score is that sum's share.

The passes go over many documents side by side, one word position at a time,
so that their arithmetic is in arrays; a batch holds a bounded number of words
(a longer document is a batch of its own).  The model (fixed size) is trained
in one task from at most ``TRAIN_ROWS`` documents and sent to all tasks.

Defined results: text that is null or has no letter is "und" with score 0, and
so is every text when there is nothing to learn from; with one language to
learn from, each text with letters has it; ties go to the first language by
code point; texts of any length are read whole; repeated rows give repeated
results; an empty table gives an empty result; extra columns are ignored and
stay, but ``predict`` replaces those of its results' names; ``keep`` keeps all,
of any name.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jisfold.llm import common

#: Documents to train from, at most.
TRAIN_ROWS = 1_500
#: Of these, the documents that each language gives first.
LEAST_EACH = 50
BITS = 16
EPOCHS = 3
#: Documents of one step of the training, words of one batch of the passes,
#: words whose scores a worker remembers.
STEP, BATCH_WORDS, REMEMBERED = 32, 200_000, 400_000
UNKNOWN = "und"
_MASK = (1 << BITS) - 1
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"


def features(word: str) -> list[int]:
    """Hashed features of a word; none if it has no letter."""
    core = word.lower().strip(_PUNCTUATION)
    if not any(map(str.isalpha, core)):
        return []
    crc = zlib.crc32
    edged = f"^{core}$"
    found = ["=" + core, *(f"<{core[:k]}" for k in (1, 2, 3)), *(f">{core[-k:]}" for k in (1, 2, 3))]
    found += [edged[i : i + 3] for i in range(len(edged) - 2)]
    return [crc(x.encode("utf-8", "surrogatepass")) & _MASK for x in found]


@dataclass
class Crf:
    languages: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 0), np.float32))
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))


class Words:
    """Numbers for words, with their features' scores kept by number."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.words = weights, pa.array([], pa.string())
        self.scores, self.letters = np.zeros((0, weights.shape[1]), np.float32), np.zeros(0, bool)

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Of each word; features are computed of words not met lately only."""
        coded = words.cast(pa.string()).dictionary_encode()
        if len(self.words) > REMEMBERED:
            self.words, self.scores, self.letters = self.words[:0], self.scores[:0], self.letters[:0]
        number = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.words), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = np.arange(len(self.words), len(self.words) + len(new))
            missing = coded.dictionary.take(pa.array(new))
            scores, letters = [self.scores], [self.letters]
            for at in range(0, len(missing), 50_000):
                lists = [features(w) for w in missing[at : at + 50_000].to_pylist()]
                sizes = np.fromiter(map(len, lists), np.int64, len(lists))
                own, some = np.zeros((len(lists), self.weights.shape[1]), np.float32), np.flatnonzero(sizes)
                if len(some):
                    flat = np.fromiter((x for one in lists for x in one), np.int64, int(sizes.sum()))
                    own[some] = np.add.reduceat(self.weights[flat], (np.cumsum(sizes) - sizes)[some], axis=0)
                scores.append(own)
                letters.append(sizes > 0)
            self.words = pa.concat_arrays([self.words, missing])
            self.scores, self.letters = np.concatenate(scores), np.concatenate(letters)
        return number[coded.indices.to_numpy()]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All texts' words, one after the other, and how many each text has; null
    has none."""
    split = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = split.flatten()
    some = pc.not_equal(flat, "")  # white space at an end leaves an empty part
    of = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    return flat.filter(some), np.bincount(of[some.to_numpy(zero_copy_only=False)], minlength=len(texts))


def side_by_side(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, widths): how to lay out words by position, longest text first.

    ``order`` lists the words (numbered text by text) position by position;
    ``widths[t]`` texts have a word at position t.
    """
    rank = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[rank]
    longest = int(sizes.max()) if len(sizes) else 0
    widths = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(longest), side="right")
    at = np.repeat(np.arange(longest), widths)
    place = np.arange(len(at)) - np.repeat(np.cumsum(widths) - widths, widths)
    return starts[place] + at, widths


def passes(scores: np.ndarray, widths: np.ndarray, transitions: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Chances of each word's languages, words laid out by side_by_side; with
    ``pairs`` also the expected number of each transition."""
    e = np.exp(scores - scores.max(1, keepdims=True))
    move = np.exp(transitions - transitions.max()).astype(e.dtype)
    ends = np.cumsum(widths)
    forward = np.empty_like(e)
    before = None
    for t, n in enumerate(widths.tolist()):
        own = e[ends[t] - n : ends[t]]
        a = own if before is None else (before[:n] @ move) * own
        a = a / a.sum(1, keepdims=True)
        forward[ends[t] - n : ends[t]] = before = a
    counts = np.zeros((scores.shape[1],) * 2) if pairs else None
    back = np.ones((widths[0] if len(widths) else 0, scores.shape[1]), e.dtype)
    turned = move.T.copy()
    for t in range(len(widths) - 1, -1, -1):
        n = widths[t]
        span = slice(ends[t] - n, ends[t])
        a = forward[span]
        b = back[:n]
        p = a * b
        if t:
            later = e[span] * b
            if pairs:
                earlier = forward[ends[t - 1] - widths[t - 1] : ends[t - 1]][:n]
                norm = ((earlier @ move) * later).sum(1, keepdims=True)
                counts += (earlier / norm).T @ later * move
            new = later @ turned
            back[:n] = new / new.sum(1, keepdims=True)
        forward[span] = p / p.sum(1, keepdims=True)
    return forward, counts


def train(rows: list[tuple[str, str]], seed: int = 11, rate: float = 0.5, decay: float = 1e-4) -> Crf:
    """Stochastic gradient steps on the likelihood; rows: (text, language)."""
    languages = sorted({y for _, y in rows})
    n = len(languages)
    rows = [(t.split(), languages.index(y)) for t, y in rows]
    rows = [r for r in rows if r[0]]
    weights, transitions = np.zeros((1 << BITS, n), np.float32), np.zeros((n, n))
    seen_w, seen_t = np.full((1 << BITS, n), 1e-3, np.float32), np.full((n, n), 1e-3)
    if n < 2:
        return Crf(languages, weights, transitions)
    rng = np.random.default_rng(seed)
    cached: dict[str, list[int]] = {}
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), STEP):
            some = [rows[i] for i in order[at : at + STEP]]
            sizes = np.array([len(w) for w, _ in some])
            unique: dict[str, int] = {}
            ids = np.fromiter((unique.setdefault(w, len(unique)) for words, _ in some for w in words), np.int64, int(sizes.sum()))
            lists = [cached.get(w) or cached.setdefault(w, features(w)) for w in unique]
            lengths = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter((x for one in lists for x in one), np.int64, int(lengths.sum()))
            of = np.repeat(np.arange(len(lists)), lengths)
            scores = np.stack([np.bincount(of, weights[flat, k], len(lists)) for k in range(n)], 1)
            order_t, widths = side_by_side(sizes)
            labels = np.repeat([y for _, y in some], sizes)[order_t]
            p, pairs = passes(scores[ids][order_t], widths, transitions, True)
            p[np.arange(len(p)), labels] -= 1
            per_word = np.stack([np.bincount(ids[order_t], p[:, k], len(lists)) for k in range(n)], 1)
            g = np.stack([np.bincount(flat, per_word[of, k], 1 << BITS) for k in range(n)], 1) / len(p)
            g += decay * weights
            seen_w += g * g * 100
            weights -= (rate * 10 * g / np.sqrt(seen_w)).astype(np.float32)
            gt = pairs
            for words, y in some:
                gt[y, y] -= len(words) - 1
            gt = gt / len(p) + decay * transitions
            seen_t += gt * gt * 100
            transitions -= rate * 10 * gt / np.sqrt(seen_t)
    return Crf(languages, weights, transitions)


def fit(docs: DataFrame, learn: Column, lang: str = "lang", doc_id: str = "doc_id", text: str = "text", bound: int = TRAIN_ROWS) -> Crf:
    """Trains from a bounded number of the documents with a language that may be
    learnt from: copies count once, as the one of the smallest id; each
    language gives its ``LEAST_EACH`` smallest id hashes first, so that rare
    ones are learnt too, and the smallest hashes of all the rest fill the bound.
    (With more than bound / LEAST_EACH languages, the first of each come first,
    then the second of each, and so on.)"""
    own = docs.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull()).where(learn)
    own = own.select(F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("text"), F.col(lang).alias("lang"))
    kinds = own.groupBy(F.xxhash64("text").alias("h"), "lang").agg(F.min("id").alias("id"))
    hashed = kinds.withColumn("order", F.xxhash64("id"))
    # the limits of ranks and rows are applied before rows are sent, so no language is gathered
    ranks = F.row_number().over(Window.partitionBy("lang").orderBy("order", "id", "h"))
    firsts = hashed.withColumn("k", ranks).where(F.col("k") <= LEAST_EACH).select("h", "lang", "id", "order", "k")
    others = hashed.orderBy("order", "id", "lang", "h").limit(bound).select("h", "lang", "id", "order", F.lit(LEAST_EACH + 1).alias("k"))
    drawn = firsts.unionByName(others).groupBy("h", "lang", "id", "order").agg(F.min("k").alias("k")).orderBy("k", "order", "id", "lang", "h").limit(bound)
    found = own.withColumn("h", F.xxhash64("text")).join(F.broadcast(drawn.select("h", "lang", "id")), ["h", "lang", "id"])
    found = found.groupBy("h", "lang", "id").agg(F.min("text").alias("text")).repartition(1)

    def run(batches):
        rows = []
        for batch in batches:
            rows += list(zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True))
        rows.sort(key=lambda r: (r[0], r[2], r[1]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([(t, y) for _, t, y in rows]))], pa.binary())], names=["model"])

    models = common.map_batches(found.select("id", "text", "lang"), run, T.StructType([T.StructField("model", T.BinaryType())])).collect()
    return pickle.loads(models[0].model) if models else Crf()


def label_texts(model: Crf, words: Words, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Per text: language, score and each language's share of its words."""
    n, rows = len(model.languages), len(texts)
    shares = np.zeros((rows, n))
    if n and rows:
        flat, sizes = words_of(texts)
        numbers = words.numbers(flat)
        starts = np.cumsum(sizes) - sizes
        # texts of like length side by side: few positions in all
        by_size = np.argsort(-sizes, kind="stable")
        before = np.cumsum(sizes[by_size]) - sizes[by_size]
        for some in np.split(by_size, np.flatnonzero(np.diff(before // BATCH_WORDS)) + 1):
            own = sizes[some]
            at = np.repeat(starts[some] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            order, widths = side_by_side(own)
            number = numbers[at[order]]
            p, _ = passes(words.scores[number], widths, model.transitions)
            lettered = words.letters[number]
            of = np.repeat(np.arange(len(some)), own)[order][lettered]
            shares[some] = np.stack([np.bincount(of, p[lettered, k], len(some)) for k in range(n)], 1)
    totals = shares.sum(1)
    shares /= np.maximum(totals, 1e-300)[:, None]
    best = shares.argmax(1) if n else np.zeros(rows, np.int64)
    found = [model.languages[k] if total > 0 else UNKNOWN for k, total in zip(best.tolist(), totals.tolist(), strict=True)]
    return found, np.minimum(1.0, shares.max(1)) if n else np.zeros(rows), shares


def label_words(model: Crf, text: str) -> list[tuple[str, str]]:
    """The words of one text with their likeliest languages."""
    flat, sizes = words_of(pa.array([text]))
    words = flat.to_pylist()
    if not words or not model.languages:
        return [(w, UNKNOWN) for w in words]
    own = Words(model.weights)
    numbers = own.numbers(flat)
    p, _ = passes(own.scores[numbers], np.ones(len(words), np.int64), model.transitions)
    return [(w, model.languages[int(k)] if own.letters[i] else UNKNOWN) for w, k, i in zip(words, p.argmax(1), numbers, strict=True)]


def predict(docs: DataFrame, model: Crf, text: str = "text", lang_pred: str = "lang_pred", score: str = "score", shares: str = "lang_shares") -> DataFrame:
    """Adds the language, its score, and each language's share of the words.  No shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(shares, T.MapType(T.StringType(), T.DoubleType()))])

    def make():
        own = sent.value
        words = Words(own.weights)

        def work(batch: pa.RecordBatch) -> list:
            found, score, shares = label_texts(own, words, batch.column(text))
            offsets = pa.array(np.arange(len(found) + 1) * len(own.languages), pa.int32())
            named = pa.MapArray.from_arrays(offsets, pa.array(own.languages * len(found), pa.string()), pa.array(shares.ravel()))
            return [pa.array(found, pa.string()), pa.array(score), named]

        return work

    return common.append_columns(docs, schema, make)


def keep(docs: DataFrame, model: Crf, least: float = 0.5, text: str = "text") -> DataFrame:
    """The documents in a known language with at least that score; all columns
    stay, of any name."""
    lang, score, shares = (common.unused(docs, n) for n in ("lang_pred", "score", "lang_shares"))
    found = predict(docs, model, text, lang, score, shares)
    return found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).drop(lang, score, shares)
