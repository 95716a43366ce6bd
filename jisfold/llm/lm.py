"""Language-model scores by a hashed maximum-entropy model.

A word's chance given the words before it is the chance of its leaf in a tree
of classes, times its share of the leaf.  The tree has ``LEVELS`` levels with
``WAYS`` branches at each node, so the model is a softmax over families, one
over the family's classes and one over the class's leaves.  Each is a
log-linear model of hashed features of the context (each of the last three
words at its distance, which are n-gram and skip features, and the last two
together), on top of the branches' shares of the training tokens.  The
``SINGLES`` most frequent words are leaves of their own, so that context tells
each of them from every other word; all others fall into leaves by their
endings and have their smoothed share of the leaf's training tokens, with room
for one unknown word in each leaf.

Counts come from the whole corpus.  The texts are read once and written as
packed chunks: the chunk's distinct words, and its documents as numbers of
those words.  Words are summed over the chunks with partial sums in each task;
the ``HEAD`` most frequent words (a bounded table) go to all tasks, and only
the other words of a chunk are joined with their counts, by 96 bits of hashes,
so that no word has a row for most chunks there.  Training goes over all
training documents where they lie: each task makes gradient steps from the
same weights, and the tasks' weights are averaged, row by row as often as each
row was used, in a tree; weights have a fixed size.

Defined results: null text counts as empty and has its end token alone; the
end counts as a token; a null document id counts as the text '' for its fold,
and document ids of any type come back as they are; with nothing to learn
from, the counts are zero and the leaves by ending are equally likely; repeated rows
give repeated results; an empty table gives an empty result; texts of any
length are scored whole, as one chunk if need be; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jisfold.llm import common

LEVELS, WAYS = 3, 16
LEAVES = WAYS**LEVELS
#: Leaves of single words; the others hold words by their endings.
SINGLES = LEAVES // 2
GROUPS = LEAVES - SINGLES
#: Most frequent words, whose counts go to all tasks.
HEAD = 1 << 16
#: Hashed rows of weights at each level (row numbers are 16 bits).
ROWS = 1 << 16
FEATURES = 4
#: Bytes of the texts of a chunk.
CHUNK_BYTES = 8 << 20
STEP = 16_384
#: Rows of so many of a step's tokens are summed one by one, those of fewer side by side.
FEW = 8
#: Sums of weights count as so much at most, either way.
LIMIT = 60
RATE = 0.3
ROUNDS = 1
#: Tasks' weights that one step of the averaging takes together.
FAN = 8
END = b""
#: A row of weights as one item.
_WHOLE = np.dtype((np.void, 4 * WAYS))


def chunk_schema(doc_id: T.DataType) -> T.StructType:
    """Of packed chunks of documents whose ids have that type."""
    return T.StructType(
        [
            T.StructField("chunk", T.LongType()),
            T.StructField("words", T.ArrayType(T.BinaryType())),
            T.StructField("train_counts", T.ArrayType(T.IntegerType())),
            T.StructField("doc_ids", T.ArrayType(doc_id)),
            T.StructField("held", T.ArrayType(T.BooleanType())),
            T.StructField("sizes", T.ArrayType(T.IntegerType())),
            T.StructField("tokens", T.BinaryType()),
        ]
    )


def endings(words: pa.Array) -> np.ndarray:
    """The leaf by ending, counted from SINGLES, of each word: of its last three bytes."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    found = np.zeros(len(words), np.uint64)
    for back in (1, 2, 3):
        at = offsets[1:] - back
        inside = at >= offsets[:-1]
        own = np.zeros(len(words), np.uint64)
        own[inside] = data[at[inside]].astype(np.uint64) + np.uint64(1)
        found = (found * np.uint64(257) + own) * np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(29)
    return (found % np.uint64(GROUPS)).astype(np.int64)


def pack(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The packed chunks of all documents, written to the shared folder."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in common.slices(batch, CHUNK_BYTES):
                yield packed(some, part << 32 | made)
                made += 1

    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    schema = chunk_schema(rows.schema["doc_id"].dataType)
    path = common.new_path(docs.sparkSession, "lm-chunks")
    common.map_batches(rows, run, schema, CHUNK_BYTES).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def packed(batch: pa.RecordBatch, chunk: int) -> pa.RecordBatch:
    """One chunk of the batch's documents; word 0 to n by falling frequency."""
    texts = pc.ascii_lower(pc.fill_null(batch.column("text").cast(pa.large_string()), ""))
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    some = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # white space at an end leaves an empty part
    of = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))[some]
    sizes = np.bincount(of, minlength=len(texts)) + 1
    coded = flat.filter(pa.array(some)).dictionary_encode()
    ends = np.cumsum(sizes) - 1
    numbers = np.zeros(int(sizes.sum()), np.int64)
    inside = np.ones(len(numbers), bool)
    inside[ends] = False
    numbers[inside] = coded.indices.to_numpy() + 1
    words = pa.concat_arrays([pa.array([END], pa.binary()), coded.dictionary.cast(pa.large_binary()).cast(pa.binary())])
    # frequent words get small numbers, whose upper bytes then compress well
    rank = np.argsort(-np.bincount(numbers, minlength=len(words)), kind="stable")
    to = np.empty(len(rank), np.int64)
    to[rank] = np.arange(len(rank))
    tokens = to[numbers].astype("<u4")
    held = pc.fill_null(batch.column("held_out"), False)
    learnt = np.bincount(tokens[np.repeat(~held.to_numpy(zero_copy_only=False), sizes)], minlength=len(words))

    def row(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    data = tokens.view(np.uint8).reshape(-1, 4).T.tobytes()
    columns = [row(words.take(pa.array(rank))), row(pa.array(learnt, pa.int32())), row(batch.column("doc_id")), row(held), row(pa.array(sizes, pa.int32()))]
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *columns, pa.array([data], pa.binary())], names=chunk_schema(T.LongType()).names)


def _key(word: Column) -> list[Column]:
    """A word's 96 bits of hashes: two words share them once in 10**28 pairs."""
    return [F.xxhash64(word).alias("h"), (F.crc32(word) - (1 << 31)).cast("int").alias("k")]


def word_counts(chunks: DataFrame) -> DataFrame:
    """(word, c): the training tokens of every word of the training documents,
    written to the shared folder."""
    rows = chunks.select(F.explode(F.arrays_zip("words", "train_counts")).alias("w")).where("w.train_counts > 0").select(F.col("w.words").alias("word"), F.col("w.train_counts").alias("n"))
    return common.stash(rows.groupBy("word").agg(F.sum("n").alias("c")), "lm-counts")


class Statistics:
    """Totals of the corpus: bounded numbers of them, whatever its size."""

    def __init__(self, counts: DataFrame):
        self.cutoff = _cutoff(counts)
        top = sorted(((bytes(r.word), r.c) for r in counts.where(F.col("c") >= self.cutoff).select("word", "c").collect()), key=lambda x: (-x[1], x[0]))
        self.head = pa.array([w for w, _ in top], pa.binary())
        self.head_counts = np.array([c for _, c in top], np.int64)
        self.singles = min(SINGLES, len(top))
        n, v = np.zeros(GROUPS, np.int64), np.zeros(GROUPS, np.int64)
        for leaf, words, tokens in _ending_totals(counts):
            n[leaf], v[leaf] = tokens, words
        self.tokens, self.words = int(n.sum()), int(v.sum())
        own = endings(self.head[: self.singles])
        np.subtract.at(n, own, self.head_counts[: self.singles])
        np.subtract.at(v, own, 1)
        #: Tokens of each leaf; of those by ending with one more for each word and for an unknown one.
        self.leaf_totals = np.concatenate([np.pad(self.head_counts[: self.singles], (0, SINGLES - self.singles)), n + v + 1])

    def place(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(place among the most frequent words or -1, leaf) of each word."""
        at = pc.fill_null(pc.index_in(words, value_set=self.head), -1).to_numpy().astype(np.int64)
        return at, np.where((at >= 0) & (at < self.singles), at, SINGLES + endings(words))

    def biases(self) -> list[np.ndarray]:
        """For each level, the logarithms of the branches' shares at each node.
        A leaf of no word has no share."""
        totals = self.leaf_totals.astype(np.float64)
        out = []
        for level in range(LEVELS):
            sums = totals.reshape(WAYS**level, WAYS, -1).sum(-1)
            out.append(np.log(np.maximum(sums, 1e-12) / np.maximum(sums.sum(1, keepdims=True), 1e-12)).astype(np.float32))
        return out


def _cutoff(counts: DataFrame) -> int:
    """The least count such that at most HEAD words have it or more, from a
    histogram of counts (exact below 128, then 64 steps from a power of two to
    the next, so a few thousand rows)."""
    exponent = F.floor(F.log2("c")).cast("int")
    step = F.when(F.col("c") < 128, F.lit(1)).otherwise(F.pow(F.lit(2.0), exponent - 6)).cast("long")
    found = counts.groupBy((F.col("c") - F.col("c") % step).alias("least")).count().collect()
    cutoff, words = 1 << 62, 0
    for row in sorted(found, key=lambda r: -r.least):
        words += row["count"]
        if words > HEAD:
            return cutoff
        cutoff = row.least
    return 1


def _ending_totals(counts: DataFrame) -> list[tuple[int, int, int]]:
    """(leaf by ending, words, tokens) of the corpus: GROUPS rows at most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(GROUPS, np.int64), np.zeros(GROUPS, np.int64)
        for batch in batches:
            leaf = endings(batch.column("word"))
            np.add.at(n, leaf, batch.column("c").to_numpy())
            v += np.bincount(leaf, minlength=GROUPS)
        some = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(v[some]), pa.array(n[some])], names=["leaf", "words", "tokens"])

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("leaf", "words", "tokens")])
    found = common.map_batches(counts.select("word", "c"), run, schema).groupBy("leaf").agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens"))
    return [(r.leaf, r.words, r.tokens) for r in found.collect()]


def _unpacked(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(tokens, sizes, words, word hashes) of a chunk."""
    raw = np.frombuffer(batch.column("tokens")[i].as_buffer(), np.uint8)
    tokens = np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    words = batch.column("words")[i].values
    hashes = np.fromiter(map(zlib.crc32, words.to_pylist()), np.uint64, len(words))
    return tokens, batch.column("sizes")[i].values.to_numpy().astype(np.int64), words, hashes


def contexts(tokens: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes of each token's features: (FEATURES, tokens)."""
    n = len(tokens)
    at = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    start = np.uint64(0xFFFFFFFF + 1)  # before the document's beginning
    back = []
    for d in (1, 2, 3):
        before = np.full(n, start)
        before[d:] = hashes[tokens[:-d]] if d < n else start
        before[at < d] = start
        back.append(before)
    out = np.empty((FEATURES, n), np.uint64)
    for f, x in enumerate([*back, back[0] * np.uint64(31) + back[1]]):
        out[f] = (x + np.uint64(f + 1) * np.uint64(0x9E3779B9)) * np.uint64(0x9E3779B97F4A7C15)
    return out


def _rows(context: np.ndarray, level: int, node: np.ndarray) -> np.ndarray:
    """The hashed rows of a feature at a level's nodes, in 16 bits."""
    if not level:
        return (context >> np.uint64(48)).astype(np.uint16)
    both = (context >> np.uint64(20)) + node.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return (both * np.uint64(0x9FB21C651E98DF25) >> np.uint64(48)).astype(np.uint16)


def _summed(g: np.ndarray, own: np.ndarray, sums: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, their tokens, sums of their tokens' gradients) of a feature; own:
    each token's row.  The sums lie in the given array, ``room`` is overwritten.

    Rows of fewer than ``FEW`` tokens are summed side by side, token by token;
    np.add.reduceat is for long runs.
    """
    order = np.argsort(own, kind="stable")
    key = own[order]
    edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    starts, sizes = edges[:-1], edges[1:] - edges[:-1]
    sums = np.take(g, order[starts], 0, out=sums[: len(starts)], mode="clip")
    whole, several = sums.view(_WHOLE)[:, 0], np.flatnonzero(sizes > 1)
    large, some = several[sizes[several] >= FEW], several[sizes[several] < FEW]
    if len(large):
        n = sizes[large]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(starts[large] - (ends - n), n)
        found = np.add.reduceat(np.take(g, order[at], 0, out=room[: len(at)], mode="clip"), ends - n, axis=0)
        np.put(whole, large, found.view(_WHOLE)[:, 0], mode="clip")
    for k in range(1, FEW):
        if not len(some):
            break
        more = np.take(g, order[starts[some] + k], 0, out=room[: len(some)], mode="clip")
        more += np.take(sums, some, 0, mode="clip")
        np.put(whole, some, more.view(_WHOLE)[:, 0], mode="clip")
        some = some[sizes[some] > k + 1]
    return key[starts].astype(np.int64), sizes.astype(np.float32), sums


class Weights:
    """A table of hashed rows for each level, on top of fixed biases."""

    def __init__(self, biases: list[np.ndarray]):
        self.biases = biases
        self.tables = [np.zeros((ROWS, WAYS), np.float32) for _ in range(LEVELS)]
        self.used = [np.zeros(ROWS, np.float32) for _ in range(LEVELS)]
        self._softmax_room = np.empty((2, STEP, WAYS), np.float32)

    def _softmax(self, level: int, node: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """What the branches' chances at each token's node are in proportion to,
        and the factor that makes them chances; the first array is used again by
        the next call."""
        z, more = self._softmax_room[:, : len(node)]
        np.take(self.biases[level], node, 0, out=z, mode="clip")
        for own in rows:
            np.take(self.tables[level], own, 0, out=more, mode="clip")
            z += more
        np.clip(z, -LIMIT, LIMIT, out=z)
        np.exp(z, out=z)
        return z, 1 / (z @ np.ones(WAYS, np.float32))

    def _levels(self, some: np.ndarray, leaf: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
        for level in range(LEVELS):
            node = leaf // WAYS ** (LEVELS - level)
            yield level, node, leaf // WAYS ** (LEVELS - level - 1) % WAYS, [_rows(x, level, node) for x in some]

    def log_chance(self, context: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """log10 of the chance of each token's leaf in its context."""
        out = np.zeros(len(leaves))
        for start in range(0, len(leaves), STEP):
            leaf = leaves[start : start + STEP]
            first, chance = np.arange(len(leaf)) * WAYS, np.ones(len(leaf))
            for level, node, branch, rows in self._levels(context[:, start : start + STEP], leaf):
                z, factor = self._softmax(level, node, rows)
                chance *= np.maximum(z.ravel()[first + branch] * factor, 1e-30)
            out[start : start + STEP] = np.log10(chance)
        return out

    def steps(self, seen: list[np.ndarray], context: np.ndarray, leaves: np.ndarray) -> None:
        """Gradient steps of the likelihood over a chunk, in place; ``seen`` has
        each row's sum of squared gradients."""
        room = np.empty((2, STEP, WAYS), np.float32)
        for start in range(0, len(leaves), STEP):
            leaf = leaves[start : start + STEP]
            first = np.arange(len(leaf)) * WAYS
            for level, node, branch, rows in self._levels(context[:, start : start + STEP], leaf):
                g, factor = self._softmax(level, node, rows)
                g *= factor[:, None]
                g.ravel()[first + branch] -= 1
                table, whole = self.tables[level], self.tables[level].view(_WHOLE)[:, 0]
                for own in rows:
                    row, many, sums = _summed(g, own, *room)
                    # a row's own tokens in a step count as their number's root
                    squares = seen[level][row] + np.multiply(sums, sums, out=room[1, : len(row)]) @ np.ones(WAYS, np.float32) / many
                    seen[level][row] = squares
                    sums *= (RATE / np.sqrt(many * squares))[:, None]
                    now = np.take(table, row, 0, out=room[1, : len(row)], mode="clip")
                    now -= sums
                    np.put(whole, row, now.view(_WHOLE)[:, 0], mode="clip")
                    self.used[level][row] += many

    def row(self, part: int) -> pa.RecordBatch:
        """What a task hands on: how often rows were used, and the rows."""
        used = np.concatenate(self.used).tobytes()
        tables = np.concatenate([t.ravel() for t in self.tables]).astype(np.float16).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([used], pa.binary()), pa.array([tables], pa.binary())], names=["part", "used", "weights"])

    def add(self, used: bytes, tables: bytes) -> None:
        """Adds another task's rows, as often as it used them."""
        u, w = np.frombuffer(used, np.float32).reshape(LEVELS, ROWS), np.frombuffer(tables, np.float16).reshape(LEVELS, ROWS, WAYS)
        for level in range(LEVELS):
            self.tables[level] += w[level] * u[level][:, None]
            self.used[level] += u[level]

    def mean(self) -> Weights:
        """Makes sums of rows their averages."""
        for table, used in zip(self.tables, self.used, strict=True):
            table /= np.maximum(used, 1)[:, None]
        return self


def _average(parts: DataFrame, n: int, biases: list[np.ndarray]) -> Weights:
    """Averages the tasks' weights in a tree."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, Weights] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                own = sums.setdefault(batch.column("part")[i].as_py() // FAN, Weights([]))
                own.add(batch.column("used")[i].as_py(), batch.column("weights")[i].as_py())
        for part in list(sums):
            yield sums.pop(part).mean().row(part)

    while n > 1:
        placed = parts.withColumn("to", F.floor(F.col("part") / FAN)).repartition(-(-n // FAN), "to").drop("to")
        parts = common.map_batches(placed, run, parts.schema)
        n = -(-n // FAN)
    weights = Weights(biases)
    for row in parts.collect():  # one row
        weights.add(row.used, row.weights)
    return weights.mean()


def train(chunks: DataFrame, statistics: Statistics) -> Weights:
    """The weights, learnt from all training documents of the chunks."""
    spark = chunks.sparkSession
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("used", T.BinaryType()), T.StructField("weights", T.BinaryType())])
    weights = Weights(statistics.biases())
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast((weights.biases, weights.tables, statistics))

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = None
            for batch in batches:
                for i in range(batch.num_rows):
                    if own is None:
                        own = Weights(sent.value[0])
                        own.tables = [t.copy() for t in sent.value[1]]
                        seen = [np.ones(ROWS, np.float32) for _ in range(LEVELS)]
                    tokens, sizes, words, hashes = _unpacked(batch, i)
                    learn = np.repeat(~np.array(batch.column("held")[i].as_py(), bool), sizes)
                    leaves = sent.value[2].place(words)[1][tokens]
                    own.steps(seen, contexts(tokens, sizes, hashes)[:, learn], leaves[learn])
            if own is not None:
                yield own.row(TaskContext.get().partitionId())

        # written once: a retried average does not train again
        parts = common.stash(common.map_batches(chunks.select("words", "held", "sizes", "tokens"), run, schema), "lm-weights")
        last = parts.agg(F.max("part")).first()[0]
        weights = _average(parts, (last or 0) + 1, weights.biases)
        common.discard(parts)
        sent.unpersist()
    return weights


def score_schema(doc_id: T.DataType) -> T.StructType:
    """Of the results for documents whose ids have that type."""
    return T.StructType(
        [
            T.StructField("doc_id", doc_id),
            T.StructField("held_out", T.BooleanType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("n_known", T.LongType()),
            T.StructField("train_tokens", T.LongType()),
            T.StructField("base_score", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
        ]
    )


def tail_counts(chunks: DataFrame, counts: DataFrame, statistics: Statistics) -> DataFrame:
    """(chunk, at, c): for each chunk, the places among its words, and the
    counts, of known words that are not among the most frequent ones."""
    spark = chunks.sparkSession
    sent = spark.sparkContext.broadcast(statistics.head)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = batch.column("words")[i].values
                at = np.flatnonzero(pc.is_null(pc.index_in(words, value_set=sent.value)).to_numpy(zero_copy_only=False))
                for a in range(0, len(at), 50_000):
                    some = at[a : a + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), batch.column("chunk")[i].as_py())), pa.array(some, pa.int32()), words.take(pa.array(some))], names=["chunk", "i", "word"])

    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("i", T.IntegerType()), T.StructField("word", T.BinaryType())])
    rows = common.map_batches(chunks.select("chunk", "words"), run, schema).select("chunk", "i", *_key(F.col("word")))
    found = rows.join(counts.where(F.col("c") < statistics.cutoff).select(*_key(F.col("word")), "c"), ["h", "k"]).select("chunk", F.struct("i", "c").alias("x"))
    found = found.groupBy("chunk").agg(F.collect_list("x").alias("x"))
    return found.select("chunk", F.col("x.i").alias("at"), F.col("x.c").alias("c"))


def score_chunks(chunks: DataFrame, counts: DataFrame, statistics: Statistics, weights: Weights) -> DataFrame:
    """One row per document of the chunks."""
    sent = chunks.sparkSession.sparkContext.broadcast((weights, statistics))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tokens, sizes, words, hashes = _unpacked(batch, i)
                at = batch.column("at")[i].values
                tail = None if at is None else (at.to_numpy(), batch.column("c")[i].values.to_numpy())
                yield scored(*sent.value, tokens, sizes, words, hashes, tail, batch.column("doc_ids")[i].values, batch.column("held")[i].values)

    schema = score_schema(chunks.schema["doc_ids"].dataType.elementType)
    return common.map_batches(chunks.drop("train_counts").join(tail_counts(chunks, counts, statistics), "chunk", "left"), run, schema)


def scored(weights: Weights, statistics: Statistics, tokens, sizes, words, hashes, tail, doc_ids: pa.Array, held: pa.Array) -> pa.RecordBatch:
    """The documents of one chunk.  tail: (places, counts) of its words beyond the head."""
    place, leaves = statistics.place(words)
    c = np.zeros(len(words))
    c[place >= 0] = statistics.head_counts[place[place >= 0]]
    if tail is not None:
        c[tail[0]] = tail[1]
    n, v = statistics.tokens, statistics.words
    # of one quotient: a difference of logarithms loses digits where a word is nearly all there is
    base = np.log10((c + 1) / (n + v + 1))
    inside = np.where(leaves < SINGLES, 0.0, np.log10((c + 1) / np.maximum(statistics.leaf_totals, 1)[leaves]))
    chance = weights.log_chance(contexts(tokens, sizes, hashes), leaves[tokens])
    first = np.cumsum(sizes) - sizes
    return pa.RecordBatch.from_arrays(
        [
            doc_ids,
            held,
            pa.array(sizes),
            pa.array(np.add.reduceat((c > 0)[tokens].astype(np.int64), first)),
            pa.array(np.full(len(sizes), n, np.int64)),
            pa.array(np.add.reduceat(base[tokens], first)),
            pa.array(np.add.reduceat(inside[tokens] + chance, first)),
        ],
        names=score_schema(T.LongType()).names,
    )


def scores(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score
    (log10 of the model's chance) of every document; learns from those that
    are not held out."""
    chunks = pack(docs, held_out, doc_id, text)
    counts = word_counts(chunks)
    statistics = Statistics(counts)
    return score_chunks(chunks, counts, statistics, train(chunks, statistics))
