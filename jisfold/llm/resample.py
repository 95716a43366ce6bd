"""Importance resampling towards a target, by hashed n-grams.

Each document's features are counted by bucket, and the counts go out as
postings partitioned by bucket: a row has one range of buckets and the
documents of one slice of the input, packed.  In each partition the counts of
its buckets are summed, both corpora meet by bucket and give each bucket's
gain, the postings emit each document's share of gains, and these are summed
by document.  A bucket that every document has is many rows of few megabytes,
dealt out by slices of documents, never one group.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jisfold.llm.common import Remembered, map_batches, raw_texts, slices, stash

#: Words in UTF-8: ASCII letters (in lower case) and digits, and all bytes of other characters.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes(range(256)).lower()
#: Ranges of buckets, and slices of documents, by which postings are dealt out.
BLOCKS, SLICES = 16, 4096
#: Words whose buckets a task remembers.
KNOWN = 400_000

POSTINGS = "block int, slice int, row long, id string, n_words long, n_features long, docs binary, sizes binary, buckets binary, counts binary"


def words(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text, A-Z in lower case.

    >>> words("A b-c \\u00c9".encode())
    [b'a', b'b', b'c', b'\\xc3\\x89']
    """
    return _WORD.findall(text.translate(_LOWER))


def _postings(most: int, n_buckets: int):
    width = -(-n_buckets // BLOCKS)
    schema = pa.schema([("block", pa.int32()), ("slice", pa.int32()), ("row", pa.int64()), ("id", pa.string()), ("n_words", pa.int64()), ("n_features", pa.int64()), *[(x, pa.binary()) for x in ("docs", "sizes", "buckets", "counts")]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of = Remembered(lambda word: zlib.crc32(word) % n_buckets, KNOWN)
        for batch in batches:
            for some in slices(batch):
                yield from one(some, bucket_of.__getitem__)

    def one(some: pa.RecordBatch, bucket_of) -> Iterator[pa.RecordBatch]:
        rows, n_words, n_features, found = some.column("row").to_numpy(), [], [], []
        for k, text in enumerate(raw_texts(some, "text")):
            own = words(text)
            n_words.append(len(own))
            features = own if most == 1 else [b" ".join(own[i : i + n]) for n in range(1, most + 1) for i in range(len(own) - n + 1)]
            n_features.append(len(features))
            buckets, counts = np.unique(np.fromiter(map(bucket_of, features), np.int64, len(features)), return_counts=True)
            found.append((np.full(len(buckets), k), buckets, counts))
        heads = {"row": rows, "id": some.column("id"), "n_words": n_words, "n_features": n_features}
        yield pa.RecordBatch.from_arrays([pa.array(heads[f.name], f.type) if f.name in heads else pa.nulls(len(rows), f.type) for f in schema], schema=schema)
        doc, bucket, count = (np.concatenate(x) for x in zip(*found, strict=True))
        # a count of more than 255 is several postings
        times = -(-count // 255)
        doc, bucket, last = np.repeat(doc, times), np.repeat(bucket, times), np.cumsum(times) - 1
        small = np.full(len(doc), 255, np.int64)
        small[last] = count - 255 * (times - 1)
        block = bucket // width
        order, out = np.argsort(block, kind="stable"), []
        ends = np.searchsorted(block[order], np.arange(BLOCKS + 1))
        for b in np.flatnonzero(np.diff(ends)).tolist():
            at = order[ends[b] : ends[b + 1]]
            own, sizes = np.unique(doc[at], return_counts=True)  # documents are in order within a block
            packed = rows[own].astype("<i8"), sizes.astype("<u4"), (bucket[at] - b * width).astype("<u2" if width <= 1 << 16 else "<u4"), small[at].astype("u1")
            out.append((b, int(zlib.crc32(rows[:1].tobytes()) % SLICES), None, None, None, None, *[x.tobytes() for x in packed]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _unpacked(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(documents, number of each one's postings, buckets, counts) of each row."""
    for block, docs, sizes, buckets, counts in zip(*[batch.column(x).to_pylist() for x in ("block", "docs", "sizes", "buckets", "counts")], strict=True):
        own = np.frombuffer(buckets, "<u2" if width <= 1 << 16 else "<u4").astype(np.int64) + block * width
        yield np.frombuffer(docs, "<i8"), np.frombuffer(sizes, "<u4").astype(np.int64), own, np.frombuffer(counts, "u1").astype(np.int64)


def postings(docs: DataFrame, text: str, most: int, n_buckets: int, doc_id: str | None = None) -> DataFrame:
    """Rows of postings (by block and slice), and a row for each document with
    its id as text, words and features, where block is null."""
    own = docs.select(F.monotonically_increasing_id().alias("row"), (F.col(doc_id).cast("string") if doc_id else F.lit(None).cast("string")).alias("id"), F.col(text).cast("string").alias("text"))
    return map_batches(own, _postings(most, n_buckets), T.StructType.fromDDL(POSTINGS))


def bucket_counts(found: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, n): the features of all documents by bucket."""
    width = -(-n_buckets // BLOCKS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * BLOCKS, np.int64)
        for batch in batches:
            for _, _, buckets, counts in _unpacked(batch, width):
                np.add.at(total, buckets, counts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    own = map_batches(found.where("block is not null").select("block", "docs", "sizes", "buckets", "counts"), run, T.StructType.fromDDL("bucket int, n long"))
    return own.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, n_buckets: int) -> np.ndarray:
    """Each bucket's gain, from the counts (bucket, n) of both corpora.

    The driver gets one number for each bucket; their number is a parameter.
    """
    both = raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    both = stash(both.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t")), "bucket-counts")
    all_s, all_t = (x or 0.0 for x in both.agg(F.sum("s"), F.sum("t")).first())
    ratio = (F.col("t") + 1) * F.lit(all_s + n_buckets) / ((F.col("s") + 1) * F.lit(all_t + n_buckets))
    out = np.zeros(-(-n_buckets // BLOCKS) * BLOCKS, np.int64)
    for bucket, gain in both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio))).collect():
        out[bucket] = gain
    return out


def contributions(found: DataFrame, gain: np.ndarray, n_buckets: int) -> DataFrame:
    """(row, gain): each document's sum of gains over its features."""
    width = -(-n_buckets // BLOCKS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, sizes, buckets, counts in _unpacked(batch, width):
                sums = np.add.reduceat(gain[buckets] * counts, np.cumsum(sizes) - sizes)
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(sums)], names=["row", "gain"])

    own = map_batches(found.where("block is not null").select("block", "docs", "sizes", "buckets", "counts"), run, T.StructType.fromDDL("row long, gain long"))
    return own.groupBy("row").agg(F.sum("gain").alias("gain"))


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), least_words: int = 20, most: int = 1, n_buckets: int = 10_000, seed: str = "2024", doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document.

    Features are all runs of 1 to ``most`` words.  A document's weight is the
    floored mean of its features' gains (0 without features), its score that
    and Gumbel noise from its id; of the documents with ``least_words`` words
    the given share is drawn by score, and numbered from 1.

    A null text has no words.  A null id counts as the text '' in the noise and
    comes last among equals.  Ties go to the smaller id, then (rows that repeat
    an id) to fewer features.  Repeated rows are documents of their own.  Whole
    texts are counted, whatever their length.  Empty tables give no rows; with
    an empty target all of it counts as unseen.  Other columns don't matter.
    """
    kind = docs.schema[doc_id].dataType
    found = stash(postings(docs, text, most, n_buckets, doc_id).repartition("block", F.coalesce("slice", F.col("row") % SLICES)), "postings", "zstd")
    gain = gains(bucket_counts(found, n_buckets), bucket_counts(postings(target, target_text, most, n_buckets), n_buckets), n_buckets)
    heads = found.where("block is null").select("row", "id", "n_words", "n_features")
    weighed = heads.join(contributions(found, gain, n_buckets), "row", "left")
    weight = F.when(F.col("n_features") > 0, F.floor(F.coalesce("gain", F.lit(0)) / F.col("n_features"))).otherwise(F.lit(0)).cast("long")
    draw = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("id", F.lit(""))), 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(draw)))
    scored = weighed.select(F.col("id").cast(kind).alias("doc_id"), "n_features", weight.alias("weight"), (weight + noise).alias("score"), (F.col("n_words") >= least_words).alias("eligible"))
    return _ranked(stash(scored, "scored"), share)


def _ranked(scored: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The rows with their place by score, where they are drawn.

    Scores are whole numbers that lie within some tens of thousands of each
    other (both their parts are logarithms), so places come from the number of
    rows above each score, and only rows of one score are put in order.
    """
    levels = scored.where("eligible").groupBy("score").agg(F.count("*").alias("n"))
    levels = levels.withColumn("band", F.floor(F.col("score") / 1024))
    bands = levels.groupBy("band").agg(F.sum("n").alias("n"))
    bands = bands.select("band", (F.sum("n").over(Window.orderBy(F.desc("band"))) - F.col("n")).alias("before"))
    own = Window.partitionBy("band").orderBy(F.desc("score"))
    above = levels.select("band", "score", (F.sum("n").over(own) - F.col("n")).alias("within")).join(bands, "band").select("score", (F.col("before") + F.col("within")).alias("above"))
    n = scored.where("eligible").count()
    drawn = n * share[0] // share[1]
    columns = ["doc_id", "n_features", "weight", "score"]
    placed = scored.where("eligible").join(above, "score")
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features")
    near = placed.where(F.col("above") < drawn).select(*columns, (F.col("above") + F.row_number().over(order)).alias("rank"))
    near = near.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = placed.where(F.col("above") >= drawn).select(*columns).unionByName(scored.where("not eligible").select(*columns))
    return near.unionByName(rest.withColumn("rank", F.lit(None).cast("long")))
