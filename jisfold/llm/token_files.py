"""Token ids in word-aligned binary files (Simple-8b).

A 64-bit word holds a 4-bit selector and 60 bits of payload, which the
selector cuts into equal fields: 60 of 1 bit, 30 of 2, down to one of 60; two
selectors stand for runs of 120 and 240 zeros.  The greedy choice at each
place is the selector that takes most ids.  Ids are packed in blocks; a block
begins a new word, and a table of the blocks' word offsets lets a reader
decode any block, or all of them at once, in array operations.  Values of
2**60 - 1 and above are escaped: their word's payload is all ones, and a table
has their places and values.

A file, in little-endian numbers: magic, version, ids per block, number of
documents, ids, blocks, escapes and words (HEADER); per document its id, a
flag (1: the id is null) and its number of ids; per block the offset of its
first word; per escape its place and value; the words.

The files of a set follow one another in the order of document ids; a list
of them, in the order of partitions and of files in one, has what comes before
each.  A file is
written under another name and renamed, and only files that a finished task
reported belong to the set, so lost executors and repeated attempts leave
nothing in it.

Defined results: null text counts as empty and has the end id alone; rows with
a null document id come first; rows that share an id follow by the hash of
their text; an empty table makes no files and reads back as no rows; a
document is never cut between files; texts of any length are encoded whole;
extra columns are ignored; document ids that are no integers are an error of
Arrow's conversion.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jisfold.llm import common
from jisfold.llm.pretokens import PartIds

MAGIC, VERSION = b"JFS8", 1
HEADER = struct.Struct("<4sHxxIxxxxQQQQQ")
#: Fixed values: (ids, bits) of Simple-8b's selectors.
SELECTORS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = (1 << 60) - 1
BLOCK = 4096
#: Ids packed at once, which bounds the memory of a writer.
SEGMENT = 64 * BLOCK
IDS_PER_FILE = 1 << 22
#: Rows of a list of files (about 100 bytes each) that are sent to all tasks; a
#: longer list is joined by a shuffle.
SENT_FILES = 50_000
#: Bits of small ids.
_WIDTHS = np.frexp(np.arange(1 << 17, dtype=np.float64))[1].astype(np.int8)
_COUNTS = np.array([c for c, _ in SELECTORS], np.int64)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, words of each block) of ids below 2**60, blocks of BLOCK ids."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    width = _WIDTHS[values] if int(values.max()) < len(_WIDTHS) else np.minimum(np.frexp(values.astype(np.float64))[1], 60).astype(np.int8)
    left = np.tile(np.arange(BLOCK, 0, -1, dtype=np.int16), -(-n // BLOCK))[:n]
    tail = n % BLOCK or BLOCK
    left[n - tail :] = np.arange(tail, 0, -1)
    selector = np.full(n, 15, np.int8)
    widest, span = width, 1
    for k in range(14, -1, -1):
        count, bits = SELECTORS[k]
        if count > n:
            break
        # the widest of the next `count` ids, from the widest of the next `span`
        while span < count:
            step = min(span, count - span)
            widest = np.maximum(widest[:-step], widest[step:]) if len(widest) > step else widest[:0]
            span += step
        fits = widest <= bits
        if not fits.any():
            break
        fits &= left[: len(widest)] >= count
        selector[: len(widest)][fits] = k
    take = _COUNTS[selector]
    # follow the words of all blocks side by side
    starts, at = [], np.arange(0, n, BLOCK)
    ends = np.minimum(at + BLOCK, n)
    while len(at):
        starts.append(at)
        at = at + take[at]
        going = at < ends
        at, ends = at[going], ends[going]
    first = np.sort(np.concatenate(starts))
    words = np.zeros(len(first), np.uint64)
    chosen = selector[first]
    for k in np.unique(chosen):
        count, bits = SELECTORS[k]
        rows = np.flatnonzero(chosen == k)
        if bits:
            fields = values[first[rows][:, None] + np.arange(count)]
            words[rows] = np.bitwise_or.reduce(fields << (np.arange(count, dtype=np.uint64) * np.uint64(bits)), axis=1)
        words[rows] |= np.uint64(int(k) << 60)
    return words, np.bincount(first // BLOCK, minlength=-(-n // BLOCK))


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of whole words; escapes come back as ESCAPE."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[chosen]
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for k in np.unique(chosen):
        count, bits = SELECTORS[k]
        if bits:
            rows = np.flatnonzero(chosen == k)
            fields = words[rows][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits))
            out[first[rows][:, None] + np.arange(count)] = fields & np.uint64((1 << bits) - 1)
    return out


def dump(ids: list, sizes: list[int], values: np.ndarray) -> bytes:
    """The bytes of one file.  ids: document ids, None for null."""
    values = values.astype(np.uint64, copy=False)
    places = np.flatnonzero(values >= ESCAPE)
    escaped = values[places]
    if len(places):
        values = values.copy()
        values[places] = ESCAPE
    words, per_block = [], []
    for at in range(0, len(values), SEGMENT):
        w, b = pack(values[at : at + SEGMENT])
        words.append(w)
        per_block.append(b)
    words = np.concatenate(words) if words else np.zeros(0, np.uint64)
    per_block = np.concatenate(per_block) if per_block else np.zeros(0, np.int64)
    parts = [
        HEADER.pack(MAGIC, VERSION, BLOCK, len(ids), len(values), len(per_block), len(places), len(words)),
        np.array([x or 0 for x in ids], "<i8").tobytes(),
        np.array([x is None for x in ids], np.uint8).tobytes(),
        np.array(sizes, "<u8").tobytes(),
        (np.cumsum(per_block) - per_block).astype("<u8").tobytes(),
        places.astype("<u8").tobytes(),
        escaped.astype("<u8").tobytes(),
        words.astype("<u8").tobytes(),
    ]
    return b"".join(parts)


class TokenFile:
    """A file's content: documents, sizes and ids, by blocks or all at once."""

    def __init__(self, data: bytes):
        magic, version, self.block, docs, self.n_ids, blocks, escapes, words = HEADER.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file of this version")
        at = HEADER.size

        def column(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        numbers, null = column("<i8", docs), column("u1", docs)
        self.doc_ids = [None if gone else x for x, gone in zip(numbers.tolist(), null, strict=True)]
        self.sizes, self.offsets = column("<u8", docs).astype(np.int64), column("<u8", blocks).astype(np.int64)
        self.places, self.escaped, self.words = column("<u8", escapes).astype(np.int64), column("<u8", escapes), column("<u8", words)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks first..last-1."""
        end = self.offsets[last] if last < len(self.offsets) else len(self.words)
        out = unpack(self.words[self.offsets[first] : end]) if first < last else np.zeros(0, np.uint64)
        here = (self.places >= first * self.block) & (self.places < last * self.block)
        out[self.places[here] - first * self.block] = self.escaped[here]
        return out

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(document id, ids) in order; some blocks are decoded at a time."""
        at, held, step = 0, np.zeros(0, np.uint64), max(1, SEGMENT // self.block)
        for doc, size in zip(self.doc_ids, self.sizes.tolist(), strict=True):
            parts = [held]
            have = len(held)
            while have < size:
                parts.append(self.blocks(at, min(at + step, len(self.offsets))))
                at, have = at + step, have + len(parts[-1])
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield doc, held[:size]
            held = held[size:]


class LibraryIds:
    """Ids by the tokenizers library, asked once for each distinct part.

    Many parts are asked for in one text, with a tab between them: a tab that
    other white space does not stand before is a token of its own, and so the
    library's ids are cut at it.  A vocabulary for which that does not hold is
    an error.  Texts that parts do not make up are encoded whole.  ``plain``:
    special tokens' strings in a text are ordinary text.
    """

    #: Parts in one text, and texts that the library gets at once.
    PARTS, TEXTS = 1000, 32

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        tab = self._whole("\t")
        if len(tab) != 1 or self._whole("a\t b\tc") != [*self._whole("a"), *tab, *self._whole(" b"), *tab, *self._whole("c")]:
            raise ValueError(f"{path} does not keep tabs apart")
        self.tab = tab[0]
        self.known = PartIds(self._parts, self._whole, special)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = ["\t".join(parts[at : at + self.PARTS]) + "\t" for at in range(0, len(parts), self.PARTS)]
        found = [np.array(e.ids, np.uint32) for at in range(0, len(joined), self.TEXTS) for e in self.tokenizer.encode_batch_fast(joined[at : at + self.TEXTS], add_special_tokens=False)]
        ids = np.concatenate(found)
        cuts = np.flatnonzero(ids == self.tab)
        if len(cuts) != len(parts):
            raise ValueError("the library did not keep the parts apart")
        return np.delete(ids, cuts), np.diff(cuts, prepend=-1) - 1

    def encode(self, texts: pa.Array) -> list[bytes]:
        return self.known.encode(texts)


@lru_cache(maxsize=2)
def library_ids(path: str) -> LibraryIds:
    return LibraryIds(path)


def in_order(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows in ascending order of document id over the partitions, in ranges."""
    df = df.withColumn("__tie", F.xxhash64(text))
    return df.repartitionByRange(F.col(doc_id), F.col("__tie")).sortWithinPartitions(doc_id, "__tie").drop("__tie")


def write(df: DataFrame, folder: str, make_ids: Callable[[], Callable[[pa.RecordBatch], list[bytes]]], doc_id: str = "doc_id", ids_per_file: int = IDS_PER_FILE) -> list[dict]:
    """Writes the ids of df's rows, as they are ordered over its partitions.

    ``make_ids()`` gives, in a task, a function from a batch to the ids of
    each row (little-endian unsigned 32-bit integers).  Returns the list of
    files in order: name, start (ids before it), docs, ids.  The list has a
    row for each file, not for each document.
    """
    folder = _qualified(df.sparkSession, folder)
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("part", T.LongType()), T.StructField("file", T.LongType()), T.StructField("docs", T.LongType()), T.StructField("ids", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, made = None, TaskContext.get().partitionId(), 0
        docs: list = []
        coded: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal made, held
            name = f"ids-{part:06d}-{made:05d}-{uuid.uuid4().hex}.s8b"
            values = np.frombuffer(b"".join(coded), "<u4")
            out, base = pafs.FileSystem.from_uri(folder)
            out.create_dir(base, recursive=True)
            with out.open_output_stream(f"{base}/_{name}") as f:
                f.write(dump(docs, [len(x) // 4 for x in coded], values))
            out.move(f"{base}/_{name}", f"{base}/{name}")
            row = pa.RecordBatch.from_pydict({"name": [name], "part": [part], "file": [made], "docs": [len(docs)], "ids": [len(values)]})
            made, held = made + 1, 0
            docs.clear()
            coded.clear()
            return row

        for batch in batches:
            ids_of = ids_of or make_ids()
            for some in common.slices(batch):
                for doc, ids in zip(some.column(doc_id).to_pylist(), ids_of(some), strict=True):
                    docs.append(doc)
                    coded.append(ids)
                    held += len(ids) // 4
                    if held >= ids_per_file:
                        yield close()
        if docs:
            yield close()

    files, start = [], 0
    for row in sorted(common.map_batches(df, run, schema).collect(), key=lambda r: (r.part, r.file)):
        files.append({"name": row.name, "start": start, "docs": row.docs, "ids": row.ids})
        start += row.ids
    return files


def read(spark: SparkSession, folder: str, files: list[dict], row: Callable[[np.ndarray], list], outputs: T.StructType) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens and what ``row``
    makes of its ids (a list of values for ``outputs``)."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), *outputs.fields])
    if not files:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(f["name"], f["start"]) for f in files], "name string, file_start long")
    if len(files) <= SENT_FILES:
        listed = F.broadcast(listed)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.s8b").load(_qualified(spark, folder))
    found = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").join(listed, "name").select("content", "file_start")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                start = batch.column("file_start")[i].as_py()
                rows = []
                for doc, ids in TokenFile(batch.column("content")[i].as_py()).documents():
                    rows.append([doc, start, len(ids), *row(ids)])
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], names=arrow.names)

    return common.map_batches(found, run, schema)


def crc32(ids: np.ndarray) -> list[int]:
    return [zlib.crc32(ids.astype("<u4").tobytes())]


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder's full URI, as Spark's file systems name it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def write_texts(df: DataFrame, folder: str, path: str, end_id: int | None = 0, doc_id: str = "doc_id", text: str = "text", ids_per_file: int = IDS_PER_FILE) -> list[dict]:
    """Encodes whole texts with the tokenizers library, appends the end id to
    each document and writes the files in ascending order of document id."""
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def make_ids():
        library = library_ids(path)
        return lambda batch: [x + end for x in library.encode(batch.column(text))]

    return write(in_order(df.select(doc_id, text), doc_id, text), folder, make_ids, doc_id, ids_per_file)
