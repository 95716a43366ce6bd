"""Media columns: interleaved sequences of text and media, payloads by digest.

A page's HTML is parsed into an ordered array of items: runs of text, and
references to media with their captions (of a figure, else the alternative
text).  A reference ``media:<digest>`` names a payload by its SHA-256.  The
media table holds payloads in a stored form: an RGB picture of 64 pixels a
row, 8 bits a sample, as lossless PNG.  Items meet their payloads (or what was
computed from them) in a join by digest; position and caption travel with the
item, so the order of a sequence never depends on the join's.

Payloads are not shuffled: the table is written where the texts are read, a
payload that a task has stored before is not stored again, and only the small
rows computed from the stored bytes are joined, by digest and writing task, so
that a payload of very many copies is not one key.

Defined results: null text or HTML counts as empty (an empty payload is one
row of 192 spaces; empty HTML has no items); repeated rows give repeated
results; a reference without payload or digest keeps its place with nulls; equal
payloads have equal stored bytes; texts of any length are one payload each; an
empty table gives an empty result; extra columns are ignored by write_media and
kept by sequences, where one of the name of the result is replaced; resolve and
aligned keep the page columns that they are told.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jisfold.llm import common

#: Bytes of a row of samples: 64 pixels of 3 samples.
ROW = 192
PIXELS = 64
#: Bytes of payloads that a worker holds as objects at a time.
SLICE_BYTES = 4 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
ITEM = T.StructType(
    [
        T.StructField("position", T.IntegerType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("caption", T.StringType()),
    ]
)
#: Fixed values of HTML: elements that end a run of text, that hold no text
#: to show, and that refer to media by an attribute.
BLOCKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
HIDDEN = frozenset("script style noscript template".split())
MEDIA = {"img": "src", "video": "src", "audio": "src", "source": "src", "embed": "src", "object": "data"}


class _Sequence(HTMLParser):
    """Collects the items of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.caption: list[str] | None = None
        self.figure: list[int] | None = None
        self.hidden = 0

    def _flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "source": None, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        if tag in BLOCKS and self.caption is None:
            self._flush()
        if tag == "figure":
            self.figure = []
        elif tag == "figcaption" and self.figure is not None:
            self.caption = []
        elif tag in MEDIA:
            values = dict(attrs)
            source = values.get(MEDIA[tag])
            if source:
                self._flush()
                digest = (source[6:].lower() or None) if source.startswith("media:") else None
                if self.figure is not None:
                    self.figure.append(len(self.items))
                self.items.append({"position": len(self.items), "kind": "media", "text": None, "source": source, "digest": digest, "caption": values.get("alt") or values.get("title")})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in HIDDEN or tag in ("figure", "figcaption"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for at in self.figure or []:
                self.items[at]["caption"] = text or self.items[at]["caption"]
            if text and not self.figure:  # the caption came before its media
                self.figure_caption = text
            self.caption = None
        elif tag == "figure":
            early = self.__dict__.pop("figure_caption", None)
            for at in self.figure or []:
                self.items[at]["caption"] = early or self.items[at]["caption"]
            self.figure = None
        if tag in BLOCKS and self.caption is None:
            self._flush()

    def handle_data(self, data):
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)


def items(html: str) -> list[dict]:
    """The ordered items of a page.

    >>> [(i["kind"], i["text"] or i["source"]) for i in items("<p>a<img src=x.png>b")]
    [('text', 'a'), ('media', 'x.png'), ('text', 'b')]
    """
    parser = _Sequence()
    parser.feed(html)
    parser.close()
    if parser.caption:
        parser.words = parser.caption
        parser.caption = None
    parser._flush()
    return parser.items


def sequences(pages: DataFrame, html: str = "html", out: str = "items") -> DataFrame:
    """Adds each page's items, an array of structs in order.  No shuffle."""
    return common.append_columns(pages, T.StructType([T.StructField(out, T.ArrayType(ITEM, False))]), lambda: lambda batch: [[items(x) for x in common.texts(batch, html)]])


def padded(data: bytes) -> bytes:
    """The payload: spaces are added up to a positive multiple of ROW."""
    return data + b" " * (max(1, -(-len(data) // ROW)) * ROW - len(data))


def to_png(payload: bytes) -> bytes:
    """The payload, whole rows of samples, as a PNG picture."""
    rows = len(payload) // ROW
    if rows * ROW != len(payload) or not rows:
        raise ValueError("a payload has whole rows")
    lines = np.zeros((rows, ROW + 1), np.uint8)  # filter 0 before each row
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, ROW)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", PIXELS, rows, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of a picture that to_png wrote; damage is an error."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG picture")
    at, packed, shape = 8, [], None
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        data = media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + data):
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            packed.append(data)
        at += 12 + size
    if shape is None or shape[0] != PIXELS or shape[2:] != (8, 2, 0, 0, 0):
        raise ValueError("not a picture of this form")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(shape[1], ROW + 1)
    if lines[:, 0].any():
        raise ValueError("rows are filtered")
    return lines[:, 1:].tobytes()


def feature(samples: np.ndarray) -> str:
    """Rows, each channel's mean in thousandths, and shares of 8 levels in
    thousandths (rounded down)."""
    pixels = samples.reshape(-1, 3)
    means = pixels.sum(0, dtype=np.int64) * 1000 // len(pixels)
    levels = np.bincount(samples >> 5, minlength=8) * 1000 // len(samples)
    return f"rows={len(samples) // ROW};mean={','.join(map(str, means.tolist()))};levels={','.join(map(str, levels.tolist()))}"


def write_media(df: DataFrame, tag: str = "media", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores the texts as media in the shared folder; returns the table:
    the id, n_bytes (of the text), digest, part (the writing task's number)
    and media (null where that task has stored the same payload before)."""
    schema = T.StructType(
        [df.schema[doc_id], T.StructField("n_bytes", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("media", T.BinaryType())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored: set[bytes] = set()
        part = TaskContext.get().partitionId()
        for batch in batches:
            for some in common.slices(batch, SLICE_BYTES):
                sizes, digests, media = [], [], []
                for data in common.raw_texts(some, text):
                    payload = padded(data)
                    digest = hashlib.sha256(payload)
                    new = digest.digest() not in stored
                    stored.add(digest.digest())
                    sizes.append(len(data))
                    digests.append(digest.hexdigest())
                    media.append(to_png(payload) if new else None)
                columns = [some.column(doc_id), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array([part] * len(sizes), pa.int32()), pa.array(media, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[doc_id, "n_bytes", "digest", "part", "media"])

    path = common.new_path(df.sparkSession, tag)
    common.map_batches(df.select(doc_id, text), run, schema).write.option("compression", "uncompressed").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


FACTS = T.StructType(
    [
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
    ]
)


def facts(store: DataFrame) -> DataFrame:
    """One row per stored payload (its digest and part), computed from the
    stored bytes as read back.  No shuffle."""
    schema = T.StructType([T.StructField("digest", T.StringType()), T.StructField("part", T.IntegerType()), *FACTS.fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in common.slices(batch, SLICE_BYTES):
                rows = []
                for stored in some.column("media"):
                    media = stored.as_py()
                    payload = from_png(media)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(np.frombuffer(payload, np.uint8))))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                found = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([some.column("digest"), some.column("part"), *found], names=[f.name for f in schema.fields])

    return common.map_batches(store.where(F.col("media").isNotNull()).select("digest", "part", "media"), run, schema)


def by_digest(found: DataFrame) -> DataFrame:
    """facts() with one row per digest, for references that know no part."""
    return found.groupBy("digest").agg(*[F.max(f.name).alias(f.name) for f in FACTS.fields])


def resolve(pages: DataFrame, payloads: DataFrame, page_columns: list[str], sequence: str = "items", on: Sequence[str] = ("digest",)) -> DataFrame:
    """One row per media item with what ``payloads`` has of its payload:
    page columns, position, source, digest, caption, then the payloads' columns
    (null where none has the digest).

    ``on``: the digest, and page columns that name a payload with it.  With the
    part of write_media among them, a payload that very many pages refer to is
    not one key of the join.
    """
    own = pages.select(*page_columns, F.explode(sequence).alias("item")).where(F.col("item.kind") == "media")
    own = own.select(*page_columns, "item.position", "item.source", "item.digest", "item.caption")
    return own.join(payloads, list(on), "left")


def aligned(pages: DataFrame, payloads: DataFrame, page_columns: list[str], sequence: str = "items", on: Sequence[str] = ("digest",)) -> DataFrame:
    """One row per page: its columns and ``sequence``, all of its items, texts
    too, in order, each with ``payload``, what ``payloads`` has of it (null for
    texts and references without payload).

    ``on``: as for ``resolve``.  The join may bring items in any order; they
    are put together by their page's row and position.  Items that name no
    payload have a join key of their own each, so they don't meet in one task.
    """
    facts_of = [c for c in payloads.columns if c not in on]
    rows = pages.select(F.struct(*page_columns).alias("page"), F.monotonically_increasing_id().alias("row"), sequence)
    rows = rows.select("page", "row", F.explode_outer(sequence).alias("item"))  # after rows have their numbers
    keyed = rows.withColumn("digest", F.coalesce("item.digest", F.concat(F.lit("none:"), F.col("row").cast("string"))))
    for name in set(on) - {"digest"}:
        keyed = keyed.withColumn(name, F.col("page")[name])
    stored = payloads.select(*on, F.struct(*facts_of).alias("payload"))
    entry = F.when(F.col("item").isNotNull(), F.struct(*[F.col("item")[f.name].alias(f.name) for f in ITEM.fields], F.col("payload")))
    found = keyed.join(stored, list(on), "left").groupBy("row", "page").agg(F.sort_array(F.collect_list(entry)).alias(sequence))
    return found.select("page.*", sequence)
