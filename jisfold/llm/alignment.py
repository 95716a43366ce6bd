"""Alignment of two tokenizers' tokens of the same texts.

Byte offsets at which tokens of both end cut a text into groups; two tokens
are linked where their byte ranges overlap.  There are two forms:

- ``align_relational`` makes a row of every token (posexplode), lengths summed
  in a window, an equi-join on document and end for the cuts, running counts
  of cuts as group ids and a join by group for the links.
- ``align`` takes the same steps on arrays of a few megabytes of texts at a
  time, in which a token is a few bytes and not a row; what goes on are, for
  each such chunk, its distinct pairs of ids with their counts.  The corpus'
  counts of pairs are relational from there: pairs are exploded, summed,
  compared by id and joined back to the chunks that have them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jisfold.llm.common import map_batches, slices, stash, texts
from jisfold.llm.token_files import LibraryIds

SPACE = "▁"


class Pair:
    """The two tokenizers: ids of texts, and the bytes of each id.

    The first one's ids come from the distinct parts of texts; a letter before
    the space before a text makes that space like any other, and its own token
    is taken away again.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.known = LibraryIds(path_a, plain=True)
        self.a, self.b = self.known.tokenizer, sentencepiece.SentencePieceProcessor(model_file=path_b)
        ids = [self.a.encode(x, add_special_tokens=False).ids for x in ("x a", "x", " a")]
        if len(ids[1]) != 1 or ids[0] != ids[1] + ids[2]:
            raise ValueError(f"{path_a} does not keep a letter and a space apart")
        letters, self.bytes_a = _byte_letters(), [b""] * self.a.get_vocab_size()
        for piece, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in of], np.int64) for of in (self.bytes_a, self.bytes_b))
        # ids as they stand in a list of groups: before a comma or at the end of their part
        self.written = [f"{i}{end}" for of, ends in ((self.bytes_a, ",|"), (self.bytes_b, ",;")) for end in ends for i in range(len(of))]

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Both ids of each text; none where either's bytes are not a space and the text."""
        of_a, of_b, some = self.bytes_a.__getitem__, self.bytes_b.__getitem__, [t for t in texts if t]
        ids_a = [np.frombuffer(x, "<u4", offset=4).tolist() for x in self.known.encode(pa.array(["x " + t for t in some], pa.large_string()))]
        ids_b = self.b.encode(some, num_threads=1) if some else []
        found = iter(zip(some, ids_a, ids_b, strict=True))
        out = []
        for text in texts:
            _, a, b = next(found) if text else ("", [], [])
            whole = b" " + text.encode()
            out.append((a, b) if b"".join(map(of_a, a)) == whole == b"".join(map(of_b, b)) else ([], []))
        return out


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable
    characters of Latin-1 stand for themselves, others come after U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


_DOC = "struct<doc_id:string,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string>"
CHUNK = f"chunk long, docs array<{_DOC}>, sizes binary, local binary, counts binary, pairs array<long>, totals array<long>"


def _chunks(path_a: str, path_b: str):
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T.StructType.fromDDL(CHUNK))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = None
        for batch in batches:
            pair = pair or Pair(path_a, path_b)
            for some in slices(batch):
                yield _chunk(some, pair, schema)

    return run


def _chunk(some: pa.RecordBatch, pair: Pair, schema: pa.Schema) -> pa.RecordBatch:
    """A row with the slice's documents, and their pairs by place among the slice's distinct pairs."""
    coded = pair.encode(texts(some, "text"))
    n_a, n_b = (np.array([len(x[k]) for x in coded], np.int64) for k in (0, 1))
    a, b = (np.fromiter((i for x in coded for i in x[k]), np.int64, n.sum()) for k, n in ((0, n_a), (1, n_b)))
    # both sides of a text have as many bytes, so ends count on from text to text
    ends_a, ends_b = np.cumsum(pair.sizes_a[a]), np.cumsum(pair.sizes_b[b])
    last = np.searchsorted(ends_b, ends_a)  # the token of b in which a token of a ends
    cut_a = ends_b[last] == ends_a
    cut_b = np.zeros(len(b), bool)
    cut_b[last[cut_a]] = True
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    doc_a = np.repeat(np.arange(len(coded)), n_a)
    n_groups = np.bincount(doc_a[cut_a], minlength=len(coded))
    digests = _digests(pair, (a, cut_a, group_a), (b, cut_b, group_b), n_a + n_b)

    first = np.concatenate([[0], (last + cut_a)[:-1]])[: len(a)]
    times = last - first + 1
    of_a = np.repeat(np.arange(len(a)), times)
    of_b = np.arange(len(of_a)) - np.repeat(np.cumsum(times) - times - first, times)
    place, pairs = pd.factorize(b[of_b] * len(pair.bytes_a) + a[of_a])
    n_links = np.bincount(doc_a, weights=times, minlength=len(coded)).astype(np.int64)
    number, code = pd.factorize(doc_a[of_a] * max(1, len(pairs)) + place)  # in order of documents
    counts = np.bincount(number, minlength=len(code))
    doc, local = np.divmod(code, max(1, len(pairs)))
    totals = np.bincount(place, minlength=len(pairs))
    rows = [dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), x, strict=True)) for x in zip(some.column("id").to_pylist(), n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist(), digests, strict=True)]
    packed = np.bincount(doc, minlength=len(coded)).astype("<u4"), local.astype("<u4"), counts.astype("<u4")
    cells = [some.column("row")[0].as_py(), rows, *[x.tobytes() for x in packed], pairs.tolist(), totals.tolist()]
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(cells, schema, strict=True)], schema=schema)


def _digests(pair: Pair, a: tuple, b: tuple, sizes: np.ndarray) -> list[str]:
    """SHA-256 of each text's groups as ``a1,a2|b1;a3|b2,b3``, '' for texts without tokens."""
    (ids_a, cut_a, group_a), (ids_b, cut_b, group_b) = a, b
    # a group's tokens of a, then those of b: each stands after what other groups have before it
    order = np.zeros(len(ids_a) + len(ids_b), np.int64)
    before_b, upto_a = np.searchsorted(group_b, group_a, side="left"), np.searchsorted(group_a, group_b, side="right")
    base = len(pair.bytes_a)
    order[np.arange(len(ids_a)) + before_b] = ids_a + base * cut_a
    order[np.arange(len(ids_b)) + upto_a] = 2 * base + ids_b + len(pair.bytes_b) * cut_b
    out, start, written, places = [], 0, pair.written.__getitem__, order.tolist()
    for n in sizes.tolist():
        text = "".join(map(written, places[start : start + n]))
        out.append(hashlib.sha256(text[:-1].encode()).hexdigest() if n else "")
        start += n
    return out


def pair_counts(links: DataFrame, base: int) -> DataFrame:
    """(pair, n, best): the corpus' links of each pair, and whether no pair of
    the same second id has more.  links: pair, total."""
    counts = links.groupBy("pair").agg(F.sum("total").alias("n")).withColumn("b", F.floor(F.col("pair") / base))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


_RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    path_a: a byte-level vocabulary of the tokenizers library, asked for the
    text after a space; path_b: a sentencepiece model, which adds that space.
    Special tokens' strings in a text are plain text.  A text that is null or
    empty, or whose tokens of either kind don't join to it, has no tokens:
    zeros, an empty digest, and no part in the corpus' counts.  Whole texts
    count, whatever their length.  Repeated rows are documents of their own;
    ids may be null.  Pairs that share the highest count of a second id are all
    best.  An empty table gives none.  Other columns don't matter.
    """
    kind = docs.schema[doc_id].dataType
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    chunks = stash(map_batches(own, _chunks(path_a, path_b), T.StructType.fromDDL(CHUNK)), "aligned", "zstd")
    links = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "totals")).alias("at", "x")).select("chunk", "at", F.col("x.pairs").alias("pair"), F.col("x.totals").alias("total"))
    facts = stash(pair_counts(links.where("total > 0"), _size(path_a)), "pairs", "zstd")
    found = links.where("total > 0").join(facts, "pair").groupBy("chunk").agg(F.collect_list(F.struct("at", "n", "best")).alias("known"))
    whole = chunks.select("chunk", "docs", "sizes", "local", "counts").join(found, "chunk", "left")
    placed = whole.select("docs", "sizes", "local", "counts", F.col("known.at").alias("at"), F.col("known.n").alias("n"), F.col("known.best").alias("best"))
    out = T.StructType.fromDDL(f"docs array<{_DOC}>, n_best array<long>, count_sum array<long>")
    rows = map_batches(placed, _summed, out).select(F.explode(F.arrays_zip("docs", "n_best", "count_sum")).alias("x")).select("x.docs.*", "x.n_best", "x.count_sum")
    return rows.withColumn("doc_id", F.col("doc_id").cast(kind)).select(*_RESULT)


def _size(path_a: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path_a).get_vocab_size()


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's number of best links and sum of counts."""
    for batch in batches:
        for k in range(batch.num_rows):
            cell = lambda name: batch.column(name)[k]
            sizes, local, counts = (np.frombuffer(cell(x).as_py(), "<u4").astype(np.int64) for x in ("sizes", "local", "counts"))
            at = np.zeros(0, np.int64) if cell("at").as_py() is None else cell("at").values.to_numpy()
            n, best = np.zeros(int(local.max(initial=-1)) + 1, np.int64), np.zeros(int(local.max(initial=-1)) + 1, np.int64)
            if len(at):
                n[at], best[at] = cell("n").values.to_numpy(), cell("best").values.to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            sums = [np.zeros(len(sizes), np.int64) for _ in range(2)]
            np.add.at(sums[0], doc, counts * best[local])
            np.add.at(sums[1], doc, counts * n[local])
            yield pa.RecordBatch.from_arrays([batch.column("docs").slice(k, 1), *[pa.array([x], pa.list_(pa.int64())) for x in sums]], names=["docs", "n_best", "count_sum"])


def _tokens(path_a: str, path_b: str):
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T.StructType.fromDDL(_TOKENS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = None
        for batch in batches:
            pair = pair or Pair(path_a, path_b)
            for some in slices(batch):
                cells: dict[str, list] = {f.name: [] for f in schema}
                for row, i, (a, b) in zip(some.column("row").to_pylist(), some.column("id").to_pylist(), pair.encode(texts(some, "text")), strict=True):
                    for name, value in zip(cells, (row, i, a, [len(pair.bytes_a[x]) for x in a], b, [len(pair.bytes_b[x]) for x in b]), strict=True):
                        cells[name].append(value)
                yield pa.RecordBatch.from_arrays([pa.array(cells[f.name], f.type) for f in schema], schema=schema)

    return run


_TOKENS = "row long, id string, a array<int>, a_len array<int>, b array<int>, b_len array<int>"


def align_relational(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The same as ``align``, with a row for every token of every document."""
    kind = docs.schema[doc_id].dataType
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    coded = stash(map_batches(own, _tokens(path_a, path_b), T.StructType.fromDDL(_TOKENS)), "tokens", "zstd")

    def ends(side: str) -> DataFrame:
        rows = coded.select("row", F.posexplode(F.arrays_zip(side, f"{side}_len")).alias(f"pos_{side}", "x")).select("row", f"pos_{side}", F.col(f"x.{side}").alias(side), F.col(f"x.{side}_len").alias("len"))
        upto = Window.partitionBy("row").orderBy(f"pos_{side}").rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("end", F.sum("len").over(upto)).withColumn("start", F.col("end") - F.col("len"))

    def grouped(rows: DataFrame, cuts: DataFrame) -> DataFrame:
        """Rows with the number of cuts before them."""
        before = Window.partitionBy("row").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
        marked = rows.join(cuts.withColumn("cut", F.lit(1)), ["row", "end"], "left")
        return marked.withColumn("g", F.coalesce(F.sum("cut").over(before), F.lit(0))).drop("cut", "len")

    of_a, of_b = ends("a"), ends("b")
    cuts = of_a.select("row", "end").join(of_b.select("row", "end"), ["row", "end"])
    in_a, in_b = grouped(of_a, cuts), grouped(of_b, cuts)
    other = in_b.select("row", "g", "b", F.col("start").alias("start_b"), F.col("end").alias("end_b"))
    links = in_a.join(other, ["row", "g"]).where((F.col("start") < F.col("end_b")) & (F.col("start_b") < F.col("end")))
    base = _size(path_a)
    links = stash(links.groupBy("row", (F.col("b").cast("long") * base + F.col("a")).alias("pair")).agg(F.count("*").alias("total")), "links", "zstd")
    facts = pair_counts(links, base)
    sums = links.join(facts, "pair").groupBy("row").agg(
        F.sum("total").alias("n_links"), F.sum(F.when(F.col("best"), F.col("total")).otherwise(0)).alias("n_best"), F.sum(F.col("total") * F.col("n")).alias("count_sum")
    )

    def joined(rows: DataFrame, side: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct(f"pos_{side}", side)))
        return rows.groupBy("row", "g").agg(F.concat_ws(",", F.transform(ordered, lambda x: x[side].cast("string"))).alias(side))

    groups = joined(in_a, "a").join(joined(in_b, "b"), ["row", "g"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("g", "a", "b"))).alias("groups"))
    digest = F.sha2(F.concat_ws(";", F.transform("groups", lambda x: F.concat(x["a"], F.lit("|"), x["b"]))), 256)
    heads = coded.select("row", "id", F.size("a").cast("long").alias("n_a"), F.size("b").cast("long").alias("n_b"))
    whole = heads.join(groups.select("row", F.size("groups").cast("long").alias("n_groups"), digest.alias("groups_sha256")), "row", "left").join(sums, "row", "left")

    def filled(name: str) -> Column:
        return F.coalesce(name, F.lit("") if name == "groups_sha256" else F.lit(0).cast("long")).alias(name)

    return whole.select(F.col("id").cast(kind).alias("doc_id"), *[filled(x) for x in _RESULT[1:]])
