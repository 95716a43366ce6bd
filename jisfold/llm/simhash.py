"""Near-duplicates by SimHash fingerprints, linked through BK-trees.

A fingerprint takes the majority of each bit of its shingles' hashes.  Two
documents are linked when their fingerprints differ in few bits.  To find all
links, the 64 bits are cut into blocks: fingerprints that differ in at most r
bits agree in some set of blocks, so each fingerprint goes to one shard for
each such set of blocks and meets all its partners in a shard.  A shard holds
a BK-tree: children are keyed by their integer Hamming distance to the parent,
and a search follows only the edges within the radius of its own distance.

Shards instead of one tree that all fingerprints search: that tree would grow
with the data, so it could not be broadcast.  (A search with radius 4 visits
17 % of the nodes over 1,000 random values, 7 % over 10,000 and 2.6 % over
100,000, which is far more than a shard has.)  Shards go to tasks by shuffle,
and a shard's tree is bounded: a shard above ``SHARD`` fingerprints is split, and every two of its parts meet once.
Only distinct fingerprints are sharded, and a shard returns one link for each
member of a local component, never all pairs.

Similarities below about 0.95 need more bits than 64: ``dedup`` takes sketches
of several words, whose shards are bands of equal bits; their BK-trees work
alike.  There, sketches find candidates only, with keys of least values for
what bands of sketches miss; the exact similarity of the sets of shingles
decides.

Defined results: null text counts as empty; a text without words has
fingerprint zero, which links like any other; a text with fewer words than a
shingle is one shingle; equal texts have equal fingerprints; a component's id
is the smallest document id in it, null ids aside (null where all are null);
an empty table gives an empty result; texts of any length are read whole;
extra columns are ignored, by ``dedup`` kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import acos, comb, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from jisfold.llm import common
from jisfold.llm.components import components

SEED = 42
#: Fingerprints of one part of a shard; a task holds two parts at most.
SHARD = 4096
#: Bytes of the texts of one part of a component of candidates.
PART_BYTES = 16 << 20
#: Up to so many sketches of several words a BK-tree's node keeps its subtree as
#: a list: their radius is so wide that all edges would be followed.
LEAF = 24
#: A fingerprint of more than one in so many rows meets its class by broadcast.
HOT_SHARE = 4096
#: Bytes of a sketch's band.
BAND = 2
#: Shingles hashed at once of a long text.
BLOCK = 1 << 16
#: Bitmaps of 32,768 row numbers (4 KB) that are broadcast at most.
BITMAPS = 8192
#: Bands of least values of a set, and the values in a band.
LEAST_BANDS, LEAST_ROWS = 40, 6
_FACTORS = np.random.default_rng(SEED).integers(1 << 63, size=LEAST_BANDS * LEAST_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(data: bytes, shingle: int, seed: int = SEED) -> int:
    """The SimHash of a UTF-8 text, as an unsigned 64-bit integer."""
    words = data.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(first), BLOCK):
        part = b"".join([digest(joined[a:b], seed) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK], strict=True)])
        ones += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(first)).tobytes(), "big")


def fingerprints(df: DataFrame, shingle: int = 5, text: str = "text", out: str = "fp") -> DataFrame:
    """Adds the fingerprint, its 64 bits as a long.  No shuffle."""

    def make():
        def work(batch: pa.RecordBatch) -> list:
            found = np.array([fingerprint(x, shingle) for x in common.raw_texts(batch, text)], np.uint64)
            return [pa.array(found.view(np.int64))]

        return work

    return common.append_columns(df, T.StructType([T.StructField(out, T.LongType())]), make)


def shingle_hashes(data: bytes, shingle: int, seed: int = SEED) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; none without words."""
    own = data.lower().split()
    n = len(own)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: max(1, n - shingle + 1)].tolist(), ends[min(n, shingle) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], seed) for a, b in zip(first, last, strict=True)), np.uint64, len(first)))


def sketch(hashes: np.ndarray, words: int) -> bytes:
    """A SimHash of ``words`` times 64 bits of a set of shingles' hashes; its
    bits come from mixes of each hash."""
    ones = np.zeros(64 * words, np.int64)
    step = max(1, BLOCK // words)
    for at in range(0, len(hashes), step):
        h = hashes[at : at + step, None] + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h ^= h >> np.uint64(31)
        bits = np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1)
        # sums of up to 255 rows fit a byte
        for part in range(0, len(bits), 255):
            ones += np.add.reduce(bits[part : part + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def least_keys(hashes: np.ndarray) -> np.ndarray:
    """``LEAST_BANDS`` keys of a set of hashes, each of the least values of
    ``LEAST_ROWS`` mixes; none of an empty set.

    Sets of Jaccard similarity s agree in a mix with the chance s, however
    small they are, so in a key with s to the power of the rows: at 0.8 they
    share no key once in 190,000 pairs.
    """
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[at : at + 4096, None] * _FACTORS).min(0), out=least)
    keys = np.arange(1, LEAST_BANDS + 1, dtype=np.uint64)
    for values in least.reshape(LEAST_BANDS, LEAST_ROWS).T:
        keys = (keys ^ values) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def set_sketches(rows: DataFrame, words: int, shingle: int = 5, text: str = "text") -> DataFrame:
    """Adds node, a digest of the set of shingles, fp, its sketch, both
    binary, and keys, its keys of least values.  No shuffle.

    rows: a struct doc with the text, and any other columns.
    """

    def work(batch: pa.RecordBatch) -> list:
        doc = batch.column("doc")
        own = pa.RecordBatch.from_arrays([doc.field(doc.type.get_field_index(text))], names=["text"])
        sets = [shingle_hashes(x, shingle) for x in common.raw_texts(own, "text")]
        return [[xxhash.xxh3_128_digest(x.tobytes()) for x in sets], [sketch(x, words) for x in sets], [least_keys(x) for x in sets]]

    outputs = [T.StructField("node", T.BinaryType()), T.StructField("fp", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))]
    return common.append_columns(rows, T.StructType(outputs), lambda: work)


def radius_of(similarity: float, bits: int) -> int:
    """Differing bits of two texts whose sets of shingles have that Jaccard
    similarity: the mean and three standard deviations."""
    p = acos(2 * similarity / (1 + similarity)) / pi
    return int(bits * p + 3 * sqrt(bits * p * (1 - p)))


class BKTree:
    """A BK-tree over distinct values of 64 bits or more; searches go in batches.

    A node is (value's index, {distance: child}); a child is a node or, when
    its subtree is small, an array of indexes.
    """

    def __init__(self, values: np.ndarray, leaf: int | None = None):
        self.values, self.leaf = values, leaf or (1 if values.ndim == 1 else LEAF)
        self.visits = 0  # of nodes, by all queries
        self.root = self._grown(np.arange(len(values)))

    def _far(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hamming distances; the words of longer values are the last axis."""
        bits = np.bitwise_count(a ^ b)
        return bits.astype(np.int16) if self.values.ndim == 1 else bits.sum(-1, dtype=np.int16)

    def _grown(self, members: np.ndarray):
        """Builds without recursion: a tree may be as deep as a chain."""
        top: dict[int, object] = {}
        todo = [(top, 0, members)]
        while todo:
            parent, key, own = todo.pop()
            if len(own) <= self.leaf:
                parent[key] = own
                continue
            head, rest = own[0], own[1:]
            far = self._far(self.values[rest], self.values[head])
            children: dict[int, object] = {}
            parent[key] = (head, children)
            order = np.argsort(far, kind="stable")
            cuts = np.flatnonzero(np.diff(far[order])) + 1
            for part in np.split(order, cuts):
                todo.append((children, int(far[part[0]]), rest[part]))
        return top[0]

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yields (query indexes, value indexes) of pairs within the radius."""
        todo = [(self.root, np.arange(len(queries)))]
        while todo:
            node, asked = todo.pop()
            self.visits += len(asked)
            if isinstance(node, np.ndarray):
                near = self._far(queries[asked][:, None], self.values[node][None, :]) <= radius
                q, v = np.nonzero(near)
                if len(q):
                    yield asked[q], node[v]
                continue
            head, children = node
            far = self._far(queries[asked], self.values[head])
            hit = asked[far <= radius]
            if len(hit):
                yield hit, np.full(len(hit), head)
            for key, child in children.items():
                on = asked[np.abs(far - key) <= radius]
                if len(on):
                    todo.append((child, on))


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of a[i] and b[i]; a class is labelled by its least index."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        to = np.arange(len(label))
        np.minimum.at(to, high, low)
        while (nxt := to[to]).tobytes() != to.tobytes():
            to = nxt
        label[:] = to[label]


def shard_links(values: np.ndarray, part: np.ndarray, low: int, high: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a shard's pair of parts: each member with its component's head.

    The tree is built over the part ``low`` and searched by the part ``high``
    (the same, or the other one).
    """
    in_tree = np.flatnonzero(part == low)
    asking = in_tree if low == high else np.flatnonzero(part == high)
    label = np.arange(len(values))
    if len(in_tree) and len(asking):
        tree = BKTree(values[in_tree])
        for q, v in tree.search(values[asking], radius):
            _merge(label, asking[q], in_tree[v])
    linked = np.flatnonzero(label != np.arange(len(values)))
    return values[linked], values[label[linked]]


def block_plan(n: int, radius: int) -> list[int]:
    """Bit masks of the sets of blocks on one of which linked values agree.

    With b blocks and at most r differing bits, b - r blocks agree.  More
    blocks make smaller shards and more copies; the fewest blocks are taken
    that keep the expected shard within a part.  Every choice finds all links.
    """
    for blocks in range(radius + 1, 2 * radius + 1):
        agreeing = blocks - radius
        bits = 64 * agreeing // blocks
        if n >> bits <= SHARD // 2 or blocks == 2 * radius:
            break
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << bit for bit in range(edges[i], edges[i + 1])) for i in range(blocks)]
    found = [sum(masks[i] for i in chosen) for chosen in combinations(range(blocks), agreeing)]
    assert len(found) == comb(blocks, agreeing)
    return [m - (1 << 64) if m >> 63 else m for m in found]


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to connect every
    component.  nodes: a column fp of distinct longs."""
    if radius < 1:
        raise ValueError("a radius below 1 needs no search: equal fingerprints are one node")
    masks = block_plan(nodes.count(), radius)
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(masks)])
    rows = nodes.select("fp", F.explode(keys).alias("k")).select("fp", "k.band", "k.key")
    return _in_shards(rows, radius)


def sketch_links(nodes: DataFrame, words: int, radius: int) -> DataFrame:
    """Links (a, b) between distinct sketches that share a band of BAND bytes.

    nodes: a binary column fp.  Two texts whose similarity is that of the
    radius's mean share one of 40 bands of 16 bits with a chance of 95 %,
    more similar ones almost surely (0.99 from 0.85 on).
    """
    bands = F.sequence(F.lit(0), F.lit(8 * words // BAND - 1))
    rows = nodes.select("fp", F.posexplode(F.transform(bands, lambda i: F.conv(F.hex(F.substring(F.col("fp"), i * BAND + 1, F.lit(BAND))), 16, 10).cast("long"))).alias("band", "key"))
    return _in_shards(rows, radius)


def _in_shards(rows: DataFrame, radius: int) -> DataFrame:
    """Brings the rows (band, key, fp) of each shard together and links them."""
    large = rows.groupBy("band", "key").count().where(F.col("count") > SHARD).select("band", "key", F.ceil(F.col("count") / SHARD).cast("int").alias("parts"))
    # of n values in k bands at most n * k / SHARD shards are large; with them in all
    # tasks, the fingerprints shuffle once
    rows = rows.join(F.broadcast(large), ["band", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    rows = rows.select("band", "key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "fp")
    shard = ["band", "key", "low", "high"]
    placed = rows.repartition(*shard).sortWithinPartitions(*shard, "fp")
    kind = rows.schema["fp"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    return common.map_batches(placed, _shards(radius), schema)


def _shards(radius: int):
    names = ("band", "key", "low", "high", "part", "fp")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def found(columns: list[np.ndarray], last: bool):
            """Links of all whole shards; the last shard may go on in the next batch."""
            band, key, low, high, part, fp = columns
            n = len(fp)
            new = (np.diff(band) != 0) | (np.diff(key) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), n]
            out_a, out_b = [], []
            for i, j in zip(edges, edges[1:], strict=False):
                if j == n and not last:
                    break
                if j - i > 1:
                    a, b = shard_links(fp[i:j], part[i:j], low[i], high[i], radius)
                    if len(a):
                        out_a.append(a)
                        out_b.append(b)
            kept = None if last else [c[edges[-2] :] for c in columns]
            found = [np.concatenate(x) if x else fp[:0] for x in (out_a, out_b)]
            if fp.ndim == 1:
                found = [pa.array(x.view(np.int64)) for x in found]
            else:
                found = [pa.array([v.tobytes() for v in x], pa.binary()) for x in found]
            return pa.RecordBatch.from_arrays(found, names=["a", "b"]), kept

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in names[:-1]]
            values = batch.column("fp")
            if pa.types.is_int64(values.type):
                columns.append(values.to_numpy(zero_copy_only=False).view(np.uint64))
            else:
                columns.append(np.frombuffer(b"".join(values.to_pylist()), np.uint64).reshape(batch.num_rows, -1))
            if held:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            out, held = found(columns, False)
            yield out
        if held:
            yield found(held, True)[0]

    return run


def classes(fps: DataFrame, linking, doc_id: str = "doc_id") -> DataFrame:
    """(fp, rows, class_fp, component_id) of every distinct fingerprint.

    fps: the columns fp and the document id; linking: from distinct
    fingerprints to links.
    """
    nodes = common.stash(fps.groupBy("fp").agg(F.min(doc_id).alias("least"), F.count("*").alias("rows")), "fingerprints")
    # only linked fingerprints are joined by component: the others, most of all, would
    # meet in one task as nulls
    linked = components(linking(nodes)).withColumnRenamed("node", "fp").join(nodes, "fp")
    least = linked.groupBy("component").agg(F.min("least").alias("class_least"))
    members = linked.join(least, "component").select("fp", "component", "class_least")
    return nodes.join(members, "fp", "left").select(
        "fp", "rows", F.coalesce("component", "fp").alias("class_fp"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("class_least")).alias("component_id")
    )


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    fps = common.stash(fingerprints(docs.select(doc_id, text), shingle, text).select(doc_id, "fp"), "simhash")
    own = common.stash(classes(fps, lambda nodes: links(nodes, radius), doc_id).select("fp", "rows", "component_id"), "classes")
    # fewer than HOT_SHARE fingerprints can have more than that share of the rows; the
    # rows of each stay where they are, the others meet their class by shuffle
    hot = F.col("rows") * HOT_SHARE > fps.count()
    many, few = (F.broadcast(own.where(hot).drop("rows")), own.where(~hot).drop("rows"))
    found = fps.join(many, "fp").unionByName(fps.join(many.select("fp"), "fp", "left_anti").join(few, "fp"))
    return found.select(doc_id, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def set_links(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links (i, j) that connect the sets, none of them empty, whose exact
    Jaccard similarity is ``similarity`` or more, as all such pairs would.

    From each set found, those not found yet are compared with it; so sets
    near one another cost one comparison each, not one for each pair.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    kinds, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    out_a, out_b, todo = [], [], []
    rest, codes, mark = np.arange(len(sets)), flat, np.zeros(len(kinds), bool)
    while len(rest):
        if not todo:
            todo, codes, rest = [int(rest[0])], codes[sizes[rest[0]] :], rest[1:]
            continue
        head = todo.pop()
        own = flat[starts[head] : starts[head] + sizes[head]]
        mark[own] = True
        common_to = np.add.reduceat(mark[codes], np.cumsum(sizes[rest]) - sizes[rest], dtype=np.int64)
        mark[own] = False
        near = common_to >= similarity * (sizes[rest] + sizes[head] - common_to) - 1e-9
        if near.any():
            found = rest[near].tolist()
            out_a += found
            out_b += [head] * len(found)
            todo += found
            codes, rest = codes[np.repeat(~near, sizes[rest])], rest[~near]
    return out_a, out_b


def component_parts(members: DataFrame, text: str = "text") -> DataFrame:
    """(component, low, high, node, text): a component above ``SHARD`` nodes or
    ``PART_BYTES`` of texts is split, and every two of its parts meet.

    members: component, node, a text of it and its size in bytes.
    """
    wanted = F.greatest(F.ceil(F.count("*") / SHARD), F.ceil(F.sum("size") / PART_BYTES)).cast("int")
    large = members.groupBy("component").agg(wanted.alias("parts")).where("parts > 1")
    rows = members.join(F.broadcast(large), "component", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    return part.select("component", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "node", F.col(text).alias("text"))


def exact_links(members: DataFrame, shingle: int, similarity: float, text: str = "text") -> DataFrame:
    """Links (a, b) between nodes of one component of candidates, decided by
    the exact Jaccard similarity of their sets.

    members: as for ``component_parts``, a row for each node.  Texts are sent,
    which are shorter than their sets, and become sets where they meet.
    """
    part = component_parts(members, text)
    shard = ["component", "low", "high"]
    node_type, arrow_type = members.schema["node"].dataType, to_arrow_type(members.schema["node"].dataType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets, a, b = None, [], [], [], []

        def close() -> None:
            if len(nodes) > 1:
                for i, j in zip(*set_links(sets, similarity), strict=True):
                    a.append(nodes[i])
                    b.append(nodes[j])
            nodes.clear()
            sets.clear()

        def out() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(a, arrow_type), pa.array(b, arrow_type)], names=["a", "b"])
            a.clear()
            b.clear()
            return found

        for batch in batches:
            for *own, node, data in zip(*(batch.column(n).to_pylist() for n in (*shard, "node")), common.raw_texts(batch, "text"), strict=True):
                if own != key:
                    close()
                    key = own
                found = shingle_hashes(data, shingle)
                if len(found):
                    nodes.append(node)
                    sets.append(found)
            if len(a) > 10_000:
                yield out()
        close()
        yield out()

    schema = T.StructType([T.StructField("a", node_type), T.StructField("b", node_type)])
    return common.map_batches(part.repartition(*shard).sortWithinPartitions(*shard), run, schema)


def candidate_links(nodes: DataFrame, words: int, radius: int) -> DataFrame:
    """Links (a, b) that connect the nodes whose sketches are near or equal, and
    those that share a key of least values, which finds the pairs that sketches
    miss: near the similarity asked for, and of few shingles.

    nodes: the columns node, fp and keys.
    """
    heads = nodes.groupBy("fp").agg(F.min("node").alias("head"))
    near = sketch_links(heads.select("fp"), words, radius)
    for end in ("a", "b"):
        near = near.join(heads.select(F.col("fp").alias(end), F.col("head").alias(f"{end}_head")), end)
    equal = nodes.join(heads, "fp").where("node != head")
    keyed = nodes.select("node", F.explode("keys").alias("key")).withColumn("head", F.min("node").over(Window.partitionBy("key"))).where("node != head")
    return near.select(F.col("a_head").alias("a"), F.col("b_head").alias("b")).unionByName(equal.unionByName(keyed, True).select(F.col("node").alias("a"), F.col("head").alias("b")))


def rows_numbered(held: DataFrame, numbers: DataFrame) -> DataFrame:
    """The rows of held whose number, the column row, is among the numbers'.

    The numbers go to all tasks as bitmaps, a bit for each row, so that held's
    texts stay where they are.  More than ``BITMAPS`` bitmaps are not
    broadcast; then both sides meet by shuffle.
    """
    # dealt by bitmap first: partial bitmaps of every task would be many times as large
    dealt = numbers.select("row", F.bitmap_bucket_number("row").alias("bucket")).repartition("bucket")
    maps = common.stash(dealt.groupBy("bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("row")).alias("bits")), "bitmaps")
    if maps.count() > BITMAPS:
        return held.join(numbers.select("row"), "row", "left_semi").select(*held.columns)
    at = F.bitmap_bit_position("row")
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = held.join(F.broadcast(maps), F.bitmap_bucket_number("row") == F.col("bucket"))
    return found.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*held.columns)


def dedup(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, words: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one of each group of near-duplicates: the one with
    the smallest id (of repeated rows of that id, any one).  Columns stay.

    Texts are linked when the Jaccard similarity of their sets of distinct
    shingles is ``similarity`` or more.  Sketches of ``words`` times 64 bits
    (64 bits can't tell 0.8 from 0.6) and keys of least values only find
    candidates; the exact similarity decides, before components are formed.
    Texts with equal sets are one node, those without words too.  Columns of
    any name stay, since they are kept in a struct meanwhile.
    """
    radius = radius_of(similarity, 64 * words)
    # texts are written once; sketches are narrow and leave them behind
    held = common.stash(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "held", "zstd")
    own = F.col("doc")[text]
    # the first of equal sets: by id, null last, then by row, which no two share
    first = F.struct(F.col("doc")[doc_id].isNull().alias("none"), F.col("doc")[doc_id].alias("id"), "row")
    sketched = set_sketches(held.select(F.struct(own.alias(text)).alias("doc"), first.alias("first")), words, shingle, text)
    nodes = sketched.groupBy("node").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.min("first").alias("least"))
    # from here on, a set goes by its first row's number: shorter than a digest
    nodes = common.stash(nodes.select(F.col("least.row").alias("node"), "fp", "keys", "least"), "nodes", "zstd")
    common.release(docs.sparkSession)
    near = common.stash(components(candidate_links(nodes, words, radius)).withColumnRenamed("node", "row"), "near")
    common.release(docs.sparkSession)
    members = rows_numbered(held, near).select("row", own.alias("text"), F.octet_length(own).alias("size")).join(near, "row").select("component", F.col("row").alias("node"), "text", "size")
    linked = common.stash(components(exact_links(members, shingle, similarity)).join(nodes.select("node", "least"), "node"), "linked")
    common.release(docs.sparkSession)
    alone = nodes.join(linked, "node", "left_anti").select("least.row")
    kept = common.stash(alone.unionByName(linked.groupBy("component").agg(F.min("least").alias("least")).select("least.row")), "kept")
    found = rows_numbered(held, kept).select("doc.*")
    common.discard(nodes, near, linked)
    common.release(docs.sparkSession)
    return found
