"""Exact top-k search by tiled matrix products.

Vectors are quantised to integers and packed: queries into tiles, candidates
into shards, both of bounded bytes.  Tiles and shards meet in blocks: with the
candidates in G groups and the queries in H, each of the G x H cells is a join
key, to which a tile is sent G times and a shard H times.  So no vector passes
the driver, and more queries or candidates make more cells, not larger ones.
A task multiplies a cell's tiles with its shards, selects each query's k best
of a product, and merges them; the groups' lists merge in a tree of grouped
steps, so that no step sees more than a fixed number of lists for a query.
Products are exact: in float64 where no sum can reach 2**53, in 64-bit
integers where none can reach 2**62, else in Python's integers.

Defined results: vectors that are null, or that hold a null or a non-finite
component, are neither queries nor candidates; so are those of another length
than the query's (they have no inner product); rows with a null id take no
part; components and scores beyond 64 bits are the largest (or smallest)
64-bit integer; ties go to the smaller id; rows with a query's id are no
candidates of it; fewer candidates than k give all; repeated rows are
candidates each, and the candidates of queries that share an id are ranked
together; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jisfold.llm import common

#: Candidates and queries of one matrix product, and their bytes, at most.
SHARD, SHARD_BYTES = 8192, 4 << 20
TILE, TILE_BYTES = 512, 1 << 20
#: Candidates of a group and queries of a group, about.
GROUP, QUERIES = 1 << 18, 1 << 15
#: Lists of a query that one step of the merge takes together.
FAN = 16
EXACT = float(1 << 53)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int, vec_id: str, embedding: str) -> DataFrame:
    """(id, v): floor(scale * x) of each component, as longs, of usable rows."""
    usable = F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    scaled = F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return vectors.where(usable).where(finite).select(F.col(vec_id).cast("long").alias("id"), scaled.alias("v"))


def packed(rows: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """(size, ids, data): matrices of rows of one length, as bytes.  No shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v = batch.column("id").to_numpy(zero_copy_only=False), batch.column("v")
            offsets = v.offsets.to_numpy()
            flat, sizes = v.values.to_numpy(zero_copy_only=False), np.diff(offsets)
            for size in np.unique(sizes).tolist():
                of, step = np.flatnonzero(sizes == size), max(1, min(most, most_bytes // max(1, 8 * size)))
                for at in range(0, len(of), step):
                    some = of[at : at + step]
                    data = flat[offsets[some][:, None] + np.arange(size)]
                    yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([ids[some].tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())], names=["size", "ids", "data"])

    return common.map_batches(rows, run, T.StructType([T.StructField("size", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("data", T.BinaryType())]))


def product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of all rows, as longs."""
    if not q.shape[1]:
        return np.zeros((len(q), len(c)), np.int64)
    largest = float(np.abs(q.astype(np.float64)).max()) * float(np.abs(c.astype(np.float64)).max()) * q.shape[1]
    if largest < EXACT:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if largest < 2.0**62:
        return q @ c.T
    return np.clip(q.astype(object) @ c.astype(object).T, _LEAST, _MOST).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (scores, ids), ties to the smaller id."""
    if len(scores) > k:
        # all that reach the k-th score, so that ties are settled by id below
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, ~scores))[:k]  # ~x falls as x grows, without overflow
    return scores[order], ids[order]


def _cells(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        group = None

        def out() -> pa.RecordBatch:
            many = [len(s) for s, _ in found.values()]
            columns = [np.repeat(np.fromiter(found, np.int64, len(found)), many), np.full(sum(many), group), *(np.concatenate(x) for x in zip(*found.values(), strict=True))]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "part", "score", "vec_id"])

        for batch in batches:
            for i in range(batch.num_rows):
                size, own, ids_of, data_of, shard_ids, shard_data = (batch.column(c)[i] for c in ("size", "g", "q_ids", "q_data", "ids", "data"))
                if own.as_py() != group:
                    if found:
                        yield out()
                    group = own.as_py()
                queries, ids = np.frombuffer(ids_of.as_buffer(), np.int64), np.frombuffer(shard_ids.as_buffer(), np.int64)
                tile = product(*(np.frombuffer(x.as_buffer(), np.int64).reshape(-1, size.as_py()) if size.as_py() else np.zeros((n, 0), np.int64) for x, n in ((data_of, len(queries)), (shard_data, len(ids)))))
                for q, scores in zip(queries.tolist(), tile, strict=True):
                    others = ids != q
                    scores, candidates = (scores, ids) if others.all() else (scores[others], ids[others])
                    scores, candidates = best(scores, candidates, k)
                    if q in found:
                        scores, candidates = best(np.concatenate((found[q][0], scores)), np.concatenate((found[q][1], candidates)), k)
                    found[q] = scores, candidates
        if found:
            yield out()

    return run


def merged(lists: DataFrame, k: int, n_lists: int) -> DataFrame:
    """Merges partial lists (query_id, part, score, vec_id) in a tree."""
    ranked = F.struct((-1 - F.col("score")).alias("s"), "vec_id")  # falls as the score grows, without overflow
    found = lists.groupBy("query_id", "part").agg(F.collect_list(ranked).alias("l"))
    while n_lists > 1:
        n_lists = -(-n_lists // FAN)
        found = found.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("query_id", "part").agg(F.slice(F.array_sort(F.flatten(F.collect_list("l"))), 1, k).alias("l"))
    return found.select("query_id", F.posexplode(F.slice(F.array_sort("l"), 1, k)).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", (-1 - F.col("x.s")).alias("score")
    )


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best candidates."""
    spark = vectors.sparkSession
    total, asking = vectors.select(F.count("*"), F.count_if(F.coalesce(is_query, F.lit(False)))).first()
    # cells enough to keep all cores busy, as far as shards go
    groups = max(1, -(-total // GROUP), min(2 * spark.sparkContext.defaultParallelism, total // SHARD))
    blocks = max(1, -(-asking // QUERIES))
    tiles = packed(quantised(vectors.where(is_query), scale, vec_id, embedding), TILE, TILE_BYTES)
    shards = packed(quantised(vectors, scale, vec_id, embedding), SHARD, SHARD_BYTES)
    tiles = tiles.select("size", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.pmod(F.xxhash64("ids", "data"), F.lit(blocks)).cast("int").alias("h"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    shards = shards.select("size", "ids", "data", F.pmod(F.xxhash64("ids", "data"), F.lit(groups)).cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("h"))
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("query_id", "part", "score", "vec_id")])
    return merged(common.map_batches(tiles.join(shards, ["size", "g", "h"]), _cells(k), schema), k, groups)
