"""Shared helpers: reading tables, written intermediate tables, batch maps."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of anything but space and the five ASCII control spaces.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of texts that a Python worker turns into objects at a time.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the given folder, with only the columns asked for."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Where it is unset, a local session gets a temporary folder; on a cluster
    that would lose data, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="jisfold-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stash(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, and
    what was computed once is not computed again when an executor is lost."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of jobs that have ended.  Spark removes them
    when the driver happens to collect what refers to them, which may be long
    after; until then they take executors' disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*frames: DataFrame) -> None:
    """Deletes tables made by stash() that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(conf).delete(folder, True)


def unused(df: DataFrame, name: str) -> str:
    """The name, or one made of it that no column of df has in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_batches(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType, limit: int = SLICE_BYTES) -> DataFrame:
    """df.mapInArrow, with batches of about ``limit`` bytes (or of one longer row).

    Spark's own limit, 64 MB, takes several times that of an executor's memory
    outside the heap for each task.  The setting is the session's: an operator
    that needs another limit than the rest runs its job at once.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(limit))
    return df.mapInArrow(_returning(run), schema)


def _returning(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, after which the worker gives memory back: it lives on for other
    tasks, beside which what it has freed but kept would count."""

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return wrapped


def append_columns(
    df: DataFrame,
    outputs: T.StructType,
    make: Callable[[], Callable[[pa.RecordBatch], list]],
    replace: bool = True,
) -> DataFrame:
    """df with the output columns added, computed by Arrow batches.

    ``make()`` runs once in each task and returns a function from a batch to
    the output columns, in order.  Input columns of the same name as an output
    (in any letter case) are replaced by the output.
    """
    base = [f for f in df.schema.fields if f.name.lower() not in {o.name.lower() for o in outputs.fields}]
    keep = [f.name for f in base]
    schema = T.StructType(base + outputs.fields)
    return map_batches(df, _appender(make, keep, schema), schema)


def _appender(make, keep: list[str], schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, arrow = None, to_arrow_schema(schema)
        for batch in batches:
            if not batch.num_rows:
                continue
            work = work or make()
            for some in slices(batch):
                added = work(some)
                arrays = [some.column(n) for n in keep]
                for field, values in zip(list(arrow)[len(keep) :], added, strict=True):
                    arrays.append(values.cast(field.type) if isinstance(values, pa.Array) else pa.array(values, field.type))
                yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([pa.field(f.name, a.type) for f, a in zip(arrow, arrays, strict=True)]))

    return run


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many bytes (or of one longer row), so
    that a worker's memory doesn't follow the rows' lengths."""
    most = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            most += pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64)
    ends, at = np.cumsum(most), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        n = max(1, int(np.searchsorted(ends, before + limit, side="right")) - at)
        yield batch.slice(at, n)
        at += n


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's texts; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's texts as UTF-8 bytes; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(batch.column(column).type) else pa.binary()
    return [x or b"" for x in batch.column(column).cast(kind).to_pylist()]


class Remembered(dict):
    """Results by key, forgotten all at once when there are too many."""

    def __init__(self, compute: Callable, limit: int):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        found = self[key] = self.compute(key)
        return found


def fold_of(column: str, folds: int):
    """crc32 of the id as text, by remainder; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def by_code_point(values: Iterable) -> list:
    """Distinct values by code point, null last."""
    found = set(values)
    return sorted(x for x in found if x is not None) + [None] * (None in found)
