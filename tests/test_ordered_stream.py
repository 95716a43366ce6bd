"""Parts in any order give the bytes of the whole."""

import random
import time

import pytest

from jisfold.constants import ConversionMode
from jisfold.functions import machine
from jisfold.streaming import ordered

SCHEMA = "stream_id string, seq long, text string, final boolean"


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ordered.ROCKSDB)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield spark
    spark.conf.set(key, before)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def run(spark, folder, batches, mode=ConversionMode.SISO, restart=False, pause=0, **options):
    """The rows that the operator gives for the batches, each a file and a micro-batch."""
    (folder / "in").mkdir(parents=True)
    out = []
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(f"file://{folder}/staged-{n}")
        for k, part in enumerate((folder / f"staged-{n}").glob("*.parquet")):
            part.rename(folder / "in" / f"{n:03}-{k}.parquet")
        if restart or pause or n == len(batches) - 1:
            parts = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}/in")
            found = ordered.encode_ordered_stream(parts, mode, **options)
            query = found.writeStream.outputMode("append").format("parquet").option("path", f"file://{folder}/out").option("checkpointLocation", f"file://{folder}/state").trigger(availableNow=True).start()
            assert query.awaitTermination(60)
            time.sleep(pause)
    for r in spark.read.parquet(f"file://{folder}/out").collect():
        out.append((r.stream_id, r.seq, None if r.bytes is None else bytes(r.bytes), r.reason, r.start))
    return out


TEXTS = {"a": "かか゚𠂉山セ゚𠂉", "b": "𠂉𠂉ト゚か", "c": "山", None: "ジャンク"}


@pytest.mark.parametrize("restart", [False, True])
def test_any_order(rocksdb, tmp_path, restart):
    rng = random.Random(restart)
    parts = [(k, n, c, n == len(t) - 1) for k, t in TEXTS.items() for n, c in enumerate(t)]
    rng.shuffle(parts)
    found = run(rocksdb, tmp_path, [parts[i::4] for i in range(4)], restart=restart)
    assert len(found) == len(parts) and all(r[3] is None for r in found)
    for k, t in TEXTS.items():
        own = sorted((r[1], r[2]) for r in found if r[0] == k)
        assert b"".join(b for _, b in own) == machine.encode("jis", t, ConversionMode.SISO)


def test_odd_parts(rocksdb, tmp_path):
    big = 2**53 + 1
    batches = [
        [("a", 1, "い", False), ("a", None, "?", False), ("a", 3, "え", False), ("n", None, None, None), ("a", big, "x", False)],
        [("a", 0, "あ", False), ("a", 0, "ん", False), ("a", 3, "え", False)],
        [("a", 2, "✋", False), ("a", 4, None, True), ("a", 6, "お", False)],
        [("a", 5, "か", False), ("a", 4, "き", True)],
    ]
    found = run(rocksdb, tmp_path, batches)
    code = lambda t: machine.encode("jis", t, ConversionMode.SISO)
    expected = [
        ("a", None, None, ordered.NO_NUMBER, None), ("n", None, None, ordered.NO_NUMBER, None),
        ("a", 0, code("あ"), None, None), ("a", 1, code("い"), None, None), ("a", 0, None, ordered.REPEATED, None), ("a", 3, None, ordered.REPEATED, None),
        ("a", 2, None, "not convertible to JISX0208", 0), ("a", 3, code("え"), None, None), ("a", 4, b"", None, None), ("a", 6, None, ordered.AFTER_END, None),
        ("a", big, None, ordered.AFTER_END, None), ("a", 5, None, ordered.AFTER_END, None), ("a", 4, None, ordered.REPEATED, None),
    ]
    assert sorted(map(repr, found)) == sorted(map(repr, expected))


def test_missing_parts_are_given_up(rocksdb, tmp_path):
    batches = [[("a", 0, "あ", False), ("a", 2, "う", False), ("a", 5, "お", True)], [("b", 0, "山", True)], [("c", 0, "山", True)], [("d", 0, "山", True)]]
    found = run(rocksdb, tmp_path, batches, wait=200, pause=1)
    own = [r for r in found if r[0] == "a"]
    code = lambda t: machine.encode("jis", t, ConversionMode.SISO)
    assert sorted(map(repr, own)) == sorted(map(repr, [("a", 0, code("あ"), None, None), ("a", 1, None, ordered.MISSING, None), ("a", 2, code("う"), None, None), ("a", 3, None, ordered.MISSING, None), ("a", 5, code("お"), None, None)]))


def test_the_plain_stream_takes_null_and_large_numbers(spark, tmp_path):
    from jisfold.streaming import encoder

    rows = [("a", None, "x", False), ("a", 2**53 + 1, "山", False), ("a", 2**53 + 2, "か", True), ("a", None, None, None)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    parts = spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in")
    query = encoder.encode_stream(parts, ConversionMode.MEN1).writeStream.format("memory").queryName("plain_numbers").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    found = sorted(((r.seq or 0, r.reason) for r in spark.table("plain_numbers").collect()), key=repr)
    assert found == sorted([(0, encoder.NO_NUMBER), (0, encoder.NO_NUMBER), (2**53 + 1, None), (2**53 + 2, None)], key=repr)
