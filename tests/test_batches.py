"""The forms for long texts and streams of many texts: results of the plain
forms, and work that follows the input."""

import random

import pytest
from pyspark.sql import functions as F

from jisfold import functions as J
from jisfold.constants import ConversionMode, TransliterationError
from jisfold.functions import batches, machine, transducer
from jisfold.plans import catalog, corpus
from jisfold.refdata.tables import seed_jis
from jisfold.streaming.encoder import encode_stream

TABLE = seed_jis()
SF = "/root/testdata/sf0.001"


def texts():
    rng = random.Random(5)
    rows = [r.us for r in TABLE.rows.values()]
    some = ["か", "゚", "セ", "˥", "˩", "æ", "̀", "山", "𠂉", "㉑", "✋", "繫", "x", "\U000f0001", "\U00102121"]
    return [*("".join(rng.choice(some if rng.random() < 0.7 else rows) for _ in range(rng.randrange(12))) for _ in range(400)), "", *corpus.TEXTS, None]


@pytest.mark.parametrize("mode", list(ConversionMode))
def test_encode(spark, mode):
    df = spark.createDataFrame([(t,) for t in texts()], "s string").select(J.jnta_encode_with_error("s", mode).alias("a"), batches.encode_with_error("s", mode).alias("b"))
    assert all(r.a == r.b or r.a is None and r.b.value is None and r.b.reason is None for r in df.collect())


def test_shrink_and_decode(spark, monkeypatch):
    monkeypatch.setattr(batches, "SLICE", 100)
    df = spark.createDataFrame([(t,) for t in texts()], "s string")
    both = df.select(*[f("s", x, p).alias(f"c{i}{k}") for i, (x, p) in enumerate([("�", False), ("[?]", False), ("", True)]) for k, f in enumerate([J.jnta_shrink_translit, batches.shrink_translit])])
    assert all(r[0] == r[1] and r[2] == r[3] and r[4] == r[5] for r in both.collect())
    rng = random.Random(6)
    codes = [r.code for r in TABLE.rows.values() if r.plane == 1]
    data = [b"".join(rng.choice(codes) for _ in range(rng.randrange(6))) for _ in range(300)]
    data = [*data, *(d[:-1] for d in data), *(d + bytes([rng.randrange(256), rng.randrange(256)]) + d for d in data), None]
    df = spark.createDataFrame([(d,) for d in data], "d binary").select(J.jnta_decode_with_error("d").alias("a"), batches.decode_with_error("d").alias("b"))
    assert all(r.a == r.b or r.a is None and r.b.value is None and r.b.reason is None for r in df.collect())
    with pytest.raises(Exception, match="transliteration failed at position 1"):
        spark.createDataFrame([("山✋",)], "s string").select(batches.shrink_translit("s", "")).collect()


def test_arrays():
    some = [t for t in texts() if t is not None]
    for text, (found, at) in zip(some, transducer.shrink(some, TABLE, "", False, False), strict=True):
        try:
            assert found == machine.shrink_translit(text, "", False, TABLE)
        except TransliterationError as e:
            assert found is None and str(e) == f"transliteration failed at position {at}"
    assert transducer.decode([], TABLE) == [] and transducer.decode([b""], TABLE) == [("", None, None, None)]


def test_document_characters(spark):
    """A row for each code point of a task, not for each character."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counted = catalog._document_characters(spark, SF)
    expected = {}
    for r in docs.select("text").collect():
        for c in r.text or "":
            expected[ord(c)] = expected.get(ord(c), 0) + 1
    assert {r.u: r.n for r in counted.groupBy("u").agg(F.sum("n").alias("n")).collect()} == expected
    assert counted.count() <= len(expected) * counted.rdd.getNumPartitions()


def test_stream_in_shards(spark, tmp_path):
    """Many open texts are a few states, and go on from them."""
    schema = "stream_id string, seq long, text string, final boolean"
    for i in (0, 1):
        rows = [(str(k), i, ["か", "゚"][i] if k % 2 else "𠂉山"[i], i == 1 and k % 4 < 2) for k in range(200)] + [(None, i, "山", i == 1)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/parts")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/parts")
    query = encode_stream(stream, ConversionMode.SISO, shards=8).writeStream.format("memory").queryName("in_shards").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8
    found = {}
    for r in spark.table("in_shards").orderBy("seq").collect():
        found[r.stream_id] = found.get(r.stream_id, b"") + bytes(r.bytes)
    assert len(found) == 201
    for k, data in found.items():
        whole = "山山" if k is None else "か゚" if int(k) % 2 else "𠂉山"
        assert data == machine.encode("jis", whole, ConversionMode.SISO, TABLE), k
