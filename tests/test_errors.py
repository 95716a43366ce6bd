"""Plain column forms raise the types that the Python forms raise."""

import pytest
from pyspark.sql import functions as F

from jisfold import functions as J
from jisfold.constants import ConversionMode, TransliterationError
from jisfold.functions import machine


@pytest.mark.parametrize("mode", list(ConversionMode))
@pytest.mark.parametrize("text", ["山✋", "か゚か゚✋か゚", 'quote " \\ {"jisfold":', "\U000f0001"])
def test_encode(spark, mode, text):
    df = spark.createDataFrame([("山",), (None,), (text,)], "s string")
    with pytest.raises(UnicodeEncodeError) as found, J.typed_errors():
        df.select(J.jnta_encode("s", mode).alias("b")).collect()
    with pytest.raises(UnicodeEncodeError) as expected:
        machine.encode("jis", text, mode)
    assert found.value.args == expected.value.args


@pytest.mark.parametrize("data", [b"\x21", b"\x0f\x21\x21", b"\x21\x20", b"\x21\x24\x24\x7c\x21\x21", b"\x21\x24\x7f\x21", b"\xff\xd8\x00"])
def test_decode(spark, data):
    df = spark.createDataFrame([(b"!!",), (None,), (data,)], "b binary")
    with pytest.raises(UnicodeDecodeError) as found, J.typed_errors():
        df.select(J.jnta_decode("b").alias("s")).collect()
    with pytest.raises(UnicodeDecodeError) as expected:
        machine.decode("jis", data)
    assert found.value.args == expected.value.args


def test_transliterate(spark):
    df = spark.createDataFrame([("麴",), ("か゚山✋",)], "s string")
    with pytest.raises(TransliterationError, match="transliteration failed at position 3"), J.typed_errors():
        df.select(J.jnta_shrink_translit("s", replacement="").alias("s")).collect()
    assert df.where("s = '麴'").select(J.jnta_shrink_translit("s", replacement="").alias("s")).first().s == "麹"


def test_good_texts_and_other_errors(spark):
    df = spark.createDataFrame([("山",), (None,), ("",)], "s string")
    with J.typed_errors():
        coded = df.select(J.jnta_encode("s", ConversionMode.MEN1).alias("b")).select("b", J.jnta_decode("b").alias("s")).collect()
    assert [(None if r.b is None else bytes(r.b), r.s) for r in coded] == [(b";3", "山"), (None, None), (b"", "")]
    with pytest.raises(Exception, match="another") as found, J.typed_errors():
        spark.range(1).select(F.raise_error(F.lit("another"))).collect()
    assert not isinstance(found.value, UnicodeError | TransliterationError)


def test_bug_compatible_form(spark):
    df = spark.createDataFrame([("か" * 33,)], "s string")
    with pytest.raises(UnicodeEncodeError, match="lookahead buffer overflow"), J.typed_errors():
        df.select(J.jnta_encode("s", ConversionMode.MEN1, bug_compat=True).alias("b")).collect()
