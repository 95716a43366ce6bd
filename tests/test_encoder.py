"""Golden cases of the encoder, the incremental encoder, decoder and shrinking."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jisfold import functions as J
from jisfold.constants import NOT_CONVERTIBLE, ConversionMode, TransliterationError
from jisfold.functions import machine
from jisfold.functions.machine import IncrementalEncoder
from jisfold.refdata.tables import seed_jis

SISO, MEN1, X0208, TRANSLIT = ConversionMode
LONG = "ジャンクロードヴァンダム"
LONG_HEX = "2538256325732 52F256D213C254925742521257325402560".replace(" ", "")

# (text, mode, bytes or None)
GOLDEN = [
    ("\0", MEN1, None), ("゚", MEN1, None), ("⦌6", MEN1, None), ("✋", MEN1, None),
    ("，", MEN1, "2124"), ("，", X0208, "2124"), ("，", TRANSLIT, "2124"),
    ("ゔゕゖ", MEN1, "247424752476"), ("ゔゕゖ", X0208, None), ("ゔゕゖ", TRANSLIT, "257425752576"),
    ("㉑", MEN1, "2841"), ("㉑", X0208, None), ("㉑", TRANSLIT, "23322331"),
    ("繫", MEN1, "7E7E"), ("繫", X0208, None), ("繫", TRANSLIT, "3752"),
    (LONG, MEN1, LONG_HEX), (LONG, X0208, LONG_HEX), (LONG, TRANSLIT, LONG_HEX),
    ("𠂉", MEN1, None), ("𠂉", X0208, None), ("𠂉", TRANSLIT, None), ("𠂉", SISO, "0F21210E"),
    ("か゚", MEN1, "2477"), ("かか゚", MEN1, "242B2477"), ("か" * 33, MEN1, "242B" * 33), ("", MEN1, ""),
]

# (text, mode, bytes at once, bytes at the end)
INCREMENTAL = [
    ("，", MEN1, "2124", ""), ("，", X0208, "2124", ""), ("，", TRANSLIT, "2124", ""),
    ("ゔゕゖ", MEN1, "247424752476", ""), ("ゔゕゖ", TRANSLIT, "257425752576", ""),
    ("㉑", MEN1, "2841", ""), ("㉑", TRANSLIT, "23322331", ""), ("繫", MEN1, "7E7E", ""), ("繫", TRANSLIT, "3752", ""),
    ("ジャンク", MEN1, "253825632573", "252F"), ("ジャンク", X0208, "253825632573", "252F"), ("ジャンク", TRANSLIT, "253825632573", "252F"),
    ("𠂉", SISO, "0F2121", "0E"),
]


@pytest.mark.parametrize("text, mode, expected", GOLDEN)
def test_golden(text, mode, expected):
    if expected is None:
        with pytest.raises(UnicodeEncodeError) as e:
            machine.encode("jis", text, mode)
        assert e.value.reason == NOT_CONVERTIBLE
    else:
        assert machine.encode("jis", text, mode).hex().upper() == expected


@pytest.mark.parametrize("text, mode, now, end", INCREMENTAL)
def test_incremental(text, mode, now, end):
    encoder = IncrementalEncoder("jis", mode)
    assert encoder.encode(text).hex().upper() == now
    assert encoder.encode("", True).hex().upper() == end


def test_columns_give_the_golden_cases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(GOLDEN)], "i int, s string")
    for mode in ConversionMode:
        found = {r.i: r for r in df.select("i", F.hex(J.try_jnta_encode("s", mode)).alias("h"), J.jnta_encode_with_error("s", mode).alias("e")).collect()}
        for i, (_, m, expected) in enumerate(GOLDEN):
            if m == mode:
                assert found[i].h == expected
                assert (found[i].e.reason is None) == (expected is not None)


def test_plain_forms_fail_and_null_stays_null(spark):
    df = spark.createDataFrame([("✋",)], "s string")
    for c in (J.jnta_encode("s", MEN1), J.jnta_shrink_translit("s", replacement=""), J.jnta_decode(F.col("s").cast("binary"))):
        with pytest.raises(Exception, match="at position 0"):
            df.select(c).collect()
    null = spark.createDataFrame([(None,)], "s string")
    columns = [J.jnta_encode_with_error("s", m) for m in ConversionMode] + [J.jnta_shrink_translit("s"), J.mj_shrink_candidates("s", 1), J.jis_class("s"), J.try_jnta_decode(F.col("s").cast("binary"))]
    assert set(null.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()) == {None}


def test_arguments():
    with pytest.raises(ValueError):
        IncrementalEncoder("", MEN1)
    with pytest.raises(ValueError):
        IncrementalEncoder("jis", 7)
    with pytest.raises(ValueError):
        machine.decode("", b"")


def test_bug_compatible_encoder():
    assert machine.encode("jis", "かか゚", MEN1, bug_compat=True).hex() == "2477"
    with pytest.raises(UnicodeEncodeError, match="lookahead buffer overflow"):
        machine.encode("jis", "か" * 33, MEN1, bug_compat=True)


@pytest.mark.parametrize(
    "text, fixed, compat",
    [("か", "か", ""), ("山か", "山か", "山"), ("か゚山", "か゚山", "か゚か山"), ("か゚か゚山", "か゚か゚山", "か゚か゚かか山"), ("麴町", "麹町", "麹町"), ("髙", "�", "�")],
)
def test_shrinking(spark, text, fixed, compat):
    assert machine.shrink_translit(text) == fixed
    assert machine.shrink_translit(text, bug_compat=True) == compat
    row = spark.createDataFrame([(text,)], "s string").select(J.jnta_shrink_translit("s"), J.jnta_shrink_translit("s", bug_compat=True)).first()
    assert tuple(row) == (fixed, compat)


def test_shrinking_without_a_form():
    assert machine.shrink_translit("髙", passthrough=True) == "髙"
    with pytest.raises(TransliterationError, match="transliteration failed at position 0"):
        machine.shrink_translit("髙", replacement="")


@pytest.mark.parametrize("data, reason, start", [("0F2121", "unexpected byte \\x0f", 0), ("21", "incomplete multibyte character", 0), ("2120", "unexpected byte \\x20 after \\x21", 1), ("2F7E", None, None)])
def test_decode(data, reason, start):
    if reason is None:
        assert len(machine.decode("jis", bytes.fromhex(data))) == 1
    else:
        with pytest.raises(UnicodeDecodeError) as e:
            machine.decode("jis", bytes.fromhex(data))
        assert (e.value.reason, e.value.start) == (reason, start)


TABLE = seed_jis()
PLANE_1 = sorted(u for u, r in TABLE.by_text.items() if r.plane == 1)


@given(st.lists(st.sampled_from(PLANE_1), max_size=12).map("".join), st.data())
@settings(max_examples=150, deadline=None)
def test_round_trip_and_any_split(text, data):
    coded = machine.encode("jis", text, MEN1)
    assert machine.decode("jis", coded) == text
    encoder, out, at = IncrementalEncoder("jis", MEN1), b"", 0
    while at < len(text):
        n = data.draw(st.integers(1, 3))
        state = encoder.getstate()
        encoder = IncrementalEncoder("jis", MEN1)
        encoder.setstate(state)
        out += encoder.encode(text[at : at + n])
        at += n
    assert out + encoder.encode("", True) == coded


def test_columns_equal_the_machine(spark):
    import random

    rnd = random.Random(5)
    some = [*"か゚きツ山一髙棃﨑麴繫㉑ゔA PB", *(r.us for r in TABLE.pairs), "˥", "˩", "𠂉", "\U000f0000", "\U000f0001", "̀"]
    texts = ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 6))) for _ in range(400)] + PLANE_1
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    rows = df.select("s", *[J.jnta_encode_with_error("s", m).alias(f"m{int(m)}") for m in ConversionMode], J.jnta_shrink_translit("s").alias("t"), J.jnta_shrink_translit("s", passthrough=True).alias("p"))
    for r in rows.collect():
        for mode in ConversionMode:
            try:
                expected = (machine.encode("jis", r.s, mode), None, None)
            except UnicodeEncodeError as e:
                expected = (None, e.reason, e.start)
            found = r[f"m{int(mode)}"]
            assert (found.value and bytes(found.value) if found.value is not None else None, found.reason, found.start) == expected, (r.s, mode)
        assert r.t == machine.shrink_translit(r.s)
        assert r.p == machine.shrink_translit(r.s, passthrough=True)


def test_table_counts():
    from collections import Counter

    assert Counter(r.cls for r in TABLE.rows.values()) == {9: 524, 1: 2965, 2: 3390, 11: 659, 3: 1259, 4: 2436}
    assert len(TABLE.pairs) == 25
