"""The automaton on arrays gives what the one in Python gives, and faster."""

import random
import time

import pytest

from jisfold import functions as J
from jisfold.constants import ConversionMode, TransliterationError
from jisfold.functions import machine, transducer
from jisfold.plans import corpus
from jisfold.refdata.tables import seed_jis

TABLE = seed_jis()


def texts():
    rng = random.Random(21)
    rows = list(TABLE.rows.values())
    some = ["か", "゚", "セ", "˥", "˩", "æ", "̀", "山", "𠂉", "㉑", "✋", "繫", "x"]
    out = ["".join(rng.choice(some if rng.random() < 0.8 else [r.us for r in rows]) for _ in range(rng.randrange(14))) for _ in range(1500)]
    return [*out, "", "か" * 32, "か" * 33, "か" * 32 + "゚", "か" * 33 + "゚", "か" * 31 + "か゚" + "か" * 33, "✋" + "か" * 40, "か" * 40 + "✋", "˥˩˥˩˥", *corpus.TEXTS]


def expected_encode(text, mode, bug_compat):
    try:
        return machine.encode("jis", text, mode, TABLE, bug_compat), None, None, None
    except UnicodeEncodeError as e:
        return None, e.reason, e.start, e.end


@pytest.mark.parametrize("mode", list(ConversionMode))
@pytest.mark.parametrize("bug_compat", [False, True])
def test_encode(mode, bug_compat):
    some = texts()
    assert transducer.encode(some, mode, TABLE, bug_compat) == [expected_encode(t, mode, bug_compat) for t in some]
    assert transducer.encode([], mode, TABLE, bug_compat) == []
    assert transducer.encode(["", ""], mode, TABLE, bug_compat) == [(b"", None, None, None)] * 2


@pytest.mark.parametrize("replacement, passthrough", [("�", False), ("[?]", False), ("", True), ("", False)])
def test_shrink(replacement, passthrough):
    some = texts()
    for text, (found, at) in zip(some, transducer.shrink(some, TABLE, replacement, passthrough), strict=True):
        try:
            assert found == machine.shrink_translit(text, replacement, passthrough, TABLE, True), text
        except TransliterationError as e:
            assert found is None and str(e) == f"transliteration failed at position {at}", text
    assert transducer.shrink([], TABLE) == [] and transducer.shrink([""], TABLE) == [("", None)]


def test_columns(spark):
    df = spark.createDataFrame([(t,) for t in [*texts()[:300], None]], "s string")
    for r in df.select("s", J.jnta_encode_with_error("s", 0, bug_compat=True).alias("e"), J.jnta_shrink_translit("s", "[?]", bug_compat=True).alias("t")).collect():
        if r.s is None:
            assert r.e is None and r.t is None
        else:
            value = None if r.e.value is None else bytes(r.e.value)
            assert (value, r.e.reason, r.e.start, r.e.end) == expected_encode(r.s, 0, True)
            assert r.t == machine.shrink_translit(r.s, "[?]", False, TABLE, True)


def test_rate():
    plain = ["株式会社島屋か゚𠂉繫" * 20] * 500
    transducer.encode(plain[:1], 0, TABLE)
    start = time.process_time()
    transducer.encode(plain, 0, TABLE)
    fast = time.process_time() - start
    start = time.process_time()
    for t in plain:
        machine.encode("jis", t, 0, TABLE, True)
    slow = time.process_time() - start
    assert slow > 2 * fast, (slow, fast)
    print(f"\n{sum(map(len, plain)) / fast / 1e6:.1f} and {sum(map(len, plain)) / slow / 1e6:.1f} M characters a second")
