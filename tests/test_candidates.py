"""Golden cases of the shrink candidates."""

import pytest

from jisfold import functions as J
from jisfold.constants import MJShrinkSchemeCombo as C
from jisfold.functions.candidates import mj_shrink_candidates
from jisfold.refdata.tables import MjTable

UNIFY, GUESS, FAMILY = C.JIS_INCORPORATION_UCS_UNIFICATION_RULE, C.INFERENCE_BY_READING_AND_GLYPH, C.MOJ_FAMILY_REGISTER_ACT_RELATED_NOTICE

# (characters, selector number or None, schemes, candidates; "same": the input)
GOLDEN = [
    *[("658E", s, c, ["658E"]) for c in (UNIFY, GUESS) for s in (None, 18)],
    *[("9089", s, c, e) for c in (UNIFY, GUESS) for s, e in ((None, ["9089"]), (18, "same"), (31, ["9089"]), (25, "same"))],
    ("9089", None, FAMILY, ["8FBA", "908A", "9089"]), ("9089", None, UNIFY | FAMILY, ["8FBA", "908A", "9089"]),
    *[("908A", s, c, e) for c in (UNIFY, GUESS) for s, e in ((None, ["908A"]), (18, "same"), (24, ["908A"]), (25, ["908A"]))],
    ("908A", None, FAMILY, ["8FBA", "908A"]), ("908A", None, UNIFY | FAMILY, ["8FBA", "908A"]),
    *[(u, None, c, [u]) for u in ("3450", "2AC2A") for c in (UNIFY, GUESS)],
]


def text(u, s):
    return chr(int(u, 16)) + (chr(0xE0100 + s - 16) if s is not None else "")


@pytest.mark.parametrize("u, s, combo, expected", GOLDEN)
def test_golden(u, s, combo, expected):
    assert mj_shrink_candidates(text(u, s), int(combo)) == ([text(u, s)] if expected == "same" else [text(x, None) for x in expected])


def test_number_of_cases():
    assert len(GOLDEN) == 28


def test_product_limit_and_empty():
    assert mj_shrink_candidates("髙島屋", 1) == ["高島屋", "髙島屋"]
    assert [mj_shrink_candidates("髙島屋", 1, n) for n in (1, 0, -1)] == [["高島屋"], [], ["高島屋", "髙島屋"]]
    assert mj_shrink_candidates("", 1) == [""]
    assert mj_shrink_candidates("髙髙", 1) == ["高高", "髙高", "高髙", "髙髙"]
    assert mj_shrink_candidates("髙", 0) == ["髙"]


def test_a_scheme_ends_at_the_character_itself():
    table = MjTable({1: [(65, None)]}, {1: {0: [66, 65, 67], 1: [68]}})
    assert mj_shrink_candidates("A", 3, table=table) == ["B", "D", "A"]


def test_columns(spark):
    df = spark.createDataFrame([(1, "髙島屋", 9), (2, "x", 9), (3, None, 9)], "i int, s string, ord int")
    rows = J.explode_candidates(df, "s", 1).orderBy("i", "ord").collect()
    assert [(r.i, r.ord, r.candidate) for r in rows] == [(1, 0, "高島屋"), (1, 1, "髙島屋"), (2, 0, "x")]
