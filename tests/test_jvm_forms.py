"""What used to run in Python and now stays in the JVM, against the Python forms."""

import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from jisfold import functions as J
from jisfold.constants import ConversionMode
from jisfold.functions import candidates, machine
from jisfold.operators import relational
from jisfold.plans import catalog, corpus
from jisfold.refdata.tables import MjTable, seed_jis, seed_mj
from test_candidates import GOLDEN, text

SF = "/root/testdata/sf0.001"
#: A table with targets under all schemes, rows of several forms, and an identity.
RICH = MjTable(
    {1: [(65, None), (66, 17)], 2: [(66, None), (65, None), (66, 17)], 3: [(67, 3)], 4: [(0x20089, None), (68, None)], 5: [(65, None)]},
    {1: {0: [66, 65, 67], 1: [68, 66], 3: [0x20089]}, 2: {2: [67, 66, 68], 0: [66]}, 3: {1: [67, 68]}, 5: {2: [70]}},
)


def assert_no_python(df):
    found = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in found and "Pandas" not in found and "Arrow" not in found


def random_texts():
    rng = random.Random(3)
    some = ["A", "B", "C", "D", "F", "Z", "𠂉", "\n", ""]
    texts = ["".join(rng.choice(some) + rng.choice(["", "", "︃", "\U000e0101", "\U000e0100"]) for _ in range(rng.randrange(6))) for _ in range(80)]
    return [*texts, "", "︃", "︃︃A", "A\U000e0101\U000e0101"]


@pytest.mark.parametrize("table", [seed_mj(), RICH, MjTable()])
def test_candidates_equal_python(spark, table):
    texts = [*corpus.TEXTS, *random_texts()]
    df = spark.createDataFrame([(t, c) for t in texts for c in (0, 1, 6, 9, 15)], "s string, combo int")
    found = df.select("s", "combo", J.mj_shrink_candidates("s", F.col("combo"), 50, table).alias("c"), J.mj_candidate_count("s", F.col("combo"), table).alias("n"))
    assert_no_python(found)
    for r in found.collect():
        assert r.c == candidates.mj_shrink_candidates(r.s, r.combo, 50, table), (r.s, r.combo)
        assert r.n == reduce(lambda a, b: a * len(b), candidates.choices(r.s, r.combo, table), 1)


def test_golden_cases_of_the_column(spark):
    rows = [(text(u, s), int(c), [text(u, s)] if e == "same" else [text(x, None) for x in e]) for u, s, c, e in GOLDEN]
    df = spark.createDataFrame(rows, "s string, combo int, expected array<string>")
    assert df.where(J.mj_shrink_candidates("s", F.col("combo")) != F.col("expected")).count() == 0


@pytest.mark.parametrize("table", [seed_mj(), RICH])
@pytest.mark.parametrize("combo", [0, 9, 15])
def test_candidates_by_joins(spark, table, combo):
    mj = spark.createDataFrame([(mj, i, v) for i, (mj, v) in enumerate(table.variants.items())], "mj int, ord int, v array<struct<u:int,s:smallint>>")
    shrink = spark.createDataFrame([(m, k, n, u) for m, schemes in table.shrink.items() for k, us in schemes.items() for n, u in enumerate(us)], "mj int, scheme int, ord int, u int")
    df = spark.createDataFrame([(t, 1) for t in [*random_texts(), *corpus.TEXTS, None, "AA"]], "s string, choices int")
    found = relational.with_choices(df, "s", mj, shrink, combo)
    assert_no_python(found)
    rows = found.collect()
    assert len(rows) == df.count()
    for r in rows:
        assert r.choices == (None if r.s is None else candidates.choices(r.s, combo, table)), r.s


def test_candidates_by_number(spark):
    texts = ["AB", "ABAB", "", "Z", None, "A\U000e0101A"]
    df = spark.createDataFrame([(t, 7) for t in texts], "s string, ORD int")
    for first, stop in ((0, None), (2, 9), (5, 5), (100, None), (0, 1)):
        rows = J.candidates_between(df, "s", 15, first, stop, RICH)
        assert rows.columns == ["s", "ord", "candidate"]
        expected = [(t, k, c) for t in texts if t is not None for k, c in enumerate(candidates.mj_shrink_candidates(t, 15, -1, RICH)) if k >= first and (stop is None or k < stop)]
        assert sorted(map(tuple, rows.collect())) == sorted(expected)
    assert df.select(J.mj_candidate_at("s", 15, -1, RICH).alias("c")).where("c is not null").count() == 0


def test_ranges_of_many_candidates(spark):
    df = spark.createDataFrame([("A" * 200,)], "s string")
    size = len(candidates.choices("A", 15, RICH)[0])
    assert df.select(J.mj_candidate_count("s", 15, RICH).alias("n")).first().n == 2**63 - 1
    start = 10**17 + 12345
    rows = J.candidates_between(df, "s", 15, start, start + 9000, RICH)
    assert rows.count() == 9000 and rows.select("candidate").distinct().count() == 9000
    forms, n, expected = candidates.choices("A", 15, RICH)[0], start, ""
    for _ in range(200):
        n, digit = divmod(n, size)
        expected += forms[digit]
    assert rows.orderBy("ord").first().candidate == expected


def test_shift_codes_equal_the_machine(spark):
    rng = random.Random(5)
    table = seed_jis()
    second = [r.us for r in table.rows.values() if r.plane == 2]
    first = [r.us for r in table.rows.values() if r.plane == 1]
    texts = ["".join(rng.choice(rng.choice([second, first, first, ["か", "゚", "セ", "˥", "˩"]])) for _ in range(rng.randrange(12))) for _ in range(300)]
    texts += ["𠂉", "𠂉𠂉", "a𠂉", "\U00102121", "𠂉\U00102121", "\U000f0001", "", *corpus.TEXTS, "".join(second), "".join(first)]
    df = spark.createDataFrame([(t,) for t in texts], "s string").select("s", J.jnta_encode_with_error("s", ConversionMode.SISO).alias("e"), J.try_jnta_encode("s", ConversionMode.SISO).alias("b"))
    assert_no_python(df)
    for r in df.collect():
        try:
            expected = (machine.encode("jis", r.s, ConversionMode.SISO), None, None, None)
        except UnicodeEncodeError as e:
            expected = (None, e.reason, e.start, e.end)
        value = None if r.e.value is None else bytes(r.e.value)
        assert (value, r.e.reason, r.e.start, r.e.end) == expected
        assert (None if r.b is None else bytes(r.b)) == value


def python_islands(numbers, gap):
    out = []
    for u in sorted({x for x in numbers if x is not None}):
        if out and u - out[-1][1] < gap:
            out[-1][1:] = [u, out[-1][2] + 1]
        else:
            out.append([u, u, 1])
    return sorted(map(tuple, out))


@pytest.mark.parametrize("numbers, gap", [
    ([1, 2, 3, 300, 301, None, 3, 65535, 65536, 65537, 131072, 10**6, 2**40, 2**40 + 5, 2**62], 256),
    ([-5, -1, 0, 3, -(2**40), -(2**40) + 2, -70000, 2**33], 4),
    ([7 * 65536 * k for k in range(50)], 7 * 65536 + 1),
    ([], 3), ([None], 3), ([5], 1),
])
def test_islands(spark, numbers, gap):
    df = spark.createDataFrame([(x, "c") for x in numbers], "u long, first string")
    found = relational.islands(df, "u", gap)
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == python_islands(numbers, gap)


def test_last_before(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice([None, None, k * 2])) for k in rng.sample(range(-200_000, 400_000), 500)] + [(None, 1)]
    df = spark.createDataFrame(rows, "k long, v long")
    for inclusive in (False, True):
        got = {r.k: r.found for r in relational.last_before(df, "k", F.col("v"), "found", inclusive).collect()}
        last = None
        for k, v in sorted(r for r in rows if r[0] is not None):
            last = v if inclusive and v is not None else last
            assert got[k] == last
            last = v if v is not None else last
        assert got[None] is None and len(got) == len(rows)


def test_range_join(spark):
    rng = random.Random(2)
    points = [rng.randrange(-300, 300) for _ in range(200)] + [None]
    ranges = [(a, a + rng.randrange(-3, 90)) for a in (rng.randrange(-320, 300) for _ in range(40))] + [(None, 5), (5, None)]
    p, r = spark.createDataFrame([(x,) for x in points], "p long"), spark.createDataFrame(ranges, "a long, b long")
    expected = sorted((x, a, b) for x in points if x is not None for a, b in ranges if a is not None and b is not None and a <= x <= b)
    assert sorted(map(tuple, relational.range_join(p, "p", r, "a", "b", 16).collect())) == expected
    hit = {x for x, _, _ in expected}
    assert sorted(x.p for x in relational.range_join(p, "p", r, "a", "b", 16, "left_semi").collect()) == sorted(x for x in points if x in hit)
    assert relational.range_join(p, "p", r, "a", "b", 16, "left_anti").count() == sum(x not in hit for x in points)


def test_hexadecimal_lists_are_strict(spark):
    rows = ["8FBA_E0100", "XYZ_E0101", "8FBAQQ_E0101", "FFFFFFFFF_E0101", "110000_1", "_1", "+1_1", " 1_1", "10FFFF"]
    found = [r.h for r in spark.createDataFrame([(x,) for x in rows], "h string").select(J.parse_hex_list("h").alias("h")).collect()]
    assert found == [[0x8FBA, 0xE0100], [None, 0xE0101], [None, 0xE0101], [None, 0xE0101], [None, 1], [None, 1], [None, 1], [None, 1], [0x10FFFF]]


@pytest.mark.parametrize("name", ["encode_siso", "mj_candidates_exploded", "mj_candidates_limit", "mj_candidates_ivs", "mj_combo_schemes", "candidate_count_by_nation"])
def test_queries_without_python(spark, name):
    assert_no_python(catalog.QUERIES[name](spark, SF))
