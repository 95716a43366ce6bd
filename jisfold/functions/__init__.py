"""Public column functions.

Each takes a column and gives a column.  NULL gives NULL.  The plain forms
fail the job at a text that can't be converted, the ``try_`` forms give NULL
there, and the ``_with_error`` forms a struct of value, reason, start and end
(positions in characters, or bytes when decoding).

Tables are literals of the expression or captured by the UDF; they hold tens
of thousands of entries at most, whatever the data's size.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as spark_functions
from pyspark.sql import types as T

from jisfold.constants import NOT_CONVERTIBLE, ConversionMode, TransliterationError
from jisfold.errors import failing, typed_errors
from jisfold.expressions import F
from jisfold.functions import candidates, kernels, transducer
from jisfold.refdata.tables import JisTable, MjTable

RESULT = T.StructType([T.StructField("value", T.BinaryType()), T.StructField("reason", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
DECODED = T.StructType([T.StructField("value", T.StringType()), *RESULT.fields[1:]])


def _column(c: Column | str) -> Column:
    return spark_functions.col(c) if isinstance(c, str) else c


def _encode_udf(mode: int, table: JisTable | None):
    """The bug-compatible encoder, an Arrow batch of texts at a time."""

    @spark_functions.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        some, rows = texts.notna(), [(None, None, None, None)] * len(texts)
        found = iter(transducer.encode(texts[some].tolist(), mode, kernels.default_table(table)))
        rows = [next(found) if there else row for there, row in zip(some, rows, strict=True)]
        return pd.DataFrame(rows, columns=RESULT.names).astype({"start": "Int32", "end": "Int32"})

    return run


def jnta_encode_with_error(c: Column | str, conv_mode: int, table: JisTable | None = None, bug_compat: bool = False) -> Column:
    """struct<value, reason, start, end>: the bytes, or what is wrong where."""
    mode, c = ConversionMode(conv_mode), _column(c)
    if bug_compat:
        return F.when(c.isNotNull(), _encode_udf(mode, table)(c))
    table = kernels.default_table(table)

    def found(text: Column) -> Column:
        def of(value: Column) -> Column:
            start = F.when(value.isNull(), kernels.good_prefix(text, mode, table))
            reason = F.when(value.isNull(), F.lit(NOT_CONVERTIBLE))
            return kernels.bound(start, lambda at: F.struct(value.alias("value"), reason.alias("reason"), at.alias("start"), (at + 1).alias("end")))

        return kernels.bound(kernels.encode(text, mode, table), of)

    return F.when(c.isNotNull(), kernels.bound(c, found))


def jnta_encode(c: Column | str, conv_mode: int, table: JisTable | None = None, bug_compat: bool = False) -> Column:
    """The text's bytes; a text that can't be written fails the job (see
    ``jisfold.errors`` for the error's type)."""

    def whole(text: Column) -> Column:
        def of(found: Column) -> Column:
            failed = failing("encode", found["reason"], found["start"], found["end"], text).cast(T.BinaryType())
            return F.when(found["reason"].isNotNull(), failed).otherwise(found["value"])

        return kernels.bound(jnta_encode_with_error(text, conv_mode, table, bug_compat), of)

    if bug_compat:  # a UDF can't stand inside a lambda
        text, found = _column(c), jnta_encode_with_error(c, conv_mode, table, bug_compat)
        failed = failing("encode", found["reason"], found["start"], found["end"], text).cast(T.BinaryType())
        return F.when(found["reason"].isNotNull(), failed).otherwise(found["value"])
    return kernels.bound(_column(c), whole)


def try_jnta_encode(c: Column | str, conv_mode: int, table: JisTable | None = None, bug_compat: bool = False) -> Column:
    """The text's bytes, NULL where it can't be written."""
    mode, c = ConversionMode(conv_mode), _column(c)
    if bug_compat:
        return jnta_encode_with_error(c, mode, table, bug_compat)["value"]
    return kernels.bound(c, lambda text: kernels.encode(text, mode, kernels.default_table(table)))


def jnta_decode_with_error(c: Column | str, table: JisTable | None = None) -> Column:
    """struct<value, reason, start, end> of plane-1 bytes."""
    table = kernels.default_table(table)

    def error(c: Column, good: Column) -> tuple[Column, Column, Column]:
        """(reason, start, end) of what comes after so many good codes."""
        start = good * 2
        hexed = F.hex(F.substring(c, start + 1, F.lit(2)))
        first, second = F.lower(F.substring(hexed, 1, 2)), F.lower(F.substring(hexed, 3, 2))
        inside = lambda x: (x >= "21") & (x <= "7e")
        number = lambda x: F.conv(x, 16, 10).cast("int") + 1
        cases = [
            (~inside(first), F.concat(F.lit("unexpected byte \\x"), first), 0, 1),
            (second == "", F.lit("incomplete multibyte character"), 0, 1),
            (~inside(second), F.concat(F.lit("unexpected byte \\x"), second, F.lit(" after \\x"), first), 1, 2),
        ]
        reason = F.concat(F.lit("JIS character 1-"), number(first).cast("string"), F.lit("-"), number(second).cast("string"), F.lit(" does not have a corresponding unicode codepoint"))
        begin, end = start, start + 2
        for test, text_of, a, b in reversed(cases):
            reason, begin, end = F.when(test, text_of).otherwise(reason), F.when(test, start + a).otherwise(begin), F.when(test, start + b).otherwise(end)
        return reason, begin, end

    def found(c: Column) -> Column:
        bad = lambda good: F.struct(F.lit(None).cast("string").alias("value"), *[x.alias(n) for x, n in zip(error(c, good), DECODED.names[1:], strict=True)])
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in DECODED.fields[1:]]
        whole = lambda text: F.when(text.isNotNull(), F.struct(text.alias("value"), *none)).otherwise(kernels.bound(kernels.good_codes(c, table), bad))
        return kernels.bound(kernels.decode(c, table), whole)

    c = _column(c)
    return F.when(c.isNotNull(), kernels.bound(c, found))


def jnta_decode(c: Column | str, table: JisTable | None = None) -> Column:
    """The text of plane-1 bytes; bad bytes fail the job."""

    def whole(data: Column) -> Column:
        def of(found: Column) -> Column:
            failed = failing("decode", found["reason"], found["start"], found["end"], F.hex(data)).cast("string")
            return F.when(found["reason"].isNotNull(), failed).otherwise(found["value"])

        return kernels.bound(jnta_decode_with_error(data, table), of)

    return kernels.bound(_column(c), whole)


def try_jnta_decode(c: Column | str, table: JisTable | None = None) -> Column:
    """The text of plane-1 bytes, NULL where some are bad."""
    return kernels.decode(_column(c), kernels.default_table(table))


def jnta_shrink_translit(c: Column | str, replacement: str = "�", passthrough: bool = False, table: JisTable | None = None, bug_compat: bool = False) -> Column:
    """The text with rare characters replaced by their shrunken forms.

    Characters outside the table stay (``passthrough``), or become the
    replacement; an empty replacement fails the job there.
    """
    c = _column(c)
    if bug_compat:

        @spark_functions.pandas_udf("string")
        def run(texts: pd.Series) -> pd.Series:
            some = texts.notna()
            found = iter(transducer.shrink(texts[some].tolist(), kernels.default_table(table), replacement, passthrough))
            out = [next(found) if there else (None, None) for there in some]
            for _, at in out:
                if at is not None:
                    raise TransliterationError(f"transliteration failed at position {at}")
            return pd.Series([text for text, _ in out], dtype=object)

        return run(c)
    table = kernels.default_table(table)
    if passthrough or replacement:
        return kernels.shrink(c, table, replacement, passthrough)

    def whole(text: Column) -> Column:
        shrunk = kernels.shrink(text, table, "?", False)
        return kernels.bound(kernels.good_texts(text, table), lambda at: F.when(at.isNotNull(), failing("translit", F.lit("transliteration failed"), at).cast("string")).otherwise(shrunk))

    return kernels.bound(c, whole)


def try_jnta_shrink_translit(c: Column | str, table: JisTable | None = None) -> Column:
    """The shrunken text, NULL where a character has no form."""
    table = kernels.default_table(table)
    return kernels.bound(_column(c), lambda text: F.when(kernels.good_texts(text, table).isNull(), kernels.shrink(text, table, "?", False)))


def mj_shrink_candidates(c: Column | str, combo: Column | int, limit: int = 100, table: MjTable | None = None) -> Column:
    """array<string>: the text's forms under a set of schemes, in order.

    The schemes may be a column.  A negative limit gives all combinations, whose
    number is the product of the characters' forms and may exhaust memory;
    ``candidates_between`` makes rows of them instead.
    """

    def longer(found: Column, own: Column) -> Column:
        # a prefix's forms alternate fastest, so the first ones of the whole need its first ones only
        every = F.flatten(F.transform(own, lambda last: F.transform(found, lambda first: F.concat(first, last))))
        return every if limit < 0 else F.slice(every, 1, limit)

    start = F.array(F.lit("")) if limit else F.array().cast("array<string>")
    return F.aggregate(candidates.choices_column(_column(c), combo, table), start, longer)


def mj_candidate_count(c: Column | str, combo: Column | int, table: MjTable | None = None) -> Column:
    """How many candidates a text has, at most 2**63 - 1, without making any."""
    return candidates.count_column(candidates.choices_column(_column(c), combo, table))


def mj_candidate_at(c: Column | str, combo: Column | int, number: Column | int, table: MjTable | None = None) -> Column:
    """The candidate of a number (from 0), without making those before it; NULL
    where there is none."""
    number = F.lit(number) if isinstance(number, int) else number
    return candidates.at_column(candidates.choices_column(_column(c), combo, table), number)


#: Numbers in an array that is exploded; more are exploded in several levels.
_STEP = 4096


def candidates_between(df: DataFrame, text: str, combo: Column | int, first: int = 0, stop: int | None = None, table: MjTable | None = None, position: str = "ord", out: str = "candidate") -> DataFrame:
    """A row for each candidate numbered from ``first`` to before ``stop`` (none:
    all), however many these are: no array has more than 4,096 numbers.

    Input columns named like the new ones (in any letter case) are replaced;
    rows whose text is NULL or which has no such candidates give none.
    """
    kept = [x for x in df.columns if x.lower() not in (position.lower(), out.lower())]
    own = df.select(F.struct(*kept).alias("row"), candidates.choices_column(F.col(text), combo, table).alias("choices"))
    count = candidates.count_column(F.col("choices"))
    end = count if stop is None else F.least(count, F.lit(stop).cast("long"))
    own = own.select("row", "choices", F.lit(first).cast("long").alias("base"), (end - first).alias("left")).where("choices is not null and left > 0")
    for unit in (_STEP**k for k in (5, 4, 3, 2, 1, 0)):
        blocks = F.call_function("div", F.col("left") - 1, F.lit(unit))
        own = own.select("row", "choices", "base", "left", F.explode(F.sequence(F.lit(0).cast("long"), blocks)).alias("i"))
        own = own.select("row", "choices", (F.col("base") + F.col("i") * unit).alias("base"), F.least(F.lit(unit), F.col("left") - F.col("i") * unit).alias("left"))
    return own.select("row.*", F.col("base").alias(position), candidates.at_column(F.col("choices"), F.col("base")).alias(out))


def explode_candidates(df: DataFrame, text: str, combo: Column | int, limit: int = 100, table: MjTable | None = None, position: str = "ord", out: str = "candidate") -> DataFrame:
    """A row for each candidate, with its position (from 0).  A negative limit
    gives all.  Input columns named like the new ones are replaced."""
    return candidates_between(df, text, combo, 0, None if limit < 0 else limit, table, position, out)


def jis_class(c: Column | str, table: JisTable | None = None) -> Column:
    """The class of a text's first character (or pair), 0 outside the table.

    One ``translate`` to a private letter for each class, no lookup by row.
    """
    table = kernels.default_table(table)
    c = _column(c)
    pair = F.coalesce(F.regexp_extract(c, "^" + kernels.pair_pattern(table), 1), F.lit(""))
    first = F.substring(c, 1, 1)
    singles = table.singles()
    letters = {k: chr(0xF0100 + k) for k in sorted({r.cls for r in singles})}
    own = F.translate(first, "".join(r.us for r in singles) + "".join(letters.values()), "".join(letters[r.cls] for r in singles))
    found = F.lit(0)
    for k, letter in letters.items():
        found = F.when(own == letter, F.lit(k)).otherwise(found)
    for r in table.pairs:
        found = F.when(pair == r.us, F.lit(r.cls)).otherwise(found)
    return F.when(c.isNotNull(), found)


def parse_men_ku_ten(c: Column | str) -> Column:
    """The packed number of "men-ku-ten", NULL for other texts or out of range."""
    c = _column(c)
    part = lambda i: F.regexp_extract(c, r"^([0-9]+)-([0-9]+)-([0-9]+)$", i).try_cast("int")
    men, ku, ten = part(1), part(2), part(3)
    return F.when(men.between(1, 2) & ku.between(1, 94) & ten.between(1, 94), (men - 1) * 8836 + (ku - 1) * 94 + ten - 1)


def men_ku_ten(jis: Column | str) -> Column:
    """The inverse of parse_men_ku_ten."""
    jis = _column(jis)
    return F.concat_ws("-", (F.floor(jis / 8836) + 1).cast("string"), (F.floor(jis / 94) % 94 + 1).cast("string"), (jis % 94 + 1).cast("string"))


def parse_code_point(c: Column | str) -> Column:
    """The number of "U+XXXX", NULL for other texts or above U+10FFFF."""
    found = F.conv(F.regexp_extract(_column(c), "^[uU]\\+([0-9A-Fa-f]{1,8})$", 1), 16, 10).try_cast("int")
    return F.when(found <= 0x10FFFF, found)


def parse_code_points(c: Column | str) -> Column:
    """array<int> of a sequence of "U+XXXX" parted by white space."""
    return F.transform(F.split(F.trim(_column(c)), r"\s+"), parse_code_point)


def parse_hex_list(c: Column | str) -> Column:
    """array<int> of hexadecimal numbers joined by underscores, NULL in the place
    of one that is something else or above 10FFFF."""

    def number(x: Column) -> Column:
        found = F.conv(F.when(F.regexp_like(x, F.lit("^[0-9A-Fa-f]{1,6}$")), x), 16, 10).cast("int")
        return F.when(found <= 0x10FFFF, found)

    return F.transform(F.split(_column(c), "_"), number)


def parse_mj(c: Column | str) -> Column:
    """The number of an MJ code."""
    return F.regexp_extract(_column(c), "^MJ([0-9]+)$", 1).try_cast("int")


def selector_number(code_point: Column | str) -> Column:
    """The number of a variation selector, NULL for other code points."""
    u = _column(code_point)
    return F.when(u.between(0xFE00, 0xFE0F), u - 0xFE00).when(u.between(0xE0100, 0xE01EF), u - 0xE0100 + 16)


def selector_code_point(number: Column | str) -> Column:
    """The inverse of selector_number."""
    n = _column(number)
    return F.when(n.between(0, 15), n + 0xFE00).when(n.between(16, 255), n - 16 + 0xE0100)


def take_until_empty(array: Column | str) -> Column:
    """An array's elements before the first that is null or empty."""
    a = F.transform(_column(array), lambda x: F.coalesce(x, F.lit("")))
    at = F.array_position(a, "")
    return F.when(at > 0, F.slice(a, F.lit(1), (at - 1).cast("int"))).otherwise(a)


__all__ = [
    "ConversionMode",
    "TransliterationError",
    "candidates_between",
    "explode_candidates",
    "jis_class",
    "jnta_decode",
    "jnta_decode_with_error",
    "jnta_encode",
    "jnta_encode_with_error",
    "jnta_shrink_translit",
    "men_ku_ten",
    "mj_candidate_at",
    "mj_candidate_count",
    "mj_shrink_candidates",
    "parse_code_point",
    "parse_code_points",
    "parse_hex_list",
    "parse_men_ku_ten",
    "parse_mj",
    "selector_code_point",
    "selector_number",
    "take_until_empty",
    "try_jnta_decode",
    "try_jnta_encode",
    "try_jnta_shrink_translit",
    "typed_errors",
]
