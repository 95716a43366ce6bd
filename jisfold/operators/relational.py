"""Relational operators over the character tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jisfold.functions.candidates import TOKENS
from jisfold.refdata.tables import SLOTS


def densify(df: DataFrame, key: str, fill: dict, slots: int = SLOTS) -> DataFrame:
    """A row for each number below ``slots``; missing ones get ``fill``."""
    return df.sparkSession.range(slots).select(F.col("id").cast("int").alias(key)).join(df, key, "left").fillna(fill)


def singles(jis_map: DataFrame) -> DataFrame:
    """T2: (u, jis) of characters that are one code point."""
    return jis_map.where((F.col("class") != 0) & (F.size("us") == 1)).select(F.col("us")[0].alias("u"), "jis")


def with_secondary(jis_map: DataFrame) -> DataFrame:
    """Rows, and once more those with secondary code points, under these."""
    second = jis_map.where(F.size("sus") > 0).withColumn("us", F.col("sus"))
    return jis_map.unionByName(second)


def pairs(jis_map: DataFrame) -> DataFrame:
    """T3: (u0, u1, jis) of characters that are two code points."""
    return jis_map.where(F.size("us") == 2).select(F.col("us")[0].alias("u0"), F.col("us")[1].alias("u1"), "jis")


def pairs_by_lead(jis_map: DataFrame) -> DataFrame:
    """(u0, list of (u1, jis) in the table's order)."""
    return pairs(jis_map).groupBy("u0").agg(F.transform(F.array_sort(F.collect_list(F.struct("jis", "u1"))), lambda x: F.struct(x["u1"].alias("u1"), x["jis"].alias("jis"))).alias("seconds"))


#: Keys that a window of a scan holds at most.
_BLOCK = 1 << 16


def _bounds(df: DataFrame, key: str) -> tuple[int, int] | None:
    """The least and the largest key, None if there is none; one row for the driver."""
    least, most = df.agg(F.min(F.col(key).cast("long")), F.max(F.col(key).cast("long"))).first()
    return None if least is None else (least, most)


def last_before(df: DataFrame, key: str, value: Column, out: str, inclusive: bool = False, block: int = _BLOCK, bounds: tuple[int, int] | None = None) -> DataFrame:
    """df with ``out``: the last non-null value among the rows with smaller keys,
    over the whole table (``inclusive``: or of the row itself).

    A scan in parallel: rows look in their own block of keys; each block makes
    a row of the next level, which is scanned in blocks of blocks, and so on,
    until a block holds them all.  The number of levels comes from the keys'
    bounds, for which the table is read once more unless they are given.  Keys
    are distinct whole numbers; a row whose key is null finds nothing.  Input
    columns named like ``out``, in any letter case, are replaced.
    """
    least, most = bounds or _bounds(df, key) or (0, 0)
    kept = [c for c in df.columns if c.lower() != out.lower()]
    rows = df.select(F.struct(*kept).alias("row"), F.col(key).cast("long").alias("k"), value.alias("value"))
    return _scanned(rows, least, most, block, inclusive).select("row.*", F.col("found").alias(out))


def _scanned(rows: DataFrame, least: int, most: int, block: int, inclusive: bool) -> DataFrame:
    """rows (k, value) with what is found; keys lie between the bounds."""
    size = F.lit(block).cast("long")
    number = F.call_function("div", F.col("k") - F.pmod(F.col("k"), size), size) - F.lit(least // block).cast("long")
    rows = rows.withColumn("block", number)
    own = Window.partitionBy("block").orderBy("k").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    near = F.when(F.col("k").isNotNull(), F.last("value", ignorenulls=True).over(own))
    last = most // block - least // block
    if last == 0:
        return rows.withColumn("found", near).drop("block")
    blocks = rows.where("block is not null").groupBy(F.col("block").alias("k")).agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("k"))).alias("value"))
    above = _scanned(blocks, 0, last, _BLOCK, False).select(F.col("k").alias("block"), F.col("found").alias("carried"))
    return rows.withColumn("near", near).join(above, "block", "left").withColumn("found", F.coalesce("near", "carried")).drop("block", "near", "carried")


def islands(df: DataFrame, key: str, gap: int, block: int = _BLOCK) -> DataFrame:
    """Runs of numbers with gaps below ``gap``: (first, last, n).

    n counts distinct numbers; nulls are left out; an empty table has no runs.
    Runs are found within blocks of numbers first, so what is scanned over all
    blocks is a row for each run of a block, and no window holds more than a
    block of numbers.
    """
    rows = df.select(F.col(key).cast("long").alias("u")).where("u is not null")
    least, most = _bounds(rows, "u") or (0, 0)
    size = F.lit(block).cast("long")
    rows = rows.distinct().withColumn("b", F.call_function("div", F.col("u") - F.pmod(F.col("u"), size), size))
    own = Window.partitionBy("b").orderBy("u")
    new = F.coalesce((F.col("u") - F.lag("u").over(own) >= gap).cast("int"), F.lit(1))
    runs = rows.withColumn("new", new).withColumn("run", F.sum("new").over(own))
    runs = runs.groupBy("b", "run").agg(F.min("u").alias("u"), F.max("u").alias("last"), F.count("*").alias("n")).drop("b", "run")
    runs = last_before(runs, "u", F.col("last"), "before", block=block, bounds=(least, most))
    first = F.when(F.col("before").isNull() | (F.col("u") - F.col("before") >= gap), F.col("u"))
    runs = last_before(runs, "u", first, "first", inclusive=True, block=block, bounds=(least, most))
    return runs.groupBy("first").agg(F.max("last").alias("last"), F.sum("n").alias("n"))


def range_join(df: DataFrame, point: str, ranges: DataFrame, first: str, last: str, width: int, how: str = "inner") -> DataFrame:
    """df joined with the ranges that hold its points (``first`` to ``last``, both included).

    An equi-join on blocks of ``width`` numbers, in which a range stands once
    for each block that it touches, so only pairs of one block are looked at.
    Ranges may overlap, then a point has a row for each.  Null points and
    ranges with a null or crossed end match nothing.  The two tables' columns
    must have different names.  ``how``: inner, left, left_semi or left_anti.
    """

    def block(c: str) -> Column:
        number = F.col(c).cast("long")
        return F.call_function("div", number - F.pmod(number, F.lit(width).cast("long")), F.lit(width).cast("long"))

    own = ranges.where(F.col(first) <= F.col(last)).withColumn("__block", F.explode(F.sequence(block(first), block(last))))
    found = df.withColumn("__at", block(point)).join(own, (F.col("__at") == F.col("__block")) & F.col(point).between(F.col(first), F.col(last)), how)
    return found.drop("__at", "__block")


def character(code_point: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code_point), 8, "0")), "UTF-32")


def token_forms(tokens: DataFrame, mj_map: DataFrame, mj_shrink: DataFrame, combo: int) -> DataFrame:
    """(token, forms): the candidates of each distinct token (a character, with
    the selector after it if there is one) under a set of schemes.

    mj_map: (mj, ord, v); mj_shrink: (mj, scheme, ord, u).  Rows of the
    character and selector are found by an equi-join; with a selector only the
    first counts.  Their schemes' targets, up to the character itself where
    there is no selector, come before the rows' own forms; each form counts
    where it comes first.  A token without forms is its own.
    """
    code = lambda i: F.ascii(F.substring("token", i, 1))
    number = F.when(code(2).between(0xFE00, 0xFE0F), code(2) - 0xFE00).when(code(2) >= 0xE0100, code(2) - 0xE0100 + 16)
    own = tokens.select("token").where("token is not null").distinct().select("token", code(1).alias("u"), F.coalesce(number, F.lit(-1)).alias("s"))
    variants = mj_map.select("mj", F.col("ord").alias("o"), F.posexplode("v").alias("n", "x"))
    variants = variants.select("mj", "o", "n", F.col("x.u").alias("u"), F.coalesce(F.col("x.s").cast("int"), F.lit(-1)).alias("s"))
    rows = own.join(variants, ["u", "s"]).groupBy("token", "u", "s", "mj").agg(F.min("o").alias("o"))
    first = rows.where("s >= 0").groupBy("token", "u", "s").agg(F.min_by("mj", "o").alias("mj"), F.min("o").alias("o"))
    rows = rows.where("s < 0").unionByName(first)

    some = mj_shrink.where(F.lit(int(combo)).bitwiseAND(F.call_function("shiftleft", F.lit(1), F.col("scheme"))) != 0)
    some = some.select("mj", "scheme", F.col("ord").alias("n"), F.col("u").alias("to"))
    itself = F.when((F.col("s") < 0) & (F.col("to") == F.col("u")), F.col("n"))
    targets = rows.join(some, "mj").withColumn("end", F.min(itself).over(Window.partitionBy("token", "mj", "scheme")))
    place = lambda k, scheme: F.struct(F.lit(k).alias("k"), "o", scheme.cast("int").alias("scheme"), F.col("n").cast("int").alias("n")).alias("place")
    targets = targets.where("end is null or n < end").select("token", "to", place(0, F.col("scheme")))
    kept = rows.select("token", "mj", "o").join(variants.where("s < 0").select("mj", "n", F.col("u").alias("to")), "mj").select("token", "to", place(1, F.lit(0)))
    places = targets.unionByName(kept).groupBy("token", "to").agg(F.min("place").alias("place"))
    forms = places.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("place", "to"))).alias("l"))
    forms = forms.select("token", F.transform("l", lambda x: character(x["to"])).alias("forms"))
    return own.select("token").join(forms, "token", "left").select("token", F.coalesce("forms", F.array("token")).alias("forms"))


def with_choices(df: DataFrame, text: str, mj_map: DataFrame, mj_shrink: DataFrame, combo: int, out: str = "choices") -> DataFrame:
    """df with ``out``: each token's candidates in the text's order, by joins,
    for tables too large to be a literal of the plan.

    Distinct texts are cut into tokens, the distinct tokens looked up once, and
    the texts put together again; Spark broadcasts the forms where they are
    few.  A null text has null, an empty one no tokens.  An input column named
    like ``out`` is replaced.
    """
    texts = df.select(F.col(text).alias("__text")).where("__text is not null").distinct()
    cut = texts.select("__text", F.posexplode(F.regexp_extract_all("__text", F.lit(TOKENS), F.lit(0))).alias("at", "token"))
    found = cut.join(token_forms(cut, mj_map, mj_shrink, combo), "token")
    listed = found.groupBy("__text").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "forms"))), lambda x: x["forms"]).alias(out))
    kept = [c for c in df.columns if c.lower() != out.lower()]
    joined = df.select(*kept).join(listed, F.col(text) == F.col("__text"), "left").drop("__text")
    return joined.withColumn(out, F.when(F.col(text).isNotNull(), F.coalesce(out, F.array().cast("array<array<string>>"))))


def by_code_point(mj_map: DataFrame) -> DataFrame:
    """T5: (u, ord, mj, v), the MJ rows of a code point, each once, in order."""
    own = mj_map.select("mj", "ord", "v", F.explode(F.array_distinct(F.transform("v", lambda x: x["u"]))).alias("u"))
    return own.select("u", "ord", "mj", "v")


def shrinkable(mj_shrink: DataFrame) -> DataFrame:
    """MJ codes with some target."""
    return mj_shrink.select("mj").distinct()


def longest(df: DataFrame, array: str) -> DataFrame:
    """The size of the longest array."""
    return df.agg(F.max(F.size(array)).alias("longest"))


def padded(array: str, size: int, value) -> Column:
    """The array cut or filled to a size."""
    return F.slice(F.concat(F.col(array), F.array_repeat(F.lit(value), size)), 1, size)
