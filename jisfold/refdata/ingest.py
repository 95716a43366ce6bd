"""Builds the tables T1 to T6 from the official files, as DataFrames.

The files are an XLSX workbook of JIS characters with shrink targets, an XLSX
workbook of MJ characters, and a JSON file of MJ shrink targets; see the
README for where they come from.  Results are small (tens of thousands of
rows) and are written as Parquet by ``build``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jisfold.constants import JisClass
from jisfold.functions import parse_code_point, parse_code_points, parse_hex_list, parse_men_ku_ten, parse_mj, selector_number, take_until_empty
from jisfold.operators import relational
from jisfold.refdata.tables import JisRow, JisTable, MjTable
from jisfold.sources.xlsx import XlsxDataSource

# The class labels of the JIS workbook.
CLASS_LABELS = {
    "非漢字": JisClass.JISX0208_NON_KANJI,
    "追加非漢字": JisClass.JISX0213_NON_KANJI,
    "JIS1水": JisClass.KANJI_LEVEL_1,
    "JIS2水": JisClass.KANJI_LEVEL_2,
    "JIS3水": JisClass.KANJI_LEVEL_3,
    "JIS4水": JisClass.KANJI_LEVEL_4,
}
# The keys of the MJ shrink file's schemes, in the order of their numbers.
SCHEME_LABELS = ("JIS包摂規準・UCS統合規則", "読み・字形による類推", "法務省告示582号別表第四", "法務省戸籍法関連通達・通知")
MJ_NAME = "MJ文字図形名"
# Headers of the JIS workbook by column, its memo's form, and the MJ workbook's headers.
JIS_HEAD_1 = {0: "変換元の文字（JISX0213：1-4水）", 4: "コード変換（1対1変換）", 7: "文字列変換（追加非漢字や、1対ｎの文字変換を行う）", 16: "備考"}
JIS_HEAD_2 = dict(enumerate("面区点コード Unicode 字形 JIS区分 面区点コード Unicode 字形 面区点コード① 面区点コード② 面区点コード③ 面区点コード④ Unicode① Unicode② Unicode③ Unicode④ 字形".split()))
MEMO = "^類似字形([uU][+]?[0-9a-fA-F]+)は本文字に変換する。"
MJ_HEAD = ("図形", "font", MJ_NAME, "対応するUCS", "実装したUCS", "実装したMoji_JohoコレクションIVS", "実装したSVS")


class InvalidFormatError(ValueError):
    """A source file is not laid out as expected."""


def sheet(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(XlsxDataSource)
    return spark.read.format("xlsx").load(path)


def cell(i: int):
    return F.coalesce(F.get("cells", F.lit(i)), F.lit(""))


def _text_cells(first: int, last: int) -> Column:
    """An array of the cells, up to the first empty one."""
    return take_until_empty(F.array(*[cell(i) for i in range(first, last)]))


def _body(rows: DataFrame) -> DataFrame:
    """The JIS workbook's rows below two rows of headers, up to the first without a number."""
    end = rows.where((F.col("row_no") > 2) & (cell(0) == "")).agg(F.min("row_no").alias("end"))  # one row
    return rows.join(F.broadcast(end)).where((F.col("row_no") > 2) & (F.col("end").isNull() | (F.col("row_no") < F.col("end"))))


def _memo() -> Column:
    return F.regexp_extract(cell(16), MEMO, 1)


def jis_rows(rows: DataFrame, labels: dict[str, int] = CLASS_LABELS) -> DataFrame:
    """T1 from the JIS workbook's rows.  A single target is preferred to several.

    Rows that jis_problems names come out with nulls; ``build`` refuses them.
    """
    names = F.create_map(*[F.lit(x) for k, v in labels.items() for x in (k, int(v))])
    found = _body(rows).select(
        parse_men_ku_ten(cell(0)).alias("jis"),
        parse_code_points(cell(1)).alias("us"),
        F.when(_memo() != "", F.array(parse_code_point(_memo()))).otherwise(F.array().cast("array<int>")).alias("sus"),
        F.try_element_at(names, cell(3)).alias("class"),
        F.transform(F.when(cell(4) != "", F.array(cell(4))).otherwise(_text_cells(7, 11)), parse_men_ku_ten).alias("tx_jis"),
        F.transform(F.when(cell(4) != "", F.array(cell(5))).otherwise(F.when(cell(7) != "", _text_cells(11, 15)).otherwise(F.array().cast("array<string>"))), parse_code_point).alias("tx_us"),
    )
    return found.where(F.col("jis").isNotNull())


def _first_problem(rows: DataFrame, tests: list[tuple[Column, str]]) -> DataFrame:
    """(row_no, problem) of the rows that fail a test, by the first one failed."""
    found = F.coalesce(*[F.when(bad, F.lit(text)) for bad, text in tests])
    return rows.select("row_no", found.alias("problem")).where("problem is not null")


def _header_problems(rows: DataFrame, heads: list[dict[int, str]]) -> DataFrame:
    """Rows of headers that are missing or unlike what is expected."""
    expected = rows.sparkSession.range(1, len(heads) + 1).select(F.col("id").cast("int").alias("row_no"))
    missing = expected.join(rows.select(F.col("row_no").cast("int")).where(F.col("row_no") <= len(heads)), "row_no", "left_anti").select("row_no", F.lit("the row is missing").alias("problem"))
    tests = [((F.col("row_no") == n) & (cell(i) != text), f"column {i + 1} is not headed {text}") for n, head in enumerate(heads, 1) for i, text in head.items()]
    return missing.unionByName(_first_problem(rows.where(F.col("row_no") <= len(heads)), tests).select(F.col("row_no").cast("int").alias("row_no"), "problem"))


def _some_null(array: Column) -> Column:
    return F.exists(array, lambda x: x.isNull())


def jis_problems(rows: DataFrame, labels: dict[str, int] = CLASS_LABELS) -> DataFrame:
    """(row_no, problem) of what in the JIS workbook is not as it must be."""
    us, one, several = parse_code_points(cell(1)), cell(4) != "", (cell(4) == "") & (cell(7) != "")
    codes, points = _text_cells(7, 11), _text_cells(11, 15)
    tests = [
        (~cell(3).isin(*labels), "the class is unknown"),
        (parse_men_ku_ten(cell(0)).isNull(), "the men-ku-ten number cannot be read"),
        (_some_null(us) | (F.size(us) > 2), "the code points cannot be read, or are more than two"),
        (one & (cell(5) == ""), "a target has a number but no code point"),
        (one & parse_men_ku_ten(cell(4)).isNull(), "the target's number cannot be read"),
        (one & parse_code_point(cell(5)).isNull(), "the target's code point cannot be read"),
        (several & (cell(11) == ""), "targets have numbers but no code points"),
        (several & _some_null(F.transform(codes, parse_men_ku_ten)), "a target's number cannot be read"),
        (several & _some_null(F.transform(points, parse_code_point)), "a target's code point cannot be read"),
        (several & (F.size(codes) != F.size(points)), "targets have more numbers than code points, or fewer"),
        ((_memo() != "") & parse_code_point(_memo()).isNull(), "the memo's code point cannot be read"),
    ]
    return _header_problems(rows, [JIS_HEAD_1, JIS_HEAD_2]).unionByName(_first_problem(_body(rows), tests).select(F.col("row_no").cast("int").alias("row_no"), "problem"))


def mj_problems(rows: DataFrame) -> DataFrame:
    """(row_no, problem) of what in the MJ workbook is not as it must be."""

    def bad(c: Column) -> Column:
        parts = F.transform(F.split(c, ";"), lambda x: parse_hex_list(F.trim(x)))
        return (c != "") & F.exists(parts, lambda x: (F.size(x) != 2) | x[0].isNull() | selector_number(F.get(x, F.lit(1))).isNull())

    named, used = cell(2) != "", (cell(2) != "") & (cell(3) != "")
    tests = [
        (named & parse_mj(cell(2)).isNull(), "the MJ code cannot be read"),
        (used & parse_code_point(cell(3)).isNull(), "the code point cannot be read"),
        (used & (cell(4) != "") & parse_code_point(cell(4)).isNull(), "the implemented code point cannot be read"),
        (used & bad(cell(5)), "an ideographic variation sequence cannot be read"),
        (used & bad(cell(6)), "a standardised variation sequence cannot be read"),
    ]
    return _header_problems(rows, [dict(enumerate(MJ_HEAD))]).unionByName(_first_problem(rows.where(F.col("row_no") > 1), tests).select(F.col("row_no").cast("int").alias("row_no"), "problem"))


def refuse(problems: DataFrame, name: str) -> None:
    """Raises InvalidFormatError with the first ten problems, if there are any."""
    found = problems.orderBy("row_no").take(11)
    if found:
        listed = "; ".join(f"row {r.row_no}: {r.problem}" for r in found[:10])
        raise InvalidFormatError(f"{name}: {listed}{'; and more' if len(found) > 10 else ''}")


def mj_rows(rows: DataFrame) -> DataFrame:
    """T4 from the MJ workbook's rows: (mj, ord, v) with v the sorted variants."""

    def listed(c):
        pairs = F.filter(F.split(c, ";"), lambda x: F.length(F.trim(x)) > 0)
        return F.transform(pairs, lambda x: F.struct(parse_hex_list(F.trim(x))[0].alias("u"), selector_number(parse_hex_list(F.trim(x))[1]).cast("short").alias("s")))

    alone = lambda c: F.when(c != "", F.array(F.struct(parse_code_point(c).alias("u"), F.lit(None).cast("short").alias("s")))).otherwise(F.array().cast("array<struct<u:int,s:smallint>>"))
    variants = F.array_sort(F.array_distinct(F.concat(alone(cell(3)), alone(cell(4)), listed(cell(5)), listed(cell(6)))))
    rows = rows.where((F.col("row_no") > 1) & (cell(2) != "") & (cell(3) != ""))
    return rows.select(parse_mj(cell(2)).alias("mj"), F.col("row_no").alias("ord"), variants.alias("v")).where(F.col("mj").isNotNull())


def mj_shrink_rows(spark: SparkSession, path: str) -> DataFrame:
    """T6 from the MJ shrink file: (mj, scheme, ord, u)."""
    targets = T.ArrayType(T.StructType([T.StructField("UCS", T.StringType())]))
    entry = T.StructType([T.StructField(MJ_NAME, T.StringType()), *[T.StructField(x, targets) for x in SCHEME_LABELS]])
    entries = spark.read.schema(T.StructType([T.StructField("content", T.ArrayType(entry))])).json(path, multiLine=True).select(F.explode("content").alias("e"))
    schemes = F.array(*[F.struct(F.lit(k).alias("scheme"), F.col(f"e.`{label}`").alias("t")) for k, label in enumerate(SCHEME_LABELS)])
    flat = entries.select(parse_mj(F.col(f"e.`{MJ_NAME}`")).alias("mj"), F.explode(schemes).alias("s"))
    return flat.select("mj", "s.scheme", F.posexplode("s.t").alias("ord", "t")).select("mj", "scheme", "ord", parse_code_point("t.UCS").alias("u")).where(F.col("u").isNotNull())


def frozen_order(shrink: DataFrame) -> DataFrame:
    """T6 with each scheme's targets in the order that Python's sets give them.

    The reference results list a scheme's targets in that order; it is fixed
    here once, so that nothing depends on it later.
    """
    rows = shrink.groupBy("mj", "scheme").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "u"))), lambda x: x["u"]).alias("us")).collect()
    flat = [(r.mj, r.scheme, i, u) for r in rows for i, u in enumerate(set(r.us))]
    return shrink.sparkSession.createDataFrame(flat, "mj int, scheme int, ord int, u int")


def jis_table(rows: DataFrame, use_secondary: bool = False) -> JisTable:
    """The table for the functions; duplicates of a code point are an error."""
    text = lambda us: "".join(map(chr, us or []))
    return JisTable({r.jis: JisRow(r.jis, text(r.us), r["class"], tuple(r.tx_jis or ()), text(r.tx_us), text(r.sus), "official") for r in rows.collect()}, use_secondary)


def mj_table(mj: DataFrame, shrink: DataFrame) -> MjTable:
    variants = {r.mj: [(v.u, v.s) for v in r.v] for r in mj.orderBy("ord").collect()}
    targets: dict[int, dict[int, list[int]]] = {}
    for r in shrink.orderBy("mj", "scheme", "ord").collect():
        targets.setdefault(r.mj, {}).setdefault(r.scheme, []).append(r.u)
    return MjTable(variants, targets)


def build(spark: SparkSession, jis_xlsx: str, mj_xlsx: str, mj_shrink_json: str, dest: str) -> None:
    """Writes T1 to T6 as Parquet tables under dest.  A workbook that is not
    laid out as expected is an InvalidFormatError.

    The tables are written beside dest and take its place together, so a build
    that fails leaves those of the one before.
    """
    jis, mj = sheet(spark, jis_xlsx), sheet(spark, mj_xlsx)
    refuse(jis_problems(jis), jis_xlsx)
    refuse(mj_problems(mj), mj_xlsx)
    t1, t4 = jis_rows(jis), mj_rows(mj)
    jis_table(t1)  # fails if a code point stands for two numbers
    out = {
        "jis_map": t1,
        "u_to_jis": relational.singles(t1),
        "pair_to_jis": relational.pairs(t1),
        "mj_map": t4,
        "u_to_mj": relational.by_code_point(t4),
        "mj_shrink": frozen_order(mj_shrink_rows(spark, mj_shrink_json)),
    }
    new = f"{dest.rstrip('/')}-{uuid.uuid4().hex}"
    for name, df in out.items():
        df.write.parquet(f"{new}/{name}")
    _replace(spark, new, dest.rstrip("/"))


def _replace(spark: SparkSession, new: str, dest: str) -> None:
    """Gives the folder ``new`` the name ``dest``; what had it before goes."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(dest).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = path(f"{new}-before")
    had = system.exists(path(dest))
    if had and not system.rename(path(dest), old):
        raise OSError(f"{dest} could not be moved away")
    done = False
    try:
        done = system.exists(path(new)) and system.rename(path(new), path(dest))
    finally:
        if had and not done:
            system.rename(old, path(dest))
    if not done:
        raise OSError(f"{new} could not be renamed {dest}")
    system.delete(old, True)


def load(spark: SparkSession, dest: str) -> tuple[JisTable, MjTable]:
    """The tables that build() wrote."""
    read = lambda n: spark.read.parquet(f"{dest}/{n}")
    return jis_table(read("jis_map")), mj_table(read("mj_map"), read("mj_shrink"))
