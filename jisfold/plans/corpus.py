"""Japanese example texts for the sample queries, whose tables have none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXTS = [
    "，", "ゔゕゖ", "㉑", "繫", "ジャンクロードヴァンダム", "𠂉", "麴町", "髙島屋", "高島屋", "﨑", "棃",
    "か゚", "かか゚", "か゚か゚山", "˥˩˥", "山か", "か", "か゚山", "一丁目", "漢字かな交じり文", "株式会社", "東京都千代田区",
    "邉", "邊", "邉󠄏", "邉󠄂", "斎󠄂", "㐐", "セ゚ト", "✋", "Aか", "", "く゚け゚こ゚", "繫繫繋", "山﨑棃麴", "ツ゚ト゚", "ㇷ゚", "゚", "麹町", "山崎梨麹",
]

#: ASCII and the full-width forms of it.
ASCII = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
FULL_WIDTH = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "　"


def texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, s string")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with one of the texts; the few texts go to all tasks."""
    own = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    return own.join(F.broadcast(texts(spark)), (F.col("c_custkey") % len(TEXTS)).cast("int") == F.col("i"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(texts: list[str] = TEXTS) -> str:
    """The texts as DuckDB's VALUES."""
    return ", ".join(f"({i}, {quoted(t)})" for i, t in enumerate(texts))


CUSTOMERS = f"(SELECT c_custkey, c_nationkey, i, s FROM customer JOIN (VALUES {values()}) v(i, s) ON c_custkey % {len(TEXTS)} = i)"

#: Letters of the documents for which kanji and kana of all classes stand: rare ones with shrunken forms, ones of plane 2, pairs, and some outside the table.
LETTERS = {"a": "麴", "e": "髙", "i": "﨑", "o": "㉑", "u": "棃", "n": "𠂉", "r": "か゚", "s": "高", "t": "邉", "z": "✋", "é": "繫", "q": "か"}


def kanji(text):
    """The text in full-width form, with kanji for its letters; line feeds go."""
    one = {k: v for k, v in LETTERS.items() if len(v) == 1}
    wide = [c for c in ASCII if c not in one and c != "r"]
    found = F.translate(text, "".join([*one, *wide, "\n"]), "".join([*one.values(), *(FULL_WIDTH[ASCII.index(c)] for c in wide)]))
    return F.replace(found, F.lit("r"), F.lit(LETTERS["r"]))


def sql_kanji(text: str) -> str:
    """The same in SQL."""
    one = {k: v for k, v in LETTERS.items() if len(v) == 1}
    ascii_only = "".join(c for c in ASCII if c not in one and c != "r")
    wide = "".join(FULL_WIDTH[ASCII.index(c)] for c in ascii_only)
    return f"replace(translate({text}, {quoted(''.join(one) + ascii_only + chr(10))}, {quoted(''.join(one.values()) + wide)}), 'r', {quoted(LETTERS['r'])})"
