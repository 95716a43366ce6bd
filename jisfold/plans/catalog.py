"""The registered queries and their DuckDB equivalents.

The SQL has the few table entries that the example texts need as literals and
computes the rest by itself, token by token.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jisfold import functions as J
from jisfold.constants import ConversionMode, MJShrinkSchemeCombo
from jisfold.functions import batches
from jisfold.operators import relational
from jisfold.plans import corpus
from jisfold.refdata import ingest
from jisfold.refdata.tables import seed_jis, seed_mj

C = MJShrinkSchemeCombo
FAMILY_REGISTER = C.MOJ_FAMILY_REGISTER_ACT_RELATED_NOTICE
UNIFICATION = C.JIS_INCORPORATION_UCS_UNIFICATION_RULE
TABLE = seed_jis()
q = corpus.quoted

#: Tokens as SQL finds them: pairs, else single characters.
_PAIRS = "|".join(r.us for r in TABLE.pairs)
_TOKENS = f"regexp_extract_all(s, '({_PAIRS}|(?s:.))')"


def _map(found: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in found.items()) + "}"


def _used() -> list[str]:
    """Tokens of the example texts that the table has."""
    tokens = dict.fromkeys(c for t in corpus.TEXTS for c in [*t, *(t[i : i + 2] for i in range(len(t)))])
    return [t for t in tokens if t in TABLE.by_text]


def _t1() -> str:
    """The table's rows of those tokens: text, number, class, targets as numbers and as text."""
    rows = [(t, TABLE.by_text[t]) for t in _used()]
    return "(VALUES " + ", ".join(f"({q(t)}, {r.jis}, {r.cls}, {list(r.tx_jis)}::INTEGER[], {q(r.tx_us)})" for t, r in rows) + ") t1(x, jis, cls, tx, tx_us)"


def _t4() -> str:
    """The MJ rows: code, place in the table, place among its forms, code point, selector (-1: none)."""
    return "(VALUES " + ", ".join(f"({mj}, {o}, {n}, {u}, {-1 if x is None else x})" for o, (mj, v) in enumerate(seed_mj().variants.items()) for n, (u, x) in enumerate(v)) + ") t4(mj, o, n, u, s)"


def _t6() -> str:
    """The MJ shrink targets: code, scheme, place, code point."""
    return "(VALUES " + ", ".join(f"({mj}, {k}, {n}, {u})" for mj, schemes in seed_mj().shrink.items() for k, us in schemes.items() for n, u in enumerate(us)) + ") t6(mj, scheme, n, u)"


#: The rules of the modes in SQL, over a row of T1.
_SQL_CODE = "printf('%02X%02X', j % 8836 // 94 + 33, j % 94 + 33)"
_SQL_OWN = _SQL_CODE.replace("j %", "jis %")
_SQL_0208 = f"CASE WHEN cls IN (1, 2, 9) THEN {_SQL_OWN} END"
_SQL_RULES = {
    ConversionMode.MEN1: f"CASE WHEN jis < 8836 THEN {_SQL_OWN} END",
    ConversionMode.JISX0208: _SQL_0208,
    ConversionMode.JISX0208_TRANSLIT: f"coalesce({_SQL_0208}, CASE WHEN len(tx) > 0 THEN array_to_string(list_transform(tx, lambda j: {_SQL_CODE}), '') END)",
}


def _sql_map(value: str) -> str:
    """A map from tokens to a value made of their rows of T1, where it is not null."""
    return f"(SELECT map_from_entries(list((x, v))) FROM (SELECT x, {value} AS v FROM {_t1()}) WHERE v IS NOT NULL)"


def _sql_encode(mode: int) -> str:
    return f"""
SELECT c_custkey, s, CASE WHEN len(list_filter(t, lambda x: m[x] IS NULL)) = 0 THEN coalesce(array_to_string(list_transform(t, lambda x: m[x]), ''), '') END AS jis_hex
FROM (SELECT c_custkey, s, {_TOKENS} AS t, {_sql_map(_SQL_RULES[mode])} AS m FROM {corpus.CUSTOMERS})
"""


def _encode(mode: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return corpus.customers(spark, sf_dir).select("c_custkey", "s", F.hex(J.try_jnta_encode("s", mode)).alias("jis_hex"))

    return query


def encode_siso(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.customers(spark, sf_dir).select("c_custkey", "s", F.hex(J.try_jnta_encode("s", ConversionMode.SISO)).alias("jis_hex"))


_SQL_SISO = f"""
WITH t AS (SELECT i, s, {_TOKENS} AS t, {_sql_map(f"(jis // 8836 + 1)::VARCHAR || {_SQL_OWN}")} AS m FROM (VALUES {corpus.values()}) v(i, s)),
p AS (SELECT i, unnest(t) AS x, unnest(range(len(t))) AS n, m FROM t),
c AS (SELECT i, n, m[x] AS c, lag(m[x][1], 1, '1') OVER (PARTITION BY i ORDER BY n) AS was FROM p),
o AS (SELECT i, count(*) FILTER (c IS NULL) AS bad, string_agg((CASE WHEN c[1] = was THEN '' WHEN c[1] = '1' THEN '0E' ELSE '0F' END) || c[2:], '' ORDER BY n)
        || CASE WHEN last(c[1] ORDER BY n) = '2' THEN '0E' ELSE '' END AS h FROM c GROUP BY i)
"""
SISO_SQL = f"{_SQL_SISO} SELECT c_custkey, s, CASE WHEN s = '' THEN '' WHEN bad = 0 THEN h END AS jis_hex FROM {corpus.CUSTOMERS} k LEFT JOIN o ON k.i = o.i"


def encode_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with characters of two code points: bytes, and the text from them."""
    own = corpus.customers(spark, sf_dir).where(F.translate("s", TABLE.seconds, "") != F.col("s")).withColumn("jis", J.try_jnta_encode("s", ConversionMode.MEN1))
    return own.select("c_custkey", "s", F.hex("jis").alias("jis_hex"), J.try_jnta_decode("jis").alias("back"))


PAIRS_SQL = f"SELECT c_custkey, s, jis_hex, CASE WHEN jis_hex IS NOT NULL THEN s END AS back FROM ({_sql_encode(ConversionMode.MEN1)}) WHERE len(translate(s, {q(TABLE.seconds)}, '')) < len(s)"


def encode_error_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that JIS X 0208 can't write: why and where."""
    error = J.jnta_encode_with_error("s", ConversionMode.JISX0208)
    return corpus.customers(spark, sf_dir).withColumn("e", error).where("e.reason is not null").select("c_custkey", "s", "e.reason", F.col("e.start").cast("long").alias("start_pos"), F.col("e.end").cast("long").alias("end_pos"))


ERROR_SQL = f"""
WITH t AS (SELECT c_custkey, s, {_TOKENS} AS t, {_sql_map(_SQL_RULES[ConversionMode.JISX0208])} AS m FROM {corpus.CUSTOMERS}),
b AS (SELECT *, list_position(list_transform(t, lambda x: m[x] IS NULL), true) AS p FROM t)
SELECT c_custkey, s, 'not convertible to JISX0208' AS reason, (len(array_to_string(t[1:p - 1], '')))::BIGINT AS start_pos, (len(array_to_string(t[1:p - 1], '')) + 1)::BIGINT AS end_pos
FROM b WHERE p > 0
"""


def try_encode_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by whether JIS X 0208, plane 1 and shrinking can write them."""
    modes = {"men1": ConversionMode.MEN1, "jisx0208": ConversionMode.JISX0208, "translit": ConversionMode.JISX0208_TRANSLIT}
    found = corpus.customers(spark, sf_dir).select(*[J.try_jnta_encode("s", m).isNotNull().cast("long").alias(n) for n, m in modes.items()])
    return found.groupBy(*modes).agg(F.count("*").alias("n"))


def _sql_can(m: str) -> str:
    return f"(len(list_filter(t, lambda x: {m}[x] IS NULL)) = 0)::BIGINT"


_MAPS = ", ".join(f"{_sql_map(_SQL_RULES[mode])} AS m{int(mode)}" for mode in _SQL_RULES)
UNMAPPED_SQL = f"""
SELECT {_sql_can("m1")} AS men1, {_sql_can("m2")} AS jisx0208, {_sql_can("m3")} AS translit, count(*) AS n
FROM (SELECT {_TOKENS} AS t, {_MAPS} FROM {corpus.CUSTOMERS}) GROUP BY ALL
"""


def fullwidth_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names in full-width form, as JIS bytes and back."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    wide = part.withColumn("wide", F.translate("p_name", corpus.ASCII, corpus.FULL_WIDTH))
    coded = wide.withColumn("jis", J.try_jnta_encode("wide", ConversionMode.JISX0208))
    return coded.select("p_partkey", "wide", F.hex("jis").alias("jis_hex"), (J.try_jnta_decode("jis") == F.col("wide")).cast("long").alias("same"))


_WIDE = {a: TABLE.by_text[w].code.hex().upper() for a, w in zip(corpus.ASCII, corpus.FULL_WIDTH, strict=True) if w in TABLE.by_text and TABLE.is_0208(TABLE.by_text[w])}
FULLWIDTH_SQL = f"""
SELECT p_partkey, translate(p_name, {q(corpus.ASCII)}, {q(corpus.FULL_WIDTH)}) AS wide,
       array_to_string(list_transform(string_split(p_name, ''), lambda c: {_map(_WIDE)}[c]), '') AS jis_hex, 1::BIGINT AS same
FROM part
"""


def fullwidth_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in full-width form: bytes of those that plane 1 can write."""
    wide = F.replace(F.translate("text", corpus.ASCII, corpus.FULL_WIDTH), F.lit("\n"), F.lit(""))
    coded = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", J.try_jnta_encode(wide, ConversionMode.MEN1).alias("jis"))
    return coded.select("doc_id", F.coalesce(F.octet_length("jis"), F.lit(-1)).cast("long").alias("jis_bytes"), F.md5("jis").alias("jis_md5"))


_LATIN = "".join(u for u, r in TABLE.by_text.items() if len(u) == 1 and ord(u) < 0x250 and r.plane == 1)


def _sql_bytes(text: str) -> str:
    """(hex of the text's codes, NULL where some token has none) of a text without
    surrogates: distinct characters are looked up, then put in their places."""
    return f"CASE WHEN len(list_filter(list_distinct(string_split({text}, '')), lambda c: c <> '' AND m[c] IS NULL)) = 0 THEN array_to_string(list_transform(string_split({text}, ''), lambda c: coalesce(m[c], '')), '') END"


_WIDE_ALL = {w: TABLE.by_text[w].code.hex().upper() for w in [*corpus.FULL_WIDTH, *_LATIN] if w in TABLE.by_text and TABLE.by_text[w].plane == 1}
FULLWIDTH_DOCS_SQL = f"""
WITH t AS (SELECT doc_id, replace(translate(text, {q(corpus.ASCII)}, {q(corpus.FULL_WIDTH)}), chr(10), '') AS t, {_map(_WIDE_ALL)} AS m FROM documents),
h AS (SELECT doc_id, {_sql_bytes("t")} AS h FROM t)
SELECT doc_id, coalesce(len(h) // 2, -1)::BIGINT AS jis_bytes, md5(unhex(h)) AS jis_md5 FROM h
"""


def _kanji_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second document without the letters that become characters outside the table."""
    text = F.when(F.col("doc_id") % 2 == 0, F.translate("text", "ez", "xx")).otherwise(F.col("text"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", corpus.kanji(text).alias("s"))


def siso_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in full-width form and kanji, with shifts between the planes."""
    coded = _kanji_documents(spark, sf_dir).select("doc_id", batches.encode_with_error("s", ConversionMode.SISO).alias("e"))
    return coded.select("doc_id", F.md5("e.value").alias("jis_md5"), F.octet_length("e.value").cast("long").alias("n_bytes"), F.col("e.start").cast("long").alias("error_at"))


#: What may stand in the documents' kanji forms: tokens with their codes; shifts stand around runs of plane 2.
_KANJI = [*corpus.FULL_WIDTH, *_LATIN, *(c for c in corpus.LETTERS.values() if len(c) == 1)]
_KANJI_CODES = {c: TABLE.by_text[c].code.hex().upper() for c in _KANJI if c in TABLE.by_text}
_SQL_KANJI_DOCS = f"(SELECT doc_id, {corpus.sql_kanji('text')} AS s FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN translate(text, 'ez', 'xx') ELSE text END AS text FROM documents))"
#: Letters whose characters lie in plane 2, and those outside plane 1.
_SECOND = "".join(c for c in corpus.LETTERS.values() if len(c) == 1 and c in TABLE.by_text and TABLE.by_text[c].plane == 2)
_NOT_FIRST = _SECOND + "".join(c for c in corpus.LETTERS.values() if len(c) == 1 and c not in TABLE.by_text)
#: The pair as one private character.
_JOINED = f"replace(s, {q(corpus.LETTERS['r'])}, chr(983041))"
_PAIR_CODE = TABLE.by_text[corpus.LETTERS["r"]].code.hex().upper()
SISO_DOCS_SQL = f"""
WITH t AS (SELECT doc_id, s, {_JOINED} AS j, {_map(_KANJI_CODES | {chr(983041): _PAIR_CODE, chr(1): "0F", chr(2): "0E"})} AS m FROM {_SQL_KANJI_DOCS}),
b AS (SELECT doc_id, s, m, regexp_replace(j, '([{_SECOND}]+)', chr(1) || '\\1' || chr(2), 'g') AS b,
             list_position(list_transform(string_split(j, ''), lambda c: c <> '' AND m[c] IS NULL), true) AS p, j FROM t),
h AS (SELECT doc_id, CASE WHEN coalesce(p, 0) = 0 THEN array_to_string(list_transform(string_split(b, ''), lambda c: coalesce(m[c], '')), '') END AS h,
             CASE WHEN p > 0 THEN len(replace(j[1:p - 1], chr(983041), 'xx')) END AS error_at FROM b)
SELECT doc_id, md5(unhex(h)) AS jis_md5, (len(h) // 2)::BIGINT AS n_bytes, error_at::BIGINT AS error_at FROM h
"""


def shrink_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in full-width form and kanji: shrunken, with characters outside
    the table replaced and kept."""
    own = _kanji_documents(spark, sf_dir)
    return own.select("doc_id", F.md5(batches.shrink_translit("s")).alias("shrunk_md5"), F.md5(batches.shrink_translit("s", passthrough=True)).alias("kept_md5"))


_SHRUNK = {c: TABLE.shrunk(TABLE.by_text[c]) for c in _KANJI if c in TABLE.by_text}
_SHRUNK_ONE = {c: x for c, x in _SHRUNK.items() if len(x) == 1 and c != x}
_SHRUNK_MORE = {c: x for c, x in _SHRUNK.items() if len(x) > 1}


def _sql_shrunk(text: str) -> str:
    out = f"translate({text}, {q(''.join(_SHRUNK_ONE))}, {q(''.join(_SHRUNK_ONE.values()))})"
    for c, x in _SHRUNK_MORE.items():
        out = f"replace({out}, {q(c)}, {q(x)})"
    return out


SHRINK_DOCS_SQL = f"""
WITH t AS (SELECT doc_id, s, {_JOINED} AS j, {q("".join(sorted(_SHRUNK)))} || chr(983041) AS known FROM {_SQL_KANJI_DOCS}),
u AS (SELECT doc_id, s, array_to_string(list_transform(string_split(j, ''), lambda c: CASE WHEN c = '' OR contains(known, c) THEN c ELSE '�' END), '') AS r FROM t)
SELECT doc_id, md5({_sql_shrunk(f"replace(r, chr(983041), {q(corpus.LETTERS['r'])})")}) AS shrunk_md5, md5({_sql_shrunk("s")}) AS kept_md5 FROM u
"""


def decode_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents from the bytes of those that plane 1 can write: as text, and cut
    after an odd number of bytes, where and why that fails."""
    own = _kanji_documents(spark, sf_dir).select("doc_id", F.translate("s", _NOT_FIRST, "").alias("s"))
    own = own.select("doc_id", batches.encode_with_error("s", ConversionMode.MEN1)["value"].alias("jis")).where("octet_length(jis) > 1")
    cut = batches.decode_with_error(F.substring("jis", F.lit(1), F.octet_length("jis") - 1))
    return own.select("doc_id", F.md5(batches.decode_with_error("jis")["value"]).alias("text_md5"), cut.alias("e")).select("doc_id", "text_md5", F.col("e.reason").alias("reason"), F.col("e.start").cast("long").alias("start_pos"))


DECODE_DOCS_SQL = f"""
WITH t AS (SELECT doc_id, translate(s, {q(_NOT_FIRST)}, '') AS s FROM {_SQL_KANJI_DOCS}),
k AS (SELECT doc_id, s, {_JOINED} AS j FROM t)
SELECT doc_id, md5(s) AS text_md5, 'incomplete multibyte character' AS reason, (2 * len(j) - 2)::BIGINT AS start_pos
FROM k WHERE len(j) > 0 AND len(translate(j, {q("".join(_KANJI_CODES))} || chr(983041), '')) = 0
"""


def decode_plane1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts from their plane-1 bytes."""
    own = corpus.customers(spark, sf_dir).withColumn("jis", J.try_jnta_encode("s", ConversionMode.MEN1)).where("jis is not null")
    return own.select("c_custkey", F.hex("jis").alias("jis_hex"), J.try_jnta_decode("jis").alias("s"))


DECODE_SQL = f"SELECT c_custkey, jis_hex, s FROM ({_sql_encode(ConversionMode.MEN1)}) WHERE jis_hex IS NOT NULL"

BAD_BYTES = [
    ("2124", None, None, None), ("0F2121", "unexpected byte \\x0f", 0, 1), ("21", "incomplete multibyte character", 0, 1), ("2120", "unexpected byte \\x20 after \\x21", 1, 2),
    ("242B2477", None, None, None), ("2124247C2121", "JIS character 1-37-125 does not have a corresponding unicode codepoint", 2, 4), ("21247F21", "unexpected byte \\x7f", 2, 3), ("", None, None, None), ("2F7E", None, None, None), ("21242477217F", "unexpected byte \\x7f after \\x21", 5, 6),
]


def decode_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by good and bad byte sequences: why and where."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey")
    data = spark.createDataFrame([(i, h) for i, (h, *_) in enumerate(BAD_BYTES)], "i int, jis_hex string")
    own = nation.join(F.broadcast(data), F.col("n_nationkey") % len(BAD_BYTES) == F.col("i"))
    own = own.withColumn("e", J.jnta_decode_with_error(F.unhex("jis_hex")))
    return own.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "jis_hex", "e.reason", F.coalesce(F.col("e.start"), F.lit(-1)).cast("long").alias("start_pos"), F.coalesce(F.col("e.end"), F.lit(-1)).cast("long").alias("end_pos"))


DECODE_INVALID_SQL = (
    "SELECT n_nationkey::BIGINT AS n_nationkey, jis_hex, reason::VARCHAR AS reason, start_pos::BIGINT AS start_pos, end_pos::BIGINT AS end_pos FROM nation JOIN (VALUES "
    + ", ".join(f"({i}, {q(h)}, {q(r) if r else 'NULL'}, {a if a is not None else -1}, {b if b is not None else -1})" for i, (h, r, a, b) in enumerate(BAD_BYTES))
    + f") v(i, jis_hex, reason, start_pos, end_pos) ON n_nationkey % {len(BAD_BYTES)} = i"
)


def roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation: customers' texts that come back from plane-1 bytes."""
    own = corpus.customers(spark, sf_dir).withColumn("back", J.try_jnta_decode(J.try_jnta_encode("s", ConversionMode.MEN1)))
    return own.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("back") == F.col("s"), F.lit(False)).cast("long")).alias("n_same"))


ROUNDTRIP_SQL = f"SELECT c_nationkey, count(*) AS n, sum(CASE WHEN jis_hex IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS n_same FROM (SELECT c.c_nationkey, e.jis_hex FROM customer c JOIN ({_sql_encode(ConversionMode.MEN1)}) e USING (c_custkey)) GROUP BY c_nationkey"


def _translit(**options):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return corpus.customers(spark, sf_dir).select("c_custkey", "s", J.jnta_shrink_translit("s", **options).alias("shrunk"))

    return query


def _sql_translit(otherwise: str) -> str:
    shrunk = "CASE WHEN cls IN (3, 4, 11) AND tx_us <> '' THEN tx_us ELSE x END"
    return f"SELECT c_custkey, s, coalesce(array_to_string(list_transform({_TOKENS}, lambda x: coalesce(m[x], {otherwise})), ''), '') AS shrunk FROM (SELECT *, {_sql_map(shrunk)} AS m FROM {corpus.CUSTOMERS})"


def canonical_customer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that meet when shrunk, with the customers of each spelling."""
    own = corpus.customers(spark, sf_dir).groupBy("s").agg(F.count("*").alias("n"))
    own = own.withColumn("canonical", J.jnta_shrink_translit("s", passthrough=True))
    other = own.select("canonical", F.col("s").alias("other"), F.col("n").alias("n_other"))
    return own.join(other, "canonical").where("s < other").select("canonical", "s", "other", "n", "n_other")


CANONICAL_SQL = f"""
WITH g AS (SELECT s, shrunk AS canonical, count(*) AS n FROM ({_sql_translit('x')}) GROUP BY ALL)
SELECT a.canonical, a.s, b.s AS other, a.n, b.n AS n_other FROM g a JOIN g b ON a.canonical = b.canonical AND encode(a.s) < encode(b.s)
"""


def dedupe_by_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per shrunken text: customers, spellings, first customer."""
    own = corpus.customers(spark, sf_dir).withColumn("canonical", J.jnta_shrink_translit("s", passthrough=True))
    return own.groupBy("canonical").agg(F.count("*").alias("n"), F.countDistinct("s").alias("spellings"), F.min("c_custkey").alias("first_custkey"))


DEDUPE_SQL = f"SELECT shrunk AS canonical, count(*) AS n, count(DISTINCT s) AS spellings, min(c_custkey) AS first_custkey FROM ({_sql_translit('x')}) GROUP BY shrunk"


def _candidates(combo: int, limit: int = 100):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = corpus.customers(spark, sf_dir).select("c_custkey", "s")
        found = J.explode_candidates(own, "s", int(combo), limit)
        return found.select("c_custkey", "s", F.col("ord").cast("long").alias("ord"), "candidate")

    return query


def _sql_forms(combo: int) -> str:
    """(x, forms) of the tokens k by the rules: the MJ rows that have the
    form (with a selector, the first one only); their schemes' targets, which
    end where one is the character itself without selector; then the rows' own
    forms without selector; each form once, where it comes first."""
    return f"""
  SELECT x, list(c ORDER BY place) AS forms FROM (
    SELECT x, c, min(place) AS place FROM (
      SELECT k.x, chr(t6.u) AS c, (0, k.o, t6.scheme, t6.n) AS place FROM k JOIN {_t6()} USING (mj)
      WHERE ({int(combo)} >> t6.scheme) & 1 = 1 AND NOT EXISTS (SELECT 1 FROM (SELECT * FROM {_t6()}) e WHERE k.s = -1 AND e.mj = k.mj AND e.scheme = t6.scheme AND e.n <= t6.n AND e.u = k.u)
      UNION ALL SELECT k.x, chr(t4.u), (1, k.o, 0, t4.n) FROM k JOIN {_t4()} USING (mj) WHERE t4.s = -1
    ) GROUP BY x, c) GROUP BY x"""


def _sql_rows(tokens: str) -> str:
    """k(x, u, s, mj, o): tokens with their MJ rows."""
    rows = f"SELECT x, p.u AS u, p.s AS s, mj, min(o) AS o FROM ({tokens}) p JOIN {_t4()} ON t4.u = p.u AND t4.s = p.s GROUP BY x, p.u, p.s, mj"
    return f"SELECT x, u, s, mj, o FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY o) AS k FROM ({rows})) WHERE s = -1 OR k = 1"


#: A token's code point and selector.
_SQL_PARTS = "SELECT x, unicode(x[1]) AS u, CASE WHEN len(x) = 1 THEN -1 WHEN unicode(x[2]) < 917504 THEN unicode(x[2]) - 65024 ELSE unicode(x[2]) - 917744 END AS s"
_SQL_TOKENS = "regexp_extract_all(s, '(?s:.)[\\x{FE00}-\\x{FE0F}\\x{E0100}-\\x{E01EF}]?')"


def _sql_candidates(combo: int, limit: int = 100) -> str:
    """By cross products of the tokens' forms, numbered with the first fastest."""
    tokens = f"{_SQL_PARTS} FROM (SELECT DISTINCT unnest({_SQL_TOKENS}) AS x FROM (VALUES {corpus.values()}) v(i, s))"
    return f"""
WITH RECURSIVE k AS ({_sql_rows(tokens)}), forms AS ({_sql_forms(combo)}),
m AS (SELECT map_from_entries(list((x, forms))) AS m FROM forms), t AS (
  SELECT i, s, list_transform({_SQL_TOKENS}, lambda x: coalesce(m[x], [x])) AS f FROM (VALUES {corpus.values()}) v(i, s), m
), r AS (
  SELECT i, f, 0 AS n, '' AS candidate, 0::BIGINT AS ord, 1::BIGINT AS step FROM t
  UNION ALL
  SELECT r.i, r.f, r.n + 1, r.candidate || r.f[r.n + 1][k.k], r.ord + r.step * (k.k - 1), r.step * len(r.f[r.n + 1])
  FROM r, LATERAL (SELECT unnest(range(1, len(r.f[r.n + 1]) + 1)) AS k) k WHERE r.n < len(r.f)
)
SELECT c_custkey, s, ord, candidate FROM {corpus.CUSTOMERS} c JOIN r ON c.i = r.i AND r.n = len(r.f) WHERE ord < {limit}
"""


def mj_candidates_ivs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of characters with variation selectors 0 to 31, and with none."""
    own = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")
    code = F.when(F.col("s_suppkey") % 33 < 32, J.selector_code_point((F.col("s_suppkey") % 33).cast("int")))
    selector = F.coalesce(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"), F.lit(""))
    text = F.concat(F.when(F.col("s_suppkey") % 2 == 0, F.lit("邉")).otherwise(F.lit("邊")), selector)
    found = own.select("s_suppkey", text.alias("s")).withColumn("c", J.mj_shrink_candidates("s", int(UNIFICATION | FAMILY_REGISTER)))
    return found.select("s_suppkey", "s", F.array_join("c", "|").alias("candidates"))


IVS_SQL = f"""
WITH t AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '邉' ELSE '邊' END || CASE WHEN s_suppkey % 33 < 16 THEN chr((65024 + s_suppkey % 33)::INTEGER) WHEN s_suppkey % 33 < 32 THEN chr((917744 + s_suppkey % 33)::INTEGER) ELSE '' END AS x FROM supplier),
k AS ({_sql_rows(_SQL_PARTS + " FROM (SELECT DISTINCT x FROM t)")}), forms AS ({_sql_forms(UNIFICATION | FAMILY_REGISTER)})
SELECT s_suppkey, x AS s, coalesce(array_to_string(forms, '|'), x) AS candidates FROM t LEFT JOIN forms USING (x)
"""


def mj_candidates_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their nations' names: the candidates numbered 2 to 5 of the
    text, made from their numbers alone, and how many there are."""
    own = corpus.customers(spark, sf_dir)
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    own = own.join(nation, own.c_nationkey == nation.n_nationkey).select("c_custkey", "n_name", "s", J.mj_candidate_count("s", int(C(15))).alias("n"))
    found = J.candidates_between(own, "s", int(C(15)), 1, 6)
    return found.select("c_custkey", "n_name", "s", "n", "ord", "candidate")


NUMBERED_SQL = f"""
WITH c AS ({_sql_candidates(C(15), 1 << 40)})
SELECT c_custkey, n_name, s, count(*) OVER (PARTITION BY c_custkey) AS n, ord, candidate FROM c JOIN customer USING (c_custkey) JOIN nation ON c_nationkey = n_nationkey
QUALIFY ord BETWEEN 1 AND 5
"""


def mj_shrink(spark: SparkSession) -> DataFrame:
    """T6 of the table in use."""
    rows = [(mj, k, n, u) for mj, schemes in seed_mj().shrink.items() for k, us in schemes.items() for n, u in enumerate(us)]
    return spark.createDataFrame(rows, "mj int, scheme int, ord int, u int")


def mj_candidates_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates under all schemes, by joins with the tables."""
    found = relational.with_choices(corpus.customers(spark, sf_dir).select("c_custkey", "s"), "s", mj_map(spark), mj_shrink(spark), int(C(15)))
    forms = F.array_join(F.transform("choices", lambda x: F.array_join(x, "|")), "/")
    return found.select("c_custkey", "s", forms.alias("forms"))


JOINED_SQL = f"""
WITH k AS ({_sql_rows(f"{_SQL_PARTS} FROM (SELECT DISTINCT unnest({_SQL_TOKENS}) AS x FROM (VALUES {corpus.values()}) v(i, s))")}), forms AS ({_sql_forms(C(15))}),
m AS (SELECT map_from_entries(list((x, forms))) AS m FROM forms)
SELECT c_custkey, s, coalesce(array_to_string(list_transform({_SQL_TOKENS}, lambda x: array_to_string(coalesce(m[x], [x]), '|')), '/'), '') AS forms FROM {corpus.CUSTOMERS}, m
"""


def candidate_count_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation: customers and all their candidates."""
    own = corpus.customers(spark, sf_dir).withColumn("k", F.size(J.mj_shrink_candidates("s", int(UNIFICATION | FAMILY_REGISTER))))
    found = own.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("k").alias("candidates"))
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    return found.join(nation, found.c_nationkey == nation.n_nationkey).select("n_name", "n", "candidates")


CANDIDATE_COUNT_SQL = f"""
WITH k AS ({_sql_candidates(UNIFICATION | FAMILY_REGISTER)})
SELECT n_name, count(DISTINCT c_custkey) AS n, count(*) AS candidates FROM k JOIN customer USING (c_custkey) JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
"""


def jis_class_histogram_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: characters of all documents by JIS class.

    One ``translate`` makes each character a private letter of its class; a
    class's characters are counted as what ``replace`` takes away.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text")
    letters = {cls: chr(0xE000 + cls) for cls in sorted({r.cls for r in TABLE.singles()})}
    known = "".join(r.us for r in TABLE.singles())
    classes = F.translate("text", "".join(letters.values()) + known, "x" * len(letters) + "".join(letters[r.cls] for r in TABLE.singles()))
    own = F.transform(F.array(classes), lambda c: F.struct(*[(F.length(c) - F.length(F.replace(c, F.lit(x)))).alias(f"class_{cls}") for cls, x in letters.items()]))[0]
    found = docs.select("lang", F.length("text").alias("chars"), own.alias("n"))
    return found.groupBy("lang").agg(F.sum("chars").alias("chars"), *[F.sum(f"n.class_{cls}").alias(f"class_{cls}") for cls in letters])


_IN_DOCS = {cls: "".join(r.us for r in TABLE.singles() if r.cls == cls and ord(r.us) < 0x2000) for cls in sorted({r.cls for r in TABLE.singles()})}
HISTOGRAM_SQL = (
    "SELECT lang, sum(len(text))::BIGINT AS chars, "
    + ", ".join(f"sum(len(text) - len(translate(text, {q(chars)}, '')))::BIGINT AS class_{cls}" if chars else f"0::BIGINT AS class_{cls}" for cls, chars in _IN_DOCS.items())
    + " FROM documents GROUP BY lang"
)


def class_ranges(spark: SparkSession) -> DataFrame:
    """The table's characters as ranges of code points of one class."""
    out: list[list[int]] = []
    for r in sorted(TABLE.singles(), key=lambda r: r.us):
        if out and out[-1][1] == ord(r.us) - 1 and out[-1][2] == r.cls:
            out[-1][1] += 1
        else:
            out.append([ord(r.us), ord(r.us), r.cls])
    return spark.createDataFrame(out, "first int, last int, class int")


def jis_class_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language and class: characters of all documents, by a join of the
    distinct characters with ranges of code points."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", F.explode(F.split("text", "")).alias("c"))
    own = docs.where("c <> ''").groupBy("lang", F.ascii("c").alias("u")).agg(F.count("*").alias("n"))
    found = relational.range_join(own, "u", class_ranges(spark), "first", "last", 256, "left")
    return found.groupBy("lang", F.coalesce("class", F.lit(0)).cast("long").alias("class")).agg(F.sum("n").alias("n"))


_CLASSES = {c: r.cls for r in TABLE.singles() for c in r.us if ord(c) < 0x2000}
BY_RANGES_SQL = f"""
WITH c AS (SELECT lang, unnest(string_split(text, '')) AS c FROM documents), m AS (SELECT * FROM (VALUES {", ".join(f"({q(c)}, {k})" for c, k in _CLASSES.items())}) m(c, k))
SELECT lang, coalesce(k, 0)::BIGINT AS class, count(*) AS n FROM c LEFT JOIN m USING (c) WHERE c <> '' GROUP BY ALL
"""


def order_key_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the keys of large orders with gaps below 4."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_totalprice > 250000")
    found = relational.islands(orders, "o_orderkey", 4)
    return found.select(F.col("first").alias("first_key"), F.col("last").alias("last_key"), "n")


ORDER_ISLANDS_SQL = """
WITH p AS (SELECT DISTINCT o_orderkey AS u FROM orders WHERE o_totalprice > 250000),
g AS (SELECT u, sum(CASE WHEN u - was < 4 THEN 0 ELSE 1 END) OVER (ORDER BY u) AS k FROM (SELECT u, lag(u) OVER (ORDER BY u) AS was FROM p))
SELECT min(u) AS first_key, max(u) AS last_key, count(*) AS n FROM g GROUP BY k
"""


def men_ku_ten_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed numbers of men-ku-ten texts made of the orders' keys, and back."""
    key = F.col("o_orderkey")
    text = F.concat_ws("-", (key % 3 + 1).cast("string"), (key % 97).cast("string"), (key % 95).cast("string"))
    own = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", text.alias("t"))
    own = own.withColumn("jis", J.parse_men_ku_ten("t"))
    return own.select("o_orderkey", "t", F.coalesce("jis", F.lit(-1)).cast("long").alias("jis"), F.when(F.col("jis").isNotNull(), J.men_ku_ten("jis")).alias("back"))


MEN_KU_TEN_SQL = """
WITH p AS (SELECT o_orderkey, o_orderkey % 3 + 1 AS m, o_orderkey % 97 AS k, o_orderkey % 95 AS t FROM orders)
SELECT o_orderkey, concat_ws('-', m, k, t) AS t,
       CASE WHEN m <= 2 AND k BETWEEN 1 AND 94 AND t BETWEEN 1 AND 94 THEN (m - 1) * 8836 + (k - 1) * 94 + t - 1 ELSE -1 END::BIGINT AS jis,
       CASE WHEN m <= 2 AND k BETWEEN 1 AND 94 AND t BETWEEN 1 AND 94 THEN concat_ws('-', m, k, t) END AS back
FROM p
"""


def uni_seq_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code points of sequences written as U+XXXX, and variation selectors among them."""
    own = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")
    u = F.when(F.col("s_suppkey") % 4 == 1, F.col("s_suppkey") % 24 + 65020).when(F.col("s_suppkey") % 4 == 2, F.col("s_suppkey") % 256 + 917752).otherwise(F.col("s_suppkey") * 977 % 917999)
    own = own.withColumn("t", F.concat(F.lit("U+"), F.hex(u), F.lit("  u+"), F.lower(F.hex(u + 240))))
    found = own.withColumn("a", J.parse_code_points("t"))
    vs = J.selector_number(F.col("a")[0])
    return found.select("s_suppkey", "t", F.col("a")[0].cast("long").alias("first"), F.col("a")[1].cast("long").alias("second"), F.coalesce(vs, F.lit(-1)).cast("long").alias("selector"), F.coalesce(J.selector_code_point(vs), F.lit(-1)).cast("long").alias("back"))


UNI_SEQ_SQL = """
WITH s AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 1 THEN s_suppkey % 24 + 65020 WHEN 2 THEN s_suppkey % 256 + 917752 ELSE s_suppkey * 977 % 917999 END AS u FROM supplier),
v AS (SELECT *, CASE WHEN u BETWEEN 65024 AND 65039 THEN u - 65024 WHEN u BETWEEN 917760 AND 917999 THEN u - 917760 + 16 END AS n FROM s)
SELECT s_suppkey, 'U+' || upper(to_hex(u)) || '  u+' || lower(to_hex(u + 240)) AS t, u::BIGINT AS first, (u + 240)::BIGINT AS second,
       coalesce(n, -1)::BIGINT AS selector, (CASE WHEN n IS NOT NULL THEN u ELSE -1 END)::BIGINT AS back
FROM v
"""


def jis_map(spark: SparkSession) -> DataFrame:
    """T1 of the table in use."""
    rows = [(r.jis, list(map(ord, r.us)), list(map(ord, r.sus)), r.cls, list(r.tx_jis), list(map(ord, r.tx_us))) for r in TABLE.rows.values()]
    return spark.createDataFrame(rows, "jis int, us array<int>, sus array<int>, class int, tx_jis array<int>, tx_us array<int>")


def mj_map(spark: SparkSession) -> DataFrame:
    """T4 of the table in use."""
    return spark.createDataFrame([(mj, i, v) for i, (mj, v) in enumerate(seed_mj().variants.items())], "mj int, ord int, v array<struct<u:int,s:smallint>>")


def _characters(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """The code points of a column's texts, with the given columns."""
    return df.select(*keys, F.explode(F.split(text, "")).alias("c")).where("c <> ''").select(*keys, F.ascii("c").alias("u"))


def _document_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, n): the documents' code points, with partial counts of each task; so
    a task sends a row for each code point, not for each character."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(0x110000, np.int64)
        for batch in batches:
            for text in batch.column(0):
                some = np.frombuffer((text.as_py() or "").encode("utf-32-le", "surrogatepass"), "<u4")
                if len(some) < 1 << 16:  # sorted sooner than counted
                    u, k = np.unique(some, return_counts=True)
                    n[u] += k
                else:
                    n += np.bincount(some, minlength=len(n))
        u = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int32()), pa.array(n[u])], names=["u", "n"])

    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").mapInArrow(run, "u int, n long")


def _customer_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _characters(corpus.customers(spark, sf_dir), "s", "c_custkey").distinct()


_SQL_DOC_CHARS = "(SELECT unicode(x) AS u FROM (SELECT unnest(string_split(text, '')) AS x FROM documents) WHERE x <> '')"
_SQL_CUSTOMER_CHARS = f"(SELECT DISTINCT c_custkey, unicode(x) AS u FROM (SELECT c_custkey, unnest(string_split(s, '')) AS x FROM {corpus.CUSTOMERS}) WHERE x <> '')"


def _kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder, for what reads it more than once."""
    path = f"{_shared(df.sparkSession)}/kept"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def refdata_densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All slots of the JIS table with their classes and how often the documents
    have their characters; free slots are reserved."""
    t1 = jis_map(spark)
    counts = _document_characters(spark, sf_dir).groupBy("u").agg(F.sum("n").alias("n"))
    counts = relational.singles(t1).join(counts, "u").select("jis", "n")
    found = relational.densify(t1.select("jis", "class").join(counts, "jis", "left"), "jis", {"class": 0, "n": 0})
    return found.select(F.col("jis").cast("long").alias("jis"), F.col("class").cast("long").alias("class"), "n")


def _runs() -> list[tuple[int, int, int]]:
    out: list[list[int]] = []
    for jis in sorted(TABLE.rows):
        cls = TABLE.rows[jis].cls
        if out and out[-1][1] == jis - 1 and out[-1][2] == cls:
            out[-1][1] = jis
        else:
            out.append([jis, jis, cls])
    return [tuple(x) for x in out]


_DOC_CODES = ", ".join(f"({ord(r.us)}, {r.jis})" for r in TABLE.singles() if ord(r.us) < 0x2000)
DENSIFY_SQL = f"""
WITH c AS (SELECT u, count(*) AS n FROM {_SQL_DOC_CHARS} GROUP BY u), n AS (SELECT j, n FROM c JOIN (VALUES {_DOC_CODES}) k(u, j) USING (u))
SELECT r.i AS jis, coalesce(c, 0)::BIGINT AS class, coalesce(n.n, 0)::BIGINT AS n
FROM range(17672) r(i) LEFT JOIN (VALUES {", ".join(map(str, _runs()))}) v(a, b, c) ON r.i BETWEEN a AND b LEFT JOIN n ON n.j = r.i
"""


def refdata_gaps_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of those code points of the table that documents and customers'
    texts have, joined over gaps below 256."""
    used = _document_characters(spark, sf_dir).select("u").unionByName(_characters(corpus.customers(spark, sf_dir), "s"))
    found = relational.islands(_kept(relational.singles(jis_map(spark)).select("u").join(used.distinct(), "u", "left_semi")), "u", 256)
    return found.select(F.col("first").alias("first_u"), F.col("last").alias("last_u"), "n")


def _points() -> str:
    """The table's code points as ranges without gaps."""
    out: list[list[int]] = []
    for u in sorted(ord(r.us) for r in TABLE.singles()):
        if out and out[-1][1] == u - 1:
            out[-1][1] = u
        else:
            out.append([u, u])
    return ", ".join(f"({a}, {b})" for a, b in out)


ISLANDS_SQL = f"""
WITH p AS (SELECT u FROM (SELECT unnest(range(a, b + 1)) AS u FROM (VALUES {_points()}) v(a, b)) WHERE u IN (SELECT u FROM {_SQL_DOC_CHARS} UNION SELECT u FROM {_SQL_CUSTOMER_CHARS})),
g AS (SELECT u, sum(CASE WHEN u - was < 256 THEN 0 ELSE 1 END) OVER (ORDER BY u) AS k FROM (SELECT u, lag(u) OVER (ORDER BY u) AS was FROM p))
SELECT min(u) AS first_u, max(u) AS last_u, count(*) AS n FROM g GROUP BY k
"""


def refdata_reverse_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair leads that customers' texts have: their second characters, in the
    table's order, and the number of customers."""
    found = relational.pairs_by_lead(jis_map(spark))
    listed = F.array_join(F.transform("seconds", lambda x: F.concat_ws(":", x["u1"].cast("string"), x["jis"].cast("string"))), ",")
    used = _customer_characters(spark, sf_dir).groupBy(F.col("u").alias("u0")).agg(F.count("*").alias("customers"))
    return found.join(used, "u0").select(F.col("u0").cast("long").alias("u0"), listed.alias("seconds"), "customers")


REVERSE_SQL = f"""
WITH p AS (SELECT a::BIGINT AS u0, string_agg(b || ':' || j, ',' ORDER BY j) AS seconds FROM (VALUES {", ".join(f"({ord(r.us[0])}, {ord(r.us[1])}, {r.jis})" for r in TABLE.pairs)}) v(a, b, j) GROUP BY a)
SELECT u0, seconds, count(*) AS customers FROM p JOIN {_SQL_CUSTOMER_CHARS} c ON c.u = u0 GROUP BY ALL
"""


def refdata_u_to_mj(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MJ codes of each code point of customers' texts, each once, in order."""
    rows = relational.by_code_point(mj_map(spark)).join(_customer_characters(spark, sf_dir), "u", "left_semi")
    found = rows.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("ord", "mj"))).alias("l"))
    return found.select(F.col("u").cast("long").alias("u"), F.array_join(F.transform("l", lambda x: x["mj"].cast("string")), ",").alias("mjs"))


U_TO_MJ_SQL = f"""
SELECT u::BIGINT AS u, string_agg(mj, ',' ORDER BY o) AS mjs FROM (SELECT DISTINCT u, o, mj FROM {_t4()})
WHERE u IN (SELECT u FROM {_SQL_CUSTOMER_CHARS}) GROUP BY u
"""


def _shared(spark: SparkSession) -> str:
    """A new folder under the one that all executors share."""
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        import tempfile

        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp()
    return f"{folder}/{uuid.uuid4().hex}"


def _write(spark: SparkSession, name: str, data: bytes) -> str:
    """Puts a small file into the folder that all executors share."""
    from pyarrow import fs

    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{_shared(spark)}/{name}")
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    system, base = fs.FileSystem.from_uri(uri)
    system.create_dir(base.rpartition("/")[0], recursive=True)
    with system.open_output_stream(base) as f:
        f.write(data)
    return uri


def workbook(rows: list[list[str | None]]) -> bytes:
    """A small XLSX workbook with shared strings, for examples and tests."""
    from xml.sax.saxutils import escape

    strings = list(dict.fromkeys(c for row in rows for c in row if c is not None))
    at = {s: i for i, s in enumerate(strings)}
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'

    def name(i: int) -> str:
        return (chr(64 + i // 26) if i >= 26 else "") + chr(65 + i % 26)

    body = "".join(f'<row r="{r}">' + "".join(f'<c r="{name(i)}{r}" t="s"><v>{at[c]}</v></c>' for i, c in enumerate(row) if c is not None) + "</row>" for r, row in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in strings) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def xlsx_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a workbook made of the nations, of which there are a few dozen."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").limit(1000).collect()
    rows = [["key", "name", None, "region"]] + [[str(r.n_nationkey), r.n_name, None, str(r.n_regionkey) if r.n_regionkey else None] for r in nations]
    found = ingest.sheet(spark, _write(spark, "book.xlsx", workbook(rows)))
    return found.select(F.col("row_no").cast("long").alias("row_no"), F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit("-"))), "|").alias("cells"))


XLSX_SQL = """
SELECT 1::BIGINT AS row_no, 'key|name|-|region' AS cells
UNION ALL SELECT row_number() OVER (ORDER BY n_nationkey) + 1, n_nationkey || '|' || n_name || CASE WHEN n_regionkey = 0 THEN '' ELSE '|-|' || n_regionkey END FROM nation
"""


def jis_book(rows: list[dict[int, str]]) -> list[list[str | None]]:
    """The JIS workbook's layout: two rows of headers, then rows by column."""
    return [[x.get(i) for i in range(17)] for x in (ingest.JIS_HEAD_1, ingest.JIS_HEAD_2, *rows)]


JIS_ROWS: list[dict[int, str]] = [
    {0: "1-4-84", 1: "U+3094", 3: "追加非漢字", 4: "1-5-84", 5: "U+30F4"},
    {0: "1-8-33", 1: "U+3251", 3: "追加非漢字", 7: "1-3-18", 8: "1-3-17", 11: "U+FF12", 12: "U+FF11", 16: "類似字形U+2460は本文字に変換する。"},
    {0: "1-4-87", 1: "U+304B U+309A", 3: "追加非漢字"},
    {0: "2-1-1", 1: "U+20089", 3: "JIS4水", 7: "1-16-1", 9: "1-16-2", 11: "U+4E9C"},
    {},
    {0: "1-3-19", 1: "U+FF13", 3: "非漢字"},
]


def _nation_keys(spark: SparkSession, sf_dir: str) -> list[int]:
    """The nations' keys, of which there are a few dozen."""
    return [r.n_nationkey for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey").orderBy("n_nationkey").limit(1000).collect()]


def _nation_row(key: int) -> dict[int, str]:
    """A row of the JIS workbook for a nation, with a target for every second."""
    row = {0: f"1-{key % 94 + 1}-{key * 7 % 94 + 1}", 1: f"U+{0x4E00 + key * 3:X}", 3: "JIS3水" if key % 2 else "追加非漢字"}
    return row | ({4: f"1-{key % 94 + 1}-1", 5: f"u+{0x5000 + key:x}"} if key % 2 else {})


def ingest_jis_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JIS table's rows of a workbook made of the nations and of rows of each
    kind, and once more by their secondary code points, with targets in four places."""
    book = jis_book([*map(_nation_row, _nation_keys(spark, sf_dir)), *JIS_ROWS])
    rows = ingest.jis_rows(ingest.sheet(spark, _write(spark, "jis.xlsx", workbook(book))))
    rows = relational.with_secondary(rows)
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    four = relational.padded("tx_jis", 4, -1)
    return rows.select(F.col("jis").cast("long").alias("jis"), text("us").alias("us"), F.col("class").cast("long").alias("class"), text("tx_us").alias("tx_us"), text(four).alias("tx_jis"))


def _sql_point(x: str) -> str:
    return f"('0x' || {x}[3:])::INTEGER"


def _sql_number(x: str) -> str:
    return f"((split_part({x}, '-', 1)::INTEGER - 1) * 8836 + (split_part({x}, '-', 2)::INTEGER - 1) * 94 + split_part({x}, '-', 3)::INTEGER - 1)"


def _sql_listed(cells: list[str]) -> str:
    """The cells before the first empty one."""
    return f"(SELECT coalesce(list(c ORDER BY n), []) FROM (SELECT c, n, sum(CASE WHEN c = '' THEN 1 ELSE 0 END) OVER (ORDER BY n) AS ended FROM (SELECT unnest([{', '.join(cells)}]) AS c, unnest(range({len(cells)})) AS n)) WHERE ended = 0)"


INGEST_JIS_SQL = f"""
WITH c AS (
  SELECT * FROM (VALUES {", ".join("(" + ", ".join([str(n), *(q(r.get(i, "")) for i in range(17))]) + ")" for n, r in enumerate(JIS_ROWS))}) c(n, {", ".join(f"c{i}" for i in range(17))})
  UNION ALL
  SELECT n_nationkey - 1000, '1-' || (n_nationkey % 94 + 1) || '-' || (n_nationkey * 7 % 94 + 1), 'U+' || upper(to_hex(19968 + n_nationkey * 3)), '', CASE n_nationkey % 2 WHEN 1 THEN 'JIS3水' ELSE '追加非漢字' END,
         CASE n_nationkey % 2 WHEN 1 THEN '1-' || (n_nationkey % 94 + 1) || '-1' ELSE '' END, CASE n_nationkey % 2 WHEN 1 THEN 'U+' || upper(to_hex(20480 + n_nationkey)) ELSE '' END, {", ".join(["''"] * 11)}
  FROM nation
),
k AS (SELECT * FROM c WHERE n < coalesce((SELECT min(n) FROM c WHERE c0 = ''), 1000)),
p AS (
  SELECT {_sql_number("c0")}::BIGINT AS jis, list_transform(string_split(c1, ' '), lambda x: {_sql_point("x")}) AS us, c16,
         CASE c3 {" ".join(f"WHEN {q(k)} THEN {int(v)}" for k, v in ingest.CLASS_LABELS.items())} END::BIGINT AS class,
         CASE WHEN c4 <> '' THEN [c4] ELSE {_sql_listed(["c7", "c8", "c9", "c10"])} END AS t, CASE WHEN c4 <> '' THEN [c5] WHEN c7 <> '' THEN {_sql_listed(["c11", "c12", "c13", "c14"])} ELSE [] END AS u
  FROM k
), b AS (
  SELECT jis, us, class, u, t FROM p
  UNION ALL SELECT jis, [('0x' || regexp_extract(c16, '^類似字形U[+]([0-9A-F]+)は', 1))::INTEGER], class, u, t FROM p WHERE c16 <> ''
)
SELECT jis, array_to_string(us, ',') AS us, class, array_to_string(list_transform(u, lambda x: {_sql_point("x")}), ',') AS tx_us,
       array_to_string(list_concat(list_transform(t, lambda x: {_sql_number("x")}), list_transform(range(4 - len(t)), lambda x: -1)), ',') AS tx_jis
FROM b
"""

#: Rows of a workbook, and what is wrong with them.
BAD_JIS_ROWS: list[tuple[dict[int, str], str | None]] = [
    ({0: "1-3-17", 1: "U+FF11", 3: "漢字"}, "the class is unknown"),
    ({0: "1-95-1", 1: "U+FF11", 3: "非漢字"}, "the men-ku-ten number cannot be read"),
    ({0: "1-3-17", 1: "FF11", 3: "非漢字"}, "the code points cannot be read, or are more than two"),
    ({0: "1-3-17", 1: "U+1 U+2 U+3", 3: "非漢字"}, "the code points cannot be read, or are more than two"),
    ({0: "1-3-17", 1: "U+FF11", 3: "非漢字", 4: "1-3-18"}, "a target has a number but no code point"),
    ({0: "1-3-17", 1: "U+FF11", 3: "非漢字", 4: "1-3", 5: "U+FF12"}, "the target's number cannot be read"),
    ({0: "1-3-17", 1: "U+FF11", 3: "非漢字", 4: "1-3-18", 5: "U+110000"}, "the target's code point cannot be read"),
    ({0: "1-3-17", 1: "U+FF11", 3: "非漢字", 7: "1-3-18"}, "targets have numbers but no code points"),
    ({0: "1-3-17", 1: "U+FF11", 3: "非漢字", 7: "1-3-18", 8: "1-3-19", 11: "U+FF12"}, "targets have more numbers than code points, or fewer"),
    ({0: "1-3-17", 1: "U+FF11", 3: "非漢字", 16: "類似字形U2460は本文字に変換する。"}, "the memo's code point cannot be read"),
    ({0: "1-3-17", 1: "U+FF11", 3: "非漢字", 16: "U2460"}, None),
]


def ingest_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong in a workbook with bad rows and a bad header; every third
    nation's row has a number that there is not."""
    nations = [_nation_row(k) | ({0: f"1-{k}-95"} if k % 3 == 0 else {}) for k in _nation_keys(spark, sf_dir)]
    book = jis_book([*nations, *(r for r, _ in BAD_JIS_ROWS)])
    book[1][3] = "区分"
    found = ingest.jis_problems(ingest.sheet(spark, _write(spark, "bad.xlsx", workbook(book))))
    return found.select(F.col("row_no").cast("long").alias("row_no"), "problem")


INGEST_PROBLEMS_SQL = f"""
SELECT 2::BIGINT AS row_no, 'column 4 is not headed JIS区分' AS problem
UNION ALL SELECT k + 2, 'the men-ku-ten number cannot be read' FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation) WHERE n_nationkey % 3 = 0
UNION ALL SELECT n + (SELECT count(*) FROM nation), p FROM (VALUES {", ".join(f"({n}, {q(p)})" for n, (_, p) in enumerate(BAD_JIS_ROWS, 3) if p)}) v(n, p)
"""

MJ_ROWS: list[list[str | None]] = [
    [None, None, "MJ000002", "U+9089", "U+9089", "9089_E010F", ""],
    [None, None, "MJ000001", "U+908A", None, "908A_E0108;908A_E0109", "908A_FE00"],
    [None, None, None, "U+1"],
    [None, None, "MJ000003", None],
]


def ingest_mj_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The MJ table's variants of a workbook made of the nations and of rows of
    each kind, one a row, with the size of the longest list."""
    point = lambda k: f"{0x4E00 + k:X}"
    nations = [[None, None, f"MJ{k + 1000:06}", f"U+{point(k)}", f"U+{point(2 * k)}" if k % 2 else None, ";".join(f"{point(k)}_E01{16 + i:X}" for i in range(k % 4)), f"{point(k)}_FE0{k % 3}"] for k in _nation_keys(spark, sf_dir)]
    rows = ingest.mj_rows(ingest.sheet(spark, _write(spark, "mj.xlsx", workbook([list(ingest.MJ_HEAD), *nations, *MJ_ROWS]))))
    longest = relational.longest(rows, "v")  # one row
    found = rows.select("mj", F.posexplode("v").alias("place", "x")).join(F.broadcast(longest))
    return found.select(F.col("mj").cast("long").alias("mj"), F.col("place").cast("long").alias("place"), F.col("x.u").cast("long").alias("u"), F.coalesce(F.col("x.s"), F.lit(-1)).cast("long").alias("s"), F.col("longest").cast("long").alias("longest"))


INGEST_MJ_SQL = f"""
WITH c AS (SELECT * FROM (VALUES {", ".join("(" + ", ".join(q((r + [None] * 7)[i] or "") for i in range(2, 7)) + ")" for r in MJ_ROWS)}) c(m, a, b, i, s) WHERE m <> '' AND a <> ''
  UNION ALL SELECT 'MJ' || lpad((n_nationkey + 1000)::VARCHAR, 6, '0'), 'U+' || h, CASE n_nationkey % 2 WHEN 1 THEN 'U+' || upper(to_hex(19968 + 2 * n_nationkey)) ELSE '' END,
         array_to_string(list_transform(range(n_nationkey % 4), lambda i: h || '_E01' || upper(to_hex(16 + i))), ';'), h || '_FE0' || (n_nationkey % 3)
  FROM (SELECT n_nationkey, upper(to_hex(19968 + n_nationkey)) AS h FROM nation)),
v AS (
  SELECT m, a[3:] AS u, '' AS s FROM c UNION SELECT m, b[3:], '' FROM c WHERE b <> ''
  UNION SELECT m, split_part(x, '_', 1), split_part(x, '_', 2) FROM (SELECT m, unnest(string_split(i || ';' || s, ';')) AS x FROM c) WHERE x <> ''
), n AS (SELECT m[3:]::BIGINT AS mj, ('0x' || u)::BIGINT AS u, CASE WHEN s = '' THEN -1 WHEN s < 'F' THEN ('0x' || s)::BIGINT - 917744 ELSE ('0x' || s)::BIGINT - 65024 END AS s FROM v)
SELECT mj, row_number() OVER (PARTITION BY mj ORDER BY u, s) - 1 AS place, u, s, (SELECT max(k) FROM (SELECT count(*) AS k FROM n GROUP BY mj)) AS longest FROM n
"""


def refdata_mj_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of those code points of the MJ table that customers' texts have,
    joined over gaps below 64."""
    used = _characters(corpus.customers(spark, sf_dir), "s").distinct()
    found = relational.islands(_kept(relational.by_code_point(mj_map(spark)).select("u").join(used, "u", "left_semi")), "u", 64)
    return found.select(F.col("first").alias("first_u"), F.col("last").alias("last_u"), "n")


MJ_ISLANDS_SQL = f"""
SELECT min(u) AS first_u, max(u) AS last_u, count(*) AS n FROM (
  SELECT u, sum(CASE WHEN u - was < 64 THEN 0 ELSE 1 END) OVER (ORDER BY u) AS k FROM (
    SELECT u, lag(u) OVER (ORDER BY u) AS was FROM (SELECT DISTINCT u::BIGINT AS u FROM {_t4()} WHERE u IN (SELECT u FROM {_SQL_CUSTOMER_CHARS})))) GROUP BY k
"""


def refdata_shrinkable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All MJ codes up to a number: whether some scheme shrinks them, and the
    customers whose texts have one of their code points."""
    used = relational.by_code_point(mj_map(spark)).join(_customer_characters(spark, sf_dir), "u").groupBy("mj").agg(F.countDistinct("c_custkey").alias("customers"))
    some = relational.shrinkable(mj_shrink(spark)).withColumn("valid", F.lit(1)).join(used, "mj", "full")
    found = relational.densify(some, "mj", {"valid": 0, "customers": 0}, 30_000)
    return found.select(F.col("mj").cast("long").alias("mj"), F.col("valid").cast("long").alias("valid"), "customers")


SHRINKABLE_SQL = f"""
WITH k AS (SELECT mj, count(DISTINCT c_custkey) AS n FROM {_t4()} JOIN {_SQL_CUSTOMER_CHARS} c ON c.u = t4.u GROUP BY mj)
SELECT i AS mj, (i IN (SELECT mj FROM {_t6()}))::BIGINT AS valid, coalesce(k.n, 0)::BIGINT AS customers FROM range(30000) r(i) LEFT JOIN k ON k.mj = i
"""


def mj_json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shrink targets of JSON files that are made of the suppliers, a thousand a file."""
    key = F.col("s_suppkey")
    point = lambda n: F.struct(F.concat(F.lit("U+"), F.hex(n)).alias("UCS"))
    targets = F.array(point(key % 20_000 + 0x4E00), point(key % 300 + 0x3400))
    schemes = [F.when((key % 5 != 0) & (key % 4 == k), targets).alias(label) for k, label in enumerate(ingest.SCHEME_LABELS)]
    entry = F.to_json(F.struct(F.concat(F.lit("MJ"), F.lpad((key + 1).cast("string"), 6, "0")).alias(ingest.MJ_NAME), *schemes))
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select((key - key % 1000).alias("file"), entry.alias("entry"))
    texts = rows.groupBy("file").agg(F.concat(F.lit('{"content":['), F.array_join(F.collect_list("entry"), ","), F.lit("]}")).alias("value"))
    folder = _shared(spark)
    texts.write.partitionBy("file").text(folder)
    return ingest.mj_shrink_rows(spark, folder).select(*[F.col(c).cast("long").alias(c) for c in ("mj", "scheme", "ord", "u")])


MJ_JSON_SQL = """
SELECT s_suppkey + 1 AS mj, s_suppkey % 4 AS scheme, o::BIGINT AS ord, (CASE WHEN o = 0 THEN s_suppkey % 20000 + 19968 ELSE s_suppkey % 300 + 13312 END)::BIGINT AS u
FROM supplier, (VALUES (0), (1)) v(o) WHERE s_suppkey % 5 <> 0
"""


def stream_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' texts as a stream of single characters; what the parts give,
    joined, is the bytes of the whole."""
    from jisfold.streaming.encoder import encode_stream

    own = corpus.customers(spark, sf_dir).where(F.col("i").isin(_STREAMED_PLACES))
    parts = own.select("c_custkey", F.length("s").alias("size"), F.posexplode(F.split("s", "")).alias("seq", "text")).where("text <> ''")
    parts = parts.select(F.col("c_custkey").cast("string").alias("stream_id"), F.col("seq").cast("long").alias("seq"), "text", (F.col("seq") == F.col("size") - 1).alias("final"))
    folder = _shared(spark)
    parts.write.parquet(f"{folder}/parts")
    stream = spark.readStream.schema(parts.schema).parquet(f"{folder}/parts")
    run = encode_stream(stream, ConversionMode.SISO).writeStream.outputMode("append").format("parquet").option("path", f"{folder}/coded").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    found = spark.read.schema("stream_id string, seq long, bytes binary, reason string, start int").parquet(f"{folder}/coded")
    hexes = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.hex("bytes").alias("h")))), lambda x: x["h"])
    return found.groupBy(F.col("stream_id").cast("long").alias("stream_id")).agg(F.array_join(hexes, "").alias("jis_hex"), F.count("reason").alias("errors"))


#: Places of the example texts that can be streamed: those whose characters the table has.
_STREAMED_PLACES = [i for i, t in enumerate(corpus.TEXTS) if t and all(u in TABLE.by_text for u in t if u not in TABLE.seconds)]
STREAM_SQL = f"""
{_SQL_SISO}
SELECT c_custkey AS stream_id, coalesce(h, '') AS jis_hex, bad AS errors FROM {corpus.CUSTOMERS} k JOIN o ON k.i = o.i WHERE k.i IN ({", ".join(map(str, _STREAMED_PLACES))})
"""


def stream_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose turns come in any order, over several micro-batches:
    each one's bytes, with shifts between the planes, put together again."""
    from jisfold.streaming import ordered

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    parts = turns.join(last, "conv_id").select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("seq"), corpus.kanji(F.translate("text", "ez", "xx")).alias("text"), (F.col("turn") == F.col("last")).alias("final"))
    folder = _shared(spark)
    # three micro-batches of as many files as there are cores
    files = spark.sparkContext.defaultParallelism
    parts.repartition(3 * files, F.xxhash64("stream_id", "seq")).write.parquet(f"{folder}/parts")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ordered.ROCKSDB)
    try:
        stream = spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/parts")
        coded = ordered.encode_ordered_stream(stream, ConversionMode.SISO)
        coded.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/coded").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    found = spark.read.schema(ordered.OUT).parquet(f"{folder}/coded")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.hex("bytes").alias("h")))), lambda x: x["h"]), "")
    return found.groupBy(F.col("stream_id").cast("long").alias("conv_id")).agg(F.md5(F.unhex(joined)).alias("jis_md5"), F.count("*").alias("parts"), F.count("reason").alias("errors"))


STREAM_CONVERSATIONS_SQL = f"""
WITH t AS (SELECT conv_id, count(*) AS parts, string_agg(translate(text, 'ez', 'xx'), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
s AS (SELECT conv_id, parts, {corpus.sql_kanji('text')} AS s FROM t),
b AS (SELECT conv_id, parts, regexp_replace({_JOINED}, '([{_SECOND}]+)', chr(1) || '\\1' || chr(2), 'g') AS b, {_map(_KANJI_CODES | {chr(983041): _PAIR_CODE, chr(1): "0F", chr(2): "0E"})} AS m FROM s)
SELECT conv_id, md5(unhex(array_to_string(list_transform(string_split(b, ''), lambda c: coalesce(m[c], '')), ''))) AS jis_md5, parts, 0::BIGINT AS errors FROM b
"""

QUERIES = {
    "encode_pairs": encode_pairs,
    "ingest_jis_rows": ingest_jis_rows,
    "ingest_mj_rows": ingest_mj_rows,
    "ingest_problems": ingest_problems,
    "refdata_mj_islands": refdata_mj_islands,
    "refdata_shrinkable": refdata_shrinkable,
    "mj_candidates_ivs": mj_candidates_ivs,
    "encode_men1": _encode(ConversionMode.MEN1),
    "encode_jisx0208": _encode(ConversionMode.JISX0208),
    "encode_jisx0208_translit": _encode(ConversionMode.JISX0208_TRANSLIT),
    "encode_siso": encode_siso,
    "try_encode_unmapped": try_encode_unmapped,
    "encode_error_position": encode_error_position,
    "fullwidth_part_names": fullwidth_part_names,
    "fullwidth_documents": fullwidth_documents,
    "decode_plane1": decode_plane1,
    "decode_invalid": decode_invalid,
    "roundtrip": roundtrip,
    "translit_default": _translit(),
    "translit_passthrough": _translit(passthrough=True),
    "translit_replacement": _translit(replacement="[?]"),
    "canonical_customer_join": canonical_customer_join,
    "dedupe_by_canonical": dedupe_by_canonical,
    "mj_candidates_exploded": _candidates(FAMILY_REGISTER),
    "mj_candidates_limit": _candidates(UNIFICATION | FAMILY_REGISTER, 1),
    "mj_combo_schemes": _candidates(C(15)),
    "candidate_count_by_nation": candidate_count_by_nation,
    "jis_class_histogram_by_lang": jis_class_histogram_by_lang,
    "men_ku_ten_parse": men_ku_ten_parse,
    "uni_seq_parse": uni_seq_parse,
    "refdata_densify": refdata_densify,
    "refdata_gaps_islands": refdata_gaps_islands,
    "refdata_reverse_pairs": refdata_reverse_pairs,
    "refdata_u_to_mj": refdata_u_to_mj,
    "xlsx_scan": xlsx_scan,
    "mj_json_scan": mj_json_scan,
    "stream_encode": stream_encode,
    "siso_documents": siso_documents,
    "shrink_documents": shrink_documents,
    "decode_documents": decode_documents,
    "mj_candidates_numbered": mj_candidates_numbered,
    "mj_candidates_joined": mj_candidates_joined,
    "jis_class_by_ranges": jis_class_by_ranges,
    "order_key_islands": order_key_islands,
    "stream_conversations": stream_conversations,
}

ORACLES = {
    "encode_pairs": PAIRS_SQL,
    "ingest_jis_rows": INGEST_JIS_SQL,
    "ingest_mj_rows": INGEST_MJ_SQL,
    "ingest_problems": INGEST_PROBLEMS_SQL,
    "refdata_mj_islands": MJ_ISLANDS_SQL,
    "refdata_shrinkable": SHRINKABLE_SQL,
    "mj_candidates_ivs": IVS_SQL,
    "stream_encode": STREAM_SQL,
    "encode_men1": _sql_encode(ConversionMode.MEN1),
    "encode_jisx0208": _sql_encode(ConversionMode.JISX0208),
    "encode_jisx0208_translit": _sql_encode(ConversionMode.JISX0208_TRANSLIT),
    "encode_siso": SISO_SQL,
    "try_encode_unmapped": UNMAPPED_SQL,
    "encode_error_position": ERROR_SQL,
    "fullwidth_part_names": FULLWIDTH_SQL,
    "fullwidth_documents": FULLWIDTH_DOCS_SQL,
    "decode_plane1": DECODE_SQL,
    "decode_invalid": DECODE_INVALID_SQL,
    "roundtrip": ROUNDTRIP_SQL,
    "translit_default": _sql_translit("'�'"),
    "translit_passthrough": _sql_translit("x"),
    "translit_replacement": _sql_translit("'[?]'"),
    "canonical_customer_join": CANONICAL_SQL,
    "dedupe_by_canonical": DEDUPE_SQL,
    "mj_candidates_exploded": _sql_candidates(FAMILY_REGISTER),
    "mj_candidates_limit": _sql_candidates(UNIFICATION | FAMILY_REGISTER, 1),
    "mj_combo_schemes": _sql_candidates(C(15)),
    "candidate_count_by_nation": CANDIDATE_COUNT_SQL,
    "jis_class_histogram_by_lang": HISTOGRAM_SQL,
    "men_ku_ten_parse": MEN_KU_TEN_SQL,
    "uni_seq_parse": UNI_SEQ_SQL,
    "refdata_densify": DENSIFY_SQL,
    "refdata_gaps_islands": ISLANDS_SQL,
    "refdata_reverse_pairs": REVERSE_SQL,
    "refdata_u_to_mj": U_TO_MJ_SQL,
    "xlsx_scan": XLSX_SQL,
    "mj_json_scan": MJ_JSON_SQL,
    "siso_documents": SISO_DOCS_SQL,
    "shrink_documents": SHRINK_DOCS_SQL,
    "decode_documents": DECODE_DOCS_SQL,
    "mj_candidates_numbered": NUMBERED_SQL,
    "mj_candidates_joined": JOINED_SQL,
    "jis_class_by_ranges": BY_RANGES_SQL,
    "order_key_islands": ORDER_ISLANDS_SQL,
    "stream_conversations": STREAM_CONVERSATIONS_SQL,
}
