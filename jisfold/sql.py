"""SQL names of the functions.

They are SQL functions whose bodies are the expressions of the column
functions, so a query that calls them stays in the JVM, and options that are
written as constants leave only the part of the body that they ask for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from jisfold import functions as J
from jisfold.constants import ConversionMode
from jisfold.expressions import F, Sql, as_sql
from jisfold.functions import candidates
from jisfold.refdata.tables import JisTable, MjTable

_ENCODED = "STRUCT<value: BINARY, reason: STRING, start: INT, `end`: INT>"
_DECODED = "STRUCT<value: STRING, reason: STRING, start: INT, `end`: INT>"


def _by_mode(make: Callable[[Sql, int], Sql], kind: str) -> Callable[[], Sql]:
    """A body that depends on the option ``mode``; a mode that there is not fails."""

    def body() -> Sql:
        found = F.when(Sql("mode") == int(ConversionMode.SISO), make(Sql("s"), ConversionMode.SISO))
        for mode in list(ConversionMode)[1:]:
            found = found.when(Sql("mode") == int(mode), make(Sql("s"), mode))
        return found.otherwise(F.raise_error(F.concat(F.lit("there is no mode "), F.coalesce(Sql("CAST(mode AS STRING)"), F.lit("NULL")))).cast(kind))

    return body


def _shrunk(jis: JisTable | None) -> Callable[[], Sql]:
    def body() -> Sql:
        s, replacement = Sql("s"), Sql("replacement")
        plain = F.when(replacement == "", J.jnta_shrink_translit(s, "", False, jis)).otherwise(J.jnta_shrink_translit(s, replacement, False, jis))
        return F.when(Sql("passthrough"), J.jnta_shrink_translit(s, passthrough=True, table=jis)).otherwise(plain)

    return body


def _candidates(mj: MjTable | None) -> Callable[[], Sql]:
    def body() -> Sql:
        most = Sql("most")

        def longer(found: Sql, own: Sql) -> Sql:
            every = F.flatten(F.transform(own, lambda last: F.transform(found, lambda first: F.concat(first, last))))
            return F.when(most < 0, every).otherwise(F.slice(every, 1, F.greatest(most, F.lit(0))))

        start = F.when(most == 0, Sql("CAST(array() AS array<string>)")).otherwise(F.array(F.lit("")))
        return F.aggregate(candidates.choices_column(Sql("s"), Sql("combo"), mj), start, longer)

    return body


def definitions(jis: JisTable | None = None, mj: MjTable | None = None) -> dict[str, tuple[str, str, Callable[[], Sql]]]:
    """Parameters, result and body of each SQL function."""
    text, mode, data = "s STRING", "s STRING, mode INT DEFAULT 0", "s BINARY"
    return {
        "jnta_encode": (mode, "BINARY", _by_mode(lambda s, m: J.jnta_encode(s, m, jis), "binary")),
        "try_jnta_encode": (mode, "BINARY", _by_mode(lambda s, m: J.try_jnta_encode(s, m, jis), "binary")),
        "jnta_encode_with_error": (mode, _ENCODED, _by_mode(lambda s, m: J.jnta_encode_with_error(s, m, jis), _ENCODED)),
        "jnta_decode": (data, "STRING", lambda: J.jnta_decode(Sql("s"), jis)),
        "try_jnta_decode": (data, "STRING", lambda: J.try_jnta_decode(Sql("s"), jis)),
        "jnta_decode_with_error": (data, _DECODED, lambda: J.jnta_decode_with_error(Sql("s"), jis)),
        "jnta_shrink_translit": (f"{text}, replacement STRING DEFAULT '�', passthrough BOOLEAN DEFAULT false", "STRING", _shrunk(jis)),
        "try_jnta_shrink_translit": (text, "STRING", lambda: J.try_jnta_shrink_translit(Sql("s"), jis)),
        "mj_shrink_candidates": (f"{text}, combo INT, most INT DEFAULT 100", "ARRAY<STRING>", _candidates(mj)),
        "mj_candidate_count": (f"{text}, combo INT", "BIGINT", lambda: J.mj_candidate_count(Sql("s"), Sql("combo"), mj)),
        "mj_candidate_at": (f"{text}, combo INT, number BIGINT", "STRING", lambda: J.mj_candidate_at(Sql("s"), Sql("combo"), Sql("number"), mj)),
    }


def register(spark: SparkSession, jis: JisTable | None = None, mj: MjTable | None = None) -> None:
    """Registers for SQL the xlsx source and the functions

    - jnta_encode(text [, mode = 0]), try_jnta_encode and jnta_encode_with_error,
    - jnta_decode(bytes), try_jnta_decode and jnta_decode_with_error,
    - jnta_shrink_translit(text [, replacement = U+FFFD [, passthrough = false]])
      and try_jnta_shrink_translit(text),
    - mj_shrink_candidates(text, combo [, limit = 100]), mj_candidate_count(text,
      combo) and mj_candidate_at(text, combo, number).

    The plain forms fail the query at a text that can't be converted, the
    ``try_`` forms give NULL there, the others a struct of value, reason, start
    and end.  Options may be columns; constants make smaller plans.
    """
    from jisfold.sources.xlsx import XlsxDataSource

    for name, (parameters, result, body) in definitions(jis, mj).items():
        with as_sql():
            text = body().text
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN ({text})")
    spark.dataSource.register(XlsxDataSource)
