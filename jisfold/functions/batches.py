"""The plain forms over long texts, an Arrow batch at a time.

The same results as ``functions``' expressions, from arrays of code points
(``transducer``): an expression goes over a text once for each step, with a
look-up of a string for each character, which costs microseconds a character
where most texts hold pairs.  No shuffle; texts are taken together up to
``SLICE`` characters (or one longer text), so memory doesn't follow the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from jisfold.constants import ConversionMode, TransliterationError
from jisfold.functions import transducer
from jisfold.functions.kernels import default_table
from jisfold.refdata.tables import JisTable

#: Characters (or bytes) that arrays are made for at a time.
SLICE = 1 << 18
#: Functions are marked as not deterministic so that the optimizer evaluates each once,
#: also where a filter and several results read it.
ENCODED = "value binary, reason string, start int, end int"
DECODED = "value string, reason string, start int, end int"


def _slices(texts: list) -> Iterator[list]:
    first, size = 0, 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > SLICE:
            yield texts[first:i]
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield texts[first:]


def _found(values: pd.Series, run: Callable[[list], list], none: tuple) -> list[tuple]:
    """run's result for each value, ``none`` for null."""
    some = values.notna()
    found = (x for part in _slices(values[some].tolist()) for x in run(part))
    return [next(found) if there else none for there in some]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["value", "reason", "start", "end"], dtype=object).astype({"start": "Int32", "end": "Int32"})


def encode_with_error(c: Column | str, conv_mode: int, table: JisTable | None = None) -> Column:
    """As ``functions.jnta_encode_with_error``."""
    mode = ConversionMode(conv_mode)

    @F.pandas_udf(ENCODED)
    def run(texts: pd.Series) -> pd.DataFrame:
        own = default_table(table)
        return _frame(_found(texts, lambda some: transducer.encode(some, mode, own, False), (None,) * 4))

    return run.asNondeterministic()(c)


def decode_with_error(c: Column | str, table: JisTable | None = None) -> Column:
    """As ``functions.jnta_decode_with_error``."""

    @F.pandas_udf(DECODED)
    def run(datas: pd.Series) -> pd.DataFrame:
        own = default_table(table)
        return _frame(_found(datas, lambda some: transducer.decode(some, own), (None,) * 4))

    return run.asNondeterministic()(c)


def shrink_translit(c: Column | str, replacement: str = "\ufffd", passthrough: bool = False, table: JisTable | None = None) -> Column:
    """As ``functions.jnta_shrink_translit``."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        own = default_table(table)
        found = _found(texts, lambda some: transducer.shrink(some, own, replacement, passthrough, False), (None, None))
        for _, at in found:
            if at is not None:
                raise TransliterationError(f"transliteration failed at position {at}")
        return pd.Series([text for text, _ in found], dtype=object)

    return run.asNondeterministic()(c)
