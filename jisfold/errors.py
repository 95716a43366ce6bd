"""Errors of the plain column forms, with their types.

A plain form fails the job in the JVM with a message that holds, besides its
text, what is wrong and where as JSON.  Inside ``typed_errors`` such a failure
is raised on the driver as what the Python forms raise: UnicodeEncodeError and
UnicodeDecodeError with the object, the position and the reason, and
TransliterationError with the position.  All other errors stay as they are.

    with typed_errors():
        df.select(jnta_encode("name", ConversionMode.JISX0208)).collect()
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator

from pyspark.sql import Column

from jisfold.constants import TransliterationError
from jisfold.expressions import F

_MARK = '{"jisfold":'


def failing(kind: str, reason: Column, start: Column, end: Column | None = None, subject: Column | None = None) -> Column:
    """An expression that fails the job: the reason, the position, and all as JSON.

    subject: the text, or the bytes in hexadecimal, that can't be converted.
    """
    parts = [F.lit(kind).alias("jisfold"), reason.alias("reason"), start.alias("start")]
    parts += [] if end is None else [end.alias("end")]
    parts += [] if subject is None else [subject.alias("subject")]
    return F.raise_error(F.concat(reason, F.lit(" at position "), start.cast("string"), F.lit(" "), F.to_json(F.struct(*parts))))


def typed(error: BaseException, encoding: str = "jis") -> Exception | None:
    """The typed error that a failed job's error stands for, None for any other."""
    at, seen = error, set()
    while at is not None and id(at) not in seen:
        seen.add(id(at))
        text = str(at)
        if _MARK in text:
            found, _ = json.JSONDecoder().raw_decode(text[text.index(_MARK) :])
            if found["jisfold"] == "encode":
                return UnicodeEncodeError(encoding, found["subject"], found["start"], found["end"], found["reason"])
            if found["jisfold"] == "decode":
                return UnicodeDecodeError(encoding, bytes.fromhex(found["subject"]), found["start"], found["end"], found["reason"])
            return TransliterationError(f"{found['reason']} at position {found['start']}")
        at = at.__cause__ or at.__context__
    return None


@contextlib.contextmanager
def typed_errors(encoding: str = "jis") -> Iterator[None]:
    """Raises typed errors for failures of plain forms inside the block."""
    try:
        yield
    except Exception as error:
        found = typed(error, encoding)
        if found is None:
            raise
        raise found from error
