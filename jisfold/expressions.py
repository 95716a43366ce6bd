"""The functions that expressions are built with: Spark's, or SQL text.

``F`` is ``pyspark.sql.functions``; inside ``as_sql`` the same calls give the
text of the expression instead, which becomes the body of a SQL function.  So
the column functions and the SQL names have one definition.
"""

from __future__ import annotations

import contextlib
import inspect
import itertools
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from typing import Any

from pyspark.sql import functions as spark_functions
from pyspark.sql import types as T

_AS_SQL: ContextVar[bool] = ContextVar("as_sql", default=False)
_NUMBERS = itertools.count()


@contextlib.contextmanager
def as_sql() -> Iterator[None]:
    """Calls of F inside the block give SQL text."""
    token = _AS_SQL.set(True)
    try:
        yield
    finally:
        _AS_SQL.reset(token)


def literal(value: Any) -> str:
    """A value as Spark SQL's literal.

    >>> literal("it's"), literal(b"\\xf3"), literal(None), literal(3)
    ("'it\\\\\\\\'s'", "X'F3'", 'NULL', '3')
    """
    if isinstance(value, Sql):
        return value.text
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, bytes):
        return f"X'{value.hex().upper()}'"
    if value is None or isinstance(value, bool):
        return "NULL" if value is None else str(value).upper()
    return str(int(value)) if abs(int(value)) < 1 << 31 else f"{int(value)}L"


class Sql:
    """The text of an expression, with the operators of a column."""

    def __init__(self, text: str, name: str | None = None):
        self.text, self.name = text, name

    def _with(self, sign: str, other: Any) -> Sql:
        return Sql(f"({self.text} {sign} {literal(other)})")

    def __add__(self, other: Any) -> Sql:
        return self._with("+", other)

    def __sub__(self, other: Any) -> Sql:
        return self._with("-", other)

    def __mul__(self, other: Any) -> Sql:
        return self._with("*", other)

    def __truediv__(self, other: Any) -> Sql:
        return self._with("/", other)

    def __mod__(self, other: Any) -> Sql:
        return self._with("%", other)

    def __eq__(self, other: Any) -> Sql:  # type: ignore[override]
        return self._with("=", other)

    def __ne__(self, other: Any) -> Sql:  # type: ignore[override]
        return self._with("<>", other)

    def __lt__(self, other: Any) -> Sql:
        return self._with("<", other)

    def __le__(self, other: Any) -> Sql:
        return self._with("<=", other)

    def __gt__(self, other: Any) -> Sql:
        return self._with(">", other)

    def __ge__(self, other: Any) -> Sql:
        return self._with(">=", other)

    def __and__(self, other: Any) -> Sql:
        return self._with("AND", other)

    def __or__(self, other: Any) -> Sql:
        return self._with("OR", other)

    __hash__ = None  # type: ignore[assignment]

    def __invert__(self) -> Sql:
        return Sql(f"(NOT {self.text})")

    def __getitem__(self, key: int | str) -> Sql:
        return Sql(f"({self.text}).`{key}`" if isinstance(key, str) else f"({self.text})[{key}]")

    def bitwiseAND(self, other: Any) -> Sql:
        return self._with("&", other)

    def isNull(self) -> Sql:
        return Sql(f"({self.text} IS NULL)")

    def isNotNull(self) -> Sql:
        return Sql(f"({self.text} IS NOT NULL)")

    def cast(self, kind: T.DataType | str) -> Sql:
        return Sql(f"CAST({self.text} AS {kind if isinstance(kind, str) else kind.simpleString()})")

    def alias(self, name: str) -> Sql:
        return Sql(self.text, name)


class Case(Sql):
    """CASE WHEN, that may go on."""

    def __init__(self, branches: list[tuple[Sql, Any]]):
        self.branches = branches
        super().__init__(self._ended(""))

    def _ended(self, rest: str) -> str:
        return "CASE " + "".join(f"WHEN {test.text} THEN {literal(value)} " for test, value in self.branches) + f"{rest}END"

    def when(self, test: Sql, value: Any) -> Case:
        return Case([*self.branches, (test, value)])

    def otherwise(self, value: Any) -> Sql:
        return Sql(self._ended(f"ELSE {literal(value)} "))


def _argument(value: Any) -> str:
    """An argument; a Python function is a lambda over new variables."""
    if callable(value):
        names = [f"v{next(_NUMBERS)}" for _ in inspect.signature(value).parameters]
        variables = names[0] if len(names) == 1 else f"({', '.join(names)})"
        return f"{variables} -> {literal(value(*map(Sql, names)))}"
    return literal(value)


class _Functions:
    def __getattr__(self, name: str) -> Callable:
        return getattr(_SqlFunctions if _AS_SQL.get() else spark_functions, name)


class _SqlNames(type):
    def __getattr__(cls, name: str) -> Callable[..., Sql]:
        return lambda *args: Sql(f"{name}({', '.join(map(_argument, args))})")


class _SqlFunctions(metaclass=_SqlNames):
    """Most names are the same in SQL; those that aren't are here."""

    @staticmethod
    def lit(value: Any) -> Sql:
        return Sql(literal(value))

    @staticmethod
    def when(test: Sql, value: Any) -> Case:
        return Case([(test, value)])

    @staticmethod
    def create_map(*args: Any) -> Sql:
        return Sql(f"map({', '.join(map(literal, args))})")

    @staticmethod
    def struct(*args: Sql) -> Sql:
        return Sql(f"named_struct({', '.join(f'{literal(x.name)}, {x.text}' for x in args)})")

    @staticmethod
    def call_function(name: str, *args: Any) -> Sql:
        return args[0]._with("div", args[1]) if name == "div" else Sql(f"{name}({', '.join(map(literal, args))})")


F = _Functions()


def bound(value: Any, make: Callable[[Any], Any]) -> Any:
    """make(value), which evaluates value once however often it is used."""
    return F.transform(F.array(value), make)[0]
