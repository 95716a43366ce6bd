"""Shrink candidates by the MJ tables: in Python for one text, and as columns.

In a column each token (a character, with the selector after it if there is
one) finds its entry without a search: ``translate`` turns the character into
the number of its place in an array of entries, which is a literal.  What an
entry holds doesn't depend on the schemes asked for, so these may differ by
row; they are a filter over the entry's targets.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import islice, product, takewhile

from pyspark.sql import Column

from jisfold.expressions import F, bound
from jisfold.refdata.tables import MjTable, seed_mj


def selector_number(c: str) -> int | None:
    """The number of a variation selector, null for other characters.

    >>> selector_number("\\ufe00"), selector_number("\\U000e0100"), selector_number("a")
    (0, 16, None)
    """
    u = ord(c)
    return u - 0xFE00 if 0xFE00 <= u <= 0xFE0F else u - 0xE0100 + 16 if 0xE0100 <= u <= 0xE01EF else None


def tokens(text: str) -> list[tuple[str, int | None]]:
    """Characters, each with the selector that follows it."""
    found: list[tuple[str, int | None]] = []
    i = 0
    while i < len(text):
        s = selector_number(text[i + 1]) if i + 1 < len(text) else None
        found.append((text[i : i + 1 + (s is not None)], s))
        i += 1 + (s is not None)
    return found


def of_token(token: str, selector: int | None, combo: int, table: MjTable) -> list[str]:
    """A character's candidates: shrunken forms by scheme, then its own forms."""
    shrunk, own = entry(ord(token[0]), selector, table)
    return list(dict.fromkeys([*(form for bit, form in shrunk if bit & combo), *own])) or [token]


def entry(u: int, selector: int | None, table: MjTable) -> tuple[list[tuple[int, str]], list[str]]:
    """The shrunken forms of a character, in order, each with its scheme's flag,
    and the own forms of the rows that have it.  With a selector only the
    first row counts; without one a scheme's targets end where one is the
    character itself."""
    codes = [mj for mj in table.by_code_point.get(u, []) if (u, selector) in table.variants[mj]]
    codes = codes if selector is None else codes[:1]
    shrunk = [
        (1 << scheme, chr(target))
        for mj in codes
        for scheme, targets in sorted(table.shrink.get(mj, {}).items())
        for target in takewhile(lambda t: t != u or selector is not None, targets)
    ]
    return shrunk, [chr(own) for mj in codes for own, s in table.variants[mj] if s is None]


def choices(text: str, combo: int, table: MjTable | None = None) -> list[list[str]]:
    """Each character's candidates, in the text's order."""
    table = table or seed_mj()
    return [of_token(t, s, combo, table) for t, s in tokens(text)]


def mj_shrink_candidates(text: str, combo: int, limit: int = 100, table: MjTable | None = None) -> list[str]:
    """At most ``limit`` forms of a text (negative: all, which may be very many);
    the first character's candidates alternate fastest."""
    backwards = product(*reversed(choices(text, combo, table)))
    return ["".join(reversed(x)) for x in islice(backwards, None if limit < 0 else limit)]


#: Characters with the selector that follows them.
TOKENS = r"(?s:.)[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]?"
_FORMS = "shrunk:array<struct<bit:int,form:string>>,own:array<string>"
_ENTRIES = f"array<struct<alone:struct<{_FORMS}>,selected:array<struct<token:string,{_FORMS}>>>>"
#: Characters that stand for the places in the array of entries.
_PLACES = 0x100000
_MOST = (1 << 63) - 1


@lru_cache(maxsize=16)
def _entries(table: MjTable) -> tuple[str, str, str]:
    """(characters that have entries, the characters of their places, the entries as JSON)."""

    def forms(u: int, s: int | None) -> dict:
        shrunk, own = entry(u, s, table)
        return {"shrunk": [{"bit": bit, "form": form} for bit, form in dict.fromkeys(shrunk)], "own": list(dict.fromkeys(own))}

    selectors: dict[int, set[int]] = {}
    for variants in table.variants.values():
        for u, s in variants:
            selectors.setdefault(u, set()).update(() if s is None else (s,))
    known = sorted(selectors)
    if known and known[-1] >= _PLACES:
        raise ValueError("a table has no private characters")
    listed = [{"alone": forms(u, None), "selected": [{"token": chr(u) + selector_character(s), **forms(u, s)} for s in sorted(selectors[u])]} for u in known]
    return "".join(map(chr, known)), "".join(chr(_PLACES + i) for i in range(len(known))), json.dumps(listed)


def selector_character(number: int) -> str:
    """The inverse of selector_number.

    >>> selector_character(0), selector_character(16)
    ('\\ufe00', '\\U000e0100')
    """
    return chr(0xFE00 + number if number < 16 else 0xE0100 + number - 16)


def choices_column(text: Column, combo: Column | int, table: MjTable | None = None) -> Column:
    """array<array<string>>: each token's candidates, as ``choices`` gives them."""
    known, places, listed = _entries(table or seed_mj())
    combo = F.lit(int(combo)) if isinstance(combo, int) else combo
    # the optimizer makes an array of it, once
    entries = F.from_json(F.lit(listed), _ENTRIES)

    def of(token: Column) -> Column:
        def forms(own: Column) -> Column:
            shrunk = F.transform(F.filter(own["shrunk"], lambda x: x["bit"].bitwiseAND(combo) != 0), lambda x: x["form"])
            found = F.array_distinct(F.concat(shrunk, own["own"]))
            return bound(found, lambda some: F.when(F.size(some) > 0, some).otherwise(F.array(token)))

        def in_entry(found: Column) -> Column:
            selected = F.get(F.filter(found["selected"], lambda x: x["token"] == token), F.lit(0))
            return F.when(F.length(token) == 1, bound(found["alone"], forms)).otherwise(bound(selected, forms))

        first = F.substring(token, 1, 1)
        place = lambda x: F.when(x == first, F.array(token)).otherwise(bound(F.get(entries, F.ascii(x) - _PLACES), in_entry))
        return bound(F.translate(first, known, places), place)

    return F.transform(F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0)), of)


def count_column(choices: Column) -> Column:
    """How many texts the choices make, at most 2**63 - 1."""
    return F.aggregate(choices, F.lit(1).cast("long"), lambda n, own: F.when(n > F.call_function("div", F.lit(_MOST), F.size(own).cast("long")), F.lit(_MOST)).otherwise(n * F.size(own)))


def at_column(choices: Column, number: Column) -> Column:
    """The text of a number, straight from its digits: the first token's choices
    are the lowest digit.  NULL for numbers below 0 or without a text."""

    def step(state: Column, own: Column) -> Column:
        size = F.size(own).cast("long")
        return F.struct(F.call_function("div", state["rest"], size).alias("rest"), F.concat(state["text"], F.get(own, (state["rest"] % size).cast("int"))).alias("text"))

    start = F.struct(number.cast("long").alias("rest"), F.lit("").alias("text"))
    return F.when(number >= 0, F.aggregate(choices, start, step, lambda state: F.when(state["rest"] == 0, state["text"])))
