"""Column expressions for encoding, decoding and shrinking.

All of them are built from Catalyst's string functions, with the character
tables as literals: one character to one code is ``translate``, and since all
two-byte codes are valid UTF-16 units outside the surrogates, writing bytes is
``encode(..., 'UTF-16BE')``.  Pairs of characters that share a code become one
private character first; rows without a pair's second character skip that.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column

from jisfold.constants import ConversionMode
from jisfold.expressions import F, bound
from jisfold.refdata.tables import JisRow, JisTable, seed_jis

#: Private characters: a mark before a pair, and the pairs themselves.
_MARK, _PAIR = "\U000f0000", 0xF0001
#: How the UTF-8 of all of them begins, and how many there are.
_PRIVATE_BYTES, _MOST_PRIVATE = b"\xf3\xb0", 0xFFF
#: Codes of plane 2, as long as the text is no bytes yet, and how the UTF-8 of all of them begins.
_PLANE_2, _PLANE_2_BYTE = 0x100000, b"\xf4"
#: Characters whose two bytes are a shift code twice.
_SHIFT_2, _SHIFT_1 = "\u0f0f", "\u0e0e"
#: ASCII letters, none of which any table encodes, for masks.
_GOOD, _BAD = "P", "B"


def pair_pattern(table: JisTable) -> str:
    """Pairs as an alternation; none begins another, so order doesn't matter."""
    return "(" + "|".join(re.escape(r.us) for r in table.pairs) + ")"


def _has_second(text: Column, table: JisTable) -> Column:
    """Whether the text has some pair's second character: few, sought as bytes."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in table.seconds])


def _guarded(text: Column, table: JisTable, make) -> Column:
    """make(text), for rows that hold some pair's second character."""
    if not table.pairs:
        return text
    return F.when(_has_second(text, table), make(text)).otherwise(text)


def _pairs_to(text: Column, table: JisTable, to) -> Column:
    """Pairs, from left to right, replaced by to(row).  All are marked at once;
    then only those that the text has are replaced."""

    def make(own: Column) -> Column:
        names = F.create_map(*[F.lit(x) for row in table.pairs for x in (row.us, to(row))])
        found = F.array_distinct(F.regexp_extract_all(own, F.lit(pair_pattern(table)), F.lit(1)))
        marked = F.regexp_replace(own, pair_pattern(table), _MARK + "$1")
        return F.aggregate(found, marked, lambda joined, pair: F.replace(joined, F.concat(F.lit(_MARK), pair), F.element_at(names, pair)))

    return _guarded(text, table, make)


def _expanded(text: Column, forms: list[str]) -> Column:
    """Private characters from _PAIR on, replaced by their forms; only those that
    the text has are looked at, and rows without any not at all."""
    if not forms:
        return text
    if len(forms) > _MOST_PRIVATE:
        raise ValueError(f"more than {_MOST_PRIVATE} texts of several characters")
    listed = F.split(F.lit("\x01".join(forms)), "\x01")  # the optimizer splits it, once
    range_of = f"[{chr(_PAIR)}-{chr(_PAIR + len(forms) - 1)}]"

    def of(own: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(own, F.lit(range_of), F.lit(0)))
        whole = F.aggregate(found, own, lambda now, x: F.replace(now, x, F.get(listed, F.ascii(x) - _PAIR)))
        return F.when(F.contains(own.cast("binary"), F.lit(_PRIVATE_BYTES)), whole).otherwise(own)

    return bound(text, of)


def _private(table: JisTable) -> dict[int, str]:
    return {r.jis: chr(_PAIR + i) for i, r in enumerate(table.pairs)}


def _as_code(row: JisRow) -> str:
    return row.code.decode("utf-16-be")


@lru_cache(maxsize=16)
def _codes(mode: int, table: JisTable) -> dict[str, str]:
    """Texts (one or two characters) to the codes that a mode writes, as UTF-16
    units; with shift codes, those of plane 2 as private characters."""
    if mode == ConversionMode.SISO:
        return {u: _as_code(r) if r.plane == 1 else chr(_PLANE_2 + ord(_as_code(r))) for u, r in table.by_text.items()}
    if mode == ConversionMode.MEN1:
        return {u: _as_code(r) for u, r in table.by_text.items() if r.plane == 1}
    found = {u: _as_code(r) for u, r in table.by_text.items() if table.is_0208(r)}
    if mode == ConversionMode.JISX0208_TRANSLIT:
        for u, r in table.by_text.items():
            if u not in found and r.tx_jis:
                found[u] = "".join(_as_code(table.rows[t]) for t in r.tx_jis)
    return found


def good_prefix(text: Column, mode: int, table: JisTable) -> Column:
    """The number of characters before the first that the mode can't write."""
    codes = _codes(mode, table)
    singles = "".join(u for u in codes if len(u) == 1)
    masked = _pairs_to(F.translate(text, _GOOD, _BAD), table, lambda r: 2 * (_GOOD if r.us in codes else _BAD))
    return F.length(F.regexp_extract(F.translate(masked, singles, _GOOD * len(singles)), f"^{_GOOD}*", 0))


def encode(text: Column, mode: int, table: JisTable) -> Column:
    """The bytes of a text, NULL where the mode can't write it.

    ``text`` should be cheap to evaluate (see ``bound``).  Pairs become private
    characters first; characters of several codes become the characters of
    these.  Both are rare and done only for rows that have them.
    """
    codes, private = _codes(mode, table), _private(table)
    key = {u: (u if len(u) == 1 else private[table.by_text[u].jis]) for u in codes}
    alphabet = "".join(key.values())
    single = {key[u]: c for u, c in codes.items() if len(c) == 1}
    # several codes for one text: their characters, which the table encodes again
    back = {_as_code(r): r.us for r in table.rows.values() if table.is_0208(r) and len(r.us) == 1}
    several = {key[u]: "".join(back[x] for x in c) for u, c in codes.items() if len(c) > 1}

    def expanded(joined: Column) -> Column:
        if not several:
            return joined
        forms = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
        each = F.transform(F.split(joined, ""), lambda c: F.coalesce(F.try_element_at(forms, c), c))
        return F.when(F.translate(joined, "".join(several), "") != joined, F.array_join(each, "")).otherwise(joined)

    def shifted(units: Column) -> Column:
        """Each run of plane-2 codes between the shifts to plane 2 and back.  All
        bytes but the shifts are 0x21 to 0x7E, so what is a shift twice is one."""
        if mode != ConversionMode.SISO:
            return F.encode(units, "UTF-16BE")
        second = [chr(_PLANE_2 + ord(_as_code(r))) for r in table.rows.values() if r.plane == 2]
        marked = F.regexp_replace(units, f"[{chr(_PLANE_2)}-{chr(_PLANE_2 + 0xFFFF)}]+", f"{_SHIFT_2}$0{_SHIFT_1}")
        data = F.encode(F.translate(marked, "".join(second), "".join(chr(ord(c) - _PLANE_2) for c in second)), "UTF-16BE").cast("string")
        data = F.replace(F.replace(data, F.lit("\x0f\x0f"), F.lit("\x0f")), F.lit("\x0e\x0e"), F.lit("\x0e"))
        return F.when(F.contains(units.cast("binary"), F.lit(_PLANE_2_BYTE)), data.cast("binary")).otherwise(F.encode(units, "UTF-16BE"))

    def written(joined: Column) -> Column:
        value = bound(F.translate(expanded(joined), "".join(single), "".join(single.values())), shifted)
        return F.when(F.translate(joined, alphabet, "") == "", value)

    found = bound(_pairs_to(text, table, lambda r: private[r.jis]), written)
    # a private character of the text itself is none of the table's; their UTF-8 begins alike
    return F.when(~F.contains(text.cast("binary"), F.lit(_PRIVATE_BYTES)), found)


@lru_cache(maxsize=16)
def _decoding(table: JisTable) -> tuple[str, str]:
    """The codes of plane 1 as UTF-16 units, and the characters (private ones for pairs) in their order."""
    rows, private = [r for r in table.rows.values() if r.plane == 1], _private(table)
    return "".join(map(_as_code, rows)), "".join(private[r.jis] if len(r.us) == 2 else r.us for r in rows)


#: The bytes that codes are made of, as Latin-1.
_BYTES = "".join(map(chr, range(0x21, 0x7F)))


def decode(data: Column, table: JisTable) -> Column:
    """The text of plane-1 bytes, NULL where some are bad."""
    alphabet, to = _decoding(table)

    def text(units: Column) -> Column:
        return F.when(F.translate(units, alphabet, "") == "", _expanded(F.translate(units, alphabet, to), [r.us for r in table.pairs]))

    def of(data: Column) -> Column:
        # two-byte codes have bytes 0x21 to 0x7E only, so an even number of them is good UTF-16
        formed = (F.octet_length(data) % 2 == 0) & (F.translate(F.decode(data, "ISO-8859-1"), _BYTES, "") == "")
        return F.when(formed, bound(F.decode(data, "UTF-16BE"), text))

    return bound(data, of)


def good_codes(data: Column, table: JisTable) -> Column:
    """The number of good codes at the beginning."""
    mask = F.translate(F.decode(data, "ISO-8859-1"), _BYTES, _GOOD * len(_BYTES))  # bad bytes stay, and are no letters
    formed = F.floor(F.length(F.regexp_extract(mask, f"^{_GOOD}*", 0)) / 2).cast("int")
    alphabet, _ = _decoding(table)
    units = F.decode(F.substring(data, F.lit(1), formed * 2), "UTF-16BE")
    # an ASCII letter in the units would be a byte pair 00 xx, which no code is
    return F.length(F.regexp_extract(F.translate(units, alphabet, _GOOD * len(alphabet)), f"^{_GOOD}*", 0))


@lru_cache(maxsize=16)
def _shrinking(table: JisTable) -> tuple[str, str, list[str]]:
    """(characters that change, what they become, forms of the private ones among these)."""
    forms = [table.shrunk(r) for r in table.pairs]
    singles = {u: table.shrunk(r) for u, r in table.by_text.items() if len(u) == 1}
    changed = {u: s for u, s in singles.items() if s != u}
    out = []
    for s in changed.values():
        if len(s) == 1:
            out.append(s)
        else:
            out.append(chr(_PAIR + len(forms)))
            forms.append(s)
    return "".join(changed), "".join(out), forms


def shrink(text: Column, table: JisTable, replacement: str, passthrough: bool) -> Column:
    """The shrunken text; characters outside the table stay, or are replaced."""
    private = _private(table)
    known = [u for u in table.by_text if len(u) == 1]
    alphabet = "".join([*known, *private.values()])
    changed, to, several = _shrinking(table)

    def forms(c: Column) -> Column:
        return _expanded(F.translate(c, changed, to) if changed else c, several)

    def replaced(joined: Column) -> Column:
        if passthrough:
            return forms(joined)
        # the row's own unknown characters are the list to translate
        mark = lambda strange: F.call_function("translate", joined, strange, F.repeat(F.lit(_MARK), F.length(strange)))
        marked = lambda strange: F.when(strange == "", forms(joined)).otherwise(F.replace(forms(mark(strange)), F.lit(_MARK), F.lit(replacement)))
        return bound(F.translate(joined, alphabet, ""), marked)

    def token(c: Column) -> Column:
        """The form of one character or pair."""
        pairs = F.create_map(*[F.lit(x) for r in table.pairs for x in (r.us, table.shrunk(r))]) if table.pairs else None
        own = F.when(F.translate(c, "".join(known), "") == "", forms(c)).otherwise(c if passthrough else F.lit(replacement))
        return own if pairs is None else F.coalesce(F.try_element_at(pairs, c), own)

    def of(own: Column) -> Column:
        # a private character of the text itself would look like a pair: go by tokens
        pattern = pair_pattern(table)[:-1] + "|(?s:.))" if table.pairs else "((?s:.))"
        slow = F.array_join(F.transform(F.regexp_extract_all(own, F.lit(pattern), F.lit(1)), token), "")
        fast = bound(_pairs_to(own, table, lambda r: private[r.jis]), replaced)
        return F.when(F.contains(own.cast("binary"), F.lit(_PRIVATE_BYTES)), slow).otherwise(fast)

    return bound(text, of)


def good_texts(text: Column, table: JisTable) -> Column:
    """The number of characters before the first that is outside the table, NULL
    where all are in it."""
    singles = "".join(u for u in table.by_text if len(u) == 1)

    def of(own: Column) -> Column:
        masked = _pairs_to(F.translate(own, _GOOD, _BAD), table, lambda r: _GOOD * 2)
        return bound(F.translate(masked, singles, _GOOD * len(singles)), lambda m: F.when(F.translate(m, _GOOD, "") != "", F.length(F.regexp_extract(m, f"^{_GOOD}*", 0))))

    return bound(text, of)


def default_table(table: JisTable | None) -> JisTable:
    return table or seed_jis()
