"""The character tables: JIS X 0213 with shrink targets, and the MJ tables.

Without the official files, the JIS table is derived from Python's own codecs
of JIS X 0213 (which characters it has, where they lie, which of them JIS X
0208 has), with the few shrink targets that published examples attest.  The MJ
tables hold attested examples only; codes from 900001 on are placeholders.
``refdata.ingest`` builds complete tables from the official files.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

from jisfold.constants import CLASSES_0208, CLASSES_SHRUNK, JisClass

#: Slots of the packed number (men - 1) * 94 * 94 + (ku - 1) * 94 + (ten - 1).
SLOTS = 2 * 94 * 94

# Shrink targets attested by published examples, by men-ku-ten.
ATTESTED_SHRINK = {
    "1-4-84": ["1-5-84"],
    "1-4-85": ["1-5-85"],
    "1-4-86": ["1-5-86"],
    "1-8-33": ["1-3-18", "1-3-17"],
    "1-47-82": ["1-26-74"],
    "1-94-79": ["1-25-77"],
    "1-94-94": ["1-23-50"],
    "2-14-90": ["1-45-92"],
}

# Attested MJ rows (code, variants as (code point, selector
# number or None), shrink targets as {scheme: [code points]}).
ATTESTED_MJ = [
    (900001, [(0x658E, None), (0x658E, 18)], {}),
    (900002, [(0x9089, None), (0x9089, 31)], {3: [0x8FBA, 0x908A]}),
    (900003, [(0x908A, None), (0x908A, 24), (0x908A, 25)], {3: [0x8FBA]}),
    (900004, [(0x3450, None)], {}),
    (900005, [(0x2AC2A, None)], {}),
    (28902, [(0x9AD9, None)], {0: [0x9AD8]}),
    (28901, [(0x9AD8, None)], {}),
]


def packed(men: int, ku: int, ten: int) -> int:
    return (men - 1) * 94 * 94 + (ku - 1) * 94 + (ten - 1)


def parse_men_ku_ten(text: str) -> int:
    """The packed number of "men-ku-ten".

    >>> parse_men_ku_ten("1-25-66")
    2321
    """
    parts = text.split("-")
    if len(parts) != 3 or not all(p.isdecimal() for p in parts):
        raise ValueError(f"not a men-ku-ten: {text!r}")
    men, ku, ten = map(int, parts)
    if not (1 <= men <= 2 and 1 <= ku <= 94 and 1 <= ten <= 94):
        raise ValueError(f"out of range: {text!r}")
    return packed(men, ku, ten)


@dataclass(frozen=True)
class JisRow:
    jis: int
    us: str
    cls: int
    tx_jis: tuple[int, ...] = ()
    tx_us: str = ""
    sus: str = ""
    provenance: str = "codec"

    @property
    def plane(self) -> int:
        return self.jis // (94 * 94) + 1

    @property
    def code(self) -> bytes:
        """The two bytes that stand for it in its plane."""
        return bytes((0x21 + self.jis // 94 % 94, 0x21 + self.jis % 94))


@dataclass(eq=False)  # tables are compared and hashed by identity
class JisTable:
    """T1 and what is derived from it; checked when built."""

    rows: dict[int, JisRow]
    use_secondary: bool = False

    def __post_init__(self):
        seen: dict[str, int] = {}
        for row in self.rows.values():
            if not 1 <= len(row.us) <= 2:
                raise ValueError(f"{row.jis}: one or two code points are allowed")
            if row.us in seen:
                raise ValueError(f"{row.us!r} stands for {seen[row.us]} and {row.jis}")
            seen[row.us] = row.jis

    @cached_property
    def by_text(self) -> dict[str, JisRow]:
        """T2 and T3: rows by their one or two code points."""
        found = {r.us: r for r in self.rows.values()}
        if self.use_secondary:
            for r in self.rows.values():
                if r.sus:
                    found.setdefault(r.sus, r)
        return found

    @cached_property
    def pairs(self) -> list[JisRow]:
        return sorted((r for r in self.rows.values() if len(r.us) == 2), key=lambda r: r.jis)

    @cached_property
    def leads(self) -> frozenset[str]:
        return frozenset(r.us[0] for r in self.pairs)

    @cached_property
    def seconds(self) -> str:
        return "".join(sorted({r.us[1] for r in self.pairs}))

    def singles(self, keep=lambda r: True) -> list[JisRow]:
        found = [(u, r) for u, r in self.by_text.items() if len(u) == 1 and keep(r)]
        return [r if r.us == u else JisRow(r.jis, u, r.cls, r.tx_jis, r.tx_us) for u, r in sorted(found)]

    def is_0208(self, row: JisRow) -> bool:
        return row.cls in CLASSES_0208

    def shrunk(self, row: JisRow) -> str:
        """What shrinking writes for a row."""
        return row.tx_us if row.cls in CLASSES_SHRUNK and row.tx_us else row.us


@dataclass(eq=False)
class MjTable:
    """T4 to T6: variants and shrink targets by MJ code."""

    variants: dict[int, list[tuple[int, int | None]]] = field(default_factory=dict)
    shrink: dict[int, dict[int, list[int]]] = field(default_factory=dict)

    @cached_property
    def by_code_point(self) -> dict[int, list[int]]:
        """T5: the MJ codes of a code point, in the table's order, each once."""
        found: dict[int, list[int]] = {}
        for mj, variants in self.variants.items():
            for u in dict.fromkeys(u for u, _ in variants):
                found.setdefault(u, []).append(mj)
        return found


def _positions():
    """(packed number, text) of all characters that the codec has."""
    for first in [*range(0x81, 0xA0), *range(0xE0, 0xFD)]:
        for second in [*range(0x40, 0x7F), *range(0x80, 0xFD)]:
            try:
                text = bytes((first, second)).decode("shift_jis_2004")
            except UnicodeDecodeError:
                continue
            cell = second - 0x40 - (second > 0x7F)
            if first < 0xF0:
                row = 2 * (first - 0x81 if first < 0xA0 else first - 0xC1)
                yield packed(1, row + 1 + cell // 94, cell % 94 + 1), text
            else:
                _, ku, ten = text.encode("euc_jis_2004")
                yield packed(2, ku - 0xA0, ten - 0xA0), text


def _in_0208(text: str, jis: int) -> bool:
    try:
        code = text.encode("euc_jp")
    except UnicodeEncodeError:
        return False
    return code == bytes((0xA1 + jis // 94, 0xA1 + jis % 94))


#: The codec has these two as ASCII; in the 94 x 94 set they are full-width.
_FULL_WIDTH = {"\\": "＼", "~": "～"}


@lru_cache(maxsize=1)
def seed_jis() -> JisTable:
    """The JIS table from Python's codecs and the attested shrink targets."""
    rows = {}
    for jis, text in _positions():
        if jis >= 94 * 94:
            cls = JisClass.KANJI_LEVEL_4
        elif _in_0208(text, jis):
            cls = JisClass.JISX0208_NON_KANJI if jis // 94 < 15 else JisClass.KANJI_LEVEL_1 if jis // 94 < 47 else JisClass.KANJI_LEVEL_2
        elif len(text) == 1 and unicodedata.name(text, "").startswith("CJK"):
            cls = JisClass.KANJI_LEVEL_3
        else:
            cls = JisClass.JISX0213_NON_KANJI
        if text in _FULL_WIDTH:
            text, cls = _FULL_WIDTH[text], JisClass.JISX0208_NON_KANJI if text == "\\" else cls
        rows[jis] = JisRow(jis, text, int(cls))
    for source, targets in ATTESTED_SHRINK.items():
        jis, tx = parse_men_ku_ten(source), tuple(map(parse_men_ku_ten, targets))
        rows[jis] = JisRow(jis, rows[jis].us, rows[jis].cls, tx, "".join(rows[t].us for t in tx), provenance="attested")
    return JisTable(rows)


@lru_cache(maxsize=1)
def seed_mj() -> MjTable:
    """The attested MJ rows."""
    return MjTable({mj: list(v) for mj, v, _ in ATTESTED_MJ}, {mj: s for mj, _, s in ATTESTED_MJ if s})
