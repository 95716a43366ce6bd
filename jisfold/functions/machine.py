"""The codec in Python: for shift codes, for streams, and for bug-compatible results.

A text is read as tokens: pairs where two characters share a code, single
characters otherwise.  A pair's first character is held back until the next
character, or the end, decides.
"""

from __future__ import annotations

from jisfold.constants import NOT_CONVERTIBLE, CLASSES_SHRUNK, ConversionMode, TransliterationError
from jisfold.refdata.tables import JisRow, JisTable, seed_jis

TO_PLANE_1, TO_PLANE_2 = b"\x0e", b"\x0f"


class IncrementalEncoder:
    """Encodes a text that comes in parts.

    Unlike a plain codec's, the state includes what is held back, so that a
    restored encoder goes on exactly.  ``bug_compat`` drops all characters but
    the last that are held back when a pair completes, and fails above 32.
    """

    def __init__(self, encoding: str, conv_mode: int, table: JisTable | None = None, bug_compat: bool = False):
        if not encoding:
            raise ValueError("encoding must not be empty")
        self.encoding, self.mode, self.table, self.bug_compat = encoding, ConversionMode(conv_mode), table or seed_jis(), bug_compat
        self.held, self.plane = "", 1

    def reset(self) -> None:
        """Forgets what is held back; the plane stays."""
        self.held = ""

    def getstate(self) -> int:
        """The held characters and the plane, as one number."""
        return int.from_bytes(self.held.encode("utf-32-be"), "big") * 2 + self.plane - 1

    def setstate(self, state: int) -> None:
        held, self.plane = state >> 1, (state & 1) + 1
        size = -(-held.bit_length() // 32) * 4
        self.held = held.to_bytes(size, "big").decode("utf-32-be")

    def _put(self, row: JisRow | None, text: str, at: int) -> bytes:
        table = self.table
        if row is not None:
            if self.mode == ConversionMode.SISO:
                shift = b"" if row.plane == self.plane else TO_PLANE_1 if row.plane == 1 else TO_PLANE_2
                self.plane = row.plane
                return shift + row.code
            if self.mode == ConversionMode.MEN1:
                if row.plane == 1:
                    return row.code
            elif table.is_0208(row):
                return row.code
            elif self.mode == ConversionMode.JISX0208_TRANSLIT and row.tx_jis:
                return b"".join(table.rows[t].code for t in row.tx_jis)
        raise UnicodeEncodeError(self.encoding, text, at, at + 1, NOT_CONVERTIBLE)

    def encode(self, text: str, final: bool = False) -> bytes:
        whole, out, i = self.held + text, [], 0
        held_before, self.held = len(self.held), ""
        by_text, leads = self.table.by_text, self.table.leads
        run = 0  # held-back characters before i, as the bug-compatible form counts them
        while i < len(whole):
            pair = by_text.get(whole[i : i + 2]) if whole[i] in leads and i + 1 < len(whole) else None
            if whole[i] in leads and i + 1 == len(whole) and not final:
                self.held = whole[i:]
                break
            at = max(0, i - held_before)
            if self.bug_compat:
                run = run + 1 if whole[i] in leads else 0
                if run > 32:
                    raise UnicodeEncodeError(self.encoding, text, at, at + 1, "lookahead buffer overflow")
                if pair and run > 1:
                    del out[len(out) - (run - 1) :]
            out.append(self._put(pair or by_text.get(whole[i]), whole if held_before else text, at))
            if pair:
                run = 0
            i += 2 if pair else 1
        if final and self.mode == ConversionMode.SISO and self.plane == 2:
            out.append(TO_PLANE_1)
            self.plane = 1
        return b"".join(out)


def encode(encoding: str, text: str, mode: int, table: JisTable | None = None, bug_compat: bool = False) -> bytes:
    """The whole text's bytes; UnicodeEncodeError names the first that has none."""
    return IncrementalEncoder(encoding, mode, table, bug_compat).encode(text, True)


def decode(encoding: str, data: bytes, table: JisTable | None = None) -> str:
    """The text of plane-1 bytes; UnicodeDecodeError names the first bad ones."""
    if not encoding:
        raise ValueError("encoding must not be empty")
    table, out = table or seed_jis(), []
    for i in range(0, len(data), 2):
        found = decode_problem(data[i : i + 2], table)
        if found:
            raise UnicodeDecodeError(encoding, data, i + found[1], i + found[2], found[0])
        out.append(table.rows[(data[i] - 0x21) * 94 + data[i + 1] - 0x21].us)
    return "".join(out)


def decode_problem(two: bytes, table: JisTable) -> tuple[str, int, int] | None:
    """(reason, start, end) of what is wrong with the next two bytes."""
    if not 0x21 <= two[0] <= 0x7E:
        return f"unexpected byte \\x{two[0]:02x}", 0, 1
    if len(two) == 1:
        return "incomplete multibyte character", 0, 1
    if not 0x21 <= two[1] <= 0x7E:
        return f"unexpected byte \\x{two[1]:02x} after \\x{two[0]:02x}", 1, 2
    if (two[0] - 0x21) * 94 + two[1] - 0x21 not in table.rows:
        # the reason's numbers are the bytes and one, as users of this codec know them
        return f"JIS character 1-{two[0] + 1}-{two[1] + 1} does not have a corresponding unicode codepoint", 0, 2
    return None


def shrink_translit(text: str, replacement: str = "�", passthrough: bool = False, table: JisTable | None = None, bug_compat: bool = False) -> str:
    """The shrunken text.

    ``bug_compat`` loses pair leads held at the end, and writes held leads
    again after a pair.
    """
    table = table or seed_jis()
    out: list[str] = []
    kept = ""  # leads that the bug-compatible form never lets go

    def put(token: str, at: int) -> None:
        row = table.by_text.get(token)
        if row is not None:
            out.append(row.tx_us if row.cls in CLASSES_SHRUNK and row.tx_us else row.us)
        elif passthrough:
            out.append(token)
        elif replacement:
            out.append(replacement)
        else:
            raise TransliterationError(f"transliteration failed at position {at}")

    i, n = 0, len(text)
    while i < n:
        lead = text[i] in table.leads
        if lead and i + 1 < n and text[i : i + 2] in table.by_text:
            put(text[i : i + 2], i)
            kept += text[i]
            i += 2
        elif lead and bug_compat:
            kept += text[i]
            i += 1
        else:
            if bug_compat:
                for c in kept:
                    put(c, i)
                kept = ""
            put(text[i], i)
            i += 1
    return "".join(out)
