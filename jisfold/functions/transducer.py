"""The codec's automaton over many texts at once, on arrays of code points.

What ``machine`` does a character at a time, in the same order and with the
same results: texts are laid end to end, pairs found greedily from the left,
and each token's bytes or characters put where the tokens before it end.  The
bug-compatible forms are made here, and those of ``functions.batches``; the other
plain ones are expressions in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np

from jisfold.constants import NOT_CONVERTIBLE, ConversionMode
from jisfold.functions.machine import decode_problem
from jisfold.refdata.tables import JisTable

OVERFLOW = "lookahead buffer overflow"
#: Leads that the bug-compatible encoder holds at most.
HELD = 32


class _Tables:
    """Rows by code point and by pair, as arrays."""

    def __init__(self, table: JisTable):
        self.rows = list(table.rows.values())
        place = {r.jis: i for i, r in enumerate(self.rows)}
        self.single = np.full(0x110000, -1, np.int32)
        self.lead, self.second = np.zeros(0x110000, np.int16), np.zeros(0x110000, np.int16)
        leads, seconds = sorted(table.leads), table.seconds
        self.pair = np.full((len(leads) + 1, len(seconds) + 1), -1, np.int32)
        for text, row in table.by_text.items():
            if len(text) == 1:
                self.single[ord(text)] = place[row.jis]
        for i, c in enumerate(leads, 1):
            self.lead[ord(c)] = i
        for i, c in enumerate(seconds, 1):
            self.second[ord(c)] = i
        for text, row in table.by_text.items():
            if len(text) == 2:
                self.pair[self.lead[ord(text[0])], self.second[ord(text[1])]] = place[row.jis]
        self.table = table

    @lru_cache(maxsize=8)
    def codes(self, mode: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of codes, the codes, plane) of each row in a mode; no code: it can't be written."""
        lists = []
        for r in self.rows:
            if mode == ConversionMode.SISO or mode == ConversionMode.MEN1 and r.plane == 1 or mode >= ConversionMode.JISX0208 and self.table.is_0208(r):
                lists.append([r.code])
            elif mode == ConversionMode.JISX0208_TRANSLIT:
                lists.append([self.table.rows[t].code for t in r.tx_jis])
            else:
                lists.append([])
        n = np.array([len(x) for x in lists], np.int64)
        codes = np.zeros((len(lists), max(n, default=0), 2), np.uint8)
        for i, x in enumerate(lists):
            for j, code in enumerate(x):
                codes[i, j] = list(code)
        return n, codes, np.array([r.plane for r in self.rows], np.int8)

    @lru_cache(maxsize=1)
    def forms(self) -> tuple[np.ndarray, np.ndarray]:
        """(number of characters, the characters) of each row's shrunken form."""
        texts = [self.table.shrunk(r) for r in self.rows]
        points = np.zeros((len(texts), max(map(len, texts))), np.uint32)
        for i, t in enumerate(texts):
            points[i, : len(t)] = list(map(ord, t))
        return np.array(list(map(len, texts)), np.int64), points

    @lru_cache(maxsize=1)
    def decoding(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row or -1 of each two bytes of plane 1, number of characters and characters of each row)."""
        by_code, points = np.full(1 << 16, -1, np.int32), np.zeros((len(self.rows), 2), np.uint32)
        for i, r in enumerate(self.rows):
            points[i, : len(r.us)] = list(map(ord, r.us))
            if r.plane == 1:
                by_code[int.from_bytes(r.code, "big")] = i
        return by_code, np.array([len(r.us) for r in self.rows], np.int64), points


@lru_cache(maxsize=4)
def _tables(table: JisTable) -> _Tables:
    return _Tables(table)


class _Tokens:
    """The tokens of texts: where each begins, its text, its row (-1: none)."""

    def __init__(self, texts: Sequence[str], tables: _Tables):
        self.size = np.array(list(map(len, texts)), np.int64)
        self.points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        of = np.repeat(np.arange(len(texts)), self.size)
        lead, second = tables.lead[self.points], tables.second[self.points]
        pair = np.full(len(self.points), -1, np.int32)
        if len(pair) > 1:
            same = of[1:] == of[:-1]
            pair[:-1] = np.where(same, tables.pair[lead[:-1], second[1:]], -1)
        at = np.arange(len(pair))
        # in a run of places that could all begin a pair, every second one does
        begins = (pair >= 0) & ~np.concatenate([[False], pair[:-1] >= 0])[: len(pair)]
        run = np.maximum.accumulate(np.where(begins, at, 0)) if len(pair) else at
        taken = (pair >= 0) & ((at - run) % 2 == 0)
        inner = np.concatenate([[False], taken[:-1]])[: len(pair)]
        self.at = np.flatnonzero(~inner)
        self.of, self.pair, self.is_lead = of[self.at], taken[self.at], lead[self.at] > 0
        self.alone = tables.single[self.points[self.at]]
        self.row = np.where(self.pair, pair[self.at], self.alone)
        self.place = self.at - (np.cumsum(self.size) - self.size)[self.of]
        self.first = np.concatenate([[True], self.of[1:] != self.of[:-1]])[: len(self.of)]


def _per_text(of: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of, weights=sizes, minlength=n).astype(np.int64)


def encode(texts: Sequence[str], mode: int, table: JisTable, bug_compat: bool = True) -> list[tuple[bytes | None, str | None, int | None, int | None]]:
    """(bytes, reason, start, end) of each text, as ``machine.encode`` gives or raises them."""
    tables = _tables(table)
    t, n = _Tokens(texts, tables), len(texts)
    count, codes, planes = tables.codes(int(mode))
    known = t.row >= 0
    sizes = np.where(known, count[t.row], 0)
    bad = sizes == 0
    shift = np.zeros(len(t.at), bool)
    plane = np.where(known, planes[t.row], 1)
    end_shift = np.zeros(n, np.int64)
    if mode == ConversionMode.SISO:
        before = np.where(t.first, 1, np.concatenate([[1], plane[:-1]])[: len(plane)])
        shift = plane != before
        last = np.concatenate([t.first[1:], [True]])[: len(plane)]
        end_shift[t.of[last]] = plane[last] == 2
    kept, late = np.ones(len(t.at), bool), np.zeros(len(t.at), bool)
    if bug_compat and len(t.at):
        # a streak of leads begins anew at a text, after a pair, and after what is no lead
        anew = t.first | np.concatenate([[False], (t.pair | ~t.is_lead)[:-1]])
        begin = np.maximum.accumulate(np.where(anew, np.arange(len(anew)), 0))
        run = np.arange(len(anew)) - begin + 1
        late = t.is_lead & (run > HELD)
        # a pair makes the encoder forget the leads before it
        change = np.zeros(len(anew) + 1, np.int64)
        lost = np.flatnonzero(t.pair & (run > 1))
        np.add.at(change, begin[lost], 1)
        np.add.at(change, lost, -1)
        kept = np.cumsum(change[:-1]) == 0
    errors: dict[int, tuple[None, str, int, int]] = {}
    for i in np.flatnonzero(bad | late).tolist():
        errors.setdefault(int(t.of[i]), (None, OVERFLOW if late[i] else NOT_CONVERTIBLE, int(t.place[i]), int(t.place[i]) + 1))

    width = np.where(kept, 2 * sizes + shift, 0)
    ends = np.cumsum(_per_text(t.of, width, n) + end_shift)
    offset = np.cumsum(width) - width + (np.cumsum(end_shift) - end_shift)[t.of]
    out = np.full(int(ends[-1]) if n else 0, 0x0E, np.uint8)
    moved = kept & shift
    out[offset[moved]] = np.where(plane[moved] == 1, 0x0E, 0x0F)
    for j in range(codes.shape[1]):
        some = np.flatnonzero(kept & (sizes > j))
        at = offset[some] + shift[some] + 2 * j
        out[at], out[at + 1] = codes[t.row[some], j, 0], codes[t.row[some], j, 1]
    data, start, found = out.tobytes(), 0, []
    for i, end in enumerate(ends.tolist()):
        found.append(errors.get(i) or (data[start:end], None, None, None))
        start = end
    return found


def shrink(texts: Sequence[str], table: JisTable, replacement: str = "�", passthrough: bool = False, bug_compat: bool = True) -> list[tuple[str | None, int | None]]:
    """(shrunken text, position of the failure) of each text; in the
    bug-compatible form leads held at the end are lost, and all that were held
    come again before the next other character."""
    tables = _tables(table)
    t, n = _Tokens(texts, tables), len(texts)
    if not bug_compat:
        return _shrunk(t, n, tables, np.arange(len(t.at)), t.row, t.place, replacement, passthrough)
    # stretches of leads, each up to the character that lets them go
    anew = t.first | np.concatenate([[False], ~t.is_lead[:-1]])[: len(t.at)]
    stretch = np.cumsum(anew) - 1
    closing = np.full(int(stretch[-1]) + 1 if len(stretch) else 0, -1)
    closing[stretch[~t.is_lead]] = np.flatnonzero(~t.is_lead)
    pairs, closers = np.flatnonzero(t.pair), np.flatnonzero(~t.is_lead)
    again = np.flatnonzero(t.is_lead & (closing[stretch] >= 0)) if len(stretch) else pairs
    token = np.concatenate([pairs, again, closers])
    phase = np.repeat([0, 1, 2], [len(pairs), len(again), len(closers)])
    order = np.lexsort((token, phase, stretch[token]))
    token, phase = token[order], phase[order]
    row = np.where(phase == 1, t.alone[token], t.row[token])
    return _shrunk(t, n, tables, token, row, t.place[closing[stretch[token]]] if len(token) else token, replacement, passthrough)


def _shrunk(t: _Tokens, n: int, tables: _Tables, token: np.ndarray, row: np.ndarray, place: np.ndarray, replacement: str, passthrough: bool) -> list[tuple[str | None, int | None]]:
    """The texts written from tokens in that order, each as a row; place: where one fails."""
    count, points = tables.forms()
    of, known = t.of[token], row >= 0
    new = np.array(list(map(ord, replacement)), np.uint32)
    errors: dict[int, int] = {}
    if not passthrough and not replacement:
        for i in np.flatnonzero(~known).tolist():
            errors.setdefault(int(of[i]), int(place[i]))
    size = np.where(known, count[row], 1 if passthrough else len(new))
    offset, ends = np.cumsum(size) - size, np.cumsum(_per_text(of, size, n))
    out = np.zeros(int(ends[-1]) if n else 0, np.uint32)
    for j in range(points.shape[1]):
        some = np.flatnonzero(known & (size > j))
        out[offset[some] + j] = points[row[some], j]
    strange = np.flatnonzero(~known)
    if passthrough:
        out[offset[strange]] = t.points[t.at[token[strange]]]
    else:
        for j, c in enumerate(new):
            out[offset[strange] + j] = c
    whole, start, found = out.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), 0, []
    for i, end in enumerate(ends.tolist()):
        found.append((None, errors[i]) if i in errors else (whole[start:end], None))
        start = end
    return found


def decode(datas: Sequence[bytes], table: JisTable) -> list[tuple[str | None, str | None, int | None, int | None]]:
    """(text, reason, start, end) of each text's plane-1 bytes, as ``machine.decode`` gives or raises them."""
    by_code, count, points = _tables(table).decoding()
    n, size = len(datas), np.array(list(map(len, datas)), np.int64)
    data, codes = np.frombuffer(b"".join(datas), np.uint8), size // 2
    of = np.repeat(np.arange(n), codes)
    at = np.repeat(np.cumsum(size) - size, codes) + 2 * (np.arange(len(of)) - np.repeat(np.cumsum(codes) - codes, codes))
    row = by_code[data[at].astype(np.int64) << 8 | data[at + 1]]
    good = codes.copy()
    bad = np.flatnonzero(row < 0)
    np.minimum.at(good, of[bad], bad - (np.cumsum(codes) - codes)[of[bad]])
    errors = {}
    for i in np.flatnonzero(2 * good < size).tolist():
        start = 2 * int(good[i])
        reason, first, last = decode_problem(datas[i][start : start + 2], table)
        errors[i] = (None, reason, start + first, start + last)
    width = np.where(row >= 0, count[row], 0)
    offset, ends = np.cumsum(width) - width, np.cumsum(_per_text(of, width, n))
    out = np.zeros(int(ends[-1]) if n else 0, np.uint32)
    for j in range(2):
        some = np.flatnonzero(width > j)
        out[offset[some] + j] = points[row[some], j]
    whole, start, found = out.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), 0, []
    for i, end in enumerate(ends.tolist()):
        found.append(errors.get(i) or (whole[start:end], None, None, None))
        start = end
    return found
