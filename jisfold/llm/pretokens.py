"""Cuts text where a byte-level BPE with the usual word pattern surely cuts it.

A single space between two characters that are no white space always begins a
new token, so the parts between such places can be encoded one by one.
``PartIds`` does this for many texts at once: Arrow splits them and finds the
distinct parts, only their inner pieces not met lately are encoded, and the texts' ids are
gathered by number.  No Python object is made for a word of a text, and what
is remembered are two arrays, not a dictionary of objects.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SAFE_CUT = re.compile(r"(?<=\S)(?= (?=\S))")
#: White space that is no single space or line feed between other characters.
_IRREGULAR = r"  | \n|\n |^\n|\n$|^ | $|[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: In such texts: a line feed and the characters around it; a letter and a mark.
_FEED, _MARK = r"([^\s])(\n[^\s])", r"(\pL)([^\s\pL\pN])"


def chunks(text: str) -> list[str]:
    """Parts of the text that encode independently; joined, they are the text.

    >>> chunks("a b  c")
    ['a', ' b  c']
    """
    return _SAFE_CUT.split(text) if text else []


class PartIds:
    """Ids of whole texts, encoded once for each distinct piece.

    ``encode_parts`` gives (all ids, number of each part's ids) of pieces that
    encode independently, each with the space before it; none has a tab.
    ``encode_whole`` gives the ids of one text, and is asked for texts in which
    some white space stands beside other white space or at an end, or that hold
    one of the ``special`` strings.  At most ``limit`` pieces are remembered, and
    those of the last call.
    """

    def __init__(self, encode_parts: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], encode_whole: Callable[[str], Sequence[int]], special: Sequence[str] = (), limit: int = 300_000):
        self.encode_parts, self.encode_whole, self.limit = encode_parts, encode_whole, limit
        self.irregular = "|".join([_IRREGULAR, *map(re.escape, special)])
        self.parts = pa.array([], pa.string())
        self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null
        and empty texts have none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, self.irregular).to_numpy(zero_copy_only=False)
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        out = [b""] * len(texts)
        for i in np.flatnonzero(whole).tolist():
            out[i] = np.asarray(self.encode_whole(texts[i].as_py()), "<u4").tobytes()
        rows = np.flatnonzero(~whole & ~empty)
        if len(rows):
            split = pc.split_pattern(pc.replace_substring(texts.take(pa.array(rows)), " ", "\t "), "\t")
            per_text = np.diff(split.offsets.to_numpy())
            coded = split.flatten().dictionary_encode()
            ids, sizes = self._ids_of(coded.dictionary)
            ids, sizes = _gathered(sizes, ids, coded.indices.to_numpy())
            ends = np.cumsum(sizes)[np.cumsum(per_text) - 1] * 4
            data, start = ids.astype("<u4", copy=False).tobytes(), 0
            for i, end in zip(rows.tolist(), ends.tolist(), strict=True):
                out[i], start = data[start:end], end
        return out

    def _ids_of(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each part's ids) of distinct parts."""
        cut = pc.replace_substring_regex(pc.replace_substring_regex(parts, _FEED, "\\1\t\\2"), _MARK, "\\1\t\\2")
        split = pc.split_pattern(cut, "\t")
        coded = split.flatten().dictionary_encode()
        number = self._known(coded.dictionary.cast(pa.string()))[coded.indices.to_numpy()]
        ids, sizes = _gathered(self.sizes, self.ids, number)
        self._forget(number)
        return ids, np.add.reduceat(sizes, split.offsets.to_numpy()[:-1])

    def _known(self, parts: pa.Array) -> np.ndarray:
        """The numbers of distinct pieces; new ones are encoded."""
        at = pc.index_in(parts, value_set=self.parts)
        number = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = np.arange(len(self.parts), len(self.parts) + len(new))
            missing = parts.take(pa.array(new))
            ids, sizes = self.encode_parts(missing.to_pylist())
            self.parts = pa.concat_arrays([self.parts, missing])
            self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids.astype(np.uint32, copy=False)])
        return number

    def _forget(self, number: np.ndarray) -> None:
        """Keeps the pieces of the last call only, where there are too many."""
        if len(self.parts) > self.limit:
            kept = np.unique(number)
            self.ids, self.sizes = _gathered(self.sizes, self.ids, kept)
            self.parts = self.parts.take(pa.array(kept))


def _gathered(sizes: np.ndarray, ids: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sizes) of the numbered parts, one after the other."""
    starts, own = (np.cumsum(sizes) - sizes)[number], sizes[number]
    at = np.repeat(starts - (np.cumsum(own) - own), own)
    at += np.arange(len(at))
    return ids[at], own
