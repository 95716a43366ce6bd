"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token that ends its encoding.
A dictionary automaton with suffix links lists the tokens that end at each
position; a token extends the prefix before it when the pair (last token of
that prefix, token) is compatible, which is to say that the two encode, side
by side, to themselves.  The first compatible token is the only one.  Following
the back-pointers from the end gives the ids that merging by rank gives, in
time linear in the number of matches and without a merge queue.

Defined results: null text encodes as empty (no ids); empty text has no ids
and decodes to the empty text; texts of any length are encoded whole; the
special tokens' strings in a text become their ids, as the tokenizers library
has it by default; ids that are not in the vocabulary are an error; repeated
rows give repeated results; an empty table gives an empty result; extra
columns stay, and one of the name of a result (in any letter case) is replaced.
"""

from __future__ import annotations

import json
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from jisfold.llm import common
from jisfold.llm.pretokens import PartIds, chunks

#: The word pattern of byte-level BPE, with white space spelled
#: out as Unicode has it.
_SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"

#: Pairs of tokens whose compatibility a Python worker remembers (about 100 bytes each).
PAIRS = 150_000


def _byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files spell bytes: printable Latin-1
    characters stand for themselves, the others follow from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """The tokens of one vocabulary file (tokenizers' JSON format)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is no plain byte-level BPE")
        letters = _byte_letters()
        self.ids = {bytes(letters[c] for c in word): i for word, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merges = []
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.append((bytes(letters[c] for c in left), bytes(letters[c] for c in right)))


class Decoder:
    """Texts of ids."""

    def __init__(self, path: str):
        own = Vocabulary(path)
        self.bytes_of = {i: b for b, i in own.ids.items()} | {i: s.encode() for s, i in own.special.items()}

    def decode(self, ids: bytes) -> str:
        """The text of little-endian ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class ByteBPE:
    """Encoder of one vocabulary file."""

    def __init__(self, path: str):
        own = Vocabulary(path)
        ids, self.special = own.ids, own.special
        # rank at which a token is formed (-1: a byte), and the halves it is formed from
        self.rank, self.halves, self.merged = {}, {}, {}
        for rank, (a, b) in enumerate(own.merges):
            made = ids[a + b]
            if made in self.halves:
                raise ValueError(f"two merges form the token {made}")
            self.merged[ids[a], ids[b]] = rank
            self.rank[made], self.halves[made] = rank, (ids[a], ids[b])
        self.compatible: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        whole = {}
        for b, i in sorted(ids.items(), key=lambda x: self.rank.get(x[1], -1)):
            halves = self.halves.get(i)
            whole[i] = len(b) == 1 if halves is None else whole[halves[0]] and whole[halves[1]] and self._pair(*halves, self.rank[i])
            if whole[i]:
                self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.find = regex.compile(PATTERN).findall
        self.known = PartIds(self._parts, self._whole, list(self.special))

    def _pair(self, a: int, b: int, limit: float = float("inf")) -> bool:
        """Whether no merge joins a and b across their border.

        Undo the later of the two tokens' last merges, again and again; a pair
        that stands at the border in between would have been merged if its
        rank comes before the merge that was undone.  Among equal ranks the
        leftmost is merged first.
        """
        while True:
            rank = self.merged.get((a, b))
            if rank is not None and rank < limit:
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, self.halves[a][1]
            else:
                limit, b = rb + 1, self.halves[b][0]

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece of the word pattern."""
        n = len(data)
        last: list[int] = [-1] * (n + 1)  # id of the token that ends each prefix
        begin = [0] * (n + 1)
        compatible = self.compatible
        for end, (token, size) in self.automaton.iter(data.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            if start:
                before = last[start]
                if before < 0:
                    continue
                key = before << 32 | token
                ok = compatible.get(key)
                if ok is None:
                    if len(compatible) > PAIRS:
                        compatible.clear()
                    ok = compatible[key] = self._pair(before, token)
                if not ok:
                    continue
            last[end], begin[end] = token, start
        out, at = [], n
        while at:
            if last[at] < 0:
                raise ValueError("the vocabulary lacks a byte of this text")
            out.append(last[at])
            at = begin[at]
        out.reverse()
        return out

    def _part(self, part: str) -> list[int]:
        """The ids of a part without special tokens."""
        if part[1:].isalpha() and (part[0] == " " or part[0].isalpha()):
            return self.piece(part.encode())
        ids: list[int] = []
        for piece in self.find(part):
            ids += self.piece(piece.encode())
        return ids

    def _parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self._part(x) for x in parts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum())), sizes

    def _whole(self, text: str) -> list[int]:
        """The ids of any text."""
        ids: list[int] = []
        for span in self.split_special.split(text) if self.split_special else [text]:
            if span in self.special:
                ids.append(self.special[span])
            else:
                for chunk in chunks(span):
                    ids += self._part(chunk)
        return ids

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return self.known.encode(texts)


@lru_cache(maxsize=2)
def loaded(path: str) -> ByteBPE:
    """One encoder for all tasks of a Python worker."""
    return ByteBPE(path)


@lru_cache(maxsize=2)
def loaded_decoder(path: str) -> Decoder:
    """One decoder for all tasks of a Python worker; far smaller than an encoder."""
    return Decoder(path)


def bpe_encode(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids", count: str = "n_tokens") -> DataFrame:
    """Adds the ids (little-endian unsigned 32-bit integers) and their number.

    ``path`` is the vocabulary file, which every executor can read.  No shuffle.
    """

    def make():
        bpe = loaded(path)

        def work(batch: pa.RecordBatch) -> list:
            found = bpe.encode(batch.column(text))
            return [found, [len(x) // 4 for x in found]]

        return work

    return common.append_columns(df, T.StructType([T.StructField(ids, T.BinaryType()), T.StructField(count, T.LongType())]), make)


def bpe_decode(df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Adds the text of the ids that bpe_encode wrote; null ids decode as empty."""

    def make():
        bpe = loaded_decoder(path)
        return lambda batch: [[bpe.decode(x or b"") for x in batch.column(ids).to_pylist()]]

    return common.append_columns(df, T.StructType([T.StructField(out, T.StringType())]), make)


def bpe_round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids", count: str = "n_tokens", out: str = "decoded") -> DataFrame:
    """bpe_encode and bpe_decode in one pass, by one Python worker a task; the
    decoded text comes from the ids alone."""

    def make():
        coder, decoder = loaded(path), loaded_decoder(path)

        def work(batch: pa.RecordBatch) -> list:
            found = coder.encode(batch.column(text))
            return [found, [len(x) // 4 for x in found], [decoder.decode(x) for x in found]]

        return work

    outputs = [T.StructField(ids, T.BinaryType()), T.StructField(count, T.LongType()), T.StructField(out, T.StringType())]
    return common.append_columns(df, T.StructType(outputs), make)
