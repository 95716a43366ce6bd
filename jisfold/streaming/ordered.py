"""The incremental encoder over parts that come in any order.

Parts of a text come as rows (key, seq, text, final), numbered from 0, in any
order and over any number of micro-batches.  A part is encoded when all parts
before it are; until then it waits in a map of the key's state, so whatever
order the parts come in, the bytes are those of the whole text.

What is not plain has these results, as rows with a reason and no bytes:

- a part without a number: "no number";
- a part whose number was there before, or waits already: "repeated number"
  (of equal numbers in one micro-batch the one with the smallest text counts);
- a part numbered above the final one: "after the end";
- with ``wait``: where a part has been missing for so long since the first one
  that waits for it, a row "missing" with its number, and the key goes on with
  the smallest number that waits.

An encoded part's errors are as in ``encode_stream``.  A text's state goes with
its final part, but for the mark that it has ended; with ``forget`` that and
parts that wait for a text nobody continues go after so long.  With either,
Spark goes on with batches without data, so a trigger ``availableNow`` ends
only where ``spark.sql.streaming.noDataMicroBatches.enabled`` is false.

Needs the RocksDB state store:
``spark.sql.streaming.stateStore.providerClass`` =
``org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from jisfold.functions.machine import IncrementalEncoder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NO_NUMBER, REPEATED, AFTER_END, MISSING = "no number", "repeated number", "after the end", "missing"
OUT_ROW = Row("stream_id", "seq", "bytes", "reason", "start")
OUT = "stream_id string, seq long, bytes binary, reason string, start int"


class Ordered(StatefulProcessor):
    """Encodes each key's parts in the order of their numbers."""

    def __init__(self, conv_mode: int, wait: int | None, forget: int | None):
        self.mode, self.wait, self.forget = conv_mode, wait, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "next long, held string, plane int, ended boolean", self.forget)
        self.early = handle.getMapState("early", "seq long", "text string, final boolean", self.forget)
        self.due = handle.getValueState("due", "at long", self.forget)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        expected, encoder, ended = self._load()
        parts = sorted(((r.seq, r.text or "", bool(r.final)) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        for seq, text, final in parts:
            if seq is None:
                yield self._row(key, None, NO_NUMBER)
            elif seq < expected or (not ended and seq > expected and self.early.containsKey((seq,))):
                yield self._row(key, seq, REPEATED)
            elif ended:
                yield self._row(key, seq, AFTER_END)
            elif seq > expected:
                self.early.updateValue((seq,), (text, final))
            else:
                yield from self._put(key, seq, text, final, encoder)
                expected, ended = seq + 1, final
                more, expected, ended = self._follow(key, expected, ended, encoder)
                yield from more
        self._store(expected, encoder, ended)
        self._watch(ended, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        expected, encoder, ended = self._load()
        self.due.clear()
        waiting = [seq for (seq,) in self.early.keys()]
        if not ended and waiting:
            yield self._row(key, expected, MISSING)
            more, expected, ended = self._follow(key, min(waiting), ended, encoder)
            yield from more
            self._store(expected, encoder, ended)
        self._watch(ended, timerValues)

    def close(self) -> None:
        pass

    def _load(self) -> tuple[int, IncrementalEncoder, bool]:
        encoder = IncrementalEncoder("jis", self.mode)
        if not self.now.exists():
            return 0, encoder, False
        expected, encoder.held, encoder.plane, ended = self.now.get()
        return expected, encoder, ended

    def _store(self, expected: int, encoder: IncrementalEncoder, ended: bool) -> None:
        self.now.update((expected, encoder.held, encoder.plane, ended))

    def _follow(self, key: tuple, expected: int, ended: bool, encoder: IncrementalEncoder) -> tuple[list[Row], int, bool]:
        """Encodes what waits from ``expected`` on; at the end, refuses what waits beyond it."""
        out: list[Row] = []
        while not ended and self.early.containsKey((expected,)):
            text, final = self.early.getValue((expected,))
            self.early.removeKey((expected,))
            out += self._put(key, expected, text, final, encoder)
            expected, ended = expected + 1, final
        if ended:
            out += [self._row(key, seq, AFTER_END) for seq in sorted(seq for (seq,) in self.early.keys())]
            self.early.clear()
        return out, expected, ended

    def _put(self, key: tuple, seq: int, text: str, final: bool, encoder: IncrementalEncoder) -> list[Row]:
        plane = encoder.plane
        try:
            return [OUT_ROW(key[0], seq, encoder.encode(text, final), None, None)]
        except UnicodeEncodeError as e:
            encoder.held, encoder.plane = "", plane
            return [OUT_ROW(key[0], seq, None, e.reason, e.start)]

    def _watch(self, ended: bool, timerValues) -> None:
        """A timer as long as a part waits, none otherwise."""
        if self.wait is None:
            return
        waits = not ended and next(iter(self.early.keys()), None) is not None
        set_to = self.due.get()[0] if self.due.exists() else None
        if waits and set_to is None:
            at = timerValues.getCurrentProcessingTimeInMs() + self.wait
            self.handle.registerTimer(at)
            self.due.update((at,))
        elif not waits and set_to is not None:
            self.handle.deleteTimer(set_to)
            self.due.clear()

    @staticmethod
    def _row(key: tuple, seq: int | None, reason: str) -> Row:
        return OUT_ROW(key[0], seq, None, reason, None)


def encode_ordered_stream(df: DataFrame, conv_mode: int, key: str = "stream_id", seq: str = "seq", text: str = "text", final: str = "final", wait: int | None = None, forget: int | None = None) -> DataFrame:
    """stream_id, seq, bytes (of each part), reason and start of an error.

    ``wait`` and ``forget`` are milliseconds.  A null key is a key of its own, a
    null text empty, a null ``final`` false.
    """
    parts = df.select(F.col(key).cast("string").alias("stream_id"), F.col(seq).cast("long").alias("seq"), F.col(text).alias("text"), F.col(final).alias("final"))
    mode = "None" if wait is None and forget is None else "ProcessingTime"
    return parts.groupBy("stream_id").transformWithState(Ordered(conv_mode, wait, forget), OUT, "append", mode)
