"""The incremental encoder as a keyed streaming operator.

Parts of a text come as rows (key, seq, text, final).  Keys are dealt out to
``shards`` by their hash, since a call of Python for each key would cost a
thousand times what encoding it does.  A shard's state holds, for each of its
keys whose text has not ended, the characters that wait for their successor,
the plane that was last written, and the last sequence number, so a query
restarted from its checkpoint goes on exactly, and any split of a text gives
the same bytes as the whole.  A micro-batch rewrites the states of the shards
that it touches: with very many texts open at a time, take more shards.  Within a
micro-batch parts are put in the order of their numbers; a part whose number
is not above the last one's gives the reason "out of order" and no bytes, one
without a number "no number" (``ordered`` has an operator that waits for the
parts before instead).  With
a final part the key's state goes, and the key begins anew with any number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from jisfold.functions.machine import IncrementalEncoder

OUT_OF_ORDER, NO_NUMBER = "out of order", "no number"
OUT = "stream_id string, seq long, bytes binary, reason string, start int"
STATE = "keys array<string>, held array<string>, planes array<int>, seqs array<long>"
#: Shards of the keys.
SHARDS = 4096


def encode_stream(df: DataFrame, conv_mode: int, key: str = "stream_id", seq: str = "seq", text: str = "text", final: str = "final", shards: int = SHARDS) -> DataFrame:
    """stream_id, seq, bytes (of each part), reason and start of an error.

    A part that can't be written gives its error and no bytes, and the key
    goes on with the next part, in the plane it had.  Null text is empty.
    ``shards`` must stay the same for a query's checkpoint.
    """

    def run(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        texts = {k: x for k, *x in zip(*state.get, strict=True)} if state.exists else {}
        rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
        encoder, out = IncrementalEncoder("jis", conv_mode), []
        for own, number, numbered, part, end in zip(*(rows[c].tolist() for c in ("key", "seq", "numbered", "text", "final")), strict=True):
            if not numbered:
                out.append((own, None, None, NO_NUMBER, None))
                continue
            encoder.held, encoder.plane, last = texts.get(own, ("", 1, None))
            if last is not None and number <= last:
                out.append((own, number, None, OUT_OF_ORDER, None))
                continue
            plane = encoder.plane
            try:
                out.append((own, number, encoder.encode(part or "", bool(end)), None, None))
            except UnicodeEncodeError as e:
                encoder.held, encoder.plane = "", plane
                out.append((own, number, None, e.reason, e.start))
            if end:
                texts.pop(own, None)
            else:
                texts[own] = (encoder.held, encoder.plane, number)
        if texts:
            state.update(([*texts], *(list(x) for x in zip(*texts.values(), strict=True))))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["stream_id", "seq", "bytes", "reason", "start"], dtype=object).astype({"seq": "Int64", "start": "Int32"})

    # numbers without nulls, so that they stay whole numbers on their way
    number = F.col(seq).cast("long")
    parts = df.select(F.col(key).cast("string").alias("key"), F.coalesce(number, F.lit(0)).alias("seq"), number.isNotNull().alias("numbered"), F.col(text).alias("text"), F.coalesce(final, F.lit(False)).alias("final"))
    parts = parts.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    return parts.groupBy("shard").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
