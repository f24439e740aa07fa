"""Conversation memory as keyed state of a stream: the last messages of each conversation, kept over restarts and forgotten after a time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import rules

KEPT = "conv_id long, turn long, role string, text string, place int"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastMessages(StatefulProcessor):
    """The messages of a conversation with the highest turns, most of them at most, in a list state with a time to live."""

    def __init__(self, most: int, forget_ms: int):
        self.most, self.forget_ms = most, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.messages = handle.getListState("messages", "turn long, role string, text string", ttlDurationMs=self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = [tuple(m) for m in self.messages.get()] if self.messages.exists() else []
        for part in rows:
            new = [(int(t), r, x) for t, r, x in part[["turn", "role", "text"]].itertuples(index=False)]
            last = sorted([*last, *new], key=lambda m: m[0])[-self.most :]
        self.messages.put(last)
        out = pd.DataFrame(last, columns=["turn", "role", "text"])
        yield out.assign(conv_id=key[0], place=range(len(last)))[["conv_id", "turn", "role", "text", "place"]]

    def close(self) -> None:
        pass


def remembered(turns: DataFrame, most: int = rules.MESSAGES, forget: int | None = None) -> DataFrame:
    """(conv_id, turn, role, text, place) of a stream of turns (conv_id, turn, role, text): with each batch, what is now kept of every conversation it has rows of.

    The rows of a conversation that come last for it are its memory, place 0 the oldest. A turn that comes late takes the place its number
    gives it; of equal turns the later row counts as later. Rows without conv_id or turn are left out. Conversations without a new row
    for forget seconds of processing time are forgotten (None: never). The session's state store has to be RocksDB (STORE);
    with a time to forget, a query that is to end by itself needs spark.sql.streaming.noDataMicroBatches.enabled to be false.
    """
    rows = turns.select("conv_id", "turn", "role", "text").where("conv_id is not null and turn is not null")
    forget_ms = forget * 1000 if forget else None
    return rows.groupBy("conv_id").transformWithStateInPandas(LastMessages(most, forget_ms), outputStructType=KEPT, outputMode="Update", timeMode="ProcessingTime" if forget else "None")
