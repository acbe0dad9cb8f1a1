"""Conversation memory with list state: the newest turns of each conversation, with an age after which they go."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "conv_id long, turn long, text string, history string"


def rocksdb_state(spark: SparkSession) -> None:
    """Keep the states of queries that start from now on in RocksDB, outside the heap; list states need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def within_budget(turns: list[tuple[int, str, str]], max_chars: int) -> list[dict]:
    """The users' and assistants' turns of these, newest first as long as characters are left, the last one cut; in order."""
    left, kept = max_chars, []
    for _, role, text in reversed(turns):
        said = (text or "").strip() if role in ("user", "assistant") else ""
        said = said if len(said) <= left else said[:left].rstrip()
        if left and said:
            kept.insert(0, {"role": role, "content": said})
            left -= len(said)
    return kept


class Memory(StatefulProcessor):
    """Rows of a conversation in, its users' turns with the turns before them out."""

    def __init__(self, limit: int, max_chars: int, ttl_ms: int | None):
        self.limit, self.max_chars, self.ttl_ms = limit, max_chars, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "turn long, role string, text string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        held = sorted(tuple(t) for t in self.turns.get()) if self.turns.exists() else []
        new = pd.concat(list(rows)).sort_values("turn", kind="stable")
        out = []
        for turn, role, text in zip(new["turn"].tolist(), new["role"], new["text"], strict=True):
            if role == "user":
                before = [h for h in held if h[0] < turn][-self.limit :]
                out.append((key[0], turn, text, json.dumps(within_budget(before, self.max_chars), ensure_ascii=False)))
            held = sorted([h for h in held if h[0] != turn] + [(turn, role, text)])[-self.limit :]
        self.turns.put(held)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "text", "history"])

    def close(self) -> None:
        pass


def stream_turns(turns: DataFrame, limit: int = 6, max_chars: int = 6000, ttl_days: float | None = None) -> DataFrame:
    """A stream of (conv_id, turn, role, text) to self-contained questions: (conv_id, turn, text, history as JSON).

    The state of a conversation is a list of its newest `limit` turns, written once for each batch that it has rows in.
    With ttl_days the turns of a conversation that has said nothing for so long go by themselves, without a timer or
    a batch of its own. Turns of a batch are taken in order; a late one gets its place, and what was emitted stays as it
    was. The session must keep its states in RocksDB, see rocksdb_state(). With ttl_days, a run with trigger(availableNow)
    ends only with spark.sql.streaming.noDataMicroBatches.enabled off.
    """
    ttl = None if ttl_days is None else int(ttl_days * 86_400_000)
    rows = turns.select("conv_id", "turn", "role", "text").groupBy("conv_id")
    return rows.transformWithStateInPandas(Memory(limit, max_chars, ttl), OUT, "Append", "None" if ttl is None else "ProcessingTime")
