"""A bounded shuffle buffer that lives across micro-batches.

Rows are dealt to shards by a hash of their ids. Each shard keeps a buffer of at most ``size`` rows as keyed
state. An arrival beyond that takes the place of a row drawn at random, and that row leaves; so rows of
different batches mix, and memory does not follow the stream. When nothing has arrived for ``idle_ms``, a timer
empties the buffer in a random order. The state is versioned with the stream's progress: a batch that is run again, or a
stream that is started again, sends each row exactly once.

The draws follow the seed, the shard and the number of rows the shard has seen.
"""

from __future__ import annotations

import random
import time
from collections.abc import Iterator
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from spanloom.functions.hashing import hex_number, order_key

# The state store that keyed state with timers needs.
STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)


class ShuffleBuffer(StatefulProcessor):
    """State of a shard: its rows by slot, and how many slots are filled, rows were seen and rows were sent."""

    def __init__(self, schema: T.StructType, size: int, seed: int, idle_ms: int) -> None:
        self.schema, self.size, self.seed, self.idle_ms = schema, size, seed, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot int", self.schema)
        self.counts = handle.getValueState("counts", "filled int, seen bigint, sent bigint")

    def _draw(self, shard: int, turn: int) -> random.Random:
        return random.Random(f"{self.seed}:{shard}:{turn}")

    def _out(self, rows: list[tuple], shard: int, sent: int) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=self.schema.fieldNames(), dtype=object)
        out["shard"] = shard
        out["place"] = range(sent, sent + len(rows))
        return out

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        (shard,) = key
        filled, seen, sent = self.counts.get() or (0, 0, 0)
        changed: dict[int, tuple] = {}
        for part in rows:
            leaving = []
            for row in part[self.schema.fieldNames()].itertuples(index=False, name=None):
                row = tuple(None if x is pd.NA or x != x else x for x in row)
                if filled < self.size:
                    slot, filled = filled, filled + 1
                else:
                    slot = self._draw(shard, seen).randrange(self.size)
                    leaving.append(changed.get(slot) or tuple(self.slots.getValue((slot,))))
                changed[slot] = row
                seen += 1
            if leaving:
                yield self._out(leaving, shard, sent)
                sent += len(leaving)
        for slot, row in changed.items():
            self.slots.updateValue((slot,), row)
        self.counts.update((filled, seen, sent))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        (shard,) = key
        filled, seen, sent = self.counts.get() or (0, 0, 0)
        order = list(range(filled))
        self._draw(shard, -seen).shuffle(order)
        rows = [tuple(self.slots.getValue((slot,))) for slot in order]
        self.slots.clear()
        self.counts.update((0, seen, sent + filled))
        if rows:
            yield self._out(rows, shard, sent)

    def close(self) -> None:
        pass


def buffered_shuffle(
    rows: DataFrame, *ids: str, size: int = 10_000, shards: int = 8, seed: int = 42, idle_ms: int = 1000
) -> DataFrame:
    """The rows of a stream in a new order, with ``shard`` and ``place`` (the position in the shard's order).

    The session must use the state store named by ``STATE_STORE``.
    """
    shard = (hex_number(order_key(seed, *ids), 1, 8) % shards).cast("int")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
    out = T.StructType([*schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("place", T.LongType())])
    return rows.withColumn("_shard", shard).groupBy("_shard").transformWithStateInPandas(
        statefulProcessor=ShuffleBuffer(schema, size, seed, idle_ms),
        outputStructType=out,
        outputMode="append",
        timeMode="processingTime",
    )


def write_shuffled(rows: DataFrame, path: str, state: str, every: str = "200 milliseconds") -> StreamingQuery:
    """Start writing a buffered stream to a table folder, each row exactly once."""
    writer = rows.writeStream.outputMode("append").format("parquet").option("path", path)
    return writer.option("checkpointLocation", state).trigger(processingTime=every).start()


def stop_when_drained(query: StreamingQuery, idle_ms: int, timeout_s: float = 600.0) -> None:
    """Stop a stream of finished input after the timers have emptied its buffers: after a batch without rows that
    began ``idle_ms`` behind the end of the last batch with rows."""
    give_up, busy_until = time.time() + timeout_s, time.time()
    try:
        while time.time() < give_up:
            for done in query.recentProgress:
                began = datetime.fromisoformat(done["timestamp"].replace("Z", "+00:00")).timestamp()
                if done["numInputRows"]:
                    busy_until = max(busy_until, began + done["batchDuration"] / 1000)
                elif began >= busy_until + idle_ms / 1000:
                    return
            if not query.isActive:
                raise query.exception() or RuntimeError("the stream was stopped")
            time.sleep(0.1)
        raise TimeoutError("the buffers were not drained in time")
    finally:
        query.stop()
