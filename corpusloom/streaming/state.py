"""Keyed state with event-time timers: what was seen of a key within a time, exactly, whatever order rows come in."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB; a stream takes the setting along when it starts."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class _Seen(StatefulProcessor):
    """State of a key: rows that wait for the watermark, and the time of the last row that was answered. A timer is set for the
    earliest row that waits; where none does, for the time when the last row is out of reach, and then the key's state goes."""

    def __init__(self, within: int):
        self.within = within  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "id long, at long")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(i), int(a)) for frame in rows for i, a in zip(frame["id"], frame["micros"], strict=True)]
        if new:
            self.waiting.appendList(new)
            self._timer(min(a for _, a in new))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted({(a, i) for i, a in self.waiting.get()}) if self.waiting.exists() else []
        due = [x for x in held if x[0] // 1000 <= now]
        rest = held[len(due) :]
        last = self.last.get()[0] if self.last.exists() else None
        if due:
            out = []
            for at, i in due:
                out.append((i, last is not None and at - last <= self.within))
                last = at
            self.last.update((last,))
            if rest:
                self.waiting.put([(i, a) for a, i in rest])
            else:
                self.waiting.clear()
            yield pd.DataFrame({"key": [key[0]] * len(out), "id": [i for i, _ in out], "seen": [s for _, s in out]})
        if rest:
            self._timer(rest[0][0])
        elif last is not None and (last + self.within) // 1000 < now:
            self.last.clear()
        elif last is not None:
            self._timer(last + self.within + 1000)

    def _timer(self, at: int) -> None:
        self.handle.registerTimer(at // 1000)

    def close(self) -> None:
        pass


def seen_within(rows: DataFrame, key: str, row_id: str, ts: str, *, within: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """key, id, seen of each row of a stream once the watermark (``late`` behind the newest row) has passed it: whether the key's row before it,
    by time and id, is at most ``within`` older.

    Rows wait in state until then, so the order in which they come does not matter; rows that come behind the watermark are dropped,
    as Spark does. Rows of one key, id and time count once. Rows without a key, id or time are left out: they can be neither ordered nor found."""
    micros = rows.sparkSession.sql(f"SELECT unix_micros(timestamp'1970-01-01 00:00:00' + INTERVAL {within}) - unix_micros(timestamp'1970-01-01 00:00:00') AS n").first()["n"]
    timed = rows.where(F.col(key).isNotNull() & F.col(row_id).isNotNull() & F.col(ts).isNotNull())
    timed = timed.select(F.col(key).alias("key"), F.col(row_id).cast("long").alias("id"), F.col(ts).cast("timestamp").alias("at")).withWatermark("at", late)
    timed = timed.withColumn("micros", F.unix_micros("at"))
    kind = timed.schema["key"].dataType.simpleString()
    return timed.groupBy("key").transformWithStateInPandas(statefulProcessor=_Seen(micros), outputStructType=f"key {kind}, id long, seen boolean", outputMode="Append", timeMode="EventTime")


def run_to_files(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what there is now, into Parquet files at ``path`` that its checkpoint keeps account of."""
    with rocks(df.sparkSession):
        stream = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
