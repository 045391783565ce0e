"""Structured Streaming jobs: stalls, failure streaks, live progress and incremental ingestion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STALL_SECONDS = 600
#: The setting of the state store that ``stall_alerts`` needs, and its value.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def progress_counts(events: DataFrame, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Events by experiment and window; rows later than ``delay`` are dropped. Works on streams and tables."""
    timed = events.withWatermark("ts", delay) if events.isStreaming else events
    return timed.groupBy(F.window("ts", window).alias("w"), "experiment").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("failed")).select("experiment", F.col("w.start").alias("start"), "n", "failed")


def stalls(events: DataFrame, limit: str = f"{STALL_SECONDS} seconds", delay: str = "1 hour") -> DataFrame:
    """Sessions of an experiment: one ends (a stall, reported once) when nothing has come for ``limit``."""
    timed = events.withWatermark("ts", delay) if events.isStreaming else events
    return timed.groupBy(F.session_window("ts", limit).alias("w"), "experiment").agg(F.count("*").alias("n")).select("experiment", F.col("w.start").alias("start"), F.col("w.end").alias("stalled_at"), "n")


def stalls_batch(events: DataFrame, seconds: int = STALL_SECONDS) -> DataFrame:
    """The same over a table: an event that no other follows within ``seconds``."""
    ts = F.col("ts").cast("timestamp")
    gap = F.lead(ts).over(Window.partitionBy("experiment").orderBy("ts", "event_id")).cast("double") - ts.cast("double")
    return events.withColumn("gap", gap).where(F.col("gap").isNull() | (F.col("gap") >= seconds)).select("experiment", "event_id", "ts")


class _Silence(StatefulProcessor):
    """Runs of events, of which each follows the one before in time: what is in a run's midst has been followed, its last event may yet be.

    A key is one experiment or, where rows name theirs, a bucket of them. Its open runs are one value and have one timer, which is set for
    the first that ends, so a batch costs a few calls of the state store for each key, however many events and experiments it has, and
    the runs of all are worked out at once. A run whose last event no other followed in time is reported once.
    """

    COLUMNS = ("experiment", "first", "last", "event_id")

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", ", ".join(f"{c} array<long>" for c in self.COLUMNS))
        self.due = handle.getValueState("due", "ms long")

    def _runs(self) -> pd.DataFrame:
        """Each experiment's runs: the first event's time, the last one's time and id."""
        held = self.open.get() if self.open.exists() else ([], [], [], [])
        return pd.DataFrame({c: np.array(v, dtype=np.int64) for c, v in zip(self.COLUMNS, held, strict=True)})

    def _ends(self, runs: pd.DataFrame) -> pd.Series:
        return -(-runs["last"] // 1000) + self.limit_ms

    def _keep(self, runs: pd.DataFrame, due: int | None) -> None:
        """Runs as the state, with a timer for the first that ends; ``due`` is that of the timer at hand."""
        if runs.empty:
            self.open.clear()
            self.due.clear()
            return
        self.open.update(tuple(runs[c].tolist() for c in self.COLUMNS))
        first = int(self._ends(runs).min())
        if first != due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(first)
            self.due.update((first,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(rows)
        # Events without an experiment have a key of their own, in which the number stands for nothing.
        whose = seen["experiment"].fillna(0) if "experiment" in seen else key[0]
        came = pd.DataFrame({"experiment": whose, "first": seen["us"], "last": seen["us"], "event_id": seen["event_id"]})
        runs = pd.concat([self._runs(), came.astype("int64")]).sort_values(["experiment", "first"], ignore_index=True)
        upto = runs.groupby("experiment")["last"].cummax().shift(fill_value=0)
        fresh = ~runs["experiment"].duplicated() | (runs["first"] - upto >= self.limit_ms * 1000)
        runs["run"] = fresh.cumsum()
        ended = runs.sort_values(["run", "last", "event_id"]).drop_duplicates("run", keep="last").reset_index(drop=True)
        ended["first"] = runs.loc[fresh, "first"].to_numpy()
        self._keep(ended, self.due.get()[0] if self.due.exists() else None)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The watermark is past the timer: whatever may follow a run that is due by then has come. All due runs are settled at once."""
        runs = self._runs()
        over = self._ends(runs) <= timerValues.getCurrentWatermarkInMs()
        self._keep(runs[~over], None)
        found = runs[over]
        whose = pd.Series(None, found.index, dtype="object") if key[0] is None else found["experiment"]
        yield pd.DataFrame({"experiment": whose, "event_id": found["event_id"], "ts": pd.to_datetime(found["last"], unit="us")})

    def close(self) -> None:
        pass


#: Buckets of experiments in :func:`stall_alerts`: the keys of its state, so a stream that goes on from a checkpoint must keep their number.
BUCKETS = 512


def stall_alerts(events: DataFrame, seconds: int = STALL_SECONDS, delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """(experiment, event_id, ts) of a stream: an event that no other of its experiment follows within ``seconds``, once the watermark has passed that time.

    The same events as ``stalls_batch``, but for those for which the stream hasn't moved on yet. Events may come late by ``delay``; a
    repeated event counts once. State is what may still be followed, in the RocksDB state store (``ROCKSDB``), which the session must name.
    Experiments share ``buckets`` keys of the state, since each key costs calls between Python and the store.
    """
    bucket = F.when(F.col("experiment").isNotNull(), F.pmod(F.xxhash64("experiment"), F.lit(buckets)))
    timed = events.withWatermark("ts", delay).where("ts is not null").select(bucket.alias("bucket"), "experiment", "event_id", "ts", F.unix_micros("ts").alias("us"))
    return timed.groupBy("bucket").transformWithStateInPandas(_Silence(seconds * 1000), "experiment long, event_id long, ts timestamp", "Append", "EventTime")


def failure_streaks(events: DataFrame, least: int = 3) -> DataFrame:
    """An alert when an experiment's failures in a row reach ``least``; a success resets the count. State: one number."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        alerts = []
        for ok, event in zip(rows["ok"], rows["event_id"]):
            count = 0 if ok else count + 1
            if count == least:
                alerts.append((key[0], int(event)))
        state.update((count,))
        yield pd.DataFrame(alerts, columns=["experiment", "event_id"])

    return events.groupBy("experiment").applyInPandasWithState(run, "experiment long, event_id long", "n int", "append", GroupStateTimeout.NoTimeout)


def ingest_stream(documents: DataFrame, path: str, checkpoint: str, chunker: Callable[[DataFrame], DataFrame]):
    """New documents (doc, text, ts) are chunked once and appended; a repeated batch replaces its own output."""
    fresh = documents.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["doc"])

    def write(batch: DataFrame, number: int) -> None:
        chunker(batch.select("doc", "text")).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
