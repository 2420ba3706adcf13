"""Keyed state in the order of event time, whatever files and micro-batches the events come in.

Rows wait in a list state until the watermark has passed them. An event-time timer then takes a key's rows in their order through a step
function, and a second one, at a time that the state names, forgets the state. The allowed lateness is the watermark's delay; a replay, whose files are in no order
of time at all, takes a delay longer than the data and closes with a clock row, which moves the watermark behind the last event.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..sources.shared import shared_path

#: The clock row's time; no event may be as late.
CLOSING = datetime.datetime(2200, 1, 1, tzinfo=datetime.UTC)
REPLAY_DELAY = "3650 days"
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedFold(StatefulProcessor):
    """Rows (columns: the event's microseconds `at`, then the rest) go by (at, next column) through step(state, row) -> (state, values). forget(state) is the
    microsecond from which on the state is as good as the first one, None if never."""

    def __init__(self, columns: list[str], waiting: str, state: str, start: tuple, names: list[str], step: Callable, forget: Callable[[tuple], int | None]):
        self.columns, self.waiting_schema, self.state_schema, self.start, self.names, self.step, self.forget = columns, waiting, state, start, names, step, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)
        self.state = handle.getValueState("state", self.state_schema)

    def wake(self, micros: int) -> None:
        """Have one timer: the earliest."""
        at, have = micros // 1000 + 1, sorted(self.handle.listTimers())
        if not have or at < have[0]:
            for t in have:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for part in rows:
            # plain lists: a key has few rows, and pandas' own checks and rows cost more than they do
            come = list(zip(*(part[c].tolist() for c in self.columns), strict=True))
            if any(x is None or x != x for r in come for x in r):
                raise ValueError("a row in event-time order has a null; give such columns a value of their own")
            if come:
                self.waiting.appendList(come)
                first = min(x for x in (first, min(r[0] for r in come)) if x is not None)
        if first is not None:
            self.wake(first)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        every = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2])
        due, later = [r for r in every if r[0] < passed], [r for r in every if r[0] >= passed]
        known = self.state.get()
        now, out = self.start if known is None else tuple(known), []
        for row in due:
            now, values = self.step(now, row)
            out.append((*key, *values))
        self.waiting.put(later) if later else self.waiting.clear()
        end = self.forget(now)
        if end is not None and end < passed:
            self.state.clear()
        else:
            self.state.update(now)
        ahead = [r[0] for r in later[:1]] + ([end] if end is not None and end >= passed else [])
        if ahead:
            self.handle.registerTimer(min(ahead) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=self.names)


def clock(spark: SparkSession, path: str, rows: list) -> None:
    spark.createDataFrame(rows, "ts timestamp").write.mode("append").parquet(path)


def replayed(events: DataFrame, key: str, columns: list[str], state: str, start: tuple, out: str, step: Callable, forget: Callable[[tuple], int | None] = lambda state: None) -> DataFrame:
    """events: a stream with ts (timestamp), key and columns, none of them null (a null is an error). Each event in the order of (ts, first of columns) goes through step(state, (microseconds, *columns)).
    The result has key and `out`. Run to the end of what is there; state and output are in the shared folder, so a restart goes on where it was."""
    spark, path = events.sparkSession, shared_path(events.sparkSession, "ordered")
    clock(spark, f"{path}-clock", [])
    ticks = spark.readStream.schema("ts timestamp").parquet(f"{path}-clock")
    given = events.select(key, "ts", *columns).unionByName(ticks, allowMissingColumns=True).withWatermark("ts", REPLAY_DELAY)
    # a condition on ts stays above the watermark, so the clock row moves it and goes no further
    rows = given.filter(F.col("ts") < F.lit(CLOSING)).select(key, "ts", F.unix_micros("ts").alias("at"), *columns)
    waiting = StructType([rows.schema[c] for c in ("at", *columns)])
    kinds = StructType([rows.schema[key], *StructType.fromDDL(out).fields])
    fold = OrderedFold(["at", *columns], waiting, state, start, kinds.names, step, forget)
    done = rows.groupBy(key).transformWithStateInPandas(fold, kinds, "Append", "EventTime")
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        for ticked in ([], [(CLOSING + datetime.timedelta(days=3660),)]):
            if ticked:
                clock(spark, f"{path}-clock", ticked)
            q = done.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    return spark.read.schema(kinds).parquet(path)
