"""Usage and offers as streams: windows with watermarks, messages counted once, and offers claimed with state and expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.offers import WINDOW

LATE = "10 minutes"


def tumbling(events: DataFrame, size: str = "1 hour", late: str = LATE, slide: str | None = None, key: str = "event_type", value: str = "value") -> DataFrame:
    """events: ts (a timestamp), key, value. Counts and sums per window and key; with slide, overlapping windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "key", "n", "total")


def session_windows(events: DataFrame, gap: str = "15 minutes", late: str = LATE, key: str = "user_id") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "key", "n")


def once(events: DataFrame, key: str = "message_id", late: str = LATE) -> DataFrame:
    """Each key's first event; repeats within the watermark's delay are dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


class OfferClaims(StatefulProcessor):
    """Per path: a stack of offers that stand. A read takes the newest; a timer forgets those that are over."""

    def __init__(self, window: int = WINDOW):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stack = handle.getListState("stack", "ts long, id long, full long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["sec", "id"])
        stack, out = [tuple(x) for x in self.stack.get()], []
        for sec, id_, kind, full, served in events[["sec", "id", "kind", "tokens_full", "tokens_served"]].itertuples(index=False):
            if kind == "suggested":
                stack.append((int(sec), int(id_), int(full)))
            elif stack and stack[-1][0] >= sec - self.window:
                at, offer, cost = stack.pop()
                out.append((key[0], int(id_), offer, int(sec), max(0, cost - int(served))))
            else:
                stack = []
        last = int(events["sec"].max())
        stack = [x for x in stack if x[0] >= last - self.window]
        if stack:
            self.stack.put(stack)
            self.handle.registerTimer((stack[-1][0] + self.window) * 1000)
        else:
            self.stack.clear()
        if out:
            yield pd.DataFrame(out, columns=["path", "read_id", "offer_id", "ts", "saved"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        stack = [tuple(x) for x in self.stack.get() if x[0] > now - self.window]
        if stack:
            self.stack.put(stack)
        else:
            self.stack.clear()
        return iter(())

    def close(self) -> None:
        pass


CLAIM = "path string, read_id long, offer_id long, ts long, saved long"


def offer_claims(events: DataFrame, window: int = WINDOW, late: str = LATE) -> DataFrame:
    """events: at (timestamp), sec, id, kind, path, tokens_full, tokens_served, in order of time per path but for what the watermark allows within a batch."""
    return events.withWatermark("at", late).groupBy("path").transformWithStateInPandas(OfferClaims(window), CLAIM, "append", "eventTime")


PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(df: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there now into a Parquet table, and reads that. State is kept in RocksDB, as lists and timers need it."""
    spark = df.sparkSession
    was = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        query = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, was) if was else spark.conf.unset(PROVIDER)
    return spark.read.schema(df.schema).parquet(out)
