"""Streaming forms of two batch operators.

``slot_counts`` is the detector sum by quarter of an hour; ``last_values`` keeps each site's latest rows in list state.
Both are changes of a result; ``roadflow.streaming.files`` runs them from files to files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from roadflow.session import ship

#: State of ``last_values``: time in microseconds, what orders rows of one time, value.
HELD = "t long, o long, v double"
LATEST = "site long, age int, t long, o long, v double"


def slot_counts(events: DataFrame, ts: str, site: str, value: str, late: str = "30 minutes") -> DataFrame:
    """(site, slot_start, n, total) for each tumbling quarter of an hour; rows later than the watermark are dropped.

    Also works on a batch frame, with equal results.
    """
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp"))
    marked = stamped.withWatermark(ts, late) if events.isStreaming else stamped
    return marked.groupBy(F.col(site), F.window(ts, "15 minutes")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(site, F.col("window.start").alias("slot_start"), "n", "total")


class Latest(StatefulProcessor):
    """The latest n rows of a key as a list state, and an event-time timer that forgets a key once nothing has come for a while."""

    def __init__(self, n: int, idle_ms: int):
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", HELD)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [tuple(r) for r in self.held.get()]
        for f in rows:
            kept += zip(f["t"].tolist(), f["o"].tolist(), f["v"].tolist())
            kept = sorted(set(kept), key=lambda r: r[:2])[-self.n :]  # a row that comes twice is one row
        self.held.put(kept)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(kept[-1][0] // 1000 + self.idle_ms)
        yield pd.DataFrame([(key[0], len(kept) - i, *r) for i, r in enumerate(kept)], columns=["site", "age", "t", "o", "v"]).astype({"age": "int32"})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def last_values(events: DataFrame, ts: str, site: str, value: str, order: str, n: int = 24, late: str = "30 minutes", idle: str = "7 days") -> DataFrame:
    """(site, age, t, o, v): after each trigger the latest n rows of every site that got rows; age 1 is the latest.

    Rows are ordered by time and ``order`` (a whole number that tells rows of one time apart), so they may come in any order within
    the watermark; later ones are dropped by Spark.  A site that was silent for ``idle`` is forgotten.  State: n rows of a key.
    """
    ship(events.sparkSession)
    stamped = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    slim = stamped.select(F.col(site).cast("long").alias("site"), "_ts", F.unix_micros("_ts").alias("t"), F.col(order).cast("long").alias("o"), F.col(value).cast("double").alias("v"))
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return slim.withWatermark("_ts", late).groupBy("site").transformWithStateInPandas(Latest(n, idle_ms), LATEST, "Update", "EventTime")
