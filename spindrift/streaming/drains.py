"""Queries pinned to epochs, as a stream: when an epoch and all before it are drained.

State is keyed by node: for each epoch that still has queries, the latest end of any. A timer at that end fires once the watermark has passed it,
so no query that could still come in time ends later; the epoch then leaves the state. Queries that come after that, within the watermark's
delay, open it again, and its later end is told too: the last row of an epoch is its drain time. What is later than the delay is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spindrift.shipping import ship

OUT = "node long, epoch long, done_us long"


class Drain(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getMapState("ends", "epoch long", "done_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for epoch, done in part.groupby("epoch")["done_us"].max().items():
                k = (int(epoch),)
                if not self.ends.containsKey(k) or self.ends.getValue(k)[0] < done:
                    self.ends.updateValue(k, (int(done),))
                    self.handle.registerTimer(-(-int(done) // 1000))
        yield pd.DataFrame({"node": [], "epoch": [], "done_us": []}).astype("int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # all that the watermark has passed goes with the first timer, so that many timers do not read the map again and again
        at = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        over = [(int(k[0]), int(v[0])) for k, v in self.ends.iterator() if v[0] <= at * 1000]
        for epoch, _ in over:
            self.ends.removeKey((epoch,))
        yield pd.DataFrame({"node": [int(key[0])] * len(over), "epoch": [e for e, _ in over], "done_us": [d for _, d in over]}).astype("int64")

    def close(self) -> None:
        pass


def drains(pinned: DataFrame, late: str = "1 hour") -> DataFrame:
    """pinned: a stream of node, epoch, ts, done_us. node, epoch, done_us when the watermark has passed an epoch's last end."""
    rows = pinned.select("node", "epoch", "ts", "done_us").withWatermark("ts", late)
    return rows.groupBy("node").transformWithStateInPandas(Drain(), OUT, "append", "EventTime")


def drained(spark: SparkSession, told: DataFrame) -> DataFrame:
    """epoch, drained_us from the stream's rows: the last end of the epoch or an earlier one on any node. A row per epoch and node at most
    is kept, so the running maximum is over epochs, of which there are few (reconfigurations)."""
    from pyspark.sql import Window

    last = told.groupBy("epoch").agg(F.max("done_us").alias("done"))
    return last.select("epoch", F.max("done").over(Window.orderBy("epoch")).alias("drained_us"))


def run(pinned: DataFrame, table: str, checkpoint: str, late: str = "1 hour"):
    """The started query that appends drains() to a table, all that is there at a time."""
    spark = ship(pinned.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    w = drains(pinned, late).writeStream.format("parquet").outputMode("append").option("path", table).option("checkpointLocation", checkpoint)
    return w.trigger(availableNow=True).start()
