"""Structured Streaming forms of sessions, rates, file detection and the question stream."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import events as E


def event_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def idle_sessions(events: DataFrame, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Sessions end after an idle gap; the watermark lets their state go (a cap on the number of sessions would need one task)."""
    return E.sessions(events.withWatermark("start", late), gap)


def request_rate(events: DataFrame, width: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("start", late).groupBy(F.window("start", width).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), "n", "total")


class _Cooldown(StatefulProcessor):
    """One number a user: the time of the last request that was accepted; a timer lets it go when the cooldown is over for certain."""

    def __init__(self, micros: int):
        self.micros = micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows)).sort_values(["at", "event_id"], kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        said = []
        for at in frame["at"].tolist():
            free = last is None or at - last >= self.micros
            last = at if free else last
            said.append(free)
        self.last.update((last,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer((last + self.micros) // 1000 + 1)
        yield pd.DataFrame({"event_id": frame["event_id"], "user_id": key[0], "accepted": said})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        yield pd.DataFrame({"event_id": [], "user_id": [], "accepted": []}).astype({"event_id": "int64", "user_id": "int64", "accepted": "bool"})

    def close(self) -> None:
        pass


def cooldown(events: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """event_id, user_id, accepted: the streaming form of ``events.cooled``.

    Requests are decided in order of time within a micro-batch; one that comes in a later batch than a newer accepted one is refused if
    less than the cooldown lies between them, and dropped if it is behind the watermark. Rows without a user or a time are left out. State of this kind
    needs the RocksDB store (``spark.sql.streaming.stateStore.providerClass``).
    """
    if not events.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider"):
        raise ValueError("spark.sql.streaming.stateStore.providerClass must name the RocksDB provider")
    rows = events.where("start IS NOT NULL AND user_id IS NOT NULL").withWatermark("start", late)
    narrow = rows.select("user_id", "event_id", "start", F.unix_micros("start").alias("at"))
    return narrow.groupBy("user_id").transformWithStateInPandas(_Cooldown(seconds * 1_000_000), "event_id long, user_id long, accepted boolean", "Append", "EventTime")


def once(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return its result."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def answer_stream(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], audit_folder: str, checkpoint: str):
    """Each micro-batch of questions is answered as a batch plan and appended to the audit table, once."""

    def batch(rows: DataFrame, number: int) -> None:
        answer(rows).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{audit_folder}/batch={number}")

    return questions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
