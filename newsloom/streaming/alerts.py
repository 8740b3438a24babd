"""Alerts that a stream of mentions raises by itself: state per topic, and a timer at the end of each window."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.trends import judged

#: The state store that keyed state with timers needs; see :func:`keyed_state`.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The session with that state store, and as it was afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class WindowCounts(StatefulProcessor):
    """Counts of each window of a topic, given out once, with those of the window before, when the watermark passes its end.

    State holds the open windows and the last closed one. A topic without rows in a window is still heard once after a window
    with rows, so that a topic that vanished is seen to drop. Rows of closed windows are late and left out.
    """

    def __init__(self, millis: int) -> None:
        self.millis = millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", "start long", "n long, negative long, emotions string")

    def _counts(self, start: int) -> tuple[int, int, dict]:
        if not self.windows.containsKey((start,)):
            return 0, 0, {}
        n, negative, emotions = self.windows.getValue((start,))
        return n, negative, json.loads(emotions)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            starts = part["millis"] // self.millis * self.millis
            for start, own in part.groupby(starts):
                start = int(start)
                if start + self.millis <= closed:
                    continue
                n, negative, emotions = self._counts(start)
                for emotion, count in own["emotion"].value_counts().items():
                    emotions[emotion] = emotions.get(emotion, 0) + int(count)
                if n == 0:
                    self.handle.registerTimer(start + self.millis)
                self.windows.updateValue((start,), (n + len(own), negative + int((own["sentiment_group"] == "negative").sum()), json.dumps(emotions)))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        start = end - self.millis
        n, negative, emotions = self._counts(start)
        previous = self._counts(start - self.millis)[0]
        self.windows.removeKey((start - self.millis,))
        found = [(start, n, previous, negative, emotions)] if n or previous else []
        if n and not self.windows.containsKey((end,)):
            if end + self.millis <= timerValues.getCurrentWatermarkInMs():  # the next window has closed as well, without rows
                found.append((end, 0, n, 0, {}))
                self.windows.removeKey((start,))
            else:
                self.handle.registerTimer(end + self.millis)
        yield pd.DataFrame([{"topic_id": key[0], "topic_name": key[1], "start": at, "mention_count": now, "previous_count": before, "negative_count": bad,
                             "emotions": json.dumps(dict(sorted(said.items())))} for at, now, before, bad, said in found])

    def close(self) -> None:
        pass


def window_alerts(stream: DataFrame, ts: str = "published_at", hours: int = 24, delay: str = "1 hour") -> DataFrame:
    """Stream of the alerts of every window (aligned to the epoch) once it is closed; the same rules as for a table.

    ``stream`` has topic_id, topic_name, emotion, sentiment_group and ``ts``. Each alert comes once; the checkpoint carries state
    and timers over a restart. To be started under :func:`keyed_state`.
    """
    millis = hours * 3_600_000
    id_type = stream.schema["topic_id"].dataType.simpleString()
    rows = (stream.filter(F.col("topic_id").isNotNull()).withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
            .select("topic_id", "topic_name", "emotion", "sentiment_group", "_ts", F.unix_millis("_ts").alias("millis")))
    counts = rows.groupBy("topic_id", "topic_name").transformWithStateInPandas(
        WindowCounts(millis), f"topic_id {id_type}, topic_name string, start long, mention_count long, previous_count long, negative_count long, emotions string",
        "append", "eventTime")
    counts = counts.withColumn("emotion_distribution", F.from_json("emotions", "map<string,bigint>"))
    return judged(counts, F.timestamp_millis("start"), F.timestamp_millis(F.col("start") + millis)).drop("alert_status").withColumn("alert_status", F.lit("active"))
