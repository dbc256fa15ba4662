"""Stateful streams: count-or-timeout batches and windows measured from their first event."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class MessageBatcher(StatefulProcessor):
    """Emit a key's messages as one ``[i] text`` block when enough have come or time is up."""

    def __init__(self, size: int = 5, timeout_ms: int = 30_000):
        self.size, self.timeout_ms = size, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # At most ``size`` messages wait per key.
        self.waiting = handle.getListState("waiting", "text string")

    def _block(self, key, texts: list[str]) -> pd.DataFrame:
        block = "\n".join(f"[{i}] {t}" for i, t in enumerate(texts, 1))
        return pd.DataFrame({"key": [str(key[0])], "n": [len(texts)], "block": [block]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        texts = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        if not texts:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        for pdf in rows:
            for text in pdf["text"]:
                texts.append(text)
                if len(texts) >= self.size:
                    yield self._block(key, texts)
                    texts = []
        if texts:
            self.waiting.put([(t,) for t in texts])
        else:
            self.waiting.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        texts = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        self.waiting.clear()
        if texts:
            yield self._block(key, texts)

    def close(self) -> None:
        pass


def batched(messages: DataFrame, key: str, size: int = 5, timeout_ms: int = 30_000) -> DataFrame:
    """(key, n, block) of a stream with a ``text`` column; needs the RocksDB state store."""
    return messages.groupBy(key).transformWithStateInPandas(
        statefulProcessor=MessageBatcher(size, timeout_ms),
        outputStructType="key string, n long, block string",
        outputMode="Append",
        timeMode="ProcessingTime",
    )


class EpisodeAssigner(StatefulProcessor):
    """Give each event the start of its episode: open for ``window`` seconds since its first event."""

    def __init__(self, window: float = 1800.0):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.start = handle.getValueState("start", "started_at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start = self.start.get()[0] if self.start.exists() else None
        for pdf in rows:
            pdf = pdf.sort_values(["ts", "event_id"])
            starts = []
            for t in pdf["ts"]:
                if start is None or t - start >= self.window:
                    start = t
                starts.append(start)
            yield pd.DataFrame({"event_id": pdf["event_id"], "episode_start": starts})
        self.start.update((start,))

    def close(self) -> None:
        pass


def episodes(events: DataFrame, key: str, window: float = 1800.0) -> DataFrame:
    """(event_id, episode_start) of a stream (key, event_id, ts double).

    State is one number per key; rows are folded as they arrive in Arrow batches.
    """
    return events.groupBy(key).transformWithStateInPandas(
        statefulProcessor=EpisodeAssigner(window),
        outputStructType="event_id long, episode_start double",
        outputMode="Append",
        timeMode="None",
    )
