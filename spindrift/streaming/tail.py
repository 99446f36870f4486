"""Live tail: filtered rows of a stream go to bounded buffers of subscribers and never hold ingest up."""

from __future__ import annotations

import threading
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from spindrift.functions.filters import matches
from spindrift.operators.search import Selector, newest


@dataclass
class Subscriber:
    """A ring of rows; the oldest fall out when it is full and are counted."""

    selector: Selector
    query: str = ""
    capacity: int = 5000
    per_batch: int = 1000
    rows: deque = field(default_factory=deque)
    dropped: int = 0
    lock: threading.Lock = field(default_factory=threading.Lock)

    def predicate(self, columns: list[str]) -> Column:
        return self.selector.column(columns) & matches("msg", self.query)

    def offer(self, rows: list, beyond: int) -> None:
        with self.lock:
            self.dropped += beyond
            for r in rows:
                if len(self.rows) >= self.capacity:
                    self.rows.popleft()
                    self.dropped += 1
                self.rows.append(r)

    def drain(self) -> tuple[list, int]:
        """Rows so far, oldest first, and how many were dropped since the last time."""
        with self.lock:
            rows, dropped = list(self.rows), self.dropped
            self.rows.clear()
            self.dropped = 0
        return rows, dropped


class Bus:
    """Feeds subscribers from micro-batches; the driver takes ``per_batch`` rows of each at most."""

    def __init__(self, most: int = 200):
        self.most, self.subscribers = most, []
        self.lock = threading.Lock()

    def subscribe(self, s: Subscriber) -> Subscriber:
        with self.lock:
            if len(self.subscribers) >= self.most:
                raise RuntimeError("too many subscribers")
            self.subscribers.append(s)
        return s

    def unsubscribe(self, s: Subscriber) -> None:
        with self.lock:
            self.subscribers = [x for x in self.subscribers if x is not s]

    def publish(self, batch: DataFrame, batch_id: int = 0) -> None:
        with self.lock:
            now = list(self.subscribers)
        if not now:
            return
        batch = batch.persist()
        try:
            for s in now:
                own = batch.filter(s.predicate(batch.columns))
                rows = newest(own, s.per_batch).collect()[::-1]
                s.offer(rows, own.count() - len(rows) if len(rows) == s.per_batch else 0)
        finally:
            batch.unpersist()

    def start(self, stream: DataFrame, checkpoint: str, once: bool = False):
        writer = stream.writeStream.foreachBatch(self.publish).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="500 milliseconds")).start()
