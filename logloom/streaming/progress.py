"""Counts and rates of a stream's batches."""

from __future__ import annotations

import logging

from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger("logloom")


class Progress(StreamingQueryListener):
    """Logs each batch's lines and rate, and keeps the totals; add it with spark.streams.addListener."""

    def __init__(self) -> None:
        self.lines = self.batches = 0

    def onQueryStarted(self, event) -> None:
        log.info("stream %s started", event.name or event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.lines += p.numInputRows
        self.batches += 1
        log.info("batch %d: %d lines, %.0f lines/s", p.batchId, p.numInputRows, p.processedRowsPerSecond or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        log.info("stream %s ended: %d lines in %d batches", event.id, self.lines, self.batches)
