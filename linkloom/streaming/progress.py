"""Crawl rates of running streams, from their progress reports."""

from __future__ import annotations

import time

from pyspark.sql.streaming import StreamingQueryListener


class Rates(StreamingQueryListener):
    """Rows per second since the start, per stream name.

    Register with ``spark.streams.addListener(rates)``.
    """

    def __init__(self, clock=time.time):
        self._clock = clock
        self._start: dict[str, float] = {}
        self._rows: dict[str, int] = {}

    def onQueryStarted(self, event):
        name = event.name or str(event.id)
        self._start.setdefault(name, self._clock())
        self._rows.setdefault(name, 0)

    def onQueryProgress(self, event):
        name = event.progress.name or str(event.progress.id)
        self._rows[name] = self._rows.get(name, 0) + event.progress.numInputRows

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def rates(self) -> dict[str, float]:
        """Two decimals, ties to even."""
        now = self._clock()
        return {
            name: round(self._rows[name] / (now - start) * 100) / 100
            for name, start in self._start.items()
            if now > start
        }
