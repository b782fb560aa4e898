"""Peer history of hosts as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

COLUMNS = ["host", "window_start", "n_peers", "n_new", "n_ever", "again", "n_previous"]
OUTPUT = "host string, window_start long, n_peers long, n_new long, n_ever long, again long, n_previous long"


class _History(StatefulProcessor):
    """State of a host: a row for each peer it ever had, the peers of its last window, and how many there are."""

    def __init__(self, idle_ms: int | None, ttl_ms: int | None):
        self.idle_ms, self.ttl_ms = idle_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.peers = handle.getMapState("peers", "peer string", "first long", self.ttl_ms)
        self.last = handle.getListState("last", "peer string")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        windows: dict[int, set] = {}
        for part in rows:
            for start, peers in part.groupby("window_start")["peer"]:
                windows.setdefault(int(start), set()).update(peers)
        ever = self.count.get()[0] if self.count.exists() else 0
        previous = {p for (p,) in self.last.get()} if self.last.exists() else set()
        known: dict[str, bool] = {}  # of this trigger: each peer is looked up once
        out = []
        for start in sorted(windows):
            met, new = windows[start], 0
            for peer in met:
                if not known.get(peer) and not self.peers.containsKey((peer,)):
                    self.peers.updateValue((peer,), (start,))
                    new += 1
                known[peer] = True
            ever += new
            out.append((str(key[0]), start, len(met), new, ever, len(met & previous), len(previous)))
            previous = met
        self.count.update((ever,))
        self.last.put([(p,) for p in sorted(previous)])
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            self.handle.registerTimer(max(windows) * 1000 + self.idle_ms)
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.peers.clear()
        self.last.clear()
        self.count.clear()
        yield pd.DataFrame([], columns=COLUMNS)

    def close(self) -> None:
        pass


def peer_history(windows: DataFrame, idle_seconds: int | None = None, ttl_seconds: int | None = None) -> DataFrame:
    """Novelty per host and window from rows ``host, window_start, peer``.

    A host's windows must arrive in order, each whole within one trigger (as the
    append output of a watermarked window does). The state is a row for each host
    and peer, written once, and a host's last window. With ``idle_seconds`` (which
    needs a watermark) a host is forgotten once the watermark passes its last
    window by that time; with ``ttl_seconds`` a peer is forgotten so long after it
    was first seen by the clock. Start the query within ``state.rocksdb``.
    """
    if idle_seconds is not None and ttl_seconds is not None:
        raise ValueError("a host is forgotten by event time or a peer by the clock, not both")
    mode = "EventTime" if idle_seconds is not None else "ProcessingTime" if ttl_seconds is not None else "None"
    history = _History(idle_seconds * 1000 if idle_seconds is not None else None, ttl_seconds * 1000 if ttl_seconds is not None else None)
    return windows.groupBy("host").transformWithStateInPandas(history, OUTPUT, "Append", mode)
