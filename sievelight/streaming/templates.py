"""The template vocabulary as the state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.templates import ALIKE, MOST, Leaf, leaves

COLUMNS = ["replica", "size", "head", "seq", "masked", "number", "created"]
OUTPUT = "replica string, size int, head string, seq long, masked string, number long, created boolean"


class _Miner(StatefulProcessor):
    """State of a leaf: its open templates by number, the number of each masked message seen, and two counters."""

    def __init__(self, alike: float, most: int):
        self.alike, self.most = alike, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.templates = handle.getMapState("templates", "number long", "template string, joined long")
        self.seen = handle.getMapState("seen", "masked string", "number long")
        self.counters = handle.getValueState("counters", "next long, clock long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        lines = pd.concat(list(rows))[["seq", "masked"]].sort_values(["seq", "masked"], kind="stable")
        size = int(key[1])
        leaf: Leaf | None = None
        known: dict[str, int] = {}
        out = []
        for seq, masked in lines.itertuples(index=False):
            number, created = known.get(masked), False
            if number is None:
                stored = self.seen.getValue((masked,))
                number = stored[0] if stored is not None else None
            if number is None:
                if leaf is None:
                    leaf = Leaf(size, self.alike, self.most)
                    for (k,), (text, joined) in sorted(self.templates.iterator()):
                        leaf.restore(k, text, joined)
                    if self.counters.exists():
                        leaf.next, leaf.clock = self.counters.get()
                before = leaf.next
                number = leaf.place(masked)
                created = leaf.next > before
                self.seen.updateValue((masked,), (number,))
            known[masked] = number
            out.append((key[0], size, key[2], int(seq), masked, number, created))
        if leaf is not None:
            for number in leaf.closed:
                self.templates.removeKey((number,))
            for i in leaf.changed:
                self.templates.updateValue((int(leaf.numbers[i]),), (leaf.text(i), int(leaf.joined[i])))
            self.counters.update((leaf.next, leaf.clock))
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def mine(lines: DataFrame, alike: float = ALIKE, most: int = MOST) -> DataFrame:
    """Each line of ``replica, seq, message`` with its leaf, masked message, the template's number there, and whether it is new.

    Lines of a leaf must arrive in the order of ``seq`` from trigger to trigger;
    within one they are sorted. Numbers equal those of the batch
    (``operators.templates.assigned``) over all lines so far. A leaf's open
    templates are bounded; its masked messages are state, so that a message keeps
    its template. Start the query within ``state.rocksdb``.
    """
    keyed = leaves(lines, ["replica"]).select("replica", "size", "head", "seq", "masked")
    return keyed.groupBy("replica", "size", "head").transformWithStateInPandas(_Miner(alike, most), OUTPUT, "Append", "None")
