"""Ledgers of sessions in a stream's state: lines are added turn by turn, and a ledger that grows too long is compacted (OPS-10)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Lines above which a ledger is compacted, and what may be left of it at most.
LIMIT, LEFT = 50, 30

Compactor = Callable[[list[str]], list[str]]


def keep_last(lines: list[str]) -> list[str]:
    """A compactor for tests and for lack of a model: the last lines stay."""
    return lines[-LEFT:]


def compacted(lines: list[str], compact: Compactor) -> tuple[list[str], bool]:
    """A ledger after a turn, and whether it was compacted. An answer without lines, or a compactor that fails, leaves it as it is until the next turn."""
    if len(lines) <= LIMIT:
        return lines, False
    try:
        found = [x.strip() for x in compact(list(lines)) if x and x.strip()]
    except Exception:  # the model's errors are of any kind, and the turn must not be lost for them
        return lines, False
    return (found[:LEFT], True) if found else (lines, False)


def fold_ledger(turns: Iterable[list[str]], compact: Compactor) -> tuple[list[str], int]:
    """(lines, compactions) after all turns: the plain fold that the stream's state must equal."""
    lines, n = [], 0
    for added in turns:
        lines, done = compacted(lines + [x for x in added if x and x.strip()], compact)
        n += done
    return lines, n


class LedgerProcessor(StatefulProcessor):
    """State by session: the ledger's lines as a list, and counters. A batch's turns are taken in the order of `turn`; where idle_ms is set, a session
    without turns for so long (of processing time) is dropped by a timer."""

    def __init__(self, compact: Compactor, idle_ms: int | None = None):
        self.compact, self.idle_ms = compact, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getListState("lines", "line string")
        self.counts = handle.getValueState("counts", "turns long, compactions long, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns, compactions, due = self.counts.get() if self.counts.exists() else (0, 0, None)
        lines = [x[0] for x in self.lines.get()] if self.lines.exists() else []
        added = pd.concat([x[["turn", "lines"]] for x in rows]).sort_values("turn", kind="stable")
        for new in added["lines"]:
            lines, done = compacted(lines + [x for x in (new if new is not None else []) if x and x.strip()], self.compact)
            turns, compactions = turns + 1, compactions + done
        if self.idle_ms is not None:
            if due is not None:
                self.handle.deleteTimer(due)
            due = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(due)
        if lines:
            self.lines.put([(x,) for x in lines])
        self.counts.update((turns, compactions, due))
        yield pd.DataFrame({"session": [str(key[0])], "turns": [turns], "compactions": [compactions], "lines": [lines], "ended": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        turns, compactions, _ = self.counts.get()
        lines = [x[0] for x in self.lines.get()] if self.lines.exists() else []
        self.lines.clear()
        self.counts.clear()
        yield pd.DataFrame({"session": [str(key[0])], "turns": [turns], "compactions": [compactions], "lines": [lines], "ended": [True]})

    def close(self) -> None:
        pass


def ledger_stream(turns: DataFrame, compact: Compactor, idle_ms: int | None = None) -> DataFrame:
    """(session, turns, compactions, lines, ended) for each session that a batch has turns of (session, turn, lines array); needs the RocksDB state store.

    compact gets a ledger of more than LIMIT lines and gives back LEFT at most; more are cut off.
    """
    rows = turns.selectExpr("CAST(session AS STRING) AS session", "turn", "lines")
    return rows.groupBy("session").transformWithStateInPandas(
        LedgerProcessor(compact, idle_ms), "session string, turns long, compactions long, lines array<string>, ended boolean", "Update", "None" if idle_ms is None else "ProcessingTime"
    )
