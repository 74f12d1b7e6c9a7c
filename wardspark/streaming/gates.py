"""The same live: a window for each run of edits, and the gate of each session as state."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.gates import STEPS

EDIT = "session string, at timestamp, seq long, text string"
GATE = "session string, at timestamp, seq long, step string, state string"
#: A character that is no white space, that beyond ASCII included.
_SAID = "[^\\t-\\r\\x1c-\\x20\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
_MICROSECOND = dt.timedelta(microseconds=1)


def _events(rows: Iterator[pd.DataFrame]) -> list[dict]:
    return sorted((r for part in rows for r in part.to_dict("records")), key=lambda r: (r["at"], r["seq"]))


class Gate(StatefulProcessor):
    """The state of a session's gate, moved by STEPS."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = self.state.get()[0] if self.state.exists() else "none"
        out = []
        for e in _events(rows):
            now = STEPS.get((e["step"], now), now)
            out.append((key[0], e["at"], e["seq"], e["step"], now))
        # The first state needs no memory, so sessions without files leave none.
        self.state.update((now,)) if now != "none" else self.state.clear()
        yield pd.DataFrame(out, columns=["session", "at", "seq", "step", "state"])

    def close(self) -> None:
        pass


def debounced_live(edits: DataFrame, pause: dt.timedelta = dt.timedelta(milliseconds=300), lateness: str = "1 minute") -> DataFrame:
    """EDIT rows of a stream of edits that nothing follows within the pause; they come out once the watermark has passed it.

    Edits that follow each other within the pause are one window of the session, and its last one passes. Windows meet
    at their ends, so they reach a microsecond, the least step of time, less far than the pause.
    """
    rows = edits.where("session is not null and at is not null").select(*[x.split()[0] for x in EDIT.split(", ")]).withWatermark("at", lateness)
    gap = F.session_window("at", f"{(pause - _MICROSECOND) // _MICROSECOND} microseconds")
    last = rows.groupBy("session", gap).agg(F.max(F.struct("at", "seq", "text")).alias("last"))
    return last.select("session", "last.at", "last.seq", "last.text").where(F.col("text").rlike(_SAID))


def gates_live(steps: DataFrame) -> DataFrame:
    """GATE rows: each step of a stream with the state after it."""
    rows = steps.where(F.col("session").isNotNull()).select("session", "at", "seq", "step")
    return rows.groupBy("session").transformWithStateInPandas(Gate(), GATE, "Append", "None")
