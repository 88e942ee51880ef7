"""Alert state over a stream of ticks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.alerts import RULE_FIELDS, STATE_COLUMNS, STATE_DDL, AlertMachine

ROWS = 10_000  # fixed: ticks in one frame of the result


class AlertProcessor(StatefulProcessor):
    """Keeps one machine per alert: state, time fired, level, last notice, last condition, recent changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("machine", "state string, fired_us bigint, level int, last_us bigint, last_on boolean, changes array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stamp = lambda us: None if us is None else pd.Timestamp(us, unit="us")
        micros = lambda ts: None if ts is None else ts.value // 1000
        # of the ticks, time and condition are kept until all are in order; the rule is that of the first one
        at, on, rule = [], [], None
        for frame in rows:
            k = frame["tick_at"].argmin()
            if rule is None or frame["tick_at"].iloc[k] < rule[0]:
                rule = frame["tick_at"].iloc[k], {f: frame[f].iloc[k] for f in RULE_FIELDS}
            at.append(frame["tick_at"].to_numpy())
            on.append(frame["triggered"].to_numpy(bool))
        at, on = np.concatenate(at), np.concatenate(on)
        order = at.argsort(kind="stable")
        machine = AlertMachine(rule[1])
        if self.kept.exists():
            state, fired, level, last, last_on, changes = tuple(self.kept.get())
            machine.state, machine.fired_at, machine.level = state, stamp(fired), level
            machine.last_at, machine.last_on, machine.changes = stamp(last), last_on, [stamp(c) for c in changes]
        for start in range(0, len(order), ROWS):
            out = []
            for k in order[start : start + ROWS]:
                tick_at, triggered = pd.Timestamp(at[k]), bool(on[k])
                note = machine.tick(tick_at, triggered)
                out.append((key[0], tick_at, triggered, machine.state, note, machine.level, machine.fired_at, len(machine.changes)))
            yield pd.DataFrame(out, columns=STATE_COLUMNS)
        self.kept.update((machine.state, micros(machine.fired_at), machine.level, micros(machine.last_at), machine.last_on,
                          [micros(c) for c in machine.changes]))

    def close(self) -> None:
        pass


def alert_stream(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("alert_id").transformWithStateInPandas(AlertProcessor(), STATE_DDL, "Append", "None")
