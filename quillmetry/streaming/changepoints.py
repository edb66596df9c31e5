"""Online change-point detection as a stateful stream: the recursion of the batch detector, one value at a time.

State of an entity: the posterior of the run lengths, the running sums, the first prior and the last alarm; until the
prior is known (ten values, or 80 where those are flat) the values themselves. Nothing is forgotten and nothing is
computed again, so a replay gives the batch's alarms at any length. Values of an entity have to come in their order
across micro-batches; within one they are sorted.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillmetry.operators.changepoints import Alarms, RunLengths

OUT = "entity bigint, at bigint, confidence double"
STATE = "scalars string, log_pi binary, s1 binary, s2 binary"


class Online:
    """The detector of one entity, and its state as a row."""

    def __init__(self, hazard: float, row: tuple | None = None):
        self.hazard, self.first, self.runs, self.alarms = hazard, [], None, Alarms()
        if row:
            s = json.loads(row[0])
            self.first, (self.alarms.before, self.alarms.last) = s["first"], s["alarms"]
            if s["prior"]:
                self.runs = RunLengths(np.zeros(1), hazard)
                self.runs.mu0, self.runs.beta0, self.runs.sigma2, self.runs.t = s["prior"]
                self.runs.log_pi = np.frombuffer(row[1]).copy()
                held = [np.frombuffer(row[k]) for k in (2, 3)]
                self.runs.s1, self.runs.s2 = (np.concatenate([h, np.zeros(64)]) for h in held)
                self.runs._grow(len(self.runs.s1) - 1)

    def row(self) -> tuple:
        r = self.runs
        scalars = json.dumps({"first": self.first, "alarms": [self.alarms.before, self.alarms.last], "prior": [r.mu0, r.beta0, r.sigma2, r.t] if r else None})
        return (scalars, r.log_pi.tobytes(), r.s1[: r.t + 1].tobytes(), r.s2[: r.t + 1].tobytes()) if r else (scalars, b"", b"", b"")

    def take(self, value: float) -> Iterator[tuple[int, float]]:
        if self.runs is None:
            self.first.append(value)
            x = np.array(self.first)
            if len(x) < 10 or (x[:10].var() < 1e-12 and len(x) < 80):
                return
            self.runs, rest, self.first = RunLengths(x, self.hazard), self.first[1:], []
        else:
            rest = [value]
        for v in rest:
            at = self.runs.t
            p = self.alarms.see(at, self.runs.step(v))
            if p is not None:
                yield at, p


def online_breaks(values: DataFrame, hazard: float = 1 / 250) -> DataFrame:
    """values: entity, i, value as a stream. Emits entity, at, confidence of each alarm once."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entity = Online(hazard, tuple(state.get) if state.exists else None)
        rows = pd.concat(list(batches)).sort_values("i")
        new = [(key[0], at, p) for v in rows["value"].astype(float) for at, p in entity.take(v)]
        state.update(entity.row())
        yield pd.DataFrame(new, columns=["entity", "at", "confidence"])

    return values.groupBy("entity").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
