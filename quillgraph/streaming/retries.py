"""The retry loops as state over a stream of attempts: a question's machine, the patterns it has tried, and a timer."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.retry import OUT, Machine, finish

#: An attempt: its question, number from 1 on, time, the validator's verdict and, of an accepted one, the outcome; the
#: question's settings stand in each of its attempts.
ATTEMPT = "question_id string, step int, ts timestamp, condition string, verdict string, outcome string, linked boolean, ambiguous boolean, exhausted_at int, choices array<string>"
_COLUMNS = [c.split()[0] for c in OUT.split(", ")]


class Retries(StatefulProcessor):
    """Takes a question's attempts in the order of their numbers, whenever they come, and gives its final row at once when
    it ends. If it has not ended `patience_ms` after its last attempt, by the watermark, its last verdict and outcome
    are taken to repeat, as in the batch fold; attempts that wait for one that never came are then taken in order.
    """

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", "settings string, state string, verdict string, outcomes string, next int, due long")
        self.tried = handle.getMapState("tried", "pattern string", "place int")
        self.waiting = handle.getMapState("waiting", "step int", "verdict string, outcome string")

    def _load(self):
        row = self.machine.get()
        settings, state = json.loads(row[0]), json.loads(row[1])
        state["tried"] = [k for _, k in sorted((v[0], k[0]) for k, v in self.tried.iterator())]
        return Machine(**settings, state=state), settings, row[2], json.loads(row[3]), row[4], row[5]

    def _store(self, machine: Machine, settings: dict, verdict: str | None, outcomes: list, following: int, due: int) -> None:
        for place, pattern in enumerate(machine.state["tried"]):
            if not self.tried.containsKey((pattern,)):
                self.tried.updateValue((pattern,), (place,))
        rest = {k: v for k, v in machine.state.items() if k != "tried"}
        self.machine.update((json.dumps(settings), json.dumps(rest), verdict, json.dumps(outcomes), following, due))

    @staticmethod
    def _row(question: str, final: dict) -> pd.DataFrame:
        return pd.DataFrame([{"question_id": question, **final}])[_COLUMNS]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values("step")
        if self.machine.exists():
            machine, settings, verdict, outcomes, following, due = self._load()
        else:
            r = every.iloc[0]
            choices = None if r["choices"] is None else [str(c) for c in r["choices"]]
            limit = None if pd.isna(r["exhausted_at"]) else int(r["exhausted_at"])
            settings = dict(condition=str(r["condition"]), linked=bool(r["linked"]), ambiguous=bool(r["ambiguous"]), exhausted_at=limit, choices=choices)
            machine, verdict, outcomes, following, due = Machine(**settings), None, [], 1, 0
        if following < 0:  # has ended; its state only keeps late attempts from opening it again
            return
        early = {int(k[0]): (v[0], v[1]) for k, v in self.waiting.iterator()}
        early |= {int(s): (v, o) for s, v, o in every[["step", "verdict", "outcome"]].itertuples(index=False) if s >= following}
        while following in early and not machine.state["done"]:
            verdict, outcome = early.pop(following)
            outcomes += [] if pd.isna(outcome) else [outcome]
            machine.advance(verdict, outcome)
            following += 1
        self.waiting.clear()
        for step, (v, o) in early.items() if not machine.state["done"] else ():
            self.waiting.updateValue((step,), (v, None if pd.isna(o) else o))
        ended = machine.state["done"]
        if due:
            self.handle.deleteTimer(due)
        due = max(due, int(every["ts"].max().timestamp() * 1000) + self.patience_ms)
        self.handle.registerTimer(due)
        self._store(machine, settings, verdict, outcomes, -1 if ended else following, due)
        if ended:
            yield self._row(key[0], machine.final())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        machine, _, verdict, outcomes, following, _ = self._load()
        if following >= 0:
            for _, (v, o) in sorted((int(k[0]), tuple(x)) for k, x in self.waiting.iterator()):
                verdict = v
                outcomes += [] if o is None else [o]
                machine.advance(v, o)
            yield self._row(key[0], finish(machine, verdict or "accept", outcomes or ["correct"]))
        self.waiting.clear()
        self.tried.clear()
        self.machine.clear()

    def close(self) -> None:
        return None


def with_state_store(spark: SparkSession) -> None:
    """Let the session keep streaming state where transformWithState can: in RocksDB, with checkpoints in the shared folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def final_states(attempts: DataFrame, patience_s: int = 3600, delay: str = "10 minutes") -> DataFrame:
    """A stream of the final rows of questions (retry.OUT) from a stream of attempts (ATTEMPT).

    `patience_s` is how long after its last attempt a question may stay open, `delay` how late attempts may come.
    """
    with_state_store(attempts.sparkSession)
    keyed = attempts.withWatermark("ts", delay).groupBy("question_id")
    return keyed.transformWithStateInPandas(Retries(patience_s * 1000), OUT, "append", "eventTime")
