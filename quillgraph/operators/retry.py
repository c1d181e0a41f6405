"""The bounded retry loops of a question, folded over tables of what models and validators said.

Outer rounds follow schema failures (3 retries), inner ones syntax failures (2), and a second commitment follows a
wrong result (1, with disambiguation only). A question has at most 24 steps, so a group is a few rows and the fold runs
per question in applyInPandas.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA_RETRIES, SYNTAX_RETRIES, WRONG_RETRIES = 3, 2, 1
OUT = "question_id string, failed boolean, reason string, retry_count int, generations int, links int, commits int, evaluations int, first_flags string, verdict string, feedbacks string, tried array<string>"


class Machine:
    """Where a question stands in its loops: advance() takes one generation's verdict and, if that was accepted, the
    outcome of its evaluation. `state` is all there is to it, a dict of plain values that can be stored and taken up."""

    def __init__(self, condition: str, linked: bool = True, ambiguous: bool = False, exhausted_at: int | None = None, choices: list[str] | None = None, state: dict | None = None):
        self.full = condition == "disambiguation_enhanced"
        self.links, self.linked, self.ambiguous, self.exhausted_at, self.choices = condition != "baseline", linked, ambiguous, exhausted_at, choices
        fresh = dict(failed=False, reason=None, retry_count=0, generations=0, links=0, commits=0, evaluations=0, first_flags="", verdict=None, feedbacks="", tried=[])
        self.state = state or fresh | dict(again=0, syntax=0, feedback=False, done=False)
        if state is None:
            self._link()

    def _fail(self, reason: str) -> None:
        self.state |= dict(failed=True, reason=reason, done=True)

    def _link(self) -> None:
        """A round of the outer loop begins."""
        self.state["again"] = 0
        if self.links:
            self.state["links"] += 1
            if not self.linked:
                return self._fail("schema_linker_no_valid_beams")
        return self._commit()

    def _commit(self) -> None:
        """A pattern is committed to; without a candidate that is left the question ends."""
        s = self.state
        s["syntax"] = 0
        if not (self.full and (self.ambiguous or s["again"] or s["retry_count"])):
            return
        s["commits"] += 1
        fresh = next((c for c in self.choices if c and c not in s["tried"]), None) if self.choices is not None else None
        if self.exhausted_at is not None and s["commits"] >= self.exhausted_at or self.choices is not None and fresh is None:
            s["done"] = True
        elif fresh is not None:
            s["tried"] = [*s["tried"], fresh]

    def advance(self, verdict: str, outcome: str | None = None) -> None:
        s = self.state
        if s["done"]:
            return
        s["feedbacks"] += "1" if s["feedback"] else "0"
        s["generations"] += 1
        s["verdict"], s["feedback"] = verdict, verdict != "accept"
        if verdict == "syntax":
            s["syntax"] += 1
            if s["syntax"] > SYNTAX_RETRIES:
                self._fail("max_syntax_retries_exhausted")
        elif verdict == "schema":
            if s["retry_count"] == SCHEMA_RETRIES:
                self._fail("max_schema_retries_exhausted")
            else:
                s["retry_count"] += 1
                self._link()
        elif verdict == "accept":
            s["first_flags"] += "0" if s["retry_count"] or s["again"] else "1"
            s["evaluations"] += 1
            if self.full and outcome == "wrong_result" and s["again"] < WRONG_RETRIES:
                s["again"] += 1
                self._commit()
            else:
                s["done"] = True
        else:
            s["done"] = True

    def final(self) -> dict:
        return {c.split()[0]: self.state[c.split()[0]] for c in OUT.split(", ")[1:]}


def finish(machine: Machine, verdict: str, outcomes: list[str]) -> dict:
    """The final state if the last verdict and outcome repeat."""
    while not machine.state["done"]:
        n = machine.state["evaluations"]
        machine.advance(verdict, outcomes[min(n, len(outcomes) - 1)])
    return machine.final()


def fold(condition: str, steps: list[str], linked: bool = True, ambiguous: bool = False, exhausted_at: int | None = None, outcomes: list[str] | None = None, choices: list[str] | None = None) -> dict:
    """Run the state machine over scripted verdicts (accept, syntax, schema) and evaluation outcomes.

    The last verdict and outcome repeat if the script is shorter. `exhausted_at` is the commitment at which the
    candidates run out. With `choices`, the rendered candidates in order, each commitment takes the first whose text no
    earlier one of the question had, in whichever loop, and runs out of them where there is none.
    """
    machine, outcomes = Machine(condition, linked, ambiguous, exhausted_at, choices), outcomes or ["correct"]
    for verdict in steps[:-1]:
        machine.advance(verdict, outcomes[min(machine.state["evaluations"], len(outcomes) - 1)])
    return finish(machine, steps[-1], outcomes)


def run(scripts: DataFrame) -> DataFrame:
    """Final states of questions.

    scripts: question_id, condition, step, verdict, outcome (null where none), linked, ambiguous, exhausted_at and, if
    there are candidates, choices (their texts in order); one row a step.
    """

    def one(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("step")
        first = g.iloc[0]
        limit = None if pd.isna(first["exhausted_at"]) else int(first["exhausted_at"])
        state = fold(first["condition"], list(g["verdict"].dropna()) or ["accept"], bool(first["linked"]), bool(first["ambiguous"]), limit, list(g["outcome"].dropna()), list(first["choices"]) if "choices" in g and first["choices"] is not None else None)
        return pd.DataFrame([{"question_id": first["question_id"], **state}])[[c.split()[0] for c in OUT.split(", ")]]

    return scripts.groupBy("question_id").applyInPandas(one, OUT)
