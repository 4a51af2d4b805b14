"""The reliability folds as streams: the same transitions, with a key's state kept between micro-batches.

Each key's calls of a batch are folded in order of time and id; a call that is older than what the key has seen
is folded where it comes. Each call gives a row with the decision made on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

State = tuple
#: (state, now_ms, cost, ok) -> (state, decision)
Transition = Callable[[State, int, float, bool], tuple[State, str]]


def bucket(capacity: float, per_ms: float) -> tuple[State, str, Transition]:
    """State: tokens, last ms (-1 at first). A negative cost is an error, as it would add tokens."""

    def step(s: State, now: int, cost: float, ok: bool) -> tuple[State, str]:
        if cost < 0:
            raise ValueError("cost must not be negative")
        tokens, last = s
        tokens = min(capacity, tokens + (max(0, now - last) * per_ms if last >= 0 else 0.0))
        return ((tokens - cost, now), "granted") if tokens >= cost else ((tokens, now), "denied")

    return (float(capacity), -1), "tokens double, last long", step


def breaker(threshold: int, cooldown_ms: int, half_open: int) -> tuple[State, str, Transition]:
    """State: name, failures in a row, successes on trial, ms it opened at."""

    def step(s: State, now: int, cost: float, ok: bool) -> tuple[State, str]:
        name, fails, wins, since = s
        if name == "open":
            if now - since < cooldown_ms:
                return s, "refused"
            name, wins = "half-open", 0
        if not ok:
            fails += name == "closed"
            return (("open", fails, 0, now), "opened") if name == "half-open" or fails >= threshold else ((name, fails, wins, since), "allowed")
        if name == "closed":
            return (name, 0, wins, since), "allowed"
        return (("closed", 0, 0, since), "closed") if wins + 1 >= half_open else ((name, fails, wins + 1, since), "allowed")

    return ("closed", 0, 0, 0), "name string, fails int, wins int, since long", step


def limiter(start: int = 4, least: int = 1, most: int = 64) -> tuple[State, str, Transition]:
    """State: limit, successes since it changed."""

    def step(s: State, now: int, cost: float, ok: bool) -> tuple[State, str]:
        limit, run = s
        if not ok:
            return (max(least, limit // 2), 0), "decrease"
        return ((min(most, limit + 1), 0), "increase") if run + 1 >= limit else ((limit, run + 1), "same")

    return (min(most, max(least, start)), 0), "limit int, run int", step


def folded(calls: DataFrame, of: tuple[State, str, Transition]) -> DataFrame:
    """key, call_id, decision for a stream of calls: key, call_id, at_ms, cost, ok."""
    first, schema, step = of

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now: Any = tuple(state.get) if state.exists else first
        frame = pd.concat(list(frames)).sort_values(["at_ms", "call_id"])
        made = []
        for c in frame.itertuples(index=False):
            now, decision = step(now, int(c.at_ms), float(c.cost), bool(c.ok))
            made.append((key[0], c.call_id, decision))
        state.update(now)
        yield pd.DataFrame(made, columns=["key", "call_id", "decision"])

    kinds = dict(calls.dtypes)
    return calls.select("key", "call_id", "at_ms", "cost", "ok").groupBy("key").applyInPandasWithState(run, f"key {kinds['key']}, call_id {kinds['call_id']}, decision string", schema, "append", GroupStateTimeout.NoTimeout)


def metric_counters(events: DataFrame) -> DataFrame:
    """Cumulative counters over a stream (write with output mode complete)."""
    from weftline.operators.telemetry import counters

    return counters(events)


def deduplicated(rows: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """A memo over a stream: the first row of each key, keys being remembered as long as late rows may come."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
