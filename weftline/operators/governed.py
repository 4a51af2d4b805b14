"""Calls to the outside from rows: governed by retries, a breaker, a token bucket and a gate, inside a worker.

A leaf that calls a service (a model, an API) runs as an Arrow-batched function. State that would be global in one
process is kept for each Python worker here: a cluster's total is the number of workers times the limits
given, so divide these by it. Rows that fail keep their error, and harm no other. Each call gets the row's
idempotency key, as Spark may run a task again.
"""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.values import idempotency_key, memo_key
from weftline.streaming import twins


class CircuitOpen(RuntimeError):
    pass


class Aborted(RuntimeError):
    """Ends a run. It is neither retried nor taken for an outcome of the service."""


class Gate:
    """At most so many calls at once: a fixed number, or one that adapts (start, least, most): it grows by one after
    as many successes as it is, and halves at a failure."""

    def __init__(self, limit: int | tuple[int, int, int], told: Callable[..., None] = lambda kind, **more: None):
        self.adapts = not isinstance(limit, int)
        start, least, most = limit if self.adapts else (max(1, limit),) * 3
        self.state, _, self.step = twins.limiter(start, max(1, least), max(1, least, most))
        self.inside, self.told, self.free = 0, told, threading.Condition()

    @property
    def limit(self) -> int:
        return self.state[0]

    def acquire(self) -> None:
        with self.free:
            self.free.wait_for(lambda: self.inside < self.limit)
            self.inside += 1

    def release(self, ok: bool | None) -> None:
        """ok: None for a call that was ended and says nothing about the service."""
        with self.free:
            self.inside -= 1
            if self.adapts and ok is not None:
                self.state, said = self.step(self.state, 0, 0.0, ok)
                if said != "same":
                    self.told(f"aimd-{said}", limit=self.limit)
            self.free.notify_all()


@dataclass(frozen=True)
class Policy:
    """kind: pure leaves pass no gates, but are retried as well. concurrency: calls of a worker at once, a number or
    (start, least, most) to adapt; heavy: the same for heavy calls, if they have a gate of their own. Times in ms."""

    kind: str = "effect"
    retries: int = 0
    memo: bool = False
    backoff_base: int = 200
    backoff_cap: int = 10_000
    breaker: tuple[int, int, int] | None = None
    bucket: tuple[float, float] | None = None
    cost: float = 1.0
    concurrency: int | tuple[int, int, int] = 1
    heavy: int | tuple[int, int, int] | None = None

    @property
    def threads(self) -> int:
        return max(g if isinstance(g, int) else g[2] for g in (self.concurrency, self.heavy or 1))


@dataclass
class Governor:
    """A worker's gates for one leaf. now and sleep are in ms, so that tests can bring their own clock."""

    name: str
    policy: Policy
    now: Callable[[], float] = field(default=lambda: time.monotonic() * 1000)
    sleep: Callable[[float], None] = field(default=lambda ms: time.sleep(ms / 1000))
    draw: Callable[[], float] = random.random
    on_event: Callable[[dict], None] = field(default=lambda e: None)
    known: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        p = self.policy
        self.breaker, _, self.breaker_step = twins.breaker(*p.breaker) if p.breaker else (None, "", None)
        self.tokens, _, self.bucket_step = twins.bucket(*p.bucket) if p.bucket else (None, "", None)
        if p.bucket and not 0 <= p.cost <= p.bucket[0]:
            raise ValueError("a call's cost must be between 0 and the bucket's capacity")
        self.gate = Gate(p.concurrency, self.event)
        self.heavy_gate = self.gate if p.heavy is None else Gate(p.heavy, self.event)
        self.lock, self.running, self.probes = threading.RLock(), {}, 0

    def event(self, kind: str, **more: Any) -> None:
        self.on_event({"kind": kind, "name": self.name, **more})

    def jitter(self, attempt: int, base: int, cap: int) -> float:
        return int(self.draw() * min(cap, base * 2**attempt))

    def admit(self) -> bool:
        """Whether this call is one of a half-open breaker's probes; an open breaker, or enough probes, are an error."""
        with self.lock:
            if not self.breaker or self.breaker[0] == "closed":
                return False
            if self.breaker[0] == "open":
                if self.now() - self.breaker[3] < self.policy.breaker[1]:
                    raise CircuitOpen(f"{self.name}: circuit is open")
                self.breaker, self.probes = ("half-open", self.breaker[1], 0, self.breaker[3]), 0
                self.event("breaker-half-open")
            if self.probes >= self.policy.breaker[2]:
                raise CircuitOpen(f"{self.name}: circuit is half-open, and enough calls try")
            self.probes += 1
            return True

    def wait(self) -> None:
        """For a token."""
        attempt = 0
        while self.bucket_step:
            with self.lock:
                self.tokens, said = self.bucket_step(self.tokens, int(self.now()), self.policy.cost, True)
            if said == "granted":
                return
            delay = max(1, self.jitter(attempt, 5, 200))
            self.event("token-wait", attempt=attempt, delay_ms=delay)
            self.sleep(delay)
            attempt += 1

    def leave(self, ok: bool | None, probe: bool) -> None:
        """ok: None for a call that was ended."""
        with self.lock:
            self.probes -= probe
            if not self.breaker_step or ok is None:
                return
            self.breaker, said = self.breaker_step(self.breaker, int(self.now()), 0.0, ok)
            if said in ("opened", "closed"):
                self.event("breaker-open" if said == "opened" else "breaker-close")

    def call(self, leaf: Callable[[Any, str | None], Any], value: Any, heavy: bool = False) -> Any:
        """leaf(value, idempotency key) behind memo, breaker, bucket and gate, in this order, each try anew. Of equal calls at
        once that are remembered, one is made and the others wait for it."""
        if not self.policy.memo:
            return self.tried(leaf, value, heavy)
        key = memo_key(self.name, value)
        with self.lock:
            if key in self.known:
                self.event("memo-hit")
                return self.known[key]
            joined, own = self.running.get(key), Future()
            if joined is None:
                self.running[key] = own
        if joined is not None:
            self.event("memo-hit")
            return joined.result()
        try:
            out = self.tried(leaf, value, heavy)
        except BaseException as e:
            own.set_exception(e)
            raise
        else:
            self.known[key] = out
            own.set_result(out)
            self.event("memo-miss")
            return out
        finally:
            with self.lock:
                del self.running[key]

    def tried(self, leaf: Callable[[Any, str | None], Any], value: Any, heavy: bool) -> Any:
        p, gate = self.policy, self.heavy_gate if heavy else self.gate
        gated = p.kind == "effect"
        once = idempotency_key(self.name, value) if p.kind == "effect" and p.retries else None
        for attempt in range(p.retries + 1):
            if not gated:
                probe = False
            else:
                probe = self.admit()
                self.wait()
                gate.acquire()
            try:
                out = leaf(value, once)
            except Exception as e:
                ended = isinstance(e, Aborted)
                if gated:
                    gate.release(None if ended else False)
                    self.leave(None if ended else False, probe)
                if ended or attempt == p.retries:
                    raise
                delay = self.jitter(attempt, p.backoff_base, p.backoff_cap)
                self.event("retry-attempt", attempt=attempt, delay_ms=delay)
                self.sleep(delay)
                continue
            if gated:
                gate.release(True)
                self.leave(True, probe)
            return out
        raise AssertionError("unreachable")


OUTCOME = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("value", T.StringType()), T.StructField("error", T.StringType())])


def governed(name: str, leaf: Callable[[Any, str | None], str | None], policy: Policy, heavy: bool = False) -> Callable[[Column], Column]:
    """A step from a text column to ok, value, error. A worker makes as many calls at once as its gate lets through; results
    stay in the order of rows."""

    @F.pandas_udf(OUTCOME)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        governor = Governor(name, policy)

        def one(v: Any) -> tuple:
            try:
                return (True, governor.call(leaf, v, heavy), None)
            except Aborted:
                raise
            except Exception as e:
                return (False, None, f"{type(e).__name__}: {e}")

        with ThreadPoolExecutor(policy.threads) as threads:
            for batch in batches:
                yield pd.DataFrame(list(threads.map(one, batch)), columns=OUTCOME.names)

    return lambda v: run(v)


def over_distinct(rows: DataFrame, column: str, step: Callable[[Column], Column]) -> DataFrame:
    """rows with outcome: step is made once for each distinct value, then joined back (singleflight across the cluster)."""
    one = rows.select(column).distinct().withColumn("outcome", step(F.col(column)))
    o = one.withColumnRenamed(column, "_value")
    return rows.join(o, rows[column].eqNullSafe(F.col("_value")), "left").drop("_value")


def no_model(value: Any, key: str | None) -> str:
    raise RuntimeError("no language model is configured")


def llm_leaf(name: str, model: Callable[[Any, str | None], str | None] = no_model, policy: Policy | None = None) -> Callable[[Column], Column]:
    """extract or summarize, by a model that the caller brings."""
    return governed(name, model, policy or Policy(retries=2, memo=True))


@contextmanager
def abortable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs that begin within can be ended by abort(), from any thread."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def abort(spark: SparkSession, tag: str) -> None:
    """Ends the running jobs of a tag; their actions raise."""
    spark.sparkContext.cancelJobsWithTag(tag)


def limited(rows: DataFrame, concurrency: int) -> DataFrame:
    """rows in at most so many partitions, so that at most so many tasks call out at once."""
    return rows.coalesce(max(1, concurrency))
