"""Reliability operators as ordered folds: token bucket, circuit breaker, adaptive concurrency.

Each key's calls, in order of time and id, are folded by the transitions of the streaming twins
(weftline.streaming). Rows are dealt by key and sorted within partitions, and go by one at a time: a key's calls never
meet in one row or in memory, however many there are. A key's calls are one task's, as a state machine needs them in order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.streaming import twins


def folded(rows: DataFrame, key: Sequence[str], order: Sequence[str], now_ms: Column, cost: Column, ok: Column, of: tuple, decisions: dict[str, Sequence[str]], kept: dict[str, int]) -> DataFrame:
    """key, calls, a count for each of decisions (name: the decisions that count), and the parts of the last state that
    are kept (name: place in it)."""
    first, declared, step = of
    state_types = [t.split()[1] for t in declared.split(", ")]
    calls = rows.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(key)), *(F.col(o).alias(f"o{i}") for i, o in enumerate(order)), now_ms.cast("long").alias("now"), cost.cast("double").alias("cost"), ok.alias("ok"))
    keys, orders = [f"k{i}" for i in range(len(key))], [f"o{i}" for i in range(len(order))]
    fields = [T.StructField(k, rows.schema[k].dataType) for k in key]
    fields += [T.StructField(n, T.LongType()) for n in ("calls", *decisions)]
    schema = T.StructType(fields + [T.StructField(n, T._parse_datatype_string(state_types[i])) for n, i in kept.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, at, state, n, counts, done = to_arrow_schema(schema), None, first, 0, {}, []

        def close() -> None:
            if at is not None:
                done.append((*at, n, *(sum(counts.get(d, 0) for d in ds) for ds in decisions.values()), *(state[i] for i in kept.values())))

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(arrow.types)], schema=arrow)
            done.clear()
            return out

        for b in batches:
            own = zip(*(b.column(k).to_pylist() for k in keys), strict=True)
            for k, now, c, fine in zip(own, *(b.column(x).to_pylist() for x in ("now", "cost", "ok")), strict=True):
                if k != at:
                    close()
                    at, state, n, counts = k, first, 0, {}
                state, said = step(state, now or 0, c or 0.0, bool(fine))
                n += 1
                counts[said] = counts.get(said, 0) + 1
            if done:
                yield passed()
        close()
        if done:
            yield passed()

    ordered = calls.repartition(*keys).sortWithinPartitions(*keys, *orders).select(*keys, "now", "cost", "ok")
    return ordered.mapInArrow(run, schema)


def token_bucket(rows: DataFrame, key: Sequence[str], order: Sequence[str], now_ms: Column, cost: Column, capacity: float, per_ms: float) -> DataFrame:
    """key, calls, granted, denied, tokens: a bucket that starts full and is refilled with time. A cost that is
    negative is an error; one above the capacity is always denied."""
    of = twins.bucket(capacity, per_ms)
    return folded(rows, key, order, now_ms, cost, F.lit(True), of, {"granted": ["granted"], "denied": ["denied"]}, {"tokens": 0})


def circuit_breaker(rows: DataFrame, key: Sequence[str], order: Sequence[str], now_ms: Column, ok: Column, threshold: int, cooldown_ms: int, half_open: int) -> DataFrame:
    """key, calls, allowed, refused, opened, closed_again, state: closed opens after threshold failures in a row;
    open refuses until the cooldown is over, then lets calls try; half_open successes close it, a failure opens it again."""
    counted = {"allowed": ["allowed", "opened", "closed"], "refused": ["refused"], "opened": ["opened"], "closed_again": ["closed"]}
    return folded(rows, key, order, now_ms, F.lit(0.0), ok, twins.breaker(threshold, cooldown_ms, half_open), counted, {"state": 0})


def aimd(rows: DataFrame, key: Sequence[str], order: Sequence[str], ok: Column, start: int = 4, least: int = 1, most: int = 64) -> DataFrame:
    """key, calls, increases, decreases, limit: the limit grows by one after as many successes as it is, and halves at a failure."""
    least = max(1, least)
    of = twins.limiter(start, least, max(least, most))
    return folded(rows, key, order, F.lit(0), F.lit(0.0), ok, of, {"increases": ["increase"], "decreases": ["decrease"]}, {"limit": 0})
