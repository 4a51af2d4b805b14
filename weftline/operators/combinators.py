"""The dataflow algebra over rows: a step is a function from a Column to a Column.

A value that flows through a pipeline is a row's column; arrays of values are array columns. All steps of
one pipeline are one expression, so Catalyst sees them as one projection. A race has no clock here: of its
branches that succeed, the first in declared order wins.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.governed import Governor, Policy

Step = Callable[[Column], Column]
MOST_BRANCHES = 32


def pipe(*steps: Step) -> Step:
    return lambda v: reduce(lambda x, step: step(x), steps, v)


def with_params(step: Step, params: Mapping[str, Any]) -> Step:
    """step over a struct with these fields set."""
    return lambda v: step(reduce(lambda x, kv: x.withField(kv[0], F.lit(kv[1])), params.items(), v))


def map_(step: Step) -> Step:
    """Over each element of an array, in order."""
    return lambda v: F.transform(v, step)


def map_field(array: str, element: str, step: Step, rename: str | None = None) -> Step:
    """Over one field of each element of an array field; the array comes last, under rename if given."""

    def run(v: Column) -> Column:
        made = F.transform(v[array], lambda x: x.withField(element, step(x[element])))
        return v.dropFields(array).withField(rename or array, made) if rename and rename != array else v.withField(array, made)

    return run


def check_rename(fields: Sequence[str], array: str, rename: str | None) -> None:
    if rename and rename != array and rename in fields:
        raise ValueError(f"mapField: `{rename}` is a field already")


def parallel(*steps: Step) -> Step:
    """All branches over the same value, results in declared order."""
    _bounded(steps, "parallel")
    return lambda v: F.array(*(s(v) for s in steps))


def _bounded(steps: Sequence, what: str) -> None:
    if not 1 <= len(steps) <= MOST_BRANCHES:
        raise ValueError(f"{what} takes 1 to {MOST_BRANCHES} branches")


def attempt(value: Column, error: Column | None = None) -> Column:
    """A branch's outcome: ok, value. Null counts as a failure unless error says otherwise."""
    return F.struct((value.isNotNull() if error is None else error.isNull()).alias("ok"), value.alias("value"))


def race(*steps: Step, need: int = 1) -> Step:
    """The first success in declared order (steps give attempts); with need above 1 the first so many, as an array.
    Too few successes are an error."""
    _bounded(steps, "race")
    if not 1 <= need <= len(steps):
        raise ValueError(f"race: need must be between 1 and {len(steps)}")

    def run(v: Column) -> Column:
        won = F.filter(F.array(*(s(v) for s in steps)), lambda a: a["ok"])
        short = F.size(won) < need
        values = F.transform(F.slice(won, 1, need), lambda a: a["value"])
        values = F.when(short, F.raise_error(F.lit(f"race: fewer than {need} of {len(steps)} branches succeeded"))).otherwise(values)
        return F.element_at(values, 1) if need == 1 else values

    return run


def equals(scalar: Any, field: str | None = None) -> Step:
    """Null equals null only."""
    return lambda v: (v if field is None else v[field]).eqNullSafe(F.lit(scalar))


def one_of(scalars: Sequence[Any], field: str | None = None) -> Step:
    known = [s for s in scalars if s is not None]

    def run(v: Column) -> Column:
        x = v if field is None else v[field]
        return F.coalesce(x.isin(*known), F.lit(False)) | (x.isNull() if None in scalars else F.lit(False))

    return run


def cond(cases: Sequence[tuple[Step, Step]], default: Step | None = None) -> Step:
    """The first case whose predicate holds; without one and without a default, an error."""
    _bounded(cases, "cond")

    def run(v: Column) -> Column:
        last = F.raise_error(F.lit("cond: no case matched and no default branch was supplied")) if default is None else default(v)
        return reduce(lambda rest, case: F.when(case[0](v), case[1](v)).otherwise(rest), reversed(cases), last)

    return run


def catch(step: Step, fallback: Step) -> Step:
    """step gives an attempt; where it fails, fallback over the original value."""

    def run(v: Column) -> Column:
        tried = step(v)
        return F.when(tried["ok"], tried["value"]).otherwise(fallback(v))

    return run


def failures(attempts: Column, label: str) -> Column:
    """Null, or the message of failed attempts (ok, value, error): one's own, or how many."""
    bad = F.filter(attempts, lambda a: ~a["ok"])
    return F.when(F.size(bad) == 1, F.element_at(bad, 1)["error"]).when(F.size(bad) > 1, F.concat(F.lit(f"{label}: "), F.size(bad).cast("string"), F.lit(" concurrent failures")))


def parallel_tables(rows: DataFrame, *branches: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Branches over the same table, their rows under one another with branch: its place. Columns meet by name; those that a
    branch lacks are null."""
    _bounded(branches, "parallel")
    made = [b(rows).withColumn("branch", F.lit(i)) for i, b in enumerate(branches)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), made)


def ask(rows: DataFrame, value: str, key: str, answers: DataFrame | None, on_timeout: str) -> DataFrame:
    """rows with value replaced by its answer. answers: key, answered, value. Answered without a value lets the value
    pass; unanswered rows pass or fail by on_timeout."""
    if on_timeout not in ("proceed", "fail"):
        raise ValueError("on_timeout must be proceed or fail")
    missing = F.col(value) if on_timeout == "proceed" else F.raise_error(F.lit("ask: no answer"))
    if answers is None:
        return rows.withColumn(value, missing)
    a = answers.select(F.col(key).alias("_key"), F.col("answered").alias("_answered"), F.col("value").alias("_value"))
    out = rows.join(a, F.col(key) == F.col("_key"), "left")
    return out.withColumn(value, F.when(F.coalesce("_answered", F.lit(False)), F.coalesce("_value", F.col(value))).otherwise(missing)).drop("_key", "_answered", "_value")


def fan_out(rows: DataFrame, targets: Sequence[str | tuple[str, Mapping[str, Any]]], sinks: Mapping[str, Callable[[DataFrame, Mapping[str, Any]], None]], options: Mapping[str, Any] | None = None, storage: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Writes rows to each target and returns them. A target's own options go over the common ones, field by field.

    All targets are known before the first is written. storage (for example a write to a shared folder and
    back) is applied once, so that what is costly to make is made once for all targets. A target's retries try again
    with growing delays; a target that fails lets the others finish.
    """
    _bounded(targets, "sink")
    named = [(t, {}) if isinstance(t, str) else t for t in targets]
    for name, _ in named:
        if name not in sinks:
            raise ValueError(f'unknown sink "{name}" (known: {", ".join(sorted(sinks))})')
    kept = storage(rows) if storage else rows
    failed = []
    for name, own in named:
        both = {**(options or {}), **own}
        governor = Governor(f"sink:{name}", Policy(retries=both.get("retries") or 0))
        try:
            governor.call(lambda _, key, name=name, both=both: sinks[name](kept, both), name)
        except Exception as e:
            failed.append(e)
    if failed:
        raise failed[0] if len(failed) == 1 else RuntimeError(f"sink: {len(failed)} concurrent failures") from failed[0]
    return kept
