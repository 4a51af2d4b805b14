"""Traces as spans and events as metrics: joins and aggregations over two tables of events.

trace: kind (node-enter, node-exit), tag, name, path, run_id, call_id, at_ms, duration_ms, ok, error.
events: kind, name, run_id, call_id, at_ms, limit (and more).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds of the duration histogram's buckets, each inclusive, in ms.
BOUNDS = (1, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000)
#: Slices of time that events are dealt to, at most.
SLICES = 4096
EVENT_KINDS = ("breaker-open", "breaker-half-open", "breaker-close", "aimd-increase", "aimd-decrease", "token-wait", "retry-attempt", "memo-hit", "memo-miss")


def parent_path(path: Column) -> Column:
    """The path without its last step; null for the root."""
    return F.when(path == "", None).otherwise(F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("")))


def spans(trace: DataFrame) -> DataFrame:
    """A row for each call that was entered and left: trace_id, call_id, parent_call_id, name, start_ms, end_ms, ok, error, path.

    Enter and exit meet by run, path and call in one grouping. The parent is the call that was open at the
    path above when this one ended; of several the one entered last.
    """
    enter, leave = F.col("kind") == "node-enter", F.col("kind") == "node-exit"
    calls = trace.groupBy("run_id", "path", "call_id").agg(
        F.min(F.when(enter, F.col("at_ms"))).alias("start_ms"), F.min(F.when(leave, F.col("at_ms"))).alias("left_ms"),
        *(F.max(F.when(leave, F.col(c))).alias(c) for c in ("tag", "name", "duration_ms", "ok", "error")),
    )
    done = calls.where("start_ms is not null and left_ms is not null").withColumn("up", parent_path(F.col("path")))
    up = calls.where("start_ms is not null").select(F.col("run_id").alias("p_run"), F.col("path").alias("p_path"), F.col("call_id").alias("p_call"), F.col("start_ms").alias("p_start"), F.col("left_ms").alias("p_left"))
    open_then = (F.col("run_id") == F.col("p_run")) & (F.col("up") == F.col("p_path")) & (F.col("p_start") <= F.col("left_ms")) & (F.col("p_left").isNull() | (F.col("p_left") >= F.col("left_ms")))
    own = ["run_id", "path", "call_id"]
    found = done.join(up, open_then, "left").groupBy(*own).agg(F.max_by("p_call", F.struct("p_start", "p_call")).alias("parent_call_id"), *(F.first(c).alias(c) for c in ("tag", "name", "start_ms", "duration_ms", "ok", "error")))
    return found.select(
        F.replace("run_id", F.lit("-"), F.lit("")).alias("trace_id"), "call_id", "parent_call_id", F.concat_ws(":", "tag", F.when(F.col("name") != "", F.col("name"))).alias("name"),
        "start_ms", (F.col("start_ms") + F.col("duration_ms")).alias("end_ms"), F.when(F.col("ok"), F.lit("OK")).otherwise(F.lit("ERROR")).alias("status"), "error", "path",
    )


def events_on_spans(events: DataFrame, trace: DataFrame) -> DataFrame:
    """events with span_call_id: the call each belongs to, or null.

    Only calls of the event's name that are open at its time count: its own call_id's, else the one of its run that was
    entered last, else the one entered last of all. Events without a name belong to none. A call is open from its
    enter to its exit, both included, or for ever.

    One ordered pass for each name and slice of time. A call stands in each slice it is open in; slices are so wide that
    calls stand in two on average at most. So neither a name with a third of all events nor a long call makes a task large.
    """
    named = F.col("name").isNotNull() & (F.col("name") != "")
    enter, leave = F.col("kind") == "node-enter", F.col("kind") == "node-exit"
    calls = trace.where(named).groupBy("name", "run_id", "call_id").agg(F.min(F.when(enter, F.col("at_ms"))).alias("start"), F.min(F.when(leave, F.col("at_ms"))).alias("end")).where("start is not null")
    row = F.struct(*events.columns)
    asked = events.select("name", "at_ms", "run_id", "call_id", row.alias("row"))
    extent = asked.where(named).agg(F.min("at_ms").alias("low"), F.max("at_ms").alias("high")).first()
    nobody = events.where(~F.coalesce(named, F.lit(False))).withColumn("span_call_id", F.lit(None).cast(trace.schema["call_id"].dataType))
    if extent["low"] is None:
        return nobody
    low, high = extent["low"], extent["high"]
    ends = F.least(F.coalesce("end", F.lit(high)), F.lit(high))
    open_then = calls.where((F.col("start") <= high) & (ends >= low))
    mean = open_then.agg(F.avg(ends - F.greatest("start", F.lit(low)))).first()[0] or 0
    width = max(1.0, mean, (high - low) / SLICES)
    slice_of = lambda t: F.floor((t - F.lit(low)) / F.lit(width)).cast("long")
    first, last = slice_of(F.greatest("start", F.lit(low))), slice_of(ends)
    spans_in = open_then.select("name", F.explode(F.sequence(first, last)).alias("slice"), "start", F.lit(0).alias("rank"), "run_id", "call_id", "end", F.lit(None).cast(row_type(events)).alias("row"))
    # calls open when a slice begins come first in it, by their start as all others
    points = asked.where(named).select("name", slice_of(F.col("at_ms")).alias("slice"), F.col("at_ms").alias("start"), F.lit(1).alias("rank"), "run_id", "call_id", F.lit(None).cast(calls.schema["end"].dataType).alias("end"), "row")
    ordered = spans_in.unionByName(points).repartition("name", "slice").sortWithinPartitions("name", "slice", "start", "rank", "call_id")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, of_call, of_run, all_open = None, {}, {}, []

        def innermost(stack: list, t) -> object:
            while stack and stack[-1][1] is not None and stack[-1][1] < t:
                stack.pop()  # times rise, so it stays closed
            return stack[-1][0] if stack else None

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("name", "slice", "start", "rank", "run_id", "call_id", "end")]
            places, found = [], []
            for i, (name, part, t, rank, run, call, end) in enumerate(zip(*columns, strict=True)):
                if (name, part) != at:
                    at, of_call, of_run, all_open = (name, part), {}, {}, []
                if rank == 0:
                    of_call[call] = end
                    of_run.setdefault(run, []).append((call, end))
                    all_open.append((call, end))
                    continue
                own = call is not None and call in of_call and (of_call[call] is None or of_call[call] >= t)
                said = call if own else None
                if said is None and run is not None:
                    said = innermost(of_run.get(run, []), t)
                places.append(i)
                found.append(innermost(all_open, t) if said is None else said)
            if places:
                yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(places)), pa.array(found, b.column("call_id").type)], ["row", "span_call_id"])

    kind = trace.schema["call_id"].dataType.simpleString()
    swept = ordered.mapInArrow(sweep, f"row {row_type(events)}, span_call_id {kind}")
    return swept.select("row.*", "span_call_id").unionByName(nobody)


def row_type(df: DataFrame) -> str:
    return df.schema.simpleString()


def counters(events: DataFrame) -> DataFrame:
    """metric, name, value: how often each kind of event came from each name."""
    kind = F.when(F.col("kind") == "retry-attempt", F.lit("retry_attempts")).otherwise(F.replace("kind", F.lit("-"), F.lit("_")))
    return events.groupBy(F.concat(F.lit("op."), kind, F.lit("_total")).alias("metric"), F.coalesce("name", F.lit("")).alias("name")).agg(F.count("*").alias("value"))


def limit_gauge(events: DataFrame, order: Sequence[str]) -> DataFrame:
    """metric, name, value: the last limit of each name."""
    seen = events.where(F.col("kind").isin("aimd-increase", "aimd-decrease"))
    return seen.groupBy(F.coalesce("name", F.lit("")).alias("name")).agg(F.max_by("limit", F.struct(*order)).alias("value")).select(F.lit("op.aimd_limit").alias("metric"), "name", "value")


def durations(trace: DataFrame, bounds: Sequence[float] = BOUNDS) -> DataFrame:
    """tag, name, count, sum, buckets: of the calls' durations; a bucket holds what is at most its bound and above the one before, the last one the rest."""
    d = F.col("duration_ms")
    edges = [None, *bounds, None]
    inside = [F.count_if((F.lit(True) if low is None else d > low) & (F.lit(True) if high is None else d <= high)) for low, high in zip(edges, edges[1:], strict=False)]
    return trace.where("kind = 'node-exit'").groupBy("tag", F.coalesce("name", F.lit("")).alias("name")).agg(F.count("*").alias("count"), F.sum("duration_ms").alias("sum"), F.array(*inside).alias("buckets"))


def _attributes(pairs: dict[str, Column]) -> Column:
    """OTLP attributes of text columns; nulls are left out."""
    return F.filter(F.array(*(F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value")) for k, v in pairs.items())), lambda a: a["value"]["stringValue"].isNotNull())


def nanos(ms: Column) -> Column:
    return F.concat(F.round(ms).cast("long").cast("string"), F.lit("000000"))


def otlp_spans(done: DataFrame, service: str, batch: int = 512) -> DataFrame:
    """payload: OTLP/JSON requests of at most about batch spans each, from spans()."""
    status = F.struct(F.when(F.col("status") == "OK", F.lit(1)).otherwise(F.lit(2)).alias("code"), F.col("error").alias("message"))
    span_id = lambda c: F.substring(F.sha2(F.concat_ws(":", "trace_id", c), 256), 1, 16)
    span = F.struct(
        "trace_id", span_id("call_id").alias("spanId"), F.when(F.col("parent_call_id").isNotNull(), span_id("parent_call_id")).alias("parentSpanId"), "name", F.lit(1).alias("kind"),
        nanos(F.col("start_ms")).alias("startTimeUnixNano"), nanos(F.col("end_ms")).alias("endTimeUnixNano"), _attributes({"op.name": F.nullif(F.substring_index("name", ":", -1), F.col("name")), "op.path": F.col("path")}).alias("attributes"), status.alias("status"),
    ).withField("traceId", F.col("trace_id")).dropFields("trace_id")
    parts = done.withColumn("_part", F.pmod(F.xxhash64("trace_id", "call_id"), F.greatest(F.lit(1), F.ceil(F.lit(1.0 * done.count() / batch))).cast("long")))
    grouped = parts.select("_part", span.alias("s")).groupBy("_part").agg(F.collect_list("s").alias("spans"))
    return grouped.select(_payload("resourceSpans", "scopeSpans", F.struct("spans"), service))


def otlp_metrics(counts: DataFrame, service: str, at_ms: int) -> DataFrame:
    """payload: one OTLP/JSON request of cumulative sums, from counters() or limit_gauge() (a row a metric and name)."""
    point = F.struct(_attributes({"op.name": F.nullif("name", F.lit(""))}).alias("attributes"), F.lit(f"{at_ms}000000").alias("timeUnixNano"), F.col("value").cast("string").alias("asInt"))
    metric = counts.groupBy("metric").agg(F.array_sort(F.collect_list(F.struct("name", point.alias("p")))).alias("ps"))
    shaped = metric.select(F.struct(F.col("metric").alias("name"), F.struct(F.transform("ps", lambda p: p["p"]).alias("dataPoints"), F.lit(2).alias("aggregationTemporality"), F.lit(True).alias("isMonotonic")).alias("sum")).alias("m"))
    return shaped.agg(F.collect_list("m").alias("metrics")).select(_payload("resourceMetrics", "scopeMetrics", F.struct("metrics"), service))


def _payload(outer: str, inner: str, body: Column, service: str) -> Column:
    resource = F.struct(F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.lit(service).alias("stringValue")).alias("value"))).alias("attributes"))
    scope = F.array(body.withField("scope", F.struct(F.lit("weftline").alias("name"))))
    return F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), scope.alias(inner))).alias(outer))).alias("payload")


def post(payloads: DataFrame, send) -> DataFrame:
    """payload, ok, error: each request sent by send(text) from the workers. What fails is kept for the next flush: see unsent()."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            rows = []
            for p in frame["payload"]:
                try:
                    send(p)
                    rows.append((p, True, None))
                except Exception as e:
                    rows.append((p, False, str(e)))
            yield pd.DataFrame(rows, columns=["payload", "ok", "error"])

    return payloads.select("payload").mapInPandas(run, "payload string, ok boolean, error string")


def unsent(posted: DataFrame, before: DataFrame | None = None, most: int = 2048) -> DataFrame:
    """payload, seq of the requests that failed, to be sent with the next flush: of more than most the latest stay.
    before: what an earlier flush left, which is older. posted: payload, ok, error."""
    failed = posted.where(~F.col("ok")).select("payload", F.monotonically_increasing_id().alias("seq"))
    if before is not None:
        failed = before.select("payload", (F.col("seq") - F.lit(1 << 60)).alias("seq")).unionByName(failed)
    return failed.orderBy(F.desc("seq")).limit(most)
