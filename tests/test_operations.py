"""Governed calls, sinks, exports, the command line, streams."""

import json

import pytest
from pyspark.sql import functions as F

from weftline import cli
from weftline.operators import governed as g
from weftline.operators import folds, sinks, telemetry
from weftline.streaming import twins


class World:
    """A clock, and a service that fails as told."""

    def __init__(self, policy, fails=()):
        self.ms, self.calls, self.keys, self.events, self.fails = 0, 0, [], [], list(fails)
        self.governor = g.Governor("svc", policy, now=lambda: self.ms, sleep=self.sleep, draw=lambda: 0.5, on_event=lambda e: self.events.append(e["kind"]))

    def sleep(self, ms):
        self.ms += ms

    def leaf(self, value, key):
        self.calls += 1
        self.keys.append(key)
        if self.fails and self.fails.pop(0):
            raise OSError("down")
        return value.upper()

    def call(self, value="a"):
        return self.governor.call(self.leaf, value)


def test_retries_keep_their_key_and_wait():
    w = World(g.Policy(retries=2), [True, True])
    assert w.call() == "A" and w.calls == 3 and len(set(w.keys)) == 1 and w.keys[0] and w.events == ["retry-attempt"] * 2 and w.ms == 100 + 200
    w = World(g.Policy(retries=1), [True, True])
    with pytest.raises(OSError):
        w.call()
    w = World(g.Policy(kind="pure", retries=1), [True])
    assert w.call() == "A" and w.keys == [None, None]


def test_breaker():
    w = World(g.Policy(breaker=(2, 1000, 2)), [True, True])
    for _ in range(2):
        with pytest.raises(OSError):
            w.call()
    with pytest.raises(g.CircuitOpen):
        w.call()
    assert w.calls == 2
    w.ms = 1000
    assert [w.call(), w.call()] == ["A", "A"] and w.events == ["breaker-open", "breaker-half-open", "breaker-close"]


def test_bucket_memo_abort():
    w = World(g.Policy(bucket=(2, 0.01)))
    for _ in range(4):
        w.call()
    assert w.ms >= 190 and "token-wait" in w.events
    with pytest.raises(ValueError):
        World(g.Policy(bucket=(1, 1), cost=2))
    w = World(g.Policy(memo=True))
    assert [w.call(), w.call()] == ["A", "A"] and w.calls == 1 and w.events == ["memo-miss", "memo-hit"]
    w = World(g.Policy(retries=3))
    w.leaf = lambda v, k: (_ for _ in ()).throw(g.Aborted())
    with pytest.raises(g.Aborted):
        w.call()
    assert not w.events


def test_gate_adapts_and_bounds_calls_at_once():
    import threading
    import time
    from concurrent.futures import ThreadPoolExecutor

    now, most, lock = [0], [0], threading.Lock()

    def leaf(v, key):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.01)
        with lock:
            now[0] -= 1
        if v == "bad":
            raise ValueError("no")
        return v

    told = []
    governor = g.Governor("svc", g.Policy(concurrency=(2, 1, 3)), on_event=lambda e: told.append(e["kind"]))
    with ThreadPoolExecutor(8) as pool:
        assert list(pool.map(lambda v: governor.call(leaf, v), range(20))) == list(range(20))
    assert most[0] <= 3 and governor.gate.limit == 3 and "aimd-increase" in told
    with pytest.raises(ValueError):
        governor.call(leaf, "bad")
    assert governor.gate.limit == 1 and told[-1] == "aimd-decrease"
    heavy, most[0] = g.Governor("svc", g.Policy(concurrency=4, heavy=1)), 0
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda v: heavy.call(leaf, v, heavy=True), range(6)))
    assert most[0] == 1


def test_equal_calls_at_once_are_made_once():
    import time
    from concurrent.futures import ThreadPoolExecutor

    made = []
    governor = g.Governor("svc", g.Policy(concurrency=8, memo=True))
    with ThreadPoolExecutor(8) as pool:
        out = list(pool.map(lambda v: governor.call(lambda x, key: (time.sleep(0.02), made.append(x), x)[2], v), ["a"] * 8))
    assert out == ["a"] * 8 and made == ["a"]


def test_abort_ends_running_jobs(spark):
    import threading
    import time

    over = threading.Event()

    def end():
        while not over.wait(0.5):
            g.abort(spark, "long")

    ender = threading.Thread(target=end)
    ender.start()
    try:
        with pytest.raises(Exception, match="cancel"), g.abortable(spark, "long"):
            spark.range(2).mapInPandas(lambda frames: (time.sleep(20) or f for f in frames), "id long").count()
    finally:
        over.set()
        ender.join()


def test_parallel_tables_and_retried_sinks(spark):
    from weftline.operators import combinators as c

    rows = spark.range(3)
    both = c.parallel_tables(rows, lambda d: d.selectExpr("id", "id * 2 as twice"), lambda d: d.where("id > 1"))
    assert sorted((r.branch, r.id, r.twice) for r in both.where("branch = 0").collect()) == [(0, 0, 0), (0, 1, 2), (0, 2, 4)]
    assert [(r.branch, r.id, r.twice) for r in both.where("branch = 1").collect()] == [(1, 2, None)]
    tries = []

    def sink(df, options):
        tries.append(options["retries"])
        if len(tries) < 2:
            raise OSError("down")

    c.fan_out(rows, [("s", {"retries": 1})], {"s": sink})
    assert tries == [1, 1]


def test_governed_column(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "v string")

    def leaf(v, key):
        if v == "b":
            raise ValueError("no b")
        return v and v * 2

    out = g.over_distinct(rows, "v", g.governed("x", leaf, g.Policy())).collect()
    assert sorted((str(r.v), r.outcome.ok, r.outcome.value, r.outcome.error) for r in out) == [("None", True, None, None), ("a", True, "aa", None), ("a", True, "aa", None), ("b", False, None, "ValueError: no b")]
    assert "no language model" in rows.select(g.llm_leaf("summarize", policy=g.Policy())(F.col("v")).alias("o")).first().o.error
    assert g.limited(rows.repartition(4), 2).rdd.getNumPartitions() == 2


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "x"), (1, None)], "k int, t string")
    sink = sinks.store(str(tmp_path / "blobs"))
    sink(rows, {})
    sink(rows, {})
    stored = spark.read.parquet(str(tmp_path / "blobs")).collect()
    assert sorted(bytes(r.content).decode() for r in stored) == ['{"k":1,"t":null}', '{"k":2,"t":"x"}']
    seen = []
    sinks.each_batch({"a": lambda df, o: seen.append((df.count(), o["batch_id"]))})(rows, 4)
    sinks.each_batch({"a": lambda df, o: seen.append("again")}, written=lambda i: True)(rows, 4)
    sinks.registry({"log": sinks.parquet(str(tmp_path / "log"))}, str(tmp_path / "b"))["log"](rows, {})
    assert seen == [(3, 4)] and spark.read.parquet(str(tmp_path / "log")).count() == 3


def test_exports(spark):
    trace = spark.createDataFrame(
        [("node-enter", "pipe", None, "", "r-1", "c0", 0, None, None, None), ("node-enter", "leaf", "x", "0", "r-1", "c1", 1, None, None, None), ("node-exit", "leaf", "x", "0", "r-1", "c1", 3, 2.0, False, "bad"), ("node-exit", "pipe", None, "", "r-1", "c0", 4, 4.0, True, None), ("node-enter", "leaf", "y", "1", "r-1", "c2", 3, None, None, None)],
        "kind string, tag string, name string, path string, run_id string, call_id string, at_ms long, duration_ms double, ok boolean, error string",
    )
    done = telemetry.spans(trace)
    assert {(r.name, r.parent_call_id, r.status) for r in done.collect()} == {("pipe", None, "OK"), ("leaf:x", "c0", "ERROR")}
    payloads = telemetry.otlp_spans(done, "svc")
    spans = [s for r in payloads.collect() for s in json.loads(r.payload)["resourceSpans"][0]["scopeSpans"][0]["spans"]]
    by_name = {s["name"]: s for s in spans}
    assert by_name["leaf:x"]["parentSpanId"] == by_name["pipe"]["spanId"] and by_name["leaf:x"]["status"] == {"code": 2, "message": "bad"} and by_name["leaf:x"]["traceId"] == "r1" and by_name["leaf:x"]["endTimeUnixNano"] == "3000000"
    events = spark.createDataFrame([("retry-attempt", "x"), ("retry-attempt", "x"), ("memo-hit", None)], "kind string, name string")
    metrics = json.loads(telemetry.otlp_metrics(telemetry.counters(events), "svc", 7).first().payload)["resourceMetrics"][0]["scopeMetrics"][0]["metrics"]
    assert {m["name"]: [p["asInt"] for p in m["sum"]["dataPoints"]] for m in metrics} == {"op.retry_attempts_total": ["2"], "op.memo_hit_total": ["1"]}

    def send(text):
        if "leaf:x" in text:
            raise OSError("down")

    assert [(r.ok, r.error) for r in telemetry.post(payloads, send).collect()] == [(False, "down")]


def test_durations_at_bounds(spark):
    rows = spark.createDataFrame([("node-exit", "leaf", "x", d) for d in (0.0, 1.0, 1.5, 10_000.0, 10_000.1)], "kind string, tag string, name string, duration_ms double")
    assert telemetry.durations(rows).first().buckets == [2, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1]


def test_batch_folds_of_known_calls(spark):
    def calls(*rows):
        return spark.createDataFrame([("k", i, *r) for i, r in enumerate(rows)], "k string, i int, now long, cost double, ok boolean")

    b = folds.token_bucket(calls((0, 6.0, True), (0, 5.0, True), (0, 4.0, True)), ["k"], ["now", "i"], F.col("now"), F.col("cost"), 10, 0.0).first()
    assert (b.granted, b.denied, b.tokens) == (2, 1, 0.0)
    with pytest.raises(Exception, match="negative"):
        folds.token_bucket(calls((0, -1.0, True)), ["k"], ["i"], F.col("now"), F.col("cost"), 10, 0.0).collect()
    a = folds.aimd(calls((0, 0.0, False), *[(1, 0.0, True)] * 4), ["k"], ["i"], F.col("ok"), start=8).first()
    assert (a.decreases, a.limit) == (1, 5)
    c = folds.circuit_breaker(calls((0, 0.0, False), (1, 0.0, False), (2, 0.0, True), (60, 0.0, True), (61, 0.0, False), (62, 0.0, True), (200, 0.0, True), (201, 0.0, True)), ["k"], ["i"], F.col("now"), F.col("ok"), 2, 50, 2).first()
    assert (c.allowed, c.refused, c.opened, c.closed_again, c.state) == (6, 2, 2, 1, "closed")


def test_twins_make_the_same_steps():
    state, _, step = twins.breaker(2, 50, 2)
    said = []
    for now, ok in ((0, False), (1, False), (2, True), (60, True), (61, False), (62, True), (200, True), (201, True)):
        state, d = step(state, now, 0.0, ok)
        said.append(d)
    assert said == ["allowed", "opened", "refused", "allowed", "opened", "refused", "allowed", "closed"] and state[0] == "closed"
    state, _, step = twins.bucket(10, 1)
    state, d = step(state, 5, 10, True)
    state, e = step(state, 7, 3, True)
    assert (d, e, state) == ("granted", "denied", (2, 7))
    state, _, step = twins.limiter(8)
    assert step(state, 0, 0, False) == ((4, 0), "decrease") and step((1, 0), 0, 0, True) == ((2, 0), "increase")


def test_stream_state_spans_batches(spark, tmp_path):
    """The same calls in one batch and in several give the same decisions."""
    from weftline.plans import catalog

    calls = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").alias("key"), F.col("event_id").alias("call_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.lit(1.0).alias("cost"), (F.col("event_type") != "error").alias("ok"))
    for lo, hi in ((0, 300), (300, 700), (700, 10**9)):
        calls.where(f"call_id >= {lo} and call_id < {hi}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = twins.folded(spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), twins.limiter()).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    got = {r.key: (r.n, r.d) for r in out.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("decision") == "decrease").alias("d")).collect()}
    want = {r.user_id: (r.calls, r.decreases) for r in catalog.QUERIES["aimd_limit"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_stream_memo_and_counters(spark, tmp_path):
    rows = spark.createDataFrame([("retry-attempt", "x", "2024-01-01 00:00:00"), ("retry-attempt", "x", "2024-01-01 00:00:05")], "kind string, name string, at string").withColumn("at", F.col("at").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("memo", twins.deduplicated(read(), "name", "at", "1 minute"), "append"), ("counts", twins.metric_counters(read()), "complete")):
        df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("memo").count() == 1 and spark.table("counts").first().value == 2


def test_command_line(tmp_path, capsys):
    one = tmp_path / "one.txt"
    one.write_text("hello")
    pack, out = str(tmp_path / "p.zip"), str(tmp_path / "out")
    assert cli.main(["archive", "create", "zip", pack, str(one)]) == 0 and cli.main(["archive", "extract", "zip", pack, out]) == 0
    assert (tmp_path / "out/one.txt").read_text() == "hello"
    (tmp_path / "s.json").write_text('{"tag":"leaf","name":"unzip"}')
    (tmp_path / "d.json").write_text('{"a":1}')
    capsys.readouterr()
    assert cli.main(["pipeline", "plan", str(tmp_path / "s.json")]) == 0 and json.loads(capsys.readouterr().out)["nodeCount"] == 1
    assert cli.main(["transform", "json", "yaml", str(tmp_path / "d.json")]) == 0 and capsys.readouterr().out == "a: 1\n"
    assert cli.main(["pdf", "pages", str(one)]) == 1 and cli.main(["pipeline", "validate", str(tmp_path / "s.json")]) == 0


def test_events_belong_to_open_calls_of_their_name(spark):
    trace = spark.createDataFrame(
        [("node-enter", "r1", "c1", "a", 0), ("node-exit", "r1", "c1", "a", 10), ("node-enter", "r1", "c2", "b", 5), ("node-exit", "r1", "c2", "b", 100),
         ("node-enter", "r2", "c3", "b", 20), ("node-enter", "r2", "c4", None, 0), ("node-enter", "r1", "c5", "b", 30), ("node-exit", "r1", "c5", "b", 40)],
        "kind string, run_id string, call_id string, name string, at_ms long",
    )
    asked = [
        (1, "a", "r1", None, 7, "c1"), (2, "a", "r1", None, 20, None), (3, None, "r1", None, 50, None), (4, "b", "r1", None, 50, "c2"), (5, "b", "r1", "c2", 35, "c2"),
        (6, "b", None, None, 35, "c5"), (7, "b", None, None, 50, "c3"), (8, "b", "r9", None, 5000, "c3"), (9, "b", "r1", "c5", 41, "c2"), (10, "", None, None, 50, None), (11, "zz", None, None, 5, None),
    ]
    events = spark.createDataFrame([x[:5] for x in asked], "id long, name string, run_id string, call_id string, at_ms long")
    for part in (events, events.repartition(3)):
        assert {r.id: r.span_call_id for r in telemetry.events_on_spans(part, trace).collect()} == {x[0]: x[5] for x in asked}
    assert telemetry.events_on_spans(events.limit(0), trace).count() == 0


def test_unsent_requests_are_kept_up_to_a_bound(spark):
    posted = spark.createDataFrame([(f"p{i}", i % 2 == 0, None) for i in range(10)], "payload string, ok boolean, error string").coalesce(1)
    first = telemetry.unsent(posted)
    assert sorted(r.payload for r in first.collect()) == ["p1", "p3", "p5", "p7", "p9"]
    again = telemetry.unsent(posted.where("payload = 'p1'"), first, 3)
    assert sorted(r.payload for r in again.collect()) == ["p1", "p7", "p9"]


def test_null_handles_stay_null(spark):
    from weftline.sources import blobs

    rows = spark.createDataFrame([(1, "x"), (2, None)], "id long, text string")
    stored = blobs.put(rows, "text")
    handles = rows.select("id", blobs.handle(F.col("text"), "text/plain").alias("h")).select("id", "h.*")
    assert {r.id: r.content for r in blobs.get(handles, stored).collect()} == {1: b"x", 2: None}


def test_handle_names_over_partitions(spark):
    from weftline.sources import files

    rows = spark.createDataFrame([(i, "image/png" if i % 2 else "x/y") for i in range(20)], "pos long, type string").repartition(4)
    assert [r.name for r in files.handle_names(rows).orderBy("pos").collect()] == [f"handle-{i + 1}.{'png' if i % 2 else 'bin'}" for i in range(20)]
