"""Combinators, specs, reconcile, stores, ledgers: errors and corner cases."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import combinators as c
from weftline.operators import reconcile, runs, telemetry
from weftline.plans import spec
from weftline.sources import blobs, files


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_errors_of_steps(spark):
    for bad in (c.cond([(c.equals("b"), lambda v: v)]), c.race(lambda v: c.attempt(F.lit(None).cast("string"))), c.race(*[lambda v: c.attempt(F.when(v == "z", v))] * 3, need=2)):
        with pytest.raises(Exception):
            value(spark, bad(F.lit("a")))
    for make in (lambda: c.race(lambda v: v, need=2), lambda: c.parallel(), lambda: c.parallel(*[lambda v: v] * 33), lambda: c.check_rename(["name", "files"], "files", "name"), lambda: c.ask(spark.range(1), "id", "id", None, "later")):
        with pytest.raises(ValueError):
            make()


def test_predicates_and_null(spark):
    rows = spark.createDataFrame([(None,), ("a",), ("b",)], "v string")
    got = [tuple(r) for r in rows.select(c.equals(None)(F.col("v")), c.equals("a")(F.col("v")), c.one_of(["a", None])(F.col("v")), c.one_of(["b"])(F.col("v"))).collect()]
    assert got == [(True, False, True, False), (False, True, True, False), (False, False, False, True)]


def test_map_field(spark):
    v = F.struct(F.array(F.struct(F.lit("a").alias("name"), F.lit(1).alias("handle"))).alias("entries"), F.array(F.lit("x")).alias("skipped"))
    out = value(spark, c.map_field("entries", "handle", lambda x: x * 2, "files")(v))
    assert out.asDict(True) == {"skipped": ["x"], "files": [{"name": "a", "handle": 2}]}


def test_failures(spark):
    a = lambda *oks: F.array(*(F.struct(F.lit(ok).alias("ok"), F.lit(f"e{i}").alias("error")) for i, ok in enumerate(oks)))
    assert [value(spark, c.failures(a(*x), "map")) for x in ((True,), (True, False), (False, False))] == [None, "e1", "map: 2 concurrent failures"]


def test_ask(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    with pytest.raises(Exception, match="no answer"):
        c.ask(rows, "v", "k", None, "fail").collect()
    assert [r.v for r in c.ask(rows, "v", "k", None, "proceed").collect()] == ["a", "b"]


def test_sinks(spark):
    seen = []
    good, bad = (lambda df, o: seen.append(df.count())), (lambda df, o: 1 / 0)
    with pytest.raises(ValueError, match="unknown sink"):
        c.fan_out(spark.range(2), ["good", "nope"], {"good": good})
    assert not seen
    with pytest.raises(ZeroDivisionError):
        c.fan_out(spark.range(2), ["bad", "good"], {"good": good, "bad": bad})
    assert seen == [2]
    with pytest.raises(RuntimeError, match="2 concurrent"):
        c.fan_out(spark.range(2), ["bad", "bad"], {"bad": bad})


def test_reconcile(spark):
    rows = spark.createDataFrame([("g", 0, '{"name":"alice","age":30,"tags":["x","y"],"__proto__":1}'), ("g", 1, '{"age":31,"city":"nyc","tags":["y","z"]}'), ("g", 2, '{"tags":"z","o":{"b":1,"a":[2]}}')], "g string, pos int, doc string")
    merge = lambda **how: reconcile.field_merge(rows, ["g"], **how).first().merged
    assert merge() == '{"name":"alice","age":31,"tags":"z","city":"nyc","o":{"b":1,"a":[2]}}'
    assert merge(policy={"tags": "union", "age": "keep-first"}) == '{"name":"alice","age":30,"tags":["x","y","z"],"city":"nyc","o":{"b":1,"a":[2]}}'
    with pytest.raises(ValueError):
        merge(default="newest")
    handles = spark.createDataFrame([("g", 0, 5, "a"), ("g", 1, 7, "b"), ("g", 2, 7, "c")], "g string, pos int, produced_at long, v string")
    assert reconcile.last_write_wins(handles, ["g"], F.col("v")).first().winner == "c"
    with pytest.raises(Exception, match="no time"):
        reconcile.last_write_wins(handles.withColumn("produced_at", F.lit(None).cast("long")), ["g"], F.col("v")).collect()


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "k int, t string")
    stored = blobs.put(rows, "t")
    assert stored.count() == 2 and blobs.put_new(rows.union(spark.createDataFrame([(4, "z")], rows.schema)), "t", stored).count() == 1
    handles = rows.select("k", blobs.handle(F.col("t"), "text/plain").alias("h")).select("k", "h.*")
    with pytest.raises(Exception, match="handle not found"):
        blobs.get(handles, stored.limit(0)).collect()
    with pytest.raises(Exception, match="size mismatch"):
        blobs.get(handles.withColumn("size", F.lit(9).cast("long")), stored).collect()
    with pytest.raises(Exception, match="sha256 mismatch"):
        blobs.get(handles, stored.withColumn("content", F.lit("q").cast("binary"))).collect()
    with pytest.raises(Exception, match="not base64"):
        blobs.hydrate(spark.createDataFrame([("%%%", None)], "base64 string, type string")).collect()
    texts = spark.createDataFrame([(b"\xef\xbb\xbfhi\xff",), (b"ok\n",), (b"\x00",)], "b binary")
    assert [tuple(r) for r in texts.select(blobs.text_of(F.col("b")), blobs.looks_like_text(F.col("b"))).collect()] == [("hi�", False), ("ok\n", True), ("\x00", False)]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("alpha")
    refs = spark.createDataFrame([("a.txt", None)], "file string, type string")
    assert files.hydrated_refs(spark, refs, str(tmp_path / "in")).first().handle.size == 5
    for bad in ("../a.txt", "/etc/passwd", "missing"):
        with pytest.raises(Exception):
            files.hydrated_refs(spark, spark.createDataFrame([(bad, None)], refs.schema), str(tmp_path / "in")).select("handle").collect()
    assert files.text_files(spark, str(tmp_path / "in")).first().text == "alpha"
    out = files.write_bytes(spark.createDataFrame([("d/x", bytearray(b"1"), 1_000_000), ("e/", None, None)], "name string, content binary, mtime long"), str(tmp_path / "out"), mtime="mtime").collect()
    assert (tmp_path / "out/d/x").read_bytes() == b"1" and (tmp_path / "out/d/x").stat().st_mtime == 1000 and (tmp_path / "out/e").is_dir() and len(out) == 2
    named = files.handle_names(spark.createDataFrame([(2, "image/png"), (1, "x/y")], "pos int, type string"))
    assert sorted(r.name for r in named.collect()) == ["handle-1.bin", "handle-2.png"]


def test_ledger(spark):
    ledger = spark.createDataFrame([("r", "0", True, "v"), ("r", "1", False, None)], "run_key string, path string, done boolean, value string")
    nodes = spark.createDataFrame([("r", "0"), ("r", "1"), ("r", "2")], "run_key string, path string")
    begun = runs.started(ledger, nodes)
    assert sorted(r.path for r in runs.pending(nodes, begun).collect()) == ["1", "2"]
    done = runs.finished(begun, spark.createDataFrame([("r", "1", "w")], "run_key string, path string, value string"))
    assert sorted((r.path, r.done, r.value) for r in done.collect()) == [("0", True, "v"), ("1", True, "w"), ("2", False, None)]
    keys = spark.createDataFrame([("a", None), ("a", "s")], "i string, s string").select(runs.run_key(F.col("i"), F.col("s")).alias("k")).collect()
    assert [r.k for r in keys] == ["a", "a\x00s"]


def test_parent_paths(spark):
    rows = spark.createDataFrame([("",), ("0",), ("0/1/2",)], "p string")
    assert [r.x for r in rows.select(telemetry.parent_path(F.col("p")).alias("x")).collect()] == [None, "", "0/1"]


VALID = [
    {"tag": "leaf", "name": "unzip"}, {"tag": "map", "op": {"tag": "leaf", "name": "stamp"}, "concurrency": {"kind": "aimd", "min": 1, "max": 3}},
    {"tag": "race", "ops": [{"tag": "leaf", "name": "stamp"}] * 2, "need": 2}, {"tag": "reconcile", "opts": {"mode": "field-merge", "defaultPolicy": "union", "policy": {"a": "keep-first"}}},
    {"tag": "mapField", "arrayField": "a", "elementField": "b", "op": {"tag": "leaf", "name": "stamp"}, "concurrency": 32}, {"tag": "sink", "targets": ["store", {"name": "x", "opts": {"retries": 5}}]},
    {"tag": "cond", "cases": [{"when": {"in": [1, None, "x"]}, "then": {"tag": "leaf", "name": "stamp"}}], "default": {"tag": "ask", "prompt": "p", "timeout": "1", "onTimeout": "proceed"}},
    {"tag": "pipe", "steps": [{"tag": "leaf", "name": "unzip"}, {"tag": "map", "concurrency": 1, "op": {"tag": "leaf", "name": "extract"}}, {"tag": "reconcile", "opts": {"mode": "last-write-wins"}}]},
]
WRONG = [
    ("x", "$"), ({}, "$"), ({"tag": "leaf"}, "$"), ({"tag": "leaf", "name": "toString"}, "$"), ({"tag": "leaf", "name": "unzip", "params": {}}, "$"), ({"tag": "leaf", "name": "stamp", "opts": {"kind": "x"}}, "$"),
    ({"tag": "leaf", "name": "stamp", "opts": {"retries": True}}, "$"), ({"tag": "map", "op": {"tag": "leaf", "name": "stamp"}, "concurrency": {"kind": "aimd", "min": 4, "max": 3}}, "$"), ({"tag": "pipe", "steps": []}, "$"),
    ({"tag": "mapField", "arrayField": "__proto__", "elementField": "b", "op": {"tag": "leaf", "name": "stamp"}, "concurrency": 1}, "$"), ({"tag": "sink", "targets": ["a"] * 33}, "$"), ({"tag": "sink", "targets": [{"name": "a", "opts": {"memo": 1}}]}, "$"),
    ({"tag": "reconcile", "opts": {"mode": "field-merge", "policy": {"a": "x"}}}, "$"), ({"tag": "catch", "try": {"tag": "pipe", "steps": []}, "catch": {"tag": "leaf", "name": "stamp"}}, "$.try"), ({"tag": "parallel", "ops": [{"tag": "leaf", "name": "stamp"}] * 33}, "$"),
    ({"tag": "pipe", "steps": [{"tag": "leaf", "name": "unzip"}, {"tag": "leaf", "name": "redact"}]}, "$"),
]


@pytest.mark.parametrize("s", VALID)
def test_valid_specs(s):
    assert spec.validate(s) == []


@pytest.mark.parametrize("s,path", WRONG)
def test_wrong_specs(s, path):
    assert path in {e["path"] for e in spec.validate(s)}
    with pytest.raises(ValueError):
        spec.build(s, spec.TEXT_LEAVES)


def test_build(spark):
    s = {"tag": "pipe", "steps": [{"tag": "race", "ops": [{"tag": "leaf", "name": "none"}, {"tag": "leaf", "name": "upper"}]}, {"tag": "catch", "try": {"tag": "leaf", "name": "none"}, "catch": {"tag": "leaf", "name": "sha256"}}]}
    leaves = spec.TEXT_LEAVES | {"none": lambda v: F.lit(None).cast("string")}
    assert value(spark, spec.build(s, leaves)(F.lit("a"))) == value(spark, F.sha2(F.lit("A").cast("binary"), 256))
    with pytest.raises(ValueError, match="no implementation"):
        spec.build({"tag": "leaf", "name": "unzip"}, {})
    assert spec.describe({"mine": 1}, {"log": 1})["sinks"] == ["store", "log"] and spec.describe({"mine": 1})["leaves"]["mine"] == {"input": "unknown", "output": "unknown"}
