"""Runs of specs: every tag, every built-in leaf, resuming, traces, sinks, and the command line."""

import base64
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from weftline import cli
from weftline.functions import redact
from weftline.operators.governed import Policy
from weftline.plans import run, spec

LEAVES = {
    "up": lambda v, own: v.upper(), "boom": lambda v, own: (_ for _ in ()).throw(RuntimeError("down")), "twice": lambda v, own: v * 2,
    "same": lambda v, own: v, "text": lambda v, own: own.text_of(v), "typed": lambda v, own: v["type"],
}


def leaf(name, **more):
    return {"tag": "leaf", "name": name, **more}


def bytes_in(data, kind="application/octet-stream"):
    data = data.encode() if isinstance(data, str) else data
    return {"$handle": True, "base64": base64.b64encode(data).decode(), "type": kind}


def once(made, given, **host):
    row = {"run_id": "r", "input": json.dumps(given), "was": None, "known": None, "blobs": None, "answers": host.pop("answers", None)}
    return run.outcome(row, made, run.Host(leaves={**LEAVES, **host.pop("leaves", {})}, **host), {})


def value(made, given, **host):
    out = once(made, given, **host)
    assert out["ok"], out["error"]
    return json.loads(out["output"])


@pytest.mark.parametrize("made,given,want", [
    ({"tag": "pipe", "steps": [leaf("up"), leaf("twice")]}, "a", "AA"),
    ({"tag": "map", "concurrency": 2, "op": leaf("up")}, ["a", "b"], ["A", "B"]),
    ({"tag": "mapField", "arrayField": "xs", "elementField": "e", "renameTo": "ys", "concurrency": 1, "op": leaf("up")}, {"xs": [{"e": "a", "k": 1}], "z": 2}, {"z": 2, "ys": [{"e": "A", "k": 1}]}),
    ({"tag": "parallel", "ops": [leaf("up"), leaf("twice")]}, "a", ["A", "aa"]),
    ({"tag": "race", "ops": [leaf("boom"), leaf("up"), leaf("twice")]}, "a", "A"),
    ({"tag": "race", "need": 2, "ops": [leaf("up"), leaf("boom"), leaf("twice")]}, "a", ["A", "aa"]),
    ({"tag": "catch", "try": leaf("boom"), "catch": leaf("up")}, "a", "A"),
    ({"tag": "cond", "cases": [{"when": {"field": "k", "equals": 1}, "then": leaf("same")}], "default": leaf("twice")}, {"k": 1}, {"k": 1}),
    ({"tag": "cond", "cases": [{"when": {"in": [True, "x"]}, "then": leaf("up")}], "default": leaf("twice")}, 1, 2),
    ({"tag": "ask", "prompt": "?", "timeout": "1h", "onTimeout": "proceed"}, "a", "a"),
])
def test_tags(made, given, want):
    assert value(made, given) == want


@pytest.mark.parametrize("made,given,error", [
    (leaf("boom"), "a", "down"),
    ({"tag": "map", "concurrency": 2, "op": leaf("boom")}, ["a", "b"], "map: 2 concurrent failures"),
    ({"tag": "race", "need": 2, "ops": [leaf("boom"), leaf("boom"), leaf("up")]}, "a", "race: fewer than 2 of 3 branches succeeded"),
    ({"tag": "race", "ops": [leaf("boom")]}, "a", "down"),
    ({"tag": "cond", "cases": [{"when": {"equals": 1}, "then": leaf("up")}]}, True, "no case matched"),
    ({"tag": "mapField", "arrayField": "xs", "elementField": "e", "renameTo": "z", "concurrency": 1, "op": leaf("same")}, {"xs": [], "z": 2}, "`z` is a field already"),
    ({"tag": "ask", "prompt": "why", "timeout": "1h", "onTimeout": "fail"}, "a", "no answer to why"),
    ({"tag": "sink", "targets": ["queue"]}, "a", 'unknown sink "queue"'),
    (leaf("extract"), bytes_in("x"), "no language model"),
    (leaf("same"), {"r2Key": "cas/x", "sha256": "x", "type": "t", "size": 1}, "may not hold a handle"),
    (leaf("same"), {"$handle": True, "base64": "!!"}, "no base64"),
    ({"tag": "reconcile", "opts": {"mode": "faithful-union"}}, [], "empty"),
    ({"tag": "reconcile", "opts": {"mode": "last-write-wins"}}, [bytes_in("x")], "no time"),
])
def test_errors(made, given, error):
    out = once(made, given)
    assert not out["ok"] and error in out["error"] and out["result"] is None


def test_archive_leaves():
    pack = {"tag": "pipe", "steps": [leaf("pack", params={"format": "zip"}), leaf("unzip"), {"tag": "map", "concurrency": 1, "op": leaf("text")}]}
    assert value(pack, {"files": [{"name": "a.txt", "handle": bytes_in("one")}, {"name": "b.pdf", "handle": bytes_in("two"), "mtime": 1_600_000_000_000}]}) == ["one", "two"]
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("x.pdf", b"p")
        f.writestr("y", b"q")
    assert value({"tag": "pipe", "steps": [leaf("unzip"), {"tag": "map", "concurrency": 1, "op": leaf("typed")}]}, bytes_in(z.getvalue())) == ["application/pdf", "application/octet-stream"]
    both = {"tag": "pipe", "steps": [leaf("unpack", params={"format": "zip"}), {"tag": "mapField", "arrayField": "entries", "elementField": "handle", "concurrency": 1, "op": leaf("text")}]}
    got = value(both, {"handle": bytes_in(z.getvalue())})
    assert [(e["name"], e["handle"]) for e in got["entries"]] == [("x.pdf", "p"), ("y", "q")]


def test_text_image_and_pdf_leaves():
    clean = value(leaf("redact"), {"handle": bytes_in("mail a.b@c.org now"), "types": ["email"]})
    assert base64.b64decode(clean["handle"]["base64"]) == b"mail [REDACTED:email] now" and clean["counts"] == {"email": 1}
    csv = value({"tag": "pipe", "steps": [leaf("convert", params={"from": "json", "to": "csv"}), leaf("text")]}, {"handle": bytes_in('[{"a":1,"b":"x"}]')})
    assert csv.splitlines() == ["a,b", "1,x"]
    png = bytes.fromhex("89504e470d0a1a0a0000000d4948445200000001000000010800000000") + bytes.fromhex("3a7e9b55") + bytes.fromhex("0000000049454e44ae426082")
    assert value(leaf("scrub"), {"handle": bytes_in(png)})["kind"] == "png"
    doc = b"%PDF-1.4\n1 0 obj\n<</Type/Catalog/Pages 2 0 R>>\nendobj\n2 0 obj\n<</Type/Pages/Count 1/Kids[3 0 R]>>\nendobj\n3 0 obj\n<</Type/Page/Parent 2 0 R/MediaBox[0 0 9 9]>>\nendobj\ntrailer\n<</Root 1 0 R>>\nstartxref\n0\n%%EOF\n"
    assert value(leaf("pageCount"), bytes_in(doc)) == 1
    small = value(leaf("shrink"), {"handle": bytes_in(doc)})
    assert small["inputBytes"] == len(doc) and small["outputBytes"] == small["handle"]["size"]
    out = value({"tag": "pipe", "steps": [leaf("extract"), leaf("summarize")]}, bytes_in(doc), models={"extract": lambda b: f"{len(b)} bytes", "summarize": lambda t: t[:3]})
    assert out["abstract"] == str(len(doc))[:3] and out["summaryHandle"]["type"] == "text/markdown"
    wrapped = {"tag": "pipe", "steps": [leaf("stamp"), leaf("wrapHandle"), leaf("unwrapHandle"), leaf("text")]}
    assert value(wrapped, bytes_in("t")) == "t"
    assert sorted(run.LEAVES) == sorted(spec.SHAPES)


def test_reconcile():
    texts = lambda mode, **o: {"tag": "pipe", "steps": [{"tag": "reconcile", "opts": {"mode": mode, **o}}, leaf("text")]}
    got = value(texts("faithful-union"), [bytes_in("b"), bytes_in("a"), bytes_in("b")])
    assert [x.split("\n")[1] for x in got.split("\n\n")] == ["b", "a"]
    docs = [bytes_in(json.dumps(d)) for d in ({"a": 1, "t": ["x"], "k": {"p": 1, "q": 2}}, {"t": ["y", "x"], "a": 2, "__proto__": 3, "k": {"q": 2, "p": 1}})]
    assert json.loads(value(texts("field-merge", policy={"t": "union", "k": "union"}), docs)) == {"a": 2, "t": ["x", "y"], "k": [{"p": 1, "q": 2}]}
    assert json.loads(value(texts("field-merge", defaultPolicy="keep-first"), docs))["a"] == 1
    clock = iter(range(10**6))
    last = {"tag": "pipe", "steps": [{"tag": "map", "concurrency": 1, "op": leaf("stamp")}, *texts("last-write-wins")["steps"]]}
    assert value(last, [bytes_in("a"), bytes_in("b")], now=lambda: next(clock)) == "b"


def test_retries_memo_and_events():
    tries = []

    def flaky(v, own):
        tries.append(v)
        if len(tries) % 2:
            raise RuntimeError("once")
        return own.put(f"made of {v}")

    made = {"tag": "map", "concurrency": 1, "op": {"tag": "pipe", "steps": [leaf("flaky", opts={"retries": 1, "memo": True}), leaf("text")]}}
    out = once(made, ["a", "a"], leaves={"flaky": flaky}, policies={"flaky": Policy(backoff_base=0)})
    assert json.loads(out["output"]) == ["made of a"] * 2 and tries == ["a", "a"]
    assert [e["kind"] for e in out["events"]] == ["retry-attempt", "memo-miss", "memo-hit"]


def test_trace_and_snapshots(monkeypatch):
    made = {"tag": "pipe", "steps": [leaf("up"), {"tag": "catch", "try": leaf("boom"), "catch": leaf("same")}]}
    out = once(made, "a", trace="full")
    seen = [(e["kind"], e["path"], e.get("ok")) for e in out["trace"]]
    assert seen == [("node-enter", "", None), ("node-enter", "0", None), ("node-exit", "0", True), ("node-enter", "1", None), ("node-enter", "1/try", None), ("node-exit", "1/try", False), ("node-enter", "1/catch", None), ("node-exit", "1/catch", True), ("node-exit", "1", True), ("node-exit", "", True)]
    blobs = {b["sha256"]: b["content"] for b in out["blobs"]}
    assert blobs[out["trace"][2]["ref"]] == b'"A"'
    monkeypatch.setattr(run, "MAX_SNAPSHOT", 2)
    assert once(made, "a", trace="full")["trace"][2]["ref"] is None
    monkeypatch.setattr(run, "MAX_TRACE", 3)
    assert "more than 3 events" in once(made, "a")["error"]
    assert once(made, "a", trace=False)["trace"] == []


def test_identity_does_not_depend_on_key_order():
    a, b = {"tag": "leaf", "name": "up"}, {"name": "up", "tag": "leaf"}
    assert run.run_identity(a, {"x": 1, "y": 2}) == run.run_identity(b, {"y": 2, "x": 1}) != run.run_identity(a, {"x": 1})


def test_runs_over_a_table(spark):
    """Failures stay their own; a reused id with another input meets nothing of the other run; answers come by path."""
    ask = {"tag": "pipe", "steps": [{"tag": "ask", "prompt": "?", "timeout": "1h", "onTimeout": "fail"}, leaf("same"), {"tag": "sink", "targets": ["store", "log"]}]}
    rows = spark.createDataFrame([("a", '"x"'), ("b", '"y"'), ("c", "{bad"), (None, None)], "run_id string, input string")
    answers = spark.createDataFrame([("a", "0", True, '"z"'), ("b", "0", False, None)], "run_id string, path string, answered boolean, value string")
    host = run.Host(leaves={"same": LEAVES["same"]}, sinks=("log",))
    first = run.run_spec(rows, ask, host, answers)
    got = {r.run_id: r for r in first.results.collect()}
    assert got["a"].result == '"z"' and "no answer" in got["b"].error and not got["c"].ok and len(got) == 4
    answers = spark.createDataFrame([("b", "0", True, None)], "run_id string, path string, answered boolean, value string")
    again = run.run_spec(rows.where("run_id is not null").replace({'"x"': '"other"'}, subset=["input"]), ask, host, answers, first.table)
    got = {r.run_id: r for r in again.results.collect()}
    assert got["b"].result == '"y"' and "no answer" in got["a"].error
    state = {r.run_id: r.status for r in run.status(rows.where("run_id in ('a', 'b')"), ask, first.table).collect()}
    assert state == {"a": "done", "b": "in-progress"}
    assert {r.status for r in run.status(rows.where("run_id = 'a'").withColumn("input", F.lit('"q"')), ask, first.table).collect()} == {"never-started"}
    sent, fails = [], [1]

    def log(df, options):
        if fails:
            fails.pop()
            raise RuntimeError("down")
        sent.extend(r.content for r in df.collect())

    ask["steps"][2]["opts"] = {"retries": 1}
    run.run_spec(rows.where("run_id = 'b'"), ask, host, answers).send({"log": log}, Policy(backoff_base=0))
    assert sent == ['"y"']
    assert first.blobs.where("content = cast('\"z\"' as binary)").count() == 1
    with pytest.raises(ValueError):
        first.send({})
    with pytest.raises(ValueError):
        run.run_spec(rows, {"tag": "leaf", "name": "nothing"})
    assert run.run_spec(rows.limit(0), ask, host).results.count() == 0


@pytest.mark.parametrize("text", [
    "write to x.y@z.org or +4930123456 ok", "card 4111-1111-1111-1111 and 4111 1111 1111 1112", "SSN 078051120, ref 078051120" + "." * 40, "10.1.2.3 300.1.1.1 ::1 fe80::9:8 1:2:3:4:5:6:7:8",
    "078-05-1120 and 030 1234 5678 (040) 123-4567", "", "éa@b.com٣123456789 ssn",
])
def test_one_text_as_columns_do(spark, text):
    r = redact.with_redaction(spark.createDataFrame([(text,)], "text string")).first()
    assert redact.redact_text(text) == (r.redacted, r.counts)


def test_documents_as_columns_do(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in redact.with_redaction(docs.select("text")).collect():
        assert redact.redact_text(r.text) == (r.redacted, r.counts)


def test_command_line(tmp_path, capsys):
    def call(*args):
        code = cli.main([str(a) for a in args])
        return code, capsys.readouterr().out

    (tmp_path / "doc.txt").write_text("to a@b.com")
    made = {"tag": "pipe", "steps": [leaf("redact"), leaf("unwrapHandle")]}
    (tmp_path / "spec.json").write_text(json.dumps(made))
    (tmp_path / "in.json").write_text(json.dumps({"handle": {"$file": "doc.txt", "type": "text/plain"}}))
    code, out = call("pipeline", "run", tmp_path / "spec.json", tmp_path / "in.json", "--run-id", "one", "--ledger", tmp_path / "ledger", "--trace")
    got = json.loads(out)
    assert code == 0 and base64.b64decode(got["result"]["base64"]) == b"to [REDACTED:email]" and got["runId"] == "one" and len(got["trace"]) == 6
    again = json.loads(call("pipeline", "run", tmp_path / "spec.json", tmp_path / "in.json", "--run-id", "one", "--ledger", tmp_path / "ledger", "--trace")[1])
    assert again["result"] == got["result"] and again["trace"] == []
    said = json.loads(call("pipeline", "status", tmp_path / "spec.json", tmp_path / "in.json", "--run-id", "one", "--ledger", tmp_path / "ledger")[1])
    assert said == {"done": True, "result": got["result"]}
    assert json.loads(call("pipeline", "status", tmp_path / "spec.json", tmp_path / "in.json", "--run-id", "two", "--ledger", tmp_path / "ledger")[1]) == {"done": False, "started": False}
    (tmp_path / "in.json").write_text(json.dumps({"handle": {"$file": "../x"}}))
    assert call("pipeline", "run", tmp_path / "spec.json", tmp_path / "in.json")[0] == 1
    assert json.loads(call("text", tmp_path / "doc.txt", "--types", "email")[1]) == {"redacted": "to [REDACTED:email]", "counts": {"email": 1}}
    assert call("archive", "create", "zip", tmp_path / "a.zip", tmp_path / "doc.txt", "--mtime", "doc.txt=1600000000000")[0] == 0
    assert zipfile.ZipFile(tmp_path / "a.zip").infolist()[0].date_time[0] == 2020
    assert call("archive", "create", "zip", tmp_path / "a.zip", tmp_path / "doc.txt", "--mtime", "other=1")[0] == 1
