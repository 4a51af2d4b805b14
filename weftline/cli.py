"""python -m weftline.cli COMMAND ...: single files and specs, without a Spark session.

archive create FORMAT OUT FILE... [--mtime NAME=MS]...   archive extract FORMAT FILE DIR   pdf shrink FILE OUT   pdf pages FILE
image FILE OUT   text [FILE] [--types a,b]   transform FROM TO [FILE] [--delimiter D]   pipeline describe | validate SPEC | plan SPEC
pipeline run SPEC INPUT | status SPEC INPUT [--run-id ID] [--ledger DIR] [--trace | --trace-full]

In INPUT {"$file": name, "type": ...} stands for a file below INPUT's folder. --ledger keeps what runs have done, so that a run is
resumed by its id. Tables of runs: weftline.plans.run.
"""

from __future__ import annotations

import argparse
import base64
import hashlib
import json
import os
import sys

from weftline.functions import formats, images, pdf, redact
from weftline.plans import run as runs
from weftline.plans import spec
from weftline.sources import archive


def read(path: str | None) -> bytes:
    if path in (None, "-"):
        return sys.stdin.buffer.read()
    with open(path, "rb") as f:
        return f.read()


def write(path: str, data: bytes) -> None:
    with open(path, "wb") as f:
        f.write(data)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weftline", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)
    for name, does in (("archive", ("create", "extract")), ("pdf", ("shrink", "pages")), ("pipeline", ("describe", "validate", "plan", "run", "status"))):
        p = commands.add_parser(name)
        p.add_argument("action", choices=does)
        p.add_argument("rest", nargs="*")
        if name == "archive":
            p.add_argument("--mtime", action="append", default=[], metavar="NAME=MS")
        if name == "pipeline":
            p.add_argument("--run-id")
            p.add_argument("--ledger")
            p.add_argument("--trace", action="store_true")
            p.add_argument("--trace-full", action="store_true")
    p = commands.add_parser("image")
    p.add_argument("file")
    p.add_argument("out")
    p = commands.add_parser("text")
    p.add_argument("file", nargs="?")
    p.add_argument("--types", help="comma-separated; all without it")
    p = commands.add_parser("transform")
    p.add_argument("source", choices=("auto", *formats.FORMATS))
    p.add_argument("target", choices=formats.FORMATS)
    p.add_argument("file", nargs="?")
    p.add_argument("--delimiter", default=",")
    return top


def run(args: argparse.Namespace) -> object:
    match args.command, getattr(args, "action", None):
        case "archive", "create":
            kind, out, *paths = args.rest
            own = dict(m.rsplit("=", 1) for m in args.mtime)
            names = {os.path.basename(p) for p in paths}
            if own.keys() - names:
                raise ValueError(f"--mtime for no file of the archive: {', '.join(sorted(own.keys() - names))}")
            made = []
            for p in paths:
                name = os.path.basename(p)
                made.append(archive.Entry(name, read(p), int(own[name]) if name in own else int(os.path.getmtime(p) * 1000)))
            write(out, archive.create(kind, made))
            return {"files": len(paths)}
        case "archive", "extract":
            kind, path, folder = args.rest
            entries, skipped = archive.extract(kind, read(path))
            targets = [(archive.safe_path(os.path.abspath(folder), e.name), e) for e in entries]
            for target, e in targets:
                if e.name.endswith("/"):
                    os.makedirs(target, exist_ok=True)
                    continue
                os.makedirs(os.path.dirname(target), exist_ok=True)
                write(target, e.data)
                if e.mtime is not None:
                    os.utime(target, (e.mtime / 1000, e.mtime / 1000))
            return {"written": len(entries), "skipped": skipped}
        case "pdf", "pages":
            return {"pages": pdf.page_count(read(args.rest[0]))}
        case "pdf", "shrink":
            out, saved = pdf.shrink(read(args.rest[0]))
            write(args.rest[1], out)
            return {"outputBytes": len(out), "savedPct": saved}
        case "image", _:
            data = read(args.file)
            kind, out = images.sanitize(data)
            write(args.out, out)
            return {"kind": kind, "strippedBytes": len(data) - len(out)}
        case "text", _:
            types = None if args.types is None else [t for t in args.types.split(",") if t]
            text, counts = redact.redact_text(read(args.file).decode("utf-8", "replace").removeprefix("﻿"), types)
            return {"redacted": text, "counts": counts}
        case "transform", _:
            return formats.convert(read(args.file).decode("utf-8", "replace").removeprefix("﻿"), args.source, args.target, args.delimiter)
        case "pipeline", "describe":
            return spec.describe()
        case "pipeline", "validate":
            return spec.validate(json.loads(read(args.rest[0])))
        case "pipeline", "plan":
            return spec.plan(json.loads(read(args.rest[0])))
        case "pipeline", "run" | "status" as action:
            made, given = json.loads(read(args.rest[0])), with_files(json.loads(read(args.rest[1])), os.path.dirname(os.path.abspath(args.rest[1])))
            return (run_one if action == "run" else status_of)(made, given, args)
    raise ValueError(args.command)


def with_files(v: object, folder: str) -> object:
    """An input with the files it refers to, as bytes."""
    if isinstance(v, list):
        return [with_files(x, folder) for x in v]
    if not isinstance(v, dict):
        return v
    if isinstance(v.get("$file"), str):
        data = read(archive.safe_path(folder, v["$file"]))
        return {"$handle": True, "base64": base64.b64encode(data).decode(), **({"type": v["type"]} if "type" in v else {})}
    return {k: with_files(x, folder) for k, x in v.items()}


def ledger_path(args: argparse.Namespace) -> str | None:
    if not args.ledger:
        return None
    if not args.run_id:
        raise ValueError("--ledger needs --run-id")
    return os.path.join(args.ledger, hashlib.sha256(args.run_id.encode()).hexdigest() + ".json")


def earlier(path: str | None) -> dict | None:
    """What a run's ledger has, or None."""
    if not path or not os.path.exists(path):
        return None
    kept = json.loads(read(path))
    return kept | {"blobs": [{"sha256": b["sha256"], "content": base64.b64decode(b["content"])} for b in kept["blobs"]]}


def run_one(made: dict, given: object, args: argparse.Namespace) -> object:
    wrong = spec.validate(made)
    if wrong:
        raise ValueError("; ".join(f"{e['path']}: {e['message']}" for e in wrong))
    path = ledger_path(args)
    before = earlier(path) or {"signature": None, "ledger": [], "blobs": []}
    row = {"run_id": args.run_id, "input": json.dumps(given), "answers": None, "was": before["signature"], "blobs": before["blobs"], "known": [x for x in before["ledger"] if x["done"]]}
    host = runs.Host(trace="full" if args.trace_full else args.trace)
    done = runs.outcome(row, made, host, {})
    if path:
        os.makedirs(args.ledger, exist_ok=True)
        blobs = [{"sha256": b["sha256"], "content": base64.b64encode(b["content"]).decode()} for b in done["blobs"]]
        write(path, json.dumps({"signature": done["signature"], "ledger": done["ledger"], "blobs": blobs}).encode())
    if not done["ok"]:
        raise ValueError(done["error"])
    result = json.loads(done["output"])
    out = {"result": result} | ({"trace": done["trace"]} if host.trace else {}) | ({"runId": done["run_id"]} if path else {})
    return out if len(out) > 1 else result


def status_of(made: dict, given: object, args: argparse.Namespace) -> object:
    path = ledger_path(args)
    if not path:
        raise ValueError("status needs --ledger and --run-id")
    before = earlier(path)
    if before is None or before["signature"] != runs.run_identity(made, given):
        return {"done": False, "started": False}
    root = next((x for x in before["ledger"] if x["path"] == ""), None)
    if root is None or not root["done"]:
        return {"done": False, "started": root is not None}
    own = runs.Run(runs.Host(), args.run_id, {}, {}, {b["sha256"]: b["content"] for b in before["blobs"]})
    return {"done": True, "result": own.dehydrated(json.loads(root["value"]))}


def main(argv: list[str] | None = None) -> int:
    try:
        out = run(parser().parse_args(argv))
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(out if isinstance(out, str) else json.dumps(out, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
