"""Pipelines as JSON: what is valid, what it would cost, what there is to use, and compiling one to a step.

A spec is a nested dict with a tag at each node: leaf pipe map mapField sink reconcile catch ask cond parallel race.
Rules live in one table of checks for each tag; validation, planning and compiling walk the same children.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.values import RESERVED
from weftline.operators import combinators as c
from weftline.operators.reconcile import MODES, POLICIES

# The tags, the limits, and the shapes of the built-in leaves. H is a handle, ? is anything.
TAGS = ("leaf", "pipe", "map", "mapField", "sink", "reconcile", "catch", "ask", "cond", "parallel", "race")
MAX_RETRIES, MAX_CONCURRENCY, MAX_WIDTH = 5, 32, 32
H, HS, ANY = "handle", "handle[]", "unknown"
FILES = {"name": ANY, "handle": H, "mtime": ANY}
SHAPES: dict[str, tuple[Any, Any]] = {
    "pack": ({"format": ANY, "files": [FILES]}, H),
    "unpack": ({"format": ANY, "handle": H}, {"entries": [FILES], "skipped": ANY}),
    "unzip": (H, HS),
    "shrink": ({"handle": H}, {"handle": H}),
    "redact": ({"handle": H}, {"handle": H}),
    "pageCount": (H, ANY),
    "scrub": ({"handle": H}, {"handle": H}),
    "convert": ({"handle": H}, H),
    "extract": (H, H),
    "stamp": (H, H),
    "summarize": (H, {"summaryHandle": H}),
    "wrapHandle": (H, {"handle": H}),
    "unwrapHandle": ({"handle": H}, H),
}
LLM_LEAVES = ("extract", "summarize")
SINKS = ("store",)


# ---------- shapes ----------


def field_fits(given: Any, wanted: Any) -> bool:
    if isinstance(wanted, list):
        return isinstance(given, list) and all(given[0].get(k) == H for k, v in wanted[0].items() if v == H)
    return wanted == ANY or given == wanted


def fits(given: Any, wanted: Any) -> bool:
    """Whether what one step gives may be what the next wants."""
    if ANY in (given, wanted) if isinstance(given, str) or isinstance(wanted, str) else False:
        return True
    if isinstance(given, str) or isinstance(wanted, str):
        return given == wanted
    return all(field_fits(given.get(k), v) for k, v in wanted.items())


def label(shape: Any) -> str:
    return shape if isinstance(shape, str) else "{" + ", ".join(shape) + "}"


def shape_of(spec: Any, extra: Mapping[str, Any]) -> tuple[Any, Any]:
    """Input and output shape of a node, as far as they can be told."""
    tag = spec.get("tag") if isinstance(spec, dict) else None
    inner = [shape_of(x, extra) for _, x in children(spec)] if tag in ("map", "mapField", "catch", "cond", "parallel", "race") else []
    lifted = lambda s: HS if s == H else ANY
    if tag == "leaf":
        return (ANY, ANY) if spec.get("name") in extra else SHAPES.get(spec.get("name"), (ANY, ANY))
    if tag == "map" and inner:
        return lifted(inner[0][0]), lifted(inner[0][1])
    if tag == "mapField" and inner and isinstance(spec.get("arrayField"), str):
        element = lambda s: [{spec.get("elementField"): H if s == H else ANY}]
        return {spec["arrayField"]: element(inner[0][0])}, {spec.get("renameTo") or spec["arrayField"]: element(inner[0][1])}
    quorum = tag == "race" and spec.get("need", 1) != 1
    if tag in ("catch", "cond") or tag == "race" and not quorum:
        return inner[0] if inner and all(x == inner[0] for x in inner) else (ANY, ANY)
    if tag == "parallel" or quorum:
        return ANY, HS if inner and all(o == H for _, o in inner) else ANY
    return ANY, ANY


# ---------- walking and checking ----------


def children(spec: Any) -> Iterator[tuple[str, Any]]:
    """The parts of a node that are specs themselves, with their paths."""
    if not isinstance(spec, dict):
        return
    lists = {"pipe": "steps", "parallel": "ops", "race": "ops"}
    match spec.get("tag"):
        case "pipe" | "parallel" | "race" as tag if isinstance(spec.get(lists[tag]), list):
            yield from ((f".{lists[tag]}[{i}]", x) for i, x in enumerate(spec[lists[tag]]))
        case "map" | "mapField" if spec.get("op"):
            yield ".op", spec["op"]
        case "catch":
            yield from ((f".{k}", spec[k]) for k in ("try", "catch") if spec.get(k))
        case "cond":
            cases = spec.get("cases")
            for i, x in enumerate(cases if isinstance(cases, list) else []):
                if isinstance(x, dict) and x.get("then"):
                    yield f".cases[{i}].then", x["then"]
            if spec.get("default"):
                yield ".default", spec["default"]


def whole(v: Any, low: int, high: int) -> bool:
    return isinstance(v, int) and not isinstance(v, bool) and low <= v <= high


def named(v: Any) -> bool:
    return isinstance(v, str) and v != "" and v not in RESERVED


def scalar(v: Any) -> bool:
    return v is None or isinstance(v, (str, int, float, bool))


def bad_options(options: Any, who: str, kind: bool) -> Iterator[str]:
    o = options if isinstance(options, dict) else {}
    if o.get("retries") is not None and not whole(o["retries"], 0, MAX_RETRIES):
        yield f"{who}: `retries` must be an integer between 0 and {MAX_RETRIES}"
    if kind and o.get("kind") not in (None, "pure", "effect"):
        yield f'{who}: `opts.kind` must be "pure" or "effect"'
    for flag in ("heavy", "memo"):
        if o.get(flag) is not None and not isinstance(o[flag], bool):
            yield f"{who}: `opts.{flag}` must be a boolean"


def bad_concurrency(n: Any, who: str) -> Iterator[str]:
    if whole(n, 1, MAX_CONCURRENCY):
        return
    limits = [n.get(k) for k in ("start", "min", "max")] if isinstance(n, dict) and n.get("kind") == "aimd" else None
    if limits is None or not all(x is None or whole(x, 1, MAX_CONCURRENCY) for x in limits) or None not in limits[1:] and limits[1] > limits[2]:
        yield f"{who} `concurrency` must be an integer between 1 and {MAX_CONCURRENCY}, or an aimd object within these limits"


def bad_list(items: Any, who: str, what: str) -> Iterator[str]:
    if not isinstance(items, list) or not items:
        yield f"{who} spec requires a non-empty `{what}` array"
    elif len(items) > MAX_WIDTH:
        yield f"{who} spec's `{what}` array cannot exceed {MAX_WIDTH} entries (got {len(items)})"


def problems(spec: dict, extra: Mapping[str, Any]) -> Iterator[tuple[str, str]]:
    """What is wrong with a node itself: path below it, message."""

    def here(messages: Iterator[str]) -> Iterator[tuple[str, str]]:
        return (("", m) for m in messages)

    match spec.get("tag"):
        case "leaf":
            name = spec.get("name")
            if not isinstance(name, str) or not name:
                yield "", "leaf spec requires a `name`"
                return
            if name not in SHAPES and name not in extra:
                yield "", f'unknown leaf "{name}" (registered: {", ".join(sorted({*SHAPES, *extra}))})'
            yield from here(bad_options(spec.get("opts"), f'leaf "{name}"', True))
            params = spec.get("params")
            if params is not None and not isinstance(params, dict):
                yield "", f'leaf "{name}": `params` must be an object'
            elif params is not None and (name in extra or SHAPES.get(name, (H,))[0] in (H, HS)):
                yield "", f'leaf "{name}": `params` cannot be used, as its input is no object with declared fields'
        case "pipe":
            yield from here(bad_list(spec.get("steps"), "pipe", "steps") if not isinstance(spec.get("steps"), list) or not spec["steps"] else iter(()))
            steps = spec.get("steps") if isinstance(spec.get("steps"), list) else []
            shapes = [shape_of(s, extra) for s in steps]
            for i, ((_, given), (wanted, _)) in enumerate(zip(shapes, shapes[1:], strict=False), 1):
                if not fits(given, wanted):
                    yield "", f"pipe step {i + 1} expects {label(wanted)} input, but step {i} gives {label(given)}"
        case "map" | "mapField" as tag:
            if tag == "mapField":
                for k in ("arrayField", "elementField"):
                    if not named(spec.get(k)):
                        yield "", f"mapField spec's `{k}` must be a non-empty string that is not reserved"
                if spec.get("renameTo") is not None and not named(spec["renameTo"]):
                    yield "", "mapField spec's `renameTo`, if present, must be a non-empty string that is not reserved"
            if not spec.get("op"):
                yield "", f"{tag} spec requires an `op`"
            yield from here(bad_concurrency(spec.get("concurrency"), tag))
        case "sink":
            targets = spec.get("targets")
            good = lambda t: isinstance(t, str) and t or isinstance(t, dict) and isinstance(t.get("name"), str) and t["name"] and not [*bad_options(t.get("opts"), "", False)]
            if not isinstance(targets, list) or not targets or not all(map(good, targets)):
                yield "", "sink spec requires a non-empty `targets` array, each a name or a name with valid `opts`"
            else:
                yield from here(bad_list(targets, "sink", "targets"))
            yield from here(bad_options(spec.get("opts"), "sink", False))
        case "reconcile":
            o = spec.get("opts") if isinstance(spec.get("opts"), dict) else {}
            if o.get("mode") not in MODES:
                yield "", f"reconcile spec's `opts.mode` must be one of: {', '.join(MODES)}"
            elif o["mode"] == "field-merge":
                policy = o.get("policy")
                named_policies = {"defaultPolicy": o.get("defaultPolicy")} | ({f'policy["{k}"]': v for k, v in policy.items()} if isinstance(policy, dict) else {})
                if policy is not None and not isinstance(policy, dict):
                    yield "", "reconcile spec's `opts.policy` must be an object"
                for k, p in named_policies.items():
                    if p is not None and p not in POLICIES:
                        yield "", f"reconcile spec's `opts.{k}` must be one of: {', '.join(POLICIES)}"
        case "catch":
            yield from (("", f"catch spec requires a `{k}`") for k in ("try", "catch") if not spec.get(k))
        case "ask":
            yield from (("", f"ask spec requires a non-empty `{k}`") for k in ("prompt", "timeout") if not isinstance(spec.get(k), str) or not spec[k])
            if spec.get("onTimeout") not in ("proceed", "fail"):
                yield "", 'ask spec\'s `onTimeout` must be "proceed" or "fail"'
        case "cond":
            yield from here(bad_list(spec.get("cases"), "cond", "cases"))
            cases = spec.get("cases")
            for i, x in enumerate(cases if isinstance(cases, list) else []):
                when = x.get("when") if isinstance(x, dict) and isinstance(x.get("when"), dict) else {}
                one = ("equals" in when) != ("in" in when)
                valid = one and (scalar(when["equals"]) if "equals" in when else isinstance(when["in"], list) and all(map(scalar, when["in"])))
                if not valid or "field" in when and not named(when["field"]):
                    yield f".cases[{i}]", "cond case's `when` must have exactly one of `equals` (a scalar) and `in` (scalars), and a valid `field` if any"
                if not isinstance(x, dict) or not x.get("then"):
                    yield f".cases[{i}]", "cond case requires a `then`"
        case "parallel" | "race" as tag:
            yield from here(bad_list(spec.get("ops"), tag, "ops"))
            n = len(spec["ops"]) if isinstance(spec.get("ops"), list) else 0
            if tag == "race" and n and spec.get("need") is not None and not whole(spec["need"], 1, n):
                yield "", f"race spec's `need`, if present, must be an integer between 1 and {n}"
        case other:
            yield "", f'unsupported op spec tag "{other}" (allowed: {", ".join(TAGS)})'


def validate(spec: Any, extra: Mapping[str, Any] | None = None, path: str = "$") -> list[dict[str, str]]:
    """All problems, as path and message."""
    if not isinstance(spec, dict):
        return [{"path": path, "message": "op spec must be an object"}]
    found = [{"path": path + below, "message": m} for below, m in problems(spec, extra or {})]
    return found + [e for below, part in children(spec) for e in validate(part, extra, path + below)]


def nodes(spec: Any) -> Iterator[dict]:
    if isinstance(spec, dict):
        yield spec
        for _, part in children(spec):
            yield from nodes(part)


def plan(spec: Any) -> dict[str, Any]:
    """What running a valid spec may take: nodes, widest concurrency, attempts at worst, and what it needs."""
    every = list(nodes(spec))
    calls: list[tuple[int, bool]] = []  # retries, memo of each governed call
    llm, sinks, widths = set(), set(), [0]
    for n in every:
        o = n.get("opts") or {}
        match n.get("tag"):
            case "leaf" if isinstance(n.get("name"), str) and n["name"]:
                calls.append((o.get("retries") or 0, bool(o.get("memo"))))
                calls += [(0, False)] * bool(n.get("params") is not None)
                llm |= {n["name"]} & set(LLM_LEAVES)
            case "sink" if isinstance(n.get("targets"), list):
                for t in n["targets"]:
                    name, own = (t, {}) if isinstance(t, str) else (t.get("name"), t.get("opts") or {}) if isinstance(t, dict) else (None, {})
                    if isinstance(name, str) and name:
                        both = o | {k: v for k, v in own.items() if v is not None}
                        sinks.add(name)
                        calls.append((both.get("retries") or 0, bool(both.get("memo"))))
            case "map" | "mapField":
                w = n.get("concurrency")
                widths.append(w if whole(w, -(2**53), 2**53) else w.get("max") if isinstance(w, dict) and whole(w.get("max"), 0, 2**53) else MAX_CONCURRENCY if isinstance(w, dict) and w.get("kind") == "aimd" else 0)
    return {
        "nodeCount": len(every), "maxConcurrency": max(widths), "maxRetryMultiplier": sum(r + 1 for r, _ in calls),
        "usesAsk": any(n.get("tag") == "ask" for n in every), "usesCache": any(m for _, m in calls), "usesLlm": bool(llm),
        "llmLeaves": sorted(llm), "sinkTargets": sorted(sinks),
    }


def describe(extra_leaves: Mapping[str, Any] | None = None, extra_sinks: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """Leaves with their shapes, sinks, modes, policies. A host's own leaves have no declared shape."""
    leaves = {n: {"input": i, "output": o} for n, (i, o) in SHAPES.items()} | {n: {"input": ANY, "output": ANY} for n in extra_leaves or {} if n not in SHAPES}
    return {"leaves": leaves, "sinks": [*SINKS, *(s for s in extra_sinks or {} if s not in SINKS)], "reconcileModes": list(MODES), "fieldPolicies": list(POLICIES)}


# ---------- compiling ----------

Leaf = Callable[[Column], Column]


def build(spec: dict, leaves: Mapping[str, Leaf]) -> c.Step:
    """A valid spec as one step over a Column. leaves: name to a function from Column to Column; for the branches of catch
    and race, null is a failure. sink, ask and reconcile work on tables, not on a value: see combinators and reconcile."""
    wrong = validate(spec, leaves)
    if wrong:
        raise ValueError("; ".join(f"{e['path']}: {e['message']}" for e in wrong))
    return _step(spec, leaves)


def _step(spec: dict, leaves: Mapping[str, Leaf]) -> c.Step:
    parts = [_step(p, leaves) for _, p in children(spec)]
    tried = [lambda v, p=p: c.attempt(p(v)) for p in parts]
    match spec["tag"]:
        case "leaf":
            if spec["name"] not in leaves:
                raise ValueError(f'leaf "{spec["name"]}" has no implementation here')
            leaf = leaves[spec["name"]]
            return c.with_params(leaf, spec["params"]) if spec.get("params") else leaf
        case "pipe":
            return c.pipe(*parts)
        case "map":
            return c.map_(parts[0])
        case "mapField":
            return c.map_field(spec["arrayField"], spec["elementField"], parts[0], spec.get("renameTo"))
        case "parallel":
            return c.parallel(*parts)
        case "race":
            return c.race(*tried, need=spec.get("need", 1))
        case "catch":
            return c.catch(tried[0], parts[1])
        case "cond":
            default = parts.pop() if spec.get("default") else None
            when = [c.equals(x["when"]["equals"], x["when"].get("field")) if "equals" in x["when"] else c.one_of(x["when"]["in"], x["when"].get("field")) for x in spec["cases"]]
            return c.cond(list(zip(when, parts, strict=True)), default)
    raise ValueError(f"{spec['tag']} works on tables and has no step of its own")


#: Leaves that need no Python, for specs over text columns.
TEXT_LEAVES: dict[str, Leaf] = {"upper": F.upper, "lower": F.lower, "trim": F.trim, "length": F.length, "sha256": lambda v: F.sha2(v.cast("string").cast("binary"), 256)}
