"""Values as JSON has them: canonical text, keys made of it, numbers as ECMAScript prints them."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys that never become fields.
RESERVED = ("__proto__", "constructor", "prototype")


def number(v: float) -> str:
    """As ECMAScript's String(v)."""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int) and abs(v) < 10**21:
        return str(v)
    v = float(v)
    if math.isnan(v):
        return "NaN"
    if math.isinf(v):
        return "Infinity" if v > 0 else "-Infinity"
    if v == 0:
        return "0"
    digits, _, exponent = repr(abs(v)).partition("e")
    whole, _, part = digits.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(exponent or 0)
    all_digits = (whole + part).lstrip("0")
    point -= len(whole + part) - len((whole + part).lstrip("0"))
    all_digits = all_digits.rstrip("0") or "0"
    n, sign = len(all_digits), "-" if v < 0 else ""
    if n <= point <= 21:
        return sign + all_digits + "0" * (point - n)
    if 0 < point <= 21:
        return f"{sign}{all_digits[:point]}.{all_digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{all_digits}"
    e = point - 1
    return f"{sign}{all_digits[0]}{'.' + all_digits[1:] if n > 1 else ''}e{'+' if e > 0 else '-'}{abs(e)}"


def _index(key: str) -> bool:
    """Keys like array indexes come first in objects."""
    return key.isascii() and key.isdigit() and str(int(key)) == key and int(key) < 2**32 - 1


def own_order(keys: Sequence[str]) -> list[str]:
    """In the order in which an object lists keys that were added in this one."""
    return sorted((k for k in keys if _index(k)), key=int) + [k for k in keys if not _index(k)]


def text_json(s: str) -> str:
    """A string as JSON text; lone surrogates are escaped, nothing else beyond ASCII is."""
    out = json.dumps(s, ensure_ascii=False)
    return "".join(f"\\u{ord(c):04x}" if 0xD800 <= ord(c) <= 0xDFFF else c for c in out)


def to_json(v: Any, indent: int = 0, level: int = 0) -> str:
    """As ECMAScript's JSON.stringify; indent 0 is compact."""
    if v is None or isinstance(v, float) and not math.isfinite(v):
        return "null"
    if isinstance(v, (bool, int, float)):
        return number(v)
    if isinstance(v, str):
        return text_json(v)
    if isinstance(v, (list, tuple)):
        items, ends = [to_json(x, indent, level + 1) for x in v], "[]"
    else:
        items, ends = [f"{text_json(k)}:{' ' if indent else ''}{to_json(v[k], indent, level + 1)}" for k in own_order(list(v))], "{}"
    if not items:
        return ends
    if not indent:
        return ends[0] + ",".join(items) + ends[1]
    pad = " " * indent
    return f"{ends[0]}\n{pad * (level + 1)}{(',' + chr(10) + pad * (level + 1)).join(items)}\n{pad * level}{ends[1]}"


def canonical(v: Any) -> Any:
    """With keys in order of their UTF-16 units, at all levels."""
    if isinstance(v, dict):
        return {k: canonical(v[k]) for k in sorted(v, key=lambda k: k.encode("utf-16-be", "surrogatepass"))}
    return [canonical(x) for x in v] if isinstance(v, (list, tuple)) else v


def canonical_json(v: Any) -> str:
    return to_json(canonical(v))


def without_stamps(v: Any) -> Any:
    """Handles without the time they were made, for keys that should not depend on it."""
    if isinstance(v, list):
        return [without_stamps(x) for x in v]
    if isinstance(v, dict):
        handle = {"r2Key", "sha256", "type", "size"} <= v.keys()
        return {k: without_stamps(x) for k, x in v.items() if not (handle and k == "producedAt")}
    return v


def sha256_hex(text: str) -> str:
    import hashlib

    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def idempotency_key(name: str, args: Any) -> str:
    return sha256_hex(f"{name}:{canonical_json(args)}")


def memo_key(name: str, value: Any) -> str:
    return sha256_hex(f"memo:{name}:{canonical_json(without_stamps(value))}")


def flat_json(fields: Sequence[str]) -> Column:
    """Canonical JSON text of a flat struct of string and whole-number columns, without Python. Nulls are null."""
    def value(f: str) -> Column:
        return F.when(F.col(f).isNull(), F.lit("null")).otherwise(F.regexp_extract(F.to_json(F.struct(F.col(f).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))

    parts = [F.concat(F.lit(f"{json.dumps(f)}:"), value(f)) for f in own_order(sorted(fields))]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def key_column(name: str, fields: Sequence[str], memo: bool = False) -> Column:
    return F.sha2(F.concat(F.lit(f"{'memo:' if memo else ''}{name}:"), flat_json(fields)), 256)


def backoff(attempt: Column, draw: Column, base: int = 200, cap: int = 10_000) -> Column:
    """Full jitter: floor(draw * min(cap, base * 2 ** attempt)); draw is in [0, 1)."""
    return F.floor(draw * F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), attempt))).cast("long")
