"""PII redaction as Column expressions: no Python runs on the rows.

Each kind of PII is one pass of a regular expression over the text; a match may have to meet a condition
that no regular expression can say (a checksum, a range, a label nearby). Such passes split the text
at the matches, decide each match, and put the parts together again. Before a pattern is tried at all, a cheap
test says whether the text may have a match.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = ("email", "phone", "ssn", "credit_card", "ip")
MAX_TEXT = 20_000_000
#: Characters on each side of nine digits in which a label may stand.
LABEL_DISTANCE = 30

# Word boundary of ASCII letters, digits and _ (Java's own \b follows Unicode), and white space as ECMAScript has it.
B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
S = r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"

# What counts as each kind.
EMAIL = rf"{B}[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{B}"
SSN = rf"{B}[0-9]{{3}}(?:-|{S})[0-9]{{2}}(?:-|{S})[0-9]{{4}}{B}"
NINE_DIGITS = r"(?<![0-9])[0-9]{9}(?![0-9])"
LABEL = rf"(?i){B}(?:ssn|social{S}*security){B}"
CARD = rf"{B}(?:[0-9][ -]?){{13,19}}{B}"
IPV4 = rf"{B}(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}{B}"
IPV6 = r"(?<![0-9A-Fa-f:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,7}:|(?:[0-9A-Fa-f]{1,4}:){1,6}:[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,5}(?::[0-9A-Fa-f]{1,4}){1,2}|(?:[0-9A-Fa-f]{1,4}:){1,4}(?::[0-9A-Fa-f]{1,4}){1,3}|(?:[0-9A-Fa-f]{1,4}:){1,3}(?::[0-9A-Fa-f]{1,4}){1,4}|(?:[0-9A-Fa-f]{1,4}:){1,2}(?::[0-9A-Fa-f]{1,4}){1,5}|[0-9A-Fa-f]{1,4}:(?::[0-9A-Fa-f]{1,4}){1,6}|:(?:(?::[0-9A-Fa-f]{1,4}){1,7}|:))(?![0-9A-Fa-f:.])"
PHONE = rf"(?:\+[0-9]{{1,3}}(?:{S}|[.-])?)?(?:\([0-9]{{1,4}}\)(?:{S}|[.-])?)?[0-9]{{2,4}}(?:{S}|[.-])[0-9]{{3,4}}(?:(?:{S}|[.-])[0-9]{{3,4}})?{B}|(?<![0-9])(?:\+[0-9]{{1,3}})?[0-9]{{10}}(?![0-9])"


def token(kind: str) -> str:
    return f"[REDACTED:{kind}]"


def luhn_ok(match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def ipv4_ok(match: Column) -> Column:
    return F.contains(match, F.lit(":")) | F.forall(F.split(match, r"\."), lambda p: F.try_to_number(p, F.lit("999")) <= 255)


def near_label(matches: Column, parts: Column) -> Column:
    """For each match whether a label stands near it. parts: the text between the matches. What stands near is put together from the few
    parts and matches next to it, so a match costs the same however many there are."""
    around = range(LABEL_DISTANCE // 9 + 2)  # matches have nine digits

    def one(m: Column, i: Column) -> Column:
        before = [x for k in reversed(around) for x in (F.get(matches, i - k - 1), F.get(parts, i - k))]
        after = [x for k in around for x in (F.get(parts, i + k + 1), F.get(matches, i + k + 1))]
        sides = (F.right(F.concat_ws("", *before), F.lit(LABEL_DISTANCE)), F.left(F.concat_ws("", *after), F.lit(LABEL_DISTANCE)))
        return F.regexp_like(sides[0], F.lit(LABEL)) | F.regexp_like(sides[1], F.lit(LABEL))

    return F.transform(matches, one)


@dataclass(frozen=True)
class Pass:
    """kind: what it counts as; pattern; may_have: a cheap test without which nothing matches; accept: which of the matches
    (given the parts between them) are replaced, all if None."""

    kind: str
    pattern: str
    may_have: Callable[[Column], Column]
    accept: Callable[[Column, Column], Column] | None = None


def has(pattern: str) -> Callable[[Column], Column]:
    return lambda t: F.regexp_like(t, F.lit(pattern))


CARDS = Pass("credit_card", CARD, has("(?:[0-9][ -]?){13}"), lambda ms, _: F.transform(ms, luhn_ok))
IPS = lambda pattern: Pass("ip", pattern, has(r"[0-9]\.[0-9]{1,3}\.[0-9]|:[0-9A-Fa-f]*:"), lambda ms, _: F.transform(ms, ipv4_ok))
#: Passes in their order, each over what the one before made.
PASSES: dict[str, Pass] = {
    "email": Pass("email", EMAIL, lambda t: F.contains(t, F.lit("@"))),
    "ssn": Pass("ssn", SSN, has(rf"[0-9](?:-|{S})[0-9]{{2}}(?:-|{S})[0-9]{{4}}")),
    "ssn_bare": Pass("ssn", NINE_DIGITS, has("[0-9]{9}"), near_label),
    "credit_card": CARDS,
    "ip": IPS(f"{IPV4}|{IPV6}"),
    "phone": Pass("phone", PHONE, has(rf"[0-9](?:{S}|[.)-])*[0-9]{{3}}")),
}


def with_pass(df: DataFrame, step: Pass, text: str, out: str, hits: str) -> DataFrame:
    """df with the text after one pass alone, and the number of replacements (null where the text is null).

    The matches are found once, as a column of their own; a text without any stays as it is.
    """
    t, ms, parts, ok = F.col(text), "_matches", "_parts", "_accepted"
    found = F.when(step.may_have(t), F.regexp_extract_all(t, F.lit(step.pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn(ms, F.when(t.isNotNull(), found))
    some = F.size(ms) > 0
    if step.accept is None:
        replaced = F.when(some, F.regexp_replace(t, step.pattern, token(step.kind))).otherwise(t)
        return df.withColumns({out: replaced, hits: F.size(ms)}).drop(ms)
    df = df.withColumn(parts, F.when(some, F.split(t, step.pattern, -1)))
    df = df.withColumn(ok, F.when(some, step.accept(F.col(ms), F.col(parts))).otherwise(F.array().cast("array<boolean>")))
    new = F.zip_with(F.col(ms), F.col(ok), lambda m, yes: F.when(yes, F.lit(token(step.kind))).otherwise(m))
    joined = F.array_join(F.zip_with(F.col(parts), new, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    chosen = F.when(F.array_contains(ok, True), joined).otherwise(t)
    return df.withColumns({out: chosen, hits: F.when(t.isNotNull(), F.size(F.filter(ok, lambda x: x)))}).drop(ms, parts, ok)


def with_redaction(df: DataFrame, text: str = "text", types: Sequence[str] | None = None, out: str = "redacted", counts: str = "counts") -> DataFrame:
    """df with the redacted text and a map of counts by type (types without a hit are left out).

    types: None for all, [] for none. Texts above MAX_TEXT characters raise an error; null stays null.
    """
    unknown = set(types or ()) - set(TYPES)
    if unknown:
        raise ValueError(f"unknown redaction types: {', '.join(sorted(unknown))}")
    step = F.when(F.length(text) > MAX_TEXT, F.raise_error(F.lit(f"text input is larger than {MAX_TEXT} bytes"))).otherwise(F.col(text))
    df, found = df.withColumn("_text0", step), []
    for one in PASSES.values():
        if types is None or one.kind in types:
            k = len(found)
            df = with_pass(df, one, f"_text{k}", f"_text{k + 1}", f"_n{k}")
            found.append((one.kind, f"_n{k}"))
    sums: dict[str, Column] = {}
    for kind, c in found:
        sums[kind] = sums[kind] + F.col(c) if kind in sums else F.col(c)
    pairs = F.array(*(F.struct(F.lit(kind).alias("key"), n.cast("int").alias("value")) for kind, n in sums.items())) if sums else F.expr("cast(array() as array<struct<key:string,value:int>>)")
    df = df.withColumns({out: F.col(f"_text{len(found)}"), counts: F.map_from_entries(F.filter(pairs, lambda p: p["value"] > 0))})
    return df.drop(*(f"_text{i}" for i in range(len(found) + 1)), *(c for _, c in found))


# ---------- one text in Python, for leaves of a spec ----------


def redact_text(text: str, types: Sequence[str] | None = None) -> tuple[str, dict[str, int]]:
    """A text after the same passes, and the hits by type."""
    unknown = set(types or ()) - set(TYPES)
    if unknown:
        raise ValueError(f"unknown redaction types: {', '.join(sorted(unknown))}")
    if len(text) > MAX_TEXT:
        raise ValueError(f"text input is larger than {MAX_TEXT} bytes")
    counts: dict[str, int] = {}
    for name, step in PASSES.items():
        if types is not None and step.kind not in types:
            continue
        made, at, hits = [], 0, 0
        for m in re.finditer(step.pattern, text):
            if ACCEPTED.get(name, lambda m, t: True)(m, text):
                made += [text[at : m.start()], token(step.kind)]
                at, hits = m.end(), hits + 1
        text = "".join([*made, text[at:]])
        if hits:
            counts[step.kind] = counts.get(step.kind, 0) + hits
    return text, counts


def _luhn(m: re.Match, text: str) -> bool:
    digits = [int(c) for c in m[0] if "0" <= c <= "9"]
    doubled = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return 13 <= len(digits) <= 19 and (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def _labelled(m: re.Match, text: str) -> bool:
    sides = text[max(0, m.start() - LABEL_DISTANCE) : m.start()], text[m.end() : m.end() + LABEL_DISTANCE]
    return any(re.search(LABEL, side) for side in sides)


ACCEPTED: dict[str, Callable[[re.Match, str], bool]] = {
    "ssn_bare": _labelled, "credit_card": _luhn, "ip": lambda m, text: ":" in m[0] or all(int(p) <= 255 for p in m[0].split(".")),
}
