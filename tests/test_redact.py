import hashlib
import re

import pytest
from pyspark.sql import functions as F

from weftline.functions import redact
from weftline.plans import catalog


def run(spark, text, types=None):
    r = redact.with_redaction(spark.createDataFrame([(text,)], "text string"), types=types).first()
    return r.redacted, r.counts


def test_all_kinds(spark):
    text, counts = run(spark, "Write to kim@post.net or ring 030-1234-567; tax no 321-54-9876, paid with 5500 0000 0000 0004, from 172.16.9.8")
    assert text == "Write to [REDACTED:email] or ring [REDACTED:phone]; tax no [REDACTED:ssn], paid with [REDACTED:credit_card], from [REDACTED:ip]"
    assert counts == {"email": 1, "phone": 1, "ssn": 1, "credit_card": 1, "ip": 1}


@pytest.mark.parametrize("text,types,want", [
    ("5500000000000005", ["credit_card"], "5500000000000005"), ("999.1.1.1", ["ip"], "999.1.1.1"), ("a@b.com 10.0.0.1", [], "a@b.com 10.0.0.1"),
    ("SSN: 123456789", ["ssn"], "SSN: [REDACTED:ssn]"), ("parcel 246813579", ["ssn"], "parcel 246813579"), ("135792468, a social  security id", ["ssn"], "[REDACTED:ssn], a social  security id"),
    ("xssn " + "." * 40 + "123456789", ["ssn"], "xssn " + "." * 40 + "123456789"), ("éa@b.com", ["email"], "é[REDACTED:email]"), ("::1 and fe80::1:2 and 1:2:3:4:5:6:7:8", ["ip"], "[REDACTED:ip] and [REDACTED:ip] and [REDACTED:ip]"),
    ("123 45 6789", ["ssn"], "[REDACTED:ssn]"), ("123456789 ssn 123456789", ["ssn"], "[REDACTED:ssn] ssn [REDACTED:ssn]"), ("", None, ""), ("+49301234567", ["phone"], "[REDACTED:phone]"),
])
def test_cases(spark, text, types, want):
    assert run(spark, text, types)[0] == want


def test_null_unknown_type_and_plan(spark):
    assert run(spark, None) == (None, None) or run(spark, None)[0] is None
    with pytest.raises(ValueError):
        run(spark, "x", ["name"])
    plan = redact.with_redaction(spark.createDataFrame([("x",)], "text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_limit(spark):
    big = spark.range(1).select(F.repeat(F.lit("a"), redact.MAX_TEXT + 1).alias("text"))
    with pytest.raises(Exception, match="larger than"):
        redact.with_redaction(big, types=[]).select(F.length("redacted")).collect()


def brute_bare(text):
    spots = [m.start() for m in re.finditer(r"(?<![0-9])[0-9]{9}(?![0-9])", text)]
    label = re.compile(r"\b(?:ssn|social\s*security)\b", re.I | re.A)
    spots = [s for s in spots if label.search(text[max(0, s - 30) : s]) or label.search(text[s + 9 : s + 39])]
    for s in reversed(spots):
        text = text[:s] + "[REDACTED:ssn]" + text[s + 9 :]
    return text, len(spots)


def test_bare_numbers_of_all_ids_and_whole_texts(spark, tmp_path):
    long = "word " * 20_000 + "ssn 123456789"
    rows = [(1, "my ssn is 987654321, order " + "." * 40 + " 123456789"), (1_000_000, long), (5_000_000_001, "Social Security 111223333 and 444556666"), (None, "123456789"), (2, ""), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in catalog.QUERIES["leaf_redact_ssn_bare"](spark, str(tmp_path)).collect()} == {r[0] for r in rows}
    want = {}
    for i, t in rows:
        n = str(i or 0).rjust(9, "1")[:9]
        new, hits = brute_bare(f"{t} SSN: {n} {'.' * 30} order {n}")
        want[i] = (None, None) if t is None else (hashlib.sha256(new.encode()).hexdigest(), hits)
    got = catalog.QUERIES["leaf_redact_ssn_bare_text"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and {r.doc_id: r.digest for r in got} == {k: v[0] for k, v in want.items()}
    assert all(r.hits == want[r.doc_id][1] for r in got if want[r.doc_id][0])
