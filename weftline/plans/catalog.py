"""The registered queries outside the llm subpackage, and their SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import formats, images, pdf, redact, values
from weftline.operators import combinators as c
from weftline.operators import folds, reconcile, runs, sinks, telemetry
from weftline.plans import run, spec
from weftline.sources import archive, blobs
from weftline.operators.partitions import shared_dir, spread
from weftline.streaming import twins

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a function (spark, table) under its name; table reads a table by name."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return register


def sha(text):
    return F.sha2(text.cast("binary"), 256)


# ---------- flagship: redact, store, reconcile ----------

CARD_SQL = r"""
WITH cut AS (SELECT {keys}, string_split_regex({text}, '{re}') AS parts, regexp_extract_all({text}, '{re}') AS ms FROM {source}),
judged AS (SELECT *, list_transform(ms, lambda m: {ok}) AS oks FROM cut)
"""
CARD_RE = r"\b(?:[0-9][ -]?){13,19}\b"
CARD_OK = """len(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 AND list_sum(list_transform(generate_series(1, len(regexp_replace(m, '[^0-9]', '', 'g'))), lambda i: CASE WHEN (len(regexp_replace(m, '[^0-9]', '', 'g')) - i) % 2 = 1 THEN CASE WHEN substr(regexp_replace(m, '[^0-9]', '', 'g'), i, 1)::INT * 2 > 9 THEN substr(regexp_replace(m, '[^0-9]', '', 'g'), i, 1)::INT * 2 - 9 ELSE substr(regexp_replace(m, '[^0-9]', '', 'g'), i, 1)::INT * 2 END ELSE substr(regexp_replace(m, '[^0-9]', '', 'g'), i, 1)::INT END)) % 10 = 0"""
IP_RE = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
IP_OK = "list_bool_and(list_transform(string_split(m, '.'), lambda p: p::INT <= 255))"


def replaced_sql(kind: str) -> str:
    return f"array_to_string(list_transform(generate_series(1, len(parts)), lambda i: parts[i] || coalesce(CASE WHEN oks[i] THEN '[REDACTED:{kind}]' ELSE ms[i] END, '')), '')"


#: Documents (by id) whose texts are united in one result.
BLOCK = 500


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their email addresses, social security and card numbers redacted, stored by content, and united
    by language: each distinct text once, in order of doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = redact.with_redaction(spread(docs.select("doc_id", "lang", "text")), types=["email", "ssn", "credit_card"])
    rows = clean.select("lang", reconcile.blocks(F.col("doc_id"), BLOCK).alias("block"), F.col("doc_id").alias("pos"), sha(F.col("redacted")).alias("sha256"), F.col("redacted").alias("text"), F.coalesce(F.aggregate(F.map_values("counts"), F.lit(0), lambda a, b: a + b), F.lit(0)).alias("hits"))
    united = reconcile.faithful_union(rows, ["lang", "block"])
    totals = rows.groupBy("lang", "block").agg(F.count("*").alias("documents"), F.sum("hits").alias("redactions"))
    return united.join(totals, ["lang", "block"]).select("lang", "block", "documents", "redactions", "sha256", "size")


QUERIES["flagship"] = flagship


# ---------- redaction ----------

EMAIL_SQL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"


def digests(d, step, text="text"):
    new = redact.with_pass(d, step, text, "new", "n")
    return new.select("doc_id", sha(F.col("new")).alias("digest"), F.col("n").cast("long").alias("hits"))


# DuckDB's patterns have no look-around. Where a pass looks at what is beside a match, the text is split into longest runs of the
# characters in question, and each run is judged as a whole.
S_SQL = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
SSN_SQL = rf"\b[0-9]{{3}}(?:-|{S_SQL})[0-9]{{2}}(?:-|{S_SQL})[0-9]{{4}}\b"
LABEL_SQL = rf"(?i)\b(?:ssn|social{S_SQL}*security)\b"
PHONE_GROUPS_SQL = rf"(?:\+[0-9]{{1,3}}(?:{S_SQL}|[.-])?)?(?:\([0-9]{{1,4}}\)(?:{S_SQL}|[.-])?)?[0-9]{{2,4}}(?:{S_SQL}|[.-])[0-9]{{3,4}}(?:(?:{S_SQL}|[.-])[0-9]{{3,4}})?\b"
H_SQL = "[0-9A-Fa-f]{1,4}"
IPV6_FORMS = (
    f"(?:{H_SQL}:){{7}}{H_SQL}", f"(?:{H_SQL}:){{1,7}}:", *(f"(?:{H_SQL}:){{1,{7 - k}}}(?::{H_SQL}){{1,{k}}}" for k in range(1, 7)), f":(?::{H_SQL}){{1,7}}", "::",
)
IPV6_WHOLE = "|".join(f"(?:{f})" for f in IPV6_FORMS)


def plain_step(name: str, source: str, pattern: str, kind: str) -> str:
    """A CTE with t and n after a pass that replaces every match."""
    return f"{name} AS (SELECT * EXCLUDE (t), regexp_replace(t, '{pattern}', '[REDACTED:{kind}]', 'g') AS t, len(regexp_extract_all(t, '{pattern}')) AS n_{name} FROM {source})"


def judged_step(name: str, source: str, pattern: str, ok: str, new: str) -> str:
    """CTEs with t and n after a pass that judges each match: x is its place, ms are the matches, ps the parts between them."""
    return f"""{name}_cut AS (SELECT *, string_split_regex(t, '{pattern}') AS ps, regexp_extract_all(t, '{pattern}') AS ms FROM {source}),
{name}_ok AS (SELECT *, list_transform(generate_series(1, len(ms)), lambda x: {ok}) AS oks FROM {name}_cut),
{name} AS (SELECT * EXCLUDE (t, ps, ms, oks), array_to_string(list_transform(generate_series(1, len(ps)), lambda x: ps[x] || CASE WHEN x > len(ms) THEN '' WHEN oks[x] THEN {new} ELSE ms[x] END), '') AS t,
 len(list_filter(oks, lambda y: y)) AS n_{name} FROM {name}_ok)"""


BARE_OK = f"""len(ms[x]) = 9 AND (regexp_matches(right(array_to_string(list_transform(generate_series(1, x), lambda y: CASE WHEN y > 1 THEN ms[y - 1] ELSE '' END || ps[y]), ''), 30), '{LABEL_SQL}')
 OR regexp_matches(left(array_to_string(list_transform(generate_series(x + 1, len(ps)), lambda y: ps[y] || CASE WHEN y > len(ms) THEN '' ELSE ms[y] END), ''), 30), '{LABEL_SQL}'))"""
#: Ten digits, or a plus that follows no digit and 11 to 13 of them.
LONG_PHONE_OK = "len(ltrim(ms[x], '+')) = 10 OR ms[x][1] = '+' AND len(ms[x]) BETWEEN 12 AND 14 AND NOT (x > 1 AND ps[x] = '')"
LONG_PHONE_NEW = "CASE WHEN ms[x][1] = '+' AND len(ms[x]) = 11 THEN '+' ELSE '' END || '[REDACTED:phone]'"


def phone_steps(source: str) -> str:
    return judged_step("tens", source, r"\+?[0-9]+", LONG_PHONE_OK, LONG_PHONE_NEW) + ",\n" + plain_step("groups", "tens", PHONE_GROUPS_SQL, "phone")


IPV6_SQL = f"""WITH d AS (SELECT doc_id, lower(to_hex(doc_id % 65536)) AS h, text FROM documents),
s AS (SELECT doc_id, text || ' at ' || [h || '::' || h, '::' || h, h || ':1:2:3:4:5:6:' || h, h || ':1:2::', h || ':1:2:3:4:5:6:7:' || h, h || ':' || h][(doc_id % 6 + 1)::INT] || ' now' AS t FROM d),
{judged_step("six", "s", "[0-9A-Fa-f:.]+", f"regexp_full_match(ms[x], '{IPV6_WHOLE}')", "'[REDACTED:ip]'")}
SELECT doc_id, sha256(t) AS digest, n_six AS hits FROM six"""
PHONE_SQL = f"""WITH s AS (SELECT doc_id, text AS t FROM documents),
{phone_steps("s")}
SELECT doc_id, sha256(t) AS digest, n_tens + n_groups AS hits FROM groups"""
BARE_TEXT_SQL = f"""WITH d AS (SELECT doc_id, left(lpad(coalesce(doc_id, 0)::VARCHAR, 9, '1'), 9) AS number, text FROM documents),
s AS (SELECT doc_id, text || ' SSN: ' || number || ' {"." * redact.LABEL_DISTANCE} order ' || number AS t FROM d),
{judged_step("bare", "s", "[0-9]+", BARE_OK, "'[REDACTED:ssn]'")}
SELECT doc_id, sha256(t) AS digest, n_bare AS hits FROM bare"""
ORACLES["flagship"] = f"""WITH s AS (SELECT doc_id, lang, text AS t FROM documents),
{plain_step("mail", "s", EMAIL_SQL, "email")},
{plain_step("ssn", "mail", SSN_SQL, "ssn")},
{judged_step("bare", "ssn", "[0-9]+", BARE_OK, "'[REDACTED:ssn]'")},
{judged_step("card", "bare", CARD_RE, CARD_OK.replace("(m,", "(ms[x],"), "'[REDACTED:credit_card]'")},
d AS (SELECT lang, doc_id // {BLOCK} AS block, doc_id, t, sha256(t) AS sha, n_mail + n_ssn + n_bare + n_card AS hits FROM card),
f AS (SELECT lang, block, sha, arg_min(t, doc_id) AS t, min(doc_id) AS p FROM d GROUP BY ALL),
u AS (SELECT lang, block, string_agg('<!-- source: cas/' || sha || ' -->' || chr(10) || t, chr(10) || chr(10) ORDER BY p) AS text FROM f GROUP BY ALL),
n AS (SELECT lang, block, count(*) AS documents, sum(hits)::BIGINT AS redactions FROM d GROUP BY ALL)
SELECT lang, block, documents, redactions, sha256(text) AS sha256, strlen(text)::BIGINT AS size FROM u JOIN n USING (lang, block)"""
REDACT_ALL_SQL = f"""WITH s AS (SELECT doc_id, text AS t FROM documents),
{plain_step("mail", "s", EMAIL_SQL, "email")},
{plain_step("ssn", "mail", SSN_SQL, "ssn")},
{judged_step("bare", "ssn", "[0-9]+", BARE_OK, "'[REDACTED:ssn]'")},
{judged_step("card", "bare", CARD_RE, CARD_OK.replace("(m,", "(ms[x],"), "'[REDACTED:credit_card]'")},
{judged_step("four", "card", IP_RE, IP_OK.replace("(m,", "(ms[x],"), "'[REDACTED:ip]'")},
{judged_step("six", "four", "[0-9A-Fa-f:.]+", f"regexp_full_match(ms[x], '{IPV6_WHOLE}')", "'[REDACTED:ip]'")},
{phone_steps("six")},
c AS (SELECT doc_id, t, [('email', n_mail), ('ssn', n_ssn + n_bare), ('credit_card', n_card), ('ip', n_four + n_six), ('phone', n_tens + n_groups)] AS ns FROM groups)
SELECT doc_id, sha256(t) AS digest, '{{' || array_to_string(list_transform(list_filter(ns, lambda y: y[2] > 0), lambda y: '"' || y[1] || '":' || y[2]), ',') || '}}' AS counts FROM c"""


@query(rf"SELECT doc_id, sha256(regexp_replace(text, '{EMAIL_SQL}', '[REDACTED:email]', 'g')) AS digest, len(regexp_extract_all(text, '{EMAIL_SQL}')) AS hits FROM documents")
def leaf_redact_email(spark, table):
    return digests(table("documents"), redact.PASSES["email"])


@query(r"""WITH d AS (SELECT doc_id, text || ' no 123-45-' || lpad((doc_id % 10000)::VARCHAR, 4, '0') || ' or 12-345-6789' AS t FROM documents)
SELECT doc_id, sha256(regexp_replace(t, '\b[0-9]{3}[-\s][0-9]{2}[-\s][0-9]{4}\b', '[REDACTED:ssn]', 'g')) AS digest, len(regexp_extract_all(t, '\b[0-9]{3}[-\s][0-9]{2}[-\s][0-9]{4}\b')) AS hits FROM d""")
def leaf_redact_ssn(spark, table):
    d = table("documents").select("doc_id", F.concat("text", F.lit(" no 123-45-"), F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0"), F.lit(" or 12-345-6789")).alias("t"))
    return digests(d, redact.PASSES["ssn"], "t")


@query("""SELECT doc_id, 'x ' || CASE WHEN doc_id % 2 = 0 THEN 'SSN: [REDACTED:ssn]' ELSE 'order ' || lpad(doc_id::VARCHAR, 9, '1') END || ' end' AS redacted FROM documents""")
def leaf_redact_ssn_bare(spark, table):
    """Nine digits are a social security number only with a label nearby."""
    d = table("documents").select("doc_id", F.concat(F.lit("x "), F.when(F.col("doc_id") % 2 == 0, F.lit("SSN: ")).otherwise(F.lit("order ")), F.lpad(F.col("doc_id").cast("string"), 9, "1"), F.lit(" end")).alias("t"))
    return redact.with_pass(d, redact.PASSES["ssn_bare"], "t", "redacted", "hits").select("doc_id", "redacted")


@query(BARE_TEXT_SQL)
def leaf_redact_ssn_bare_text(spark, table):
    """The same over whole texts, with a labelled number and one far from any label added."""
    number = F.lpad(F.coalesce("doc_id", F.lit(0)).cast("string"), 9, "1")
    d = table("documents").select("doc_id", F.concat("text", F.lit(" SSN: "), number, F.lit(f" {'.' * redact.LABEL_DISTANCE} order "), number).alias("t"))
    return digests(d, redact.PASSES["ssn_bare"], "t")


@query(CARD_SQL.format(keys="doc_id", text="text", re=CARD_RE, source="documents", ok=CARD_OK) + f"SELECT doc_id, sha256({replaced_sql('credit_card')}) AS digest, len(list_filter(oks, lambda x: x)) AS hits FROM judged")
def leaf_redact_credit_card(spark, table):
    return digests(table("documents"), redact.PASSES["credit_card"])


@query(CARD_SQL.format(keys="doc_id", text="text", re=IP_RE, source="documents", ok=IP_OK) + f"SELECT doc_id, sha256({replaced_sql('ip')}) AS digest, len(list_filter(oks, lambda x: x)) AS hits FROM judged")
def leaf_redact_ipv4(spark, table):
    return digests(table("documents"), redact.IPS(redact.IPV4))


@query(IPV6_SQL)
def leaf_redact_ipv6(spark, table):
    """Addresses made of the id in each of the ways to write them, and what only looks like one, appended to whole texts."""
    h = F.lower(F.hex(F.pmod("doc_id", F.lit(65536))))
    forms = [F.concat(h, F.lit("::"), h), F.concat(F.lit("::"), h), F.concat(h, F.lit(":1:2:3:4:5:6:"), h), F.concat(h, F.lit(":1:2::")), F.concat(h, F.lit(":1:2:3:4:5:6:7:"), h), F.concat(h, F.lit(":"), h)]
    chosen = F.element_at(F.array(*forms), (F.pmod("doc_id", F.lit(6)) + 1).cast("int"))
    d = table("documents").select("doc_id", F.concat("text", F.lit(" at "), chosen, F.lit(" now")).alias("t"))
    return digests(d, redact.IPS(redact.IPV6), "t")


@query(PHONE_SQL)
def leaf_redact_phone(spark, table):
    return digests(table("documents"), redact.PASSES["phone"])


@query(REDACT_ALL_SQL)
def redact_all(spark, table):
    """All passes in their order; counts as JSON."""
    return redact.with_redaction(spread(table("documents").select("doc_id", "text"))).select("doc_id", sha(F.col("redacted")).alias("digest"), F.to_json("counts").alias("counts"))


@query(CARD_SQL.format(keys="doc_id, lang, text", text="text", re=CARD_RE, source="documents", ok=CARD_OK) + rf"""SELECT lang, sum(len(regexp_extract_all(text, '{EMAIL_SQL}')))::BIGINT AS emails, sum(len(list_filter(oks, lambda x: x)))::BIGINT AS cards, count(*) AS documents FROM judged GROUP BY lang""")
def redact_counts_by_lang(spark, table):
    d = redact.with_pass(table("documents").select("lang", "text"), redact.PASSES["email"], "text", "no_email", "e")
    d = redact.with_pass(d, redact.PASSES["credit_card"], "text", "no_card", "k")
    return d.groupBy("lang").agg(F.sum("e").alias("emails"), F.sum("k").alias("cards"), F.count("*").alias("documents"))


# ---------- store ----------


@query("SELECT DISTINCT sha256(text) AS sha256, strlen(text)::BIGINT AS size FROM documents WHERE text IS NOT NULL")
def store_put(spark, table):
    return blobs.put(table("documents"), "text").select("sha256", F.octet_length("content").cast("long").alias("size"))


@query("SELECT doc_id, 'cas/' || sha256(text) AS r2_key, strlen(text)::BIGINT AS size, length(text)::BIGINT AS chars FROM documents")
def store_get_verify(spark, table):
    docs = table("documents").select("doc_id", blobs.handle(F.col("text"), "text/plain").alias("h")).select("doc_id", "h.*")
    return blobs.get(docs, blobs.put(table("documents"), "text")).select("doc_id", F.col("r2Key").alias("r2_key"), "size", F.length(blobs.text_of(F.col("content"))).cast("long").alias("chars"))


@query("SELECT n_nationkey, sha256(n_name) AS sha256, 'application/octet-stream' AS type, strlen(n_name)::BIGINT AS size, base64(n_name::BLOB) AS base64 FROM nation")
def store_hydrate_dehydrate(spark, table):
    rows = blobs.hydrate(table("nation").select("n_nationkey", F.base64(F.col("n_name").cast("binary")).alias("base64"), F.lit(None).cast("string").alias("type")))
    out = blobs.dehydrate(rows.select("n_nationkey", "handle", F.col("handle.sha256").alias("sha256")), blobs.put(rows, "content"))
    return out.select("n_nationkey", "sha256", "handle.type", "handle.size", "handle.base64")


@query("SELECT doc_id, NOT regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]') AS is_text FROM documents")
def looks_like_text(spark, table):
    return table("documents").select("doc_id", blobs.looks_like_text(F.col("text").cast("binary")).alias("is_text"))


@query("SELECT doc_id, 'cas/' || sha256(text) AS r2_key, 1700000000000 + doc_id AS produced_at FROM documents")
def leaf_wrap_stamp_unwrap(spark, table):
    step = c.pipe(lambda h: blobs.stamp(h, F.col("doc_id") + 1_700_000_000_000), blobs.wrap, blobs.unwrap)
    out = table("documents").select("doc_id", step(blobs.handle(F.col("text"), "text/plain")).alias("h"))
    return out.select("doc_id", F.col("h.r2Key").alias("r2_key"), F.col("h.producedAt").alias("produced_at"))


# ---------- reconcile ----------


@query(rf"""WITH f AS (SELECT lang, doc_id // {BLOCK} AS block, sha256(text) AS s, arg_min(text, doc_id) AS t, min(doc_id) AS p FROM documents GROUP BY ALL),
u AS (SELECT lang, block, string_agg('<!-- source: cas/' || s || ' -->' || chr(10) || t, chr(10) || chr(10) ORDER BY p) AS text FROM f GROUP BY lang, block)
SELECT lang, block, sha256(text) AS sha256, strlen(text)::BIGINT AS size FROM u""")
def reconcile_faithful_union(spark, table):
    rows = table("documents").select("lang", reconcile.blocks(F.col("doc_id"), BLOCK).alias("block"), F.col("doc_id").alias("pos"), sha(F.col("text")).alias("sha256"), "text")
    return reconcile.faithful_union(rows, ["lang", "block"]).select("lang", "block", "sha256", "size")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS winner FROM events GROUP BY user_id")
def reconcile_last_write_wins(spark, table):
    rows = table("events").select("user_id", "event_id", F.col("ts").alias("produced_at"), F.col("event_id").alias("pos"))
    return reconcile.last_write_wins(rows, ["user_id"], F.col("event_id"))


PROPS = """WITH e AS (SELECT user_id, ts, event_id, props->>'$.k' AS k, event_type FROM events WHERE props IS NOT NULL),
v AS (SELECT *, '{"k":' || k || ',"type":"' || event_type || '"}' AS doc FROM e) """


def _props(table):
    return table("events").where("props is not null").select("user_id", F.struct("ts", "event_id").alias("pos"), F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"type":"'), "event_type", F.lit('"}')).alias("doc"))


@query(PROPS + """SELECT user_id, '{"k":' || arg_max(k, (ts, event_id)) || ',"type":"' || arg_max(event_type, (ts, event_id)) || '"}' AS merged FROM v GROUP BY user_id""")
def reconcile_field_merge(spark, table):
    return reconcile.field_merge(_props(table), ["user_id"])


@query(PROPS + """SELECT user_id, '{"k":' || arg_min(k, (ts, event_id)) || ',"type":"' || arg_max(event_type, (ts, event_id)) || '"}' AS merged FROM v GROUP BY user_id""")
def reconcile_field_merge_keep_first(spark, table):
    return reconcile.field_merge(_props(table), ["user_id"], policy={"k": "keep-first"})


@query(PROPS + """, f AS (SELECT user_id, k, min((ts, event_id)) AS o FROM v GROUP BY ALL), g AS (SELECT user_id, event_type, min((ts, event_id)) AS o FROM v GROUP BY ALL)
SELECT a.user_id, '{"k":[' || a.x || '],"type":[' || b.x || ']}' AS merged FROM (SELECT user_id, string_agg(k, ',' ORDER BY o) AS x FROM f GROUP BY user_id) a
JOIN (SELECT user_id, string_agg('"' || event_type || '"', ',' ORDER BY o) AS x FROM g GROUP BY user_id) b ON a.user_id = b.user_id""")
def reconcile_field_merge_union(spark, table):
    return reconcile.field_merge(_props(table), ["user_id"], default="union")


# ---------- keys, memo, runs ----------


@query("""SELECT event_id, sha256('tick:{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') AS key FROM events""")
def idempotency_key(spark, table):
    return table("events").select("event_id", values.key_column("tick", ["user_id", "event_type", "event_id"]).alias("key"))


@query("""SELECT event_type, count(*) AS calls, count(DISTINCT user_id) AS misses, count(*) - count(DISTINCT user_id) AS hits FROM events GROUP BY event_type""")
def memo_dedupe(spark, table):
    """Calls keyed by (event_type, user): each key is computed once, the others are hits."""
    e = table("events").select("event_type", "event_id", values.key_column("leaf", ["event_type", "user_id"], memo=True).alias("key"))
    seen = runs.memo_events(e, "key", "event_id")
    return seen.groupBy("event_type").agg(F.count("*").alias("calls"), F.count_if(F.col("kind") == "memo-miss").alias("misses"), F.count_if(F.col("kind") == "memo-hit").alias("hits"))


@query("SELECT doc_id, sha256(lower(text)) AS value FROM documents")
def memo_join_back(spark, table):
    """A leaf over distinct texts only, joined back; a third of the keys is known already."""
    docs = table("documents").select("doc_id", "text", sha(F.col("text")).alias("key"))
    known = docs.where("doc_id % 3 = 0").dropDuplicates(["key"]).select("key", sha(F.lower("text")).alias("value"))
    out, _ = runs.memoized(docs, "key", lambda d: d.select("key", sha(F.lower("text")).alias("value")), known)
    return out.select("doc_id", "value")


def _ledger(table):
    o = table("orders")
    return o.where("o_orderstatus <> 'O'").select(F.concat(F.lit("run"), F.col("o_custkey").cast("string")).alias("run_key"), F.col("o_orderkey").cast("string").alias("path"), (F.col("o_orderstatus") == "F").alias("done"), F.col("o_totalprice").alias("value"))


@query("SELECT 'run' || o_custkey AS run_key, o_orderkey::VARCHAR AS path FROM orders WHERE o_orderstatus <> 'F'")
def checkpoint_pending(spark, table):
    nodes = table("orders").select(F.concat(F.lit("run"), F.col("o_custkey").cast("string")).alias("run_key"), F.col("o_orderkey").cast("string").alias("path"))
    return runs.pending(nodes, _ledger(table))


@query("""SELECT CASE WHEN o_orderstatus = 'F' THEN 'kept' WHEN o_orderstatus = 'P' THEN 'resumed' ELSE 'begun' END AS state, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END)::BIGINT AS done_now FROM orders GROUP BY 1""")
def checkpoint_resume(spark, table):
    """A ledger is begun, the rest is computed and finished; what was done is not touched."""
    nodes = table("orders").select(F.concat(F.lit("run"), F.col("o_custkey").cast("string")).alias("run_key"), F.col("o_orderkey").cast("string").alias("path"))
    before = _ledger(table)
    begun = runs.started(before, nodes)
    todo = runs.pending(nodes, begun).withColumn("value", F.lit(-1.0))
    after = runs.finished(begun, todo).where("done").withColumnRenamed("value", "now").drop("done")
    was = before.select("run_key", "path", "done")
    state = F.when(F.col("done"), F.lit("kept")).when(F.col("done").isNotNull(), F.lit("resumed")).otherwise(F.lit("begun"))
    return after.join(was, ["run_key", "path"], "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.count_if(F.col("now") == -1).alias("done_now"))


@query("""SELECT 'run' || c_custkey AS run_key, CASE WHEN c_custkey % 3 = 0 THEN 'done' WHEN c_custkey % 3 = 1 THEN 'in-progress' ELSE 'never-started' END AS status, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS value FROM customer""")
def run_status(spark, table):
    cust = table("customer").withColumn("run_key", F.concat(F.lit("run"), F.col("c_custkey").cast("string")))
    ledger = cust.where("c_custkey % 3 < 2").select("run_key", F.lit("").alias("path"), (F.col("c_custkey") % 3 == 0).alias("done"), F.col("c_acctbal").alias("value"))
    return runs.status(cust.select("run_key"), ledger)


@query("""SELECT a AS attempt, floor(0.5 * least(10000.0, 200.0 * pow(2.0, a)))::BIGINT AS delay FROM range(12) t(a)""")
def backoff_bound(spark, table):
    return spark.range(12).select(F.col("id").alias("attempt"), values.backoff(F.col("id"), F.lit(0.5)).alias("delay"))


# ---------- the algebra ----------

TURNS = "WITH t AS (SELECT conv_id, list(text ORDER BY turn) AS texts, list(role ORDER BY turn) AS roles, list(turn ORDER BY turn) AS turns FROM conversations GROUP BY conv_id) "


def _turns(table):
    conv = table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return conv


@query("SELECT conv_id, turn, length(trim(lower(text), ' ')) AS out FROM conversations")
def op_pipe(spark, table):
    return table("conversations").select("conv_id", "turn", c.pipe(F.lower, F.trim, F.length)(F.col("text")).cast("long").alias("out"))


@query(TURNS + "SELECT conv_id, array_to_string(list_transform(texts, lambda x: sha256(x)), ',') AS out FROM t")
def op_map(spark, table):
    return _turns(table).select("conv_id", F.array_join(c.map_(sha)(F.transform("turns", lambda t: t["text"])), ",").alias("out"))


@query("SELECT conv_id, string_agg(turn || ':' || upper(role), ',' ORDER BY turn) AS out FROM conversations GROUP BY conv_id")
def op_map_field(spark, table):
    v = _turns(table).select("conv_id", F.struct(F.col("conv_id").alias("id"), "turns").alias("v"))
    c.check_rename(["id", "turns"], "turns", "lines")
    out = c.map_field("turns", "role", F.upper, "lines")(F.col("v"))
    return v.select("conv_id", F.array_join(F.transform(out["lines"], lambda t: F.concat(t["turn"].cast("string"), F.lit(":"), t["role"])), ",").alias("out"))


@query("SELECT doc_id, [sha256(text), upper(lang), length(text)::VARCHAR] AS out FROM documents")
def op_parallel(spark, table):
    d = table("documents").select("doc_id", F.struct("text", "lang").alias("v"))
    return d.select("doc_id", c.parallel(lambda v: sha(v["text"]), lambda v: F.upper(v["lang"]), lambda v: F.length(v["text"]).cast("string"))(F.col("v")).alias("out"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN upper(source) WHEN 'de' THEN 'D' || source ELSE lang || source END AS out FROM documents")
def op_cond_equals(spark, table):
    d = table("documents").select("doc_id", F.struct("lang", "source").alias("v"))
    cases = [(c.equals("en", "lang"), lambda v: F.upper(v["source"])), (c.equals("de", "lang"), lambda v: F.concat(F.lit("D"), v["source"]))]
    step = c.cond(cases, lambda v: F.concat(v["lang"], v["source"]))
    return d.select("doc_id", step(F.col("v")).alias("out"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'seen' WHEN event_type = 'error' THEN 'bad' ELSE event_type END AS out FROM events")
def op_cond_in_default(spark, table):
    step = c.cond([(c.one_of(["click", "view"]), lambda v: F.lit("seen")), (c.equals("error"), lambda v: F.lit("bad"))], lambda v: v)
    return table("events").select("event_id", step(F.col("event_type")).alias("out"))


@query("SELECT event_id, coalesce(try_cast(CASE WHEN event_id % 4 = 0 THEN 'x' ELSE props->>'$.k' END AS BIGINT), -event_id) AS out FROM events")
def op_catch(spark, table):
    v = F.struct(F.when(F.col("event_id") % 4 == 0, F.lit("x")).otherwise(F.get_json_object("props", "$.k")).alias("k"), F.col("event_id").alias("id"))
    step = c.catch(lambda v: c.attempt(v["k"].try_cast("long")), lambda v: -v["id"])
    return table("events").select("event_id", step(v).alias("out"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'a' WHEN event_id % 3 = 0 THEN 'b' ELSE 'c' END AS out FROM events")
def op_race_first(spark, table):
    step = c.race(*(lambda v, n=n, m=m: c.attempt(F.when(v % n == 0, F.lit(m))) for n, m in ((2, "a"), (3, "b"), (1, "c"))))
    return table("events").select("event_id", step(F.col("event_id")).alias("out"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ['a', 'b'] WHEN event_id % 3 = 0 THEN ['b', 'c'] ELSE ['b', 'd'] END AS out FROM events")
def op_race_quorum(spark, table):
    step = c.race(*(lambda v, n=n, m=m: c.attempt(F.when(v % n == 0, F.lit(m))) for n, m in ((2, "a"), (1, "b"), (3, "c"), (1, "d"))), need=2)
    return table("events").select("event_id", step(F.col("event_id")).alias("out"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'yes' ELSE n_name END AS n_name FROM nation")
def op_ask(spark, table):
    """A third has an answer with a value, a third one without, the rest none: it proceeds."""
    n = table("nation").select("n_nationkey", "n_name")
    answers = n.where("n_nationkey % 3 < 2").select("n_nationkey", F.lit(True).alias("answered"), F.when(F.col("n_nationkey") % 3 == 0, F.lit("yes")).alias("value"))
    return c.ask(n, "n_name", "n_nationkey", answers, "proceed")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def op_sink_fanout(spark, table):
    """Two targets are written, and the rows go on."""
    written = []
    sinks = {"store": lambda df, o: written.append(("store", df.count(), dict(o))), "log": lambda df, o: written.append(("log", df.count(), dict(o)))}
    out = c.fan_out(table("orders").select("o_orderkey", "o_totalprice"), ["store", ("log", {"memo": True})], sinks, {"retries": 1})
    assert [w[0] for w in written] == ["store", "log"] and written[1][2] == {"retries": 1, "memo": True}
    return out


RUN_SPEC = {
    "tag": "pipe",
    "steps": [
        {"tag": "map", "concurrency": 4, "op": {"tag": "pipe", "steps": [{"tag": "leaf", "name": "trim"}, {"tag": "leaf", "name": "lower"}]}},
        {"tag": "map", "concurrency": {"kind": "aimd", "max": 8}, "op": {"tag": "cond", "cases": [{"when": {"equals": ""}, "then": {"tag": "leaf", "name": "upper"}}], "default": {"tag": "leaf", "name": "sha256"}}},
    ],
}


@query("SELECT conv_id, string_agg(CASE WHEN trim(text, ' ') = '' THEN '' ELSE sha256(lower(trim(text, ' '))) END, ',' ORDER BY turn) AS out FROM conversations GROUP BY conv_id")
def spec_run(spark, table):
    """A JSON spec compiled to one projection."""
    step = spec.build(json.loads(json.dumps(RUN_SPEC)), spec.TEXT_LEAVES)
    return _turns(table).select("conv_id", F.array_join(step(F.transform("turns", lambda t: t["text"])), ",").alias("out"))


# ---------- specs ----------

PLANS = {
    "two": {"tag": "pipe", "steps": [{"tag": "leaf", "name": "unzip", "opts": {"retries": 2}}, {"tag": "leaf", "name": "stamp", "opts": {"retries": 1}}]},
    "wide": {"tag": "map", "concurrency": {"kind": "aimd"}, "op": {"tag": "catch", "try": {"tag": "leaf", "name": "summarize", "opts": {"memo": True}}, "catch": {"tag": "ask", "prompt": "p", "timeout": "1h", "onTimeout": "fail"}}},
    "sinks": {"tag": "sink", "targets": ["store", {"name": "b", "opts": {"memo": True}}], "opts": {"retries": 3}},
    "params": {"tag": "parallel", "ops": [{"tag": "leaf", "name": "convert", "params": {"to": "json"}}, {"tag": "reconcile", "opts": {"mode": "faithful-union"}}]},
}


@query("""SELECT * FROM (VALUES ('two', 3, 0, 5, false, false, false, '', ''), ('wide', 4, 32, 1, true, true, true, 'summarize', ''), ('sinks', 1, 0, 8, false, true, false, '', 'b,store'), ('params', 3, 0, 2, false, false, false, '', ''))
t(name, node_count, max_concurrency, max_retry_multiplier, uses_ask, uses_cache, uses_llm, llm_leaves, sink_targets)""")
def plan_opspec(spark, table):
    rows = [(n, p["nodeCount"], p["maxConcurrency"], p["maxRetryMultiplier"], p["usesAsk"], p["usesCache"], p["usesLlm"], ",".join(p["llmLeaves"]), ",".join(p["sinkTargets"])) for n, p in ((n, spec.plan(s)) for n, s in PLANS.items())]
    return spark.createDataFrame(rows, "name string, node_count int, max_concurrency int, max_retry_multiplier int, uses_ask boolean, uses_cache boolean, uses_llm boolean, llm_leaves string, sink_targets string")


INVALID = {
    "tag": "pipe",
    "steps": [
        {"tag": "leaf", "name": "unzip", "opts": {"retries": 9}},
        {"tag": "leaf", "name": "stamp"},
        {"tag": "map", "concurrency": 99, "op": {"tag": "race", "ops": [{"tag": "nope"}], "need": 2}},
        {"tag": "cond", "cases": [{"when": {"equals": 1, "in": [1]}, "then": {"tag": "ask", "prompt": "p", "timeout": "", "onTimeout": "fail"}}]},
    ],
}


@query("""SELECT * FROM (VALUES ('$', 1), ('$.steps[0]', 1), ('$.steps[2]', 1), ('$.steps[2].op', 1), ('$.steps[2].op.ops[0]', 1), ('$.steps[3].cases[0]', 1), ('$.steps[3].cases[0].then', 1)) t(path, problems)""")
def validate_opspec(spark, table):
    found = spark.createDataFrame([(e["path"], e["message"]) for e in spec.validate(INVALID)], "path string, message string")
    return found.groupBy("path").agg(F.count("*").cast("int").alias("problems"))


@query("""SELECT * FROM (VALUES ('pack'), ('unpack'), ('unzip'), ('shrink'), ('redact'), ('pageCount'), ('scrub'), ('convert'), ('extract'), ('stamp'), ('summarize'), ('wrapHandle'), ('unwrapHandle')) t(leaf)""")
def describe_schema(spark, table):
    return spark.createDataFrame([(n,) for n in spec.describe()["leaves"]], "leaf string")


# ---------- running specs ----------

#: Redacts each document of a run, unites them, and sends the result's handle to two sinks.
UNITE = {
    "tag": "pipe",
    "steps": [
        {"tag": "map", "concurrency": 4, "op": {"tag": "pipe", "steps": [
            {"tag": "leaf", "name": "wrapHandle"}, {"tag": "leaf", "name": "redact", "params": {"types": ["email"]}}, {"tag": "leaf", "name": "unwrapHandle"},
        ]}},
        {"tag": "reconcile", "opts": {"mode": "faithful-union"}},
        {"tag": "sink", "targets": ["store", {"name": "log", "opts": {"retries": 2}}]},
    ],
}
#: Documents (by id) that are one run's input.
RUN_BLOCK = 50


@query(rf"""WITH d AS (SELECT lang, doc_id // {RUN_BLOCK} AS block, doc_id, regexp_replace(coalesce(text, ''), '{EMAIL_SQL}', '[REDACTED:email]', 'g') AS t FROM documents),
f AS (SELECT lang, block, sha256(t) AS sha, arg_min(t, doc_id) AS t, min(doc_id) AS p FROM d GROUP BY ALL),
u AS (SELECT lang || '-' || block AS run_id, string_agg('<!-- source: cas/' || sha || ' -->' || chr(10) || t, chr(10) || chr(10) ORDER BY p) AS text FROM f GROUP BY ALL)
SELECT run_id, true AS ok, sha256(text) AS sha256, strlen(text)::BIGINT AS size, 'log,store' AS sent, sha256(text) AS logged FROM u""")
def run_spec_redact_reconcile_sink(spark, table):
    """A run for each language and block of ids: its documents' texts as bytes, redacted, united, and sent to two sinks."""
    one = F.struct("doc_id", F.base64(F.coalesce("text", F.lit("")).cast("binary")).alias("base64"))
    rows = table("documents").groupBy(F.concat_ws("-", "lang", reconcile.blocks(F.col("doc_id"), RUN_BLOCK).cast("string")).alias("run_id")).agg(F.array_sort(F.collect_list(one)).alias("docs"))
    given = F.to_json(F.transform("docs", lambda d: F.struct(F.lit(True).alias("$handle"), d["base64"].alias("base64"), F.lit("text/plain").alias("type"))))
    done = run.run_spec(spread(rows.select("run_id", given.alias("input"))), UNITE, run.Host(sinks=("log",)))
    log = f"{shared_dir(spark)}/weftline-log-{uuid.uuid4().hex[:12]}"
    done.send({"log": sinks.parquet(log)})
    logged = spark.read.schema("run_id string, content string").parquet(log).select("run_id", F.get_json_object("content", "$.sha256").alias("logged"))
    sent = done.sunk.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_set("target")), ",").alias("sent"))
    out = done.results.select("run_id", "ok", F.get_json_object("result", "$.sha256").alias("sha256"), F.get_json_object("result", "$.size").cast("long").alias("size"))
    return out.join(sent, "run_id").join(logged, "run_id")


STEADY = {"tag": "pipe", "steps": [{"tag": "leaf", "name": "check"}, {"tag": "leaf", "name": "unsteady"}, {"tag": "leaf", "name": "measure"}]}
FALLBACK = {"tag": "pipe", "steps": [{"tag": "catch", "try": {"tag": "leaf", "name": "unsteady"}, "catch": {"tag": "leaf", "name": "check"}}, {"tag": "leaf", "name": "measure"}]}


def _document_leaves(steady: bool) -> dict:
    """Leaves over {id, text}: unsteady fails for every third id unless steady."""

    def unsteady(v, own):
        if v["id"] % 3 == 0 and not steady:
            raise RuntimeError("down")
        return v

    return {"check": lambda v, own: v, "unsteady": unsteady, "measure": lambda v, own: len(v["text"])}


def _document_runs(table):
    given = F.to_json(F.struct(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")))
    return spread(table("documents").select(F.col("doc_id").cast("string").alias("run_id"), given.alias("input")))


@query("SELECT doc_id::VARCHAR AS run_id, doc_id % 3 > 0 AS ok_before, true AS ok, CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 0 END::BIGINT AS nodes_run, length(coalesce(text, ''))::VARCHAR AS result, CASE WHEN doc_id % 3 = 0 THEN 'in-progress' ELSE 'done' END AS status_before FROM documents")
def run_spec_resume(spark, table):
    """Runs of which a third fails at the second step, resumed: what was done is not done again."""
    rows = _document_runs(table)
    before = run.run_spec(rows, STEADY, run.Host(leaves=_document_leaves(False)))
    after = run.run_spec(rows, STEADY, run.Host(leaves=_document_leaves(True)), previous=before.table)
    nodes = after.table.select("run_id", "ok", "result", F.size(F.filter("trace", lambda e: e["kind"] == "node-enter")).cast("long").alias("nodes_run"))
    was = before.results.select("run_id", F.col("ok").alias("ok_before")).join(run.status(rows, STEADY, before.table).select("run_id", F.col("status").alias("status_before")), "run_id")
    return nodes.join(was, "run_id").select("run_id", "ok_before", "ok", "nodes_run", "result", "status_before")


@query("""WITH n AS (SELECT count(*) AS n, count(*) FILTER (doc_id % 3 = 0) AS bad FROM documents)
SELECT '' AS path, 'pipe' AS name, n AS spans, 0 AS errors, 0 AS with_parent FROM n UNION ALL SELECT '0', 'catch', n, 0, n FROM n UNION ALL SELECT '0/try', 'leaf:unsteady', n, bad, n FROM n
UNION ALL SELECT '0/catch', 'leaf:check', bad, 0, bad FROM n UNION ALL SELECT '1', 'leaf:measure', n, 0, n FROM n""")
def run_spec_trace(spark, table):
    """The spans of the nodes that runs went through, by path."""
    done = run.run_spec(_document_runs(table), FALLBACK, run.Host(leaves=_document_leaves(False)))
    spans = telemetry.spans(done.trace)
    return spans.groupBy("path", "name").agg(F.count("*").alias("spans"), F.count_if(F.col("status") == "ERROR").alias("errors"), F.count("parent_call_id").alias("with_parent"))


# ---------- formats ----------

ODD_TEXTS = "CASE doc_id % 8 WHEN 0 THEN '42' WHEN 1 THEN 'name: Ada' WHEN 2 THEN 'a,b,c' WHEN 3 THEN '<a/>' WHEN 4 THEN '  [1]' WHEN 5 THEN '- x' WHEN 6 THEN '' ELSE 'plain words' END"


@query("SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'json' WHEN 1 THEN 'yaml' WHEN 2 THEN 'csv' WHEN 3 THEN 'xml' WHEN 4 THEN 'json' WHEN 5 THEN 'yaml' WHEN 6 THEN 'json' ELSE 'yaml' END AS format FROM documents")
def detect_format(spark, table):
    return table("documents").select("doc_id", formats.detect_format_column(F.expr(ODD_TEXTS)).alias("format"))


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '#' ELSE url END AS href FROM pages")
def sanitize_url(spark, table):
    return table("pages").select("page_id", formats.safe_url_column(F.when(F.col("page_id") % 5 == 0, F.concat(F.lit(" java\tscript:"), "url")).otherwise(F.col("url"))).alias("href"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN '''=' ELSE '' END || event_type || ',"' || replace(props, '"', '""') || '"' AS line FROM events WHERE props IS NOT NULL""")
def csv_emit(spark, table):
    e = table("events").where("props is not null")
    return e.select("event_id", F.concat_ws(",", formats.csv_cell(F.concat(F.when(F.col("event_type") == "error", F.lit("=")).otherwise(F.lit("")), "event_type")), formats.csv_cell(F.col("props"))).alias("line"))


@query("""SELECT n_nationkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}' AS json, '<row><n_name>' || n_name || '</n_name></row>' AS xml FROM nation""")
def json_xml_emit(spark, table):
    return table("nation").select("n_nationkey", values.flat_json(["n_nationkey", "n_name"]).alias("json"), F.concat(F.lit("<row><n_name>"), formats.xml_text(F.col("n_name")), F.lit("</n_name></row>")).alias("xml"))


@query("""SELECT n_nationkey, 'n_name: ' || n_name || chr(10) || 'n_nationkey: ' || n_nationkey AS yaml FROM nation WHERE NOT regexp_matches(n_name, '[:#,]')""")
def yaml_emit(spark, table):
    n = table("nation").where(~F.col("n_name").rlike("[:#,]"))
    return n.select("n_nationkey", formats.converted(values.flat_json(["n_nationkey", "n_name"]), "json", "yaml")["value"].alias("yaml"))


@query("""SELECT p_partkey, p_name, p_brand, p_type FROM part""")
def csv_parse(spark, table):
    """Parts as CSV text and back."""
    cells = [formats.csv_cell(F.col(x)) for x in ("p_name", "p_brand", "p_type")]
    p = table("part").select("p_partkey", F.concat(F.lit("p_name,p_brand,p_type\n"), F.concat_ws(",", *cells)).alias("csv"))
    back = p.select("p_partkey", F.from_json(formats.converted(F.col("csv"), "csv", "json")["value"], "array<struct<p_name:string,p_brand:string,p_type:string>>")[0].alias("r"))
    return back.select("p_partkey", "r.*")


def _round_trip(kind):
    def run(spark, table):
        e = table("events").where("props is not null").select("event_id", values.flat_json(["event_id", "event_type", "props"]).alias("json"))
        there = e.select("event_id", "json", formats.converted(F.col("json"), "json", kind)["value"].alias("t"))
        back = F.from_json(formats.converted(F.col("t"), kind, "json")["value"], "struct<event_id:string,event_type:string,props:string,root:struct<event_5f_5f_5f_id:string,event_5f_5f_5f_type:string,props:string>>")
        r = there.select("event_id", back.alias("b"))
        pick = lambda f: F.coalesce(F.col(f"b.{f}"), F.col(f"b.root.{f.replace('_', '_5f_5f_5f_')}"))
        return r.select("event_id", (pick("event_id") == F.col("event_id").cast("string")).alias("same_id"), pick("event_type").alias("event_type"), pick("props").alias("props"))

    run.__name__ = f"{kind}_round_trip"
    return query("SELECT event_id, true AS same_id, event_type, props FROM events WHERE props IS NOT NULL")(run)


yaml_round_trip, xml_round_trip = _round_trip("yaml"), _round_trip("xml")


@query()
def html_to_markdown(spark, table):
    return table("pages").select("page_id", sha(formats.converted(F.col("html"), "html", "markdown")["value"]).alias("digest"))


@query()
def markdown_to_html(spark, table):
    return table("documents").select("doc_id", sha(formats.converted(F.col("text"), "markdown", "html")["value"]).alias("digest"))


# ---------- reliability ----------

MS = "(epoch_us(ts) // 1000)"


def _ms():
    return F.unix_millis(F.col("ts").cast("timestamp"))


@query(f"""WITH RECURSIVE c AS (SELECT user_id, {MS}::DOUBLE AS now, (1 + event_id % 5)::DOUBLE AS cost, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, i, now AS last, CASE WHEN 10.0::DOUBLE >= cost THEN 10.0::DOUBLE - cost ELSE 10.0::DOUBLE END AS tokens, (10.0::DOUBLE >= cost)::BIGINT AS granted, (10.0::DOUBLE < cost)::BIGINT AS denied FROM c WHERE i = 1
UNION ALL SELECT c.user_id, c.i, c.now, CASE WHEN least(10.0::DOUBLE, r.tokens + greatest(0.0::DOUBLE, c.now - r.last) * 0.000001::DOUBLE) >= c.cost THEN least(10.0::DOUBLE, r.tokens + greatest(0.0::DOUBLE, c.now - r.last) * 0.000001::DOUBLE) - c.cost ELSE least(10.0::DOUBLE, r.tokens + greatest(0.0::DOUBLE, c.now - r.last) * 0.000001::DOUBLE) END,
 r.granted + (least(10.0::DOUBLE, r.tokens + greatest(0.0::DOUBLE, c.now - r.last) * 0.000001::DOUBLE) >= c.cost)::BIGINT, r.denied + (least(10.0::DOUBLE, r.tokens + greatest(0.0::DOUBLE, c.now - r.last) * 0.000001::DOUBLE) < c.cost)::BIGINT
 FROM r JOIN c ON c.user_id = r.user_id AND c.i = r.i + 1)
SELECT user_id, i AS calls, granted, denied FROM r WHERE (user_id, i) IN (SELECT (user_id, max(i)) FROM c GROUP BY user_id)""")
def token_bucket(spark, table):
    out = folds.token_bucket(table("events"), ["user_id"], ["ts", "event_id"], _ms(), 1 + F.col("event_id") % 5, 10, 0.000001)
    return out.drop("tokens")


BREAKER_SQL = f"""WITH RECURSIVE c AS (SELECT user_id, {MS}::BIGINT AS now, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 'closed' AS state, 0 AS fails, 0 AS wins, NULL::BIGINT AS since, 0::BIGINT AS allowed, 0::BIGINT AS refused, 0::BIGINT AS opened, 0::BIGINT AS closed_again FROM c
UNION ALL
SELECT user_id, i, CASE WHEN refuse THEN state WHEN NOT ok AND (trial OR fails + 1 >= 2) THEN 'open' WHEN trial AND ok AND w >= 2 THEN 'closed' WHEN trial THEN 'half-open' ELSE 'closed' END,
  CASE WHEN refuse THEN fails WHEN trial AND ok AND w >= 2 THEN 0 WHEN trial THEN fails WHEN ok THEN 0 ELSE fails + 1 END,
  CASE WHEN refuse THEN wins WHEN trial AND ok AND w >= 2 OR NOT ok AND (trial OR fails + 1 >= 2) THEN 0 ELSE w END,
  CASE WHEN NOT refuse AND NOT ok AND (trial OR fails + 1 >= 2) THEN now ELSE since END,
  allowed + (NOT refuse)::BIGINT, refused + refuse::BIGINT, opened + (NOT refuse AND NOT ok AND (trial OR fails + 1 >= 2))::BIGINT, closed_again + (trial AND ok AND w >= 2)::BIGINT
FROM (SELECT *, CASE WHEN ready THEN 0 ELSE wins END + (trial AND ok)::INT AS w FROM (SELECT *, state = 'open' AND NOT ready AS refuse, ready OR state = 'half-open' AS trial FROM (
  SELECT c.user_id, c.i, c.now, c.ok, r.state, r.fails, r.wins, r.since, r.allowed, r.refused, r.opened, r.closed_again, r.state = 'open' AND c.now - r.since >= 86400000 AS ready FROM r JOIN c ON c.user_id = r.user_id AND c.i = r.i + 1))))
SELECT user_id, i AS calls, allowed, refused, opened, closed_again, state FROM r WHERE (user_id, i) IN (SELECT (user_id, max(i)) FROM c GROUP BY user_id)"""


@query(BREAKER_SQL)
def circuit_breaker(spark, table):
    return folds.circuit_breaker(table("events"), ["user_id"], ["ts", "event_id"], _ms(), F.col("event_type") != "error", 2, 86_400_000, 2)


AIMD_SQL = """WITH RECURSIVE c AS (SELECT user_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 4::BIGINT AS lim, 0::BIGINT AS run, 0::BIGINT AS increases, 0::BIGINT AS decreases FROM c
UNION ALL SELECT c.user_id, c.i, CASE WHEN c.ok AND r.run + 1 >= r.lim THEN least(64, r.lim + 1) WHEN c.ok THEN r.lim ELSE greatest(1, r.lim // 2) END,
 CASE WHEN c.ok AND r.run + 1 < r.lim THEN r.run + 1 ELSE 0 END, r.increases + (c.ok AND r.run + 1 >= r.lim)::BIGINT, r.decreases + (NOT c.ok)::BIGINT FROM r JOIN c ON c.user_id = r.user_id AND c.i = r.i + 1)
SELECT user_id, i AS calls, increases, decreases, lim AS "limit" FROM r WHERE (user_id, i) IN (SELECT (user_id, max(i)) FROM c GROUP BY user_id)"""


@query(AIMD_SQL)
def aimd_limit(spark, table):
    return folds.aimd(table("events"), ["user_id"], ["ts", "event_id"], F.col("event_type") != "error")


# ---------- telemetry ----------
# A trace of the events: each user's day is a run; its events are calls below the run's root call.

TRACE = f"""WITH e AS (SELECT *, user_id || '-' || strftime(ts, '%Y-%m-%d') AS run_id, {MS}::BIGINT AS ms FROM events),
calls AS (SELECT run_id, 'c' || event_id AS call_id, event_type AS name, ms AS start_ms, 1 + event_id % 700 AS duration_ms, event_type <> 'error' AS ok FROM e),
roots AS (SELECT run_id, 'r' || run_id AS root_id, min(start_ms) - 1 AS root_start, max(start_ms + duration_ms) + 1 AS root_end FROM calls GROUP BY run_id) """


def _trace(table):
    e = table("events").withColumns({"run_id": F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")), "ms": _ms()})
    calls = e.select("run_id", F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("call_id"), F.lit("leaf").alias("tag"), F.col("event_type").alias("name"), F.concat(F.lit("0")).alias("path"), F.col("ms").alias("start_ms"), (1 + F.col("event_id") % 700).alias("duration_ms"), (F.col("event_type") != "error").alias("ok"))
    roots = calls.groupBy("run_id").agg((F.min("start_ms") - 1).alias("start_ms"), (F.max(F.col("start_ms") + F.col("duration_ms")) + 1).alias("end_ms"))
    roots = roots.select("run_id", F.concat(F.lit("r"), "run_id").alias("call_id"), F.lit("pipe").alias("tag"), F.lit(None).cast("string").alias("name"), F.lit("").alias("path"), "start_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), F.lit(True).alias("ok"))
    both = calls.unionByName(roots)
    enter = both.withColumns({"kind": F.lit("node-enter"), "at_ms": F.col("start_ms"), "error": F.lit(None).cast("string")})
    leave = both.withColumns({"kind": F.lit("node-exit"), "at_ms": F.col("start_ms") + F.col("duration_ms"), "error": F.when(~F.col("ok"), F.lit("failed"))})
    return enter.unionByName(leave).drop("start_ms")


@query(TRACE + """SELECT replace(c.run_id, '-', '') AS trace_id, call_id, root_id AS parent_call_id, 'leaf:' || name AS name, start_ms, start_ms + duration_ms AS end_ms, CASE WHEN ok THEN 'OK' ELSE 'ERROR' END AS status, CASE WHEN NOT ok THEN 'failed' END AS error, '0' AS path FROM calls c JOIN roots r ON c.run_id = r.run_id
UNION ALL SELECT replace(run_id, '-', ''), root_id, NULL, 'pipe', root_start, root_end, 'OK', NULL, '' FROM roots""")
def trace_spans(spark, table):
    return telemetry.spans(_trace(table))


def _governor_events(table):
    kind = F.when(F.col("event_type") == "error", F.lit("retry-attempt")).when(F.col("event_id") % 2 == 0, F.lit("aimd-increase")).otherwise(F.lit("memo-hit"))
    return table("events").select(kind.alias("kind"), F.when(F.col("event_id") % 7 > 0, F.col("event_type")).alias("name"), "event_id", _ms().alias("at_ms"), (F.col("event_id") % 64).alias("limit"), F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("run_id"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("c"), F.col("event_id").cast("string"))).alias("call_id"))


# Each event comes up to 600 ms after its call began, so that some calls have ended; some have no name, some no call, some no run.
@query(TRACE + """, open AS (SELECT name, run_id, call_id, start_ms, start_ms + duration_ms AS end_ms FROM calls),
x AS (SELECT event_id, CASE WHEN event_id % 7 > 0 THEN event_type END AS name, CASE WHEN event_id % 5 > 0 THEN run_id END AS run_id, CASE WHEN event_id % 3 = 0 THEN 'c' || event_id END AS call_id, ms + event_id % 4 * 200 AS at FROM e)
SELECT x.event_id, arg_max(o.call_id, (coalesce(o.call_id = x.call_id, false), coalesce(o.run_id = x.run_id, false), o.start_ms, o.call_id)) AS span_call_id
FROM x LEFT JOIN open o ON o.name = x.name AND o.start_ms <= x.at AND x.at <= o.end_ms GROUP BY x.event_id""")
def events_on_spans(spark, table):
    g = _governor_events(table)
    g = g.withColumns({"at_ms": F.col("at_ms") + F.col("event_id") % 4 * 200, "run_id": F.when(F.col("event_id") % 5 > 0, F.col("run_id"))})
    return telemetry.events_on_spans(g, _trace(table)).select("event_id", "span_call_id")


GOVERNOR = "WITH g AS (SELECT CASE WHEN event_type = 'error' THEN 'retry-attempt' WHEN event_id % 2 = 0 THEN 'aimd-increase' ELSE 'memo-hit' END AS kind, CASE WHEN event_id % 7 > 0 THEN event_type ELSE '' END AS name, event_id, event_id % 64 AS lim FROM events) "


@query(GOVERNOR + "SELECT 'op.' || CASE kind WHEN 'retry-attempt' THEN 'retry_attempts' ELSE replace(kind, '-', '_') END || '_total' AS metric, name, count(*) AS value FROM g GROUP BY ALL")
def metric_counters(spark, table):
    return telemetry.counters(_governor_events(table))


@query(GOVERNOR + "SELECT 'op.aimd_limit' AS metric, name, arg_max(lim, event_id) AS value FROM g WHERE kind = 'aimd-increase' GROUP BY name")
def metric_gauge(spark, table):
    return telemetry.limit_gauge(_governor_events(table), ["event_id"])


@query(TRACE + """, d AS (SELECT 'leaf' AS tag, name, duration_ms AS d FROM calls UNION ALL SELECT 'pipe', '', root_end - root_start FROM roots)
SELECT tag, name, count(*) AS count, sum(d)::BIGINT AS sum, [""" + ", ".join(f"count(*) FILTER ({f'd > {a}' if a else 'true'} AND {f'd <= {b}' if b else 'true'})" for a, b in zip((None, *telemetry.BOUNDS), (*telemetry.BOUNDS, None), strict=True)) + "] AS buckets FROM d GROUP BY tag, name")
def metric_histogram(spark, table):
    return telemetry.durations(_trace(table))


# ---------- archives, images, PDF ----------


def _archived(kind):
    def run(spark, table):
        """Nations packed by region and unpacked again."""
        rows = table("nation").select("n_regionkey", F.concat("n_name", F.lit(".txt")).alias("name"), F.col("n_name").cast("binary").alias("content"), (F.lit(1_600_000_000_000) + F.col("n_nationkey") * 60_000).alias("at"))
        packed = archive.pack(rows, "n_regionkey", kind, mtime="at")
        return archive.unpack(packed, kind, "archive", ("bundle",)).select(F.col("bundle").alias("n_regionkey"), "name", "bytes", "text", "mtime", "error")

    run.__name__ = f"archive_{kind.replace('.', '_')}_round_trip"
    when = "NULL::BIGINT" if kind == "none" else "1600000000000 + n_nationkey * 60000"
    return query(f"SELECT n_regionkey, n_name || '.txt' AS name, strlen(n_name)::BIGINT AS bytes, n_name AS text, {when} AS mtime, NULL::VARCHAR AS error FROM nation")(run)


for _kind in ("zip", "tar", "tar.gz"):
    _archived(_kind)


@query("SELECT n_nationkey, n_name || '.txt' AS name, n_name AS text, 1600000000000 + n_nationkey * 1000 AS mtime FROM nation")
def archive_gzip_round_trip(spark, table):
    rows = table("nation").select("n_nationkey", F.concat("n_name", F.lit(".txt")).alias("name"), F.col("n_name").cast("binary").alias("content"), (F.lit(1_600_000_000_000) + F.col("n_nationkey") * 1000).alias("at"))
    packed = archive.pack(rows, "n_nationkey", "gzip", mtime="at")
    return archive.unpack(packed, "gzip", "archive", ("bundle",)).select(F.col("bundle").alias("n_nationkey"), "name", "text", "mtime")


@query("SELECT r_regionkey, 'png' AS kind, (24 + length(r_name))::BIGINT AS stripped_bytes, NULL::VARCHAR AS error FROM region")
def image_scrub(spark, table):
    """A PNG for each region with its name as a text chunk, scrubbed."""
    chunk = lambda kind, data: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(data)), 8, "0")), F.lit(kind).cast("binary"), data, F.unhex(F.lpad(F.hex(F.crc32(F.concat(F.lit(kind).cast("binary"), data))), 8, "0")))
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A")), chunk("IHDR", F.unhex(F.lit("00000001000000010800000000"))), chunk("tEXt", F.concat(F.lit("Author").cast("binary"), F.unhex(F.lit("00")), F.lit("Mx. ").cast("binary"), F.unhex(F.lit("00")), F.col("r_name").cast("binary"))), chunk("IEND", F.lit("").cast("binary")))
    out = table("region").select("r_regionkey", images.scrubbed(png).alias("s"))
    return out.select("r_regionkey", "s.kind", "s.stripped_bytes", "s.error")


@query("SELECT r_regionkey, 1 + r_regionkey AS pages, true AS smaller, NULL::VARCHAR AS error FROM region")
def pdf_pages_and_shrink(spark, table):
    """A PDF for each region with as many pages as its key says, and metadata."""
    kids = F.array_join(F.transform(F.sequence(F.lit(0), F.col("r_regionkey")), lambda i: F.concat((i + 10).cast("string"), F.lit(" 0 R"))), " ")
    pages = F.array_join(F.transform(F.sequence(F.lit(0), F.col("r_regionkey")), lambda i: F.concat((i + 10).cast("string"), F.lit(" 0 obj\n<</Type/Page/Parent 2 0 R/MediaBox[0 0 300 400]>>\nendobj\n"))), "")
    meta = F.concat(F.lit("<x:xmpmeta>"), F.repeat(F.col("r_name"), 200), F.lit("</x:xmpmeta>"))
    text = F.concat(
        F.lit("%PDF-1.4\n1 0 obj\n<</Type/Catalog/Pages 2 0 R/Metadata 3 0 R>>\nendobj\n2 0 obj\n<</Type/Pages/Count 9/Kids["), kids, F.lit("]>>\nendobj\n3 0 obj\n<</Type/Metadata/Subtype/XML/Length "),
        F.length(meta).cast("string"), F.lit(">>\nstream\n"), meta, F.lit("\nendstream\nendobj\n4 0 obj\n<</Author(A (nested\\) one\\\\))>>\nendobj\n"), pages, F.lit("trailer\n<</Root 1 0 R/Info 4 0 R>>\nstartxref\n0\n%%EOF\n"),
    )
    out = table("region").select("r_regionkey", pdf.shrunk(text.cast("binary")).alias("s"))
    return out.select("r_regionkey", F.col("s.pages").cast("int").alias("pages"), (F.col("s.saved_pct") > 0).alias("smaller"), "s.error")


# ---------- streams ----------


def streamed(spark, table, of) -> DataFrame:
    """The decisions of a stream over the events, read as files with all that is there, in one run."""
    events = table("events")
    source = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("call_id"), _ms().alias("at_ms"), (1 + F.col("event_id") % 5).cast("double").alias("cost"), (F.col("event_type") != "error").alias("ok"))
    base = f"{shared_dir(spark)}/weftline-stream-{uuid.uuid4().hex[:12]}"
    source.write.parquet(f"{base}/in")
    calls = spark.readStream.schema(source.schema).parquet(f"{base}/in")
    run = twins.folded(calls, of).writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("key long, call_id long, decision string").parquet(f"{base}/out")


@query(ORACLES["token_bucket"])
def stream_token_bucket(spark, table):
    out = streamed(spark, table, twins.bucket(10, 0.000001))
    return out.groupBy(F.col("key").alias("user_id")).agg(F.count("*").alias("calls"), F.count_if(F.col("decision") == "granted").alias("granted"), F.count_if(F.col("decision") == "denied").alias("denied"))


@query(ORACLES["circuit_breaker"].replace("SELECT user_id, i AS calls, allowed, refused, opened, closed_again, state FROM r", "SELECT user_id, i AS calls, allowed, refused, opened, closed_again FROM r"))
def stream_circuit_breaker(spark, table):
    d = F.col("decision")
    return streamed(spark, table, twins.breaker(2, 86_400_000, 2)).groupBy(F.col("key").alias("user_id")).agg(F.count("*").alias("calls"), F.count_if(d != "refused").alias("allowed"), F.count_if(d == "refused").alias("refused"), F.count_if(d == "opened").alias("opened"), F.count_if(d == "closed").alias("closed_again"))


@query(ORACLES["aimd_limit"].replace('decreases, lim AS "limit" FROM r', "decreases FROM r"))
def stream_aimd(spark, table):
    d = F.col("decision")
    return streamed(spark, table, twins.limiter()).groupBy(F.col("key").alias("user_id")).agg(F.count("*").alias("calls"), F.count_if(d == "increase").alias("increases"), F.count_if(d == "decrease").alias("decreases"))
