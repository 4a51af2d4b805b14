"""The registered queries of this package: one opN_<name> for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, mixing, near_dedup, packing, quality_model, quality_rules, secret_scan, token_counts, toxicity, url_filters
from .shared import public_tokenizer, spread, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(spread(table(spark, sf_dir, "documents")))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = near_dedup.mark_near_copies(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), shingle=4)
    return marks.select("doc_id", "n_shingles", "component_id", "kept")


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filters.filter_urls(pages, url_filters.rules_frame(spark, url_filters.RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(spread(table(spark, sf_dir, "documents")), public_tokenizer(token_counts.VOCABULARY))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(spread(table(spark, sf_dir, "documents")))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spread(table(spark, sf_dir, "documents")), public_tokenizer(packing.TOKENIZER))


def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations, never cut, under limits on tokens, segments and loss-bearing tokens."""
    return packing.pack_examples(packing.conversation_sizes(table(spark, sf_dir, "conversations"), public_tokenizer(packing.TOKENIZER)))


def quality_base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and fixed limits of op8_quality_rules, without its outliers."""
    based = quality_rules.with_base(quality_rules.statistics(spread(table(spark, sf_dir, "documents"))))
    return based.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


BASE_RULES_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
places AS (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM worded WHERE len(words) > 2),
windows AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS n FROM places),
covered AS (SELECT rid, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM windows, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY rid),
counted AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM worded LEFT JOIN covered USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
"""

OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix:' || md5(coalesce(text, ''))), 1, 5))::BIGINT AS draw
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         source_size * 2.0::DOUBLE AS cap FROM sources),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
marked AS (SELECT *, level * weight > cap AS is_full FROM levels),
targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap ELSE weight * (max(level) FILTER (WHERE NOT is_full) OVER ()) END AS target FROM marked),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM targets),
goals AS (SELECT *, target - copies * source_size AS extra FROM rates),
sums AS (SELECT source, draw, sum(size)::BIGINT AS s FROM sized GROUP BY ALL HAVING sum(size) > 0),
runs AS (SELECT *, (sum(s) OVER (PARTITION BY source ORDER BY draw ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM sums),
hits AS (
  SELECT g.source, arg_min(CASE WHEN g.extra - (r.upto - r.s) <= r.upto - g.extra THEN r.draw - 1 ELSE r.draw END, r.draw) AS last
  FROM runs r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source WHERE r.upto > g.extra GROUP BY g.source)
SELECT d.doc_id, d.size, g.source_size, g.target,
       d.size * (g.copies + (d.draw <= coalesce(h.last, -1))::BIGINT) AS taken, d.source,
       g.copies + (d.draw <= coalesce(h.last, -1))::BIGINT AS n_copies
FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN hits h ON h.source IS NOT DISTINCT FROM g.source
"""

OP6_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(rhost, rpath, rverdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
       coalesce(arg_max(rverdict, length(rhost || rpath)), 'allow') AS verdict
FROM parts LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
GROUP BY page_id, host, path
"""

OP9_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
h AS (SELECT doc_id, chars, sha256(norm) AS text_sha256 FROM t),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

QUERIES = {"op1_toxicity": op1_toxicity, "op2_mix": op2_mix, "op3_secret_scan": op3_secret_scan, "op4_near_dedup": op4_near_dedup, "op5_quality_model": op5_quality_model, "op6_url_filter": op6_url_filter, "op7_token_counts": op7_token_counts, "op8_quality_rules": op8_quality_rules, "op9_exact_dedup": op9_exact_dedup, "op10_pack": op10_pack, "instruction_packing": instruction_packing, "quality_base_rules": quality_base_rules}
ORACLES = {"quality_base_rules": BASE_RULES_SQL, "op2_mix": OP2_SQL, "op6_url_filter": OP6_SQL, "op9_exact_dedup": OP9_SQL}
