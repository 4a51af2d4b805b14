import random
import re

from weftline.llm import url_filters as u


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, default, None))
    return host, path, best[3], best[2]


def run(spark, urls, rules, **how):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    rows = u.filter_urls(pages, u.rules_frame(spark, rules), **how).collect()
    assert len(rows) == len(urls)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}


def test_against_all_rules(spark):
    rnd = random.Random(3)
    labels = ["net", "com", "example", "a", "ab", "", "x\x01y", "\x02", "é"]
    hosts = [".".join(rnd.choice(labels) for _ in range(rnd.randint(1, 4))) for _ in range(60)]
    paths = ["", "/", "/en", "/en/", "/en/x", "/e", "/en/x/y"]
    rules = [(h, rnd.choice(paths), rnd.choice(["block", "allow"])) for h in hosts[:30]] + list(u.RULES)
    urls = [rnd.choice(["http://", "", "x://y://"]) + rnd.choice(hosts).upper() + rnd.choice(paths) + rnd.choice(["", "?q=/en/", "#a", "?"]) for _ in range(600)]
    urls += [None, "", "://", "http://", "http://net", "http://NET/", "http://a.example.net./en/", "http://example.com/de/1", "http://xexample.com/de/1"]
    got = run(spark, urls, rules)
    assert got == {i: brute(x, rules) for i, x in enumerate(urls)}


def test_no_rules_no_pages_and_other_columns(spark):
    assert run(spark, ["http://a.net/"], [], default="block") == {0: ("a.net", "/", None, "block")}
    empty = spark.createDataFrame([], "page_id long, url string, host string, stack string, `a.b` int")
    out = u.filter_urls(empty, u.rules_frame(spark, u.RULES))
    assert out.columns == ["page_id", "url", "stack", "a.b", "host", "path", "rule", "verdict"] and out.count() == 0
    twice = spark.createDataFrame([(1, "http://b.net/", "k"), (1, "http://b.net/", "k"), (None, None, None)], "page_id long, url string, key string")
    assert sorted(r.verdict for r in u.filter_urls(twice, u.rules_frame(spark, u.RULES)).collect()) == ["allow", "block", "block"]


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://b.net/")], "page_id long, url string")
    plan = u.filter_urls(pages, u.rules_frame(spark, u.RULES))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_columns_that_have_no_hash(spark):
    pages = spark.sql("select id as page_id, concat('http://a', id, '.net/x') as url, map('k', id) as more from range(5)")
    rules = u.rules_frame(spark, u.RULES)
    assert {r.verdict for r in u.filter_urls(pages, rules).collect()} == {"block"}
