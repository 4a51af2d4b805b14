"""Golden values of the formats, and round trips."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.functions import formats as f
from weftline.functions import values as v


@pytest.mark.parametrize("text,kind", [("42", "json"), ("name: Ada", "yaml"), ("a,b,c", "csv"), ("<a/>", "xml"), ("", "json"), (" [1]", "json"), ("- x", "yaml"), ("plain", "yaml"), ('"s"', "json"), ("a b\nc,d", "yaml")])
def test_detect(text, kind):
    assert f.detect_format(text) == kind


def test_yaml_goldens():
    assert f.to_yaml({"rows": [["x", 7], [8]]}) == "rows:\n  - - x\n    - 7\n  - - 8"
    assert f.parse_yaml("rows:\n  - - x\n    - 7\n  - - 8") == {"rows": [["x", 7], [8]]}
    assert f.parse_yaml("k: |2-\n   a\n  b\nm: >+\n  c\n  d\nn: |x") == {"k": " a\nb", "m": "c d\n", "n": "|x"}
    assert f.parse_yaml("k: |\n  line1\n  line2\n") == {"k": "line1\nline2\n"}
    assert f.parse_yaml("k: >\n  line1\n  line2\n") == {"k": "line1 line2\n"}
    assert f.parse_yaml("k: |-\n  line1\n  line2\n") == {"k": "line1\nline2"}
    assert f.parse_yaml("a: |\n  # no comment\n  x # nor this\nb: 1 # one") == {"a": "# no comment\nx # nor this\n", "b": 1}
    assert f.parse_yaml("it: it's # c\nq: 'a # b'\n\n# c\nz: \"x: y\"") == {"it": "it's", "q": "a # b", "z": "x: y"}
    assert f.parse_yaml("- a: 1\n  b: [1, 2]\n- c\n-\n  d: ~") == [{"a": 1, "b": [1, 2]}, "c", {"d": None}]
    assert f.parse_yaml("k:\n- 1\n- 2\nj: 01") == {"k": [1, 2], "j": "01"}
    assert f.parse_yaml("__proto__: 1\na: .5") == {"a": 0.5} and f.parse_yaml("") is None and f.parse_yaml("hello") == "hello"


def test_csv_goldens():
    assert f.parse_csv('a\n""\n\nb', ",") == [["a"], [""], ["b"]]
    assert f.parse_csv('3" pipe,"x"y,"a""b"', ",") == [['3" pipe', "xy", 'a"b']]
    assert f.parse_csv("\ufeffa;b\r\n1;2\r3;", ";") == [["a", "b"], ["1", "2"], ["3", ""]]
    assert f.parse_csv('"open\nto the end', ",") == [["open\nto the end"]] and f.parse_csv("", ",") == []
    assert f.to_csv([{"cmd": "=cmd()"}]) == "cmd\n'=cmd()" and f.to_csv([{"n": -5}]) == "n\n-5"
    assert f.to_csv(["a", {"b": 1}]) == "value,b\na,\n,1"


def test_csv_header_numbers():
    assert [list(r) for r in f.csv_rows("a,a,a_2\n1,2,3")] == [["a", "a_2", "a_2_2"]]


def test_xml_goldens():
    assert f.to_xml({"@id": 'a"b', "#text": "hi"}, "n") == '<n id="a&quot;b">hi</n>'
    assert f.parse_xml('<n id="a&quot;b">hi</n>') == {"n": {"@id": 'a"b', "#text": "hi"}}
    assert "<a_5f_5f_5f_b>1</a_5f_5f_5f_b>" in f.to_xml({"a_b": 1})
    assert f.parse_xml("<r><a>1</a><a>2</a><b/><c><![CDATA[<x>]]></c></r>") == {"r": {"a": ["1", "2"], "b": "", "c": "<x>"}}
    for value in ({"e": []}, {"e": ["x"]}, {"e": None}, {"e": [["a"], []]}, {"e": [["a", "b"], "c"]}, {"e": [None]}):
        assert f.parse_xml(f.to_xml(value)) == {"root": value}
    for bad in ("<a>", "<a></b>", "</a>", "<a"):
        with pytest.raises(ValueError):
            f.parse_xml(bad)


def test_entities():
    assert f.decode_entities("&AMP;&lt;&#65;&#x1F600;&nope;&#x110000;&amp;lt;") == "&<A😀&nope;&#x110000;&lt;"


def test_html_to_markdown():
    h = f.html_to_markdown
    assert h("<h1>Title</h1>") == "# Title"
    assert h("<ul><li>bread<ul><li>rye</li></ul></li></ul>") == "- bread\n  - rye"
    assert h("<ul><li>a<ol><li>b</li><li>c</li></ol></li><li>d</li></ul>") == "- a\n  1. b\n  2. c\n- d"
    assert h("<blockquote>she said<blockquote>they said</blockquote>and left</blockquote>") == "> she said\n> > they said\n> and left"
    assert h('<p>a <b>b</b> <i>c</i> <a href="/u">d</a> <code>x`y</code></p>') == "a **b** *c* [d](/u) ``x`y``"
    assert h("<pre><code>x &lt; y</code></pre>") == "```\nx < y\n```"
    assert h("<nav>menu</nav><p>x&amp;lt;</p><script>no</script>") == "menu\n\nx&lt;"


def test_markdown_to_html():
    m = f.markdown_to_html
    assert m("# Title") == "<h1>Title</h1>"
    assert m("[x](javascript:alert(1)) [y](a_(b)_c)") == '<p><a href="#">x</a> <a href="a_(b)_c">y</a></p>'
    assert m("- a\n- b\n\n1. c\n> q\n> r\n```\n<x>\n```\ntext\nmore **b** `*c*`") == "<ul><li>a</li><li>b</li></ul>\n<ol><li>c</li></ol>\n<blockquote>q r</blockquote>\n<pre><code>&lt;x&gt;</code></pre>\n<p>text more <strong>b</strong> <code>*c*</code></p>"


PLAIN = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**53) + 1, 2**53 - 1) | st.text(st.characters(codec="utf-8", exclude_characters="\x85\u2028\u2029", exclude_categories=["Cc", "Zl", "Zp"]), max_size=8),
    lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("abcxyz :#-\"'", min_size=1, max_size=5).filter(lambda k: k == k.strip()), x, max_size=3), max_leaves=8,
)


@settings(max_examples=300, deadline=None)
@given(PLAIN)
def test_yaml_round_trip(value):
    assert f.parse_yaml(f.to_yaml(value)) == value


@settings(max_examples=200, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from("abc"), st.text("ab,\"\n\r ;é", max_size=6).filter(lambda t: t[:1] != "\r"), min_size=3, max_size=3), min_size=1, max_size=4))
def test_csv_round_trip(rows):
    assert f.csv_rows(f.to_csv(rows)) == rows


def test_numbers_and_canonical_text():
    assert [v.number(x) for x in (1.0, 1e21, 1.5e-7, 0.1, -0.0, 123456789012345680000.0, 1e-6, 100)] == ["1", "1e+21", "1.5e-7", "0.1", "0", "123456789012345680000", "0.000001", "100"]
    assert v.canonical_json({"b": 1, "9": 2, "10": 3, "a": {"z": None, "y": [1.0]}}) == '{"9":2,"10":3,"a":{"y":[1],"z":null},"b":1}'
    handle = {"r2Key": "cas/x", "sha256": "x", "type": "t", "size": 1}
    assert v.memo_key("n", {"h": handle | {"producedAt": 5}}) == v.memo_key("n", {"h": handle}) != v.memo_key("m", {"h": handle})
    assert v.idempotency_key("n", {"a": 1, "b": 2}) == v.idempotency_key("n", {"b": 2, "a": 1})


def test_convert(spark):
    assert f.convert('{"a":[1]}', "auto", "yaml") == "a:\n  - 1" and f.convert("a,b\n1,2", "auto", "json") == '[\n  {\n    "a": "1",\n    "b": "2"\n  }\n]'
    assert f.convert("[1,2]", "json", "xml") == "<root><item>1</item><item>2</item></root>"
    for bad in (("x", "html", "json"), (" ", "auto", "json"), ("[" * 200 + "]" * 200, "json", "yaml"), ("<a>", "xml", "json")):
        with pytest.raises(ValueError):
            f.convert(*bad)
    rows = spark.createDataFrame([("<a>1</a>",), ("<a>",), (None,)], "x string")
    assert [(r.o.ok, r.o.value) for r in rows.select(f.converted(rows.x, "xml", "json").alias("o")).collect()] == [(True, '{\n  "a": "1"\n}'), (False, None), (None, None)]


def test_columns_agree_with_functions(spark):
    texts = ["42", "name: Ada", "a,b,c", "<a/>", "", " [1]", "- x", "plain", '"s"', "a b\nc,d", "1.5e3", "x:y", "nul", "{"]
    urls = ["http://a", " java\tscript:x", "JAVASCRIPT:1", "mailto:a@b", "rel/path", "data:x", 'q"uote', "HTTPS://x", "a:b"]
    rows = spark.createDataFrame([(t, u) for t, u in zip(texts, urls + [""] * 9, strict=False)], "t string, u string")
    for r in rows.select("t", "u", f.detect_format_column(rows.t).alias("d"), f.safe_url_column(rows.u).alias("s")).collect():
        assert (r.d, r.s) == (f.detect_format(r.t), f.safe_url(r.u))
