"""T1-T19 column functions against the reference's string semantics."""

import pytest
from pyspark.sql import functions as F

from calyx.functions import text as T
from calyx.functions.regex import java_re


def one(spark, expr_fn, value):
    df = spark.createDataFrame([(value,)], "s string")
    return df.select(expr_fn(F.col("s")).alias("r")).collect()[0]["r"]


@pytest.mark.parametrize("raw, want", [
    ("<b>Hello</b>&nbsp;&amp;lt; world\t\n", "Hello &lt; world"),      # decoded once
    ("  a  b  ", "a b"),
    ("x&#233;&#x41;y", "xéAy"),
    ("Tom &amp; Jerry &copy; &middot; &quot;q&quot;", 'Tom & Jerry © · "q"'),
    ("no&entity; &amp", "no&entity; &"),                                # unknown kept, an old name needs no ";"
    ("", ""),
])
def test_clean(spark, raw, want):
    assert one(spark, T.clean, raw) == want                     # Column builder
    df = spark.createDataFrame([(raw,)], "s string")
    assert df.select(T.clean("s").alias("r")).collect()[0]["r"] == want   # SQL text builder


@pytest.mark.parametrize("raw", ["&#0;&#55296;&#99999999;&#x110000;", "a&b&amp;amp;&#x263A;&apos;&AElig;", "&&;&#;&#x;"])
def test_decode_paths_agree(spark, raw):
    df = spark.createDataFrame([(raw,)], "s string")
    r = df.select(T.decode_entities(F.col("s")).alias("a"), T.decode_entities("s").alias("b")).collect()[0]
    assert r["a"] == r["b"]


def test_unicode_trim_and_ascii(spark):
    assert one(spark, T.utrim, "  x y  \t") == "x y"
    assert one(spark, lambda c: T.non_ascii(c, " "), "café – ok") == "caf    ok"
    assert one(spark, lambda c: T.non_ascii(c, ""), "café") == "caf"


def test_prefix_suffix_paren(spark):
    assert one(spark, T.strip_trailing_paren, "Accounting (ACC)") == "Accounting"
    assert one(spark, T.strip_trailing_paren, "A (x)\nB") == "A (x)\nB"   # '.' does not cross lines
    assert one(spark, lambda c: T.trim_prefix(c, "Pre-reqs:"), "Pre-reqs: X") == " X"
    assert one(spark, lambda c: T.trim_prefix(c, "Pre-reqs:"), "X Pre-reqs:") == "X Pre-reqs:"
    assert one(spark, lambda c: T.trim_suffix(c, ":"), "Heading:") == "Heading"
    assert one(spark, lambda c: T.remove_first(c, " the "), "a the b the c") == "ab the c"
    assert one(spark, T.newline_to_space, "\n a\nb \n") == "a b"


def test_split_fallback_cascade(spark):
    df = spark.createDataFrame([("a<br/>b<br/><br/>",)], "s string")
    assert df.select(T.split_literal("s", "<br/>").alias("r")).collect()[0]["r"] == ["a", "b", "", ""]
    df = spark.createDataFrame([("", "b", "c")], "a string, b string, c string")
    assert df.select(T.first_nonempty("a", "b", "c").alias("r")).collect()[0]["r"] == "b"
    df = spark.createDataFrame([("EXCLUSION: X",), ("PREREQUISITE: Y",), ("text",)], "s string")
    c = T.cascade("s", [("pre", r"PREREQUISITE:\s*(.*)", 1), ("excl", r"EXCLUSION:\s*(.*)", 1)])
    got = sorted(tuple(r) for r in df.select(c.kind, c.value).collect())
    assert got == [("excl", "X"), ("pre", "Y"), ("text", "text")]


def test_slice_between(spark):
    v = "head <a id=x>START body <hr> more <hr> tail"
    assert one(spark, lambda c: T.slice_between(c, "START", "<hr>"), v) == "START body <hr> more <hr>"
    assert one(spark, lambda c: T.slice_between(c, "NOPE", "<hr>"), v) == ""


def test_java_re_rules():
    assert java_re(r"a\s+b$") == r"(?d)a[\t\n\f\r ]+b\z"
    assert java_re(r"(?m)x$") == r"(?dm)x$"
    assert java_re(r"[[:^ascii:]]") == r"(?d)[^\x00-\x7F]"
    assert java_re(r"[\s\d]") == "(?d)[\\t\\n\\f\\r \\d]"


def test_references_of_html5(spark):
    import html as stdlib

    from pyspark.sql import functions as F

    from calyx.functions import text as T
    cases = {"a &copy b &amp c": "a © b & c", "&#150; &#x96;": "– –", "&check; &lbrace;": "✓ {", "&#0000000038;": "&", "&amp;lt;": "&lt;",
             "&notit; &notin; &nope; &": "¬it; ∉ &nope; &", "&#xD800;&#0;&#99999999999999999999;&#xFFFFFFFFFFFFFFFFFF;": "\ufffd" * 4,
             "&#38 &#x26g; &#; &#x;": "& &g; &#; &#x;", "&NotEqualTilde;": "\u2242\u0338"}
    names = {f"x&{k}y": "x" + v + "y" for k, v in stdlib.entities.html5.items() if k.endswith(";")} if hasattr(stdlib, "entities") else {}
    cases |= names
    d = spark.createDataFrame(list(cases.items()), "t string, want string")
    got = d.select("t", "want", T.decode_entities("t").alias("a"), T.decode_entities(F.col("t")).alias("b")).collect()
    assert [(r.t, r.a, r.b) for r in got if not r.a == r.b == r.want] == []


def test_positions_of_all_matches(spark):
    import re
    from calyx.functions import text as T
    texts = ["", None, "a1bb22é333", "no digits", "12", "😀 7 😀 88", "9" * 10, "x1" * 5]
    many = "ab1 " * 100_000
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*texts, many])], "doc_id long, text string, start string")
    got = T.match_positions(df, ["doc_id"], "text", "[0-9]+")
    assert got.columns == ["doc_id", "match_no", "start", "end", "match"]
    want = [(i, k, m.start(), m.end(), m[0]) for i, t in enumerate([*texts, many]) for k, m in enumerate(re.finditer("[0-9]+", t or ""))]
    assert sorted(map(tuple, got.collect())) == want


def test_members_of_untyped_payloads(spark):
    from calyx.operators import sections as S
    rows = [(1, '{"a":1,"b":[1,{"c":2}]}'), (2, '{"a":"x","b":{"c":null}}'), (3, "[1]"), (4, "no"), (5, None), (6, '{"a":null,"d":true}'), (7, "{}"), (8, '{"a":2.5}')]
    v = S.variant_payload(spark.createDataFrame(rows, "id long, body string"), "body")
    got = sorted(map(tuple, S.payload_members(v, "payload", ["id"]).collect()))
    assert got == [(1, "a", "number", "1"), (1, "b", "array", '[1,{"c":2}]'), (2, "a", "string", '"x"'), (2, "b", "object", '{"c":null}'),
                   (6, "a", "null", "null"), (6, "d", "boolean", "true"), (8, "a", "number", "2.5")]
    a = {r.id: r.a for r in v.select("id", S.member("payload", "$.a", "double").alias("a")).collect()}
    assert a == {1: 1.0, 2: None, 3: None, 4: None, 5: None, 6: None, 7: None, 8: 2.5}
    r = S.payload_report(v, "payload").collect()[0]
    assert r.n_payloads == 6 and r.schema == "VARIANT"
