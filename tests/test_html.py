"""Element extents and the tree on small hand-made pages."""

from pyspark.sql import functions as F

from calyx.operators import html as H

from .conftest import pages_df


def elems(spark, html):
    n = H.shred(pages_df(spark, [("u", html)]))
    return {r["pos"]: r for r in n.collect()}, n


def test_p_closed_by_block_start_and_container_end(spark):
    # tokens: 0 <div> 1 <p> 2 a 3 <div> 4 b 5 </div> 6 <p> 7 c 8 </div> 9 d
    html = "<div><p>a<div>b</div><p>c</div>d"
    e, _ = elems(spark, html)
    assert e[1]["tag"] == "p" and e[1]["end"] == 3          # <div> closes the open p
    assert e[3]["parent"] == 0                             # the inner div is not inside the p
    assert e[6]["tag"] == "p" and e[6]["end"] == 8         # </div> of the container ends the p
    assert e[0]["end"] == 8


def test_unclosed_inline_ends_with_parent_and_texts(spark):
    # tokens: 0 <li> 1 <b> 2 x 3 <i> 4 y 5 </i> 6 z 7 </li> 8 <li> 9 <div> ...
    html = "<li><b>x<i>y</i>z</li><li><div>q<div>r</div></div></li>"
    e, n = elems(spark, html)
    assert e[1]["tag"] == "b" and e[1]["end"] == 7         # never closed: ends where the li ends
    assert e[3]["parent"] == 1                             # and holds what follows it
    t = {r["pos"]: r["text"] for r in H.element_text(n, H.sel(tag="div")).collect()}
    outer = min(t)
    assert t[outer] == "qr" and sorted(t.values()) == ["qr", "r"]   # nested same tag: both texts
    li = H.element_text(n, H.sel(tag="li")).orderBy("pos").select("text").collect()
    assert [r[0] for r in li] == ["xyz", "qr"]


def test_descendant_selector_and_attrs(spark):
    html = ('<nav><ul><li><a href="/a?x=1&amp;y=2">A</a></li></ul></nav>'
            "<a href='/b' class=' k  m '>B</a><a href=/c>C</a>")
    _, n = elems(spark, html)
    inside = H.select_path(n, H.sel(tag="nav"), H.sel(tag="li"), H.sel(tag="a"))
    assert [r[0] for r in inside.select(H.attr("href")).collect()] == ["/a?x=1&y=2"]
    a = n.filter(H.sel(tag="a")).orderBy("pos").select(H.attr("href").alias("h"),
                                                        H.sel(tag="a", cls=["k", "m"]).alias("km"))
    assert [tuple(r) for r in a.collect()] == [("/a?x=1&y=2", False), ("/b", True), ("/c", False)]


def texts_of(spark, html, tag):
    from calyx.plans.extract import texts
    from calyx.operators import html as H
    n = H.shred(spark.createDataFrame([(1, html)], "page_id long, html string"))
    return [r.text for r in texts(n, H.sel(tag=tag)).orderBy("pos").collect()]


def test_end_tags_that_may_be_left_out(spark):
    assert texts_of(spark, "<ul><li>a<li>b<li>c</ul>", "li") == ["a", "b", "c"]
    assert texts_of(spark, "<table><tr><td>1<td>2<tr><td>3<td>4</table>", "td") == ["1", "2", "3", "4"]
    assert texts_of(spark, "<table><tr><td>1<td>2<tr><td>3<td>4</table>", "tr") == ["12", "34"]
    assert texts_of(spark, "<a>x<a>y</a>", "a") == ["x", "y"]
    assert texts_of(spark, "<ul><li>a<ul><li>b</ul>c<li>d</ul>", "li") == ["abc", "b", "d"]
    assert texts_of(spark, "<dl><dt>a<dd>b<dt>c<dd>d</dl>", "dd") == ["b", "d"]
    assert texts_of(spark, "<table><tbody><tr><td>1<table><tr><td>x</table>2<td>3<tbody><tr><td>4</table>", "td") == ["1x2", "x", "3", "4"]
    assert texts_of(spark, "<select><optgroup><option>a<option>b<optgroup><option>c</select>", "option") == ["a", "b", "c"]
    assert texts_of(spark, "<div>a<script>if (a &amp;& b) x();</script>b &amp; c</div>", "div") == ["aif (a &amp;& b) x();b & c"]


def test_attributes_are_stepped_over_whole(spark):
    from calyx.operators import html as H
    toks = ['<a title="a > b" href="/x">', '<a title="see href=foo now" href="/y">', "<a data-x=\"v href='/z'\" href=\"/ok\">",
            "<a HREF = /u class>", "<a href>", "<a hrefs='/no'>", "<a/href='/s'>", "<a href='/1' href='/2'>", '<a href="?a=1&amp;b=2">']
    d = spark.createDataFrame([(t,) for t in toks], "tok string")
    got = d.select(H.attr("href").alias("a"), H.has_attr("href").alias("h"), H.has_attr("class").alias("c"),
                   H.all_attrs("tok").alias("all")).collect()
    assert [r.a for r in got] == ["/x", "/y", "/ok", "/u", "", "", "/s", "/1", "?a=1&b=2"]
    assert [r.h for r in got] == [True, True, True, True, True, False, True, True, True]
    assert [r.c for r in got] == [False] * 3 + [True] + [False] * 5
    for r in got:
        assert next((x.value for x in r.all if x.name == "href"), "") == r.a


def outline(spark, html, **how):
    """The tree as nested lists: [tag, child, ...], a text as a string."""
    n = sorted(H.shred(pages_df(spark, [("u", html)]), **how).collect(), key=lambda r: r["pos"])
    top, at = [], {}
    for r in n:
        box = top if r["parent"] is None else at[r["parent"]]
        if r["is_elem"]:
            at[r["pos"]] = [r["tag"]]
            box.append(at[r["pos"]])
        elif r["kind"] == "text":
            box.append(r["tok"])
    return top


BROKEN = [  # page, its tree, its tree with formatting elements opened again
    ("<b>1<i>2</b>3</i>4", [["b", "1", ["i", "2"]], "3", "4"], [["b", "1", ["i", "2"]], ["i", "3"], "4"]),
    ("<p>1<b>2<p>3</b>4", [["p", "1", ["b", "2"]], ["p", "3", "4"]], [["p", "1", ["b", "2"]], ["p", ["b", "3"], "4"]]),
    ("<div>1</span>2</div></div>3</p>", [["div", "1", "2"], "3"], None),
    ("<table><tr><td>1<table><tr><td>2</td></tr></table>3</td></tr></table>4",
     [["table", ["tr", ["td", "1", ["table", ["tr", ["td", "2"]]], "3"]]], "4"], None),
    ("<table><tr><td>1<td><p>2<div>3</td></div>4<tr><td>5", [["table", ["tr", ["td", "1"], ["td", ["p", "2"], ["div", "3"]], "4"], ["tr", ["td", "5"]]]], None),
    ("<div><table><tr><td>1</div>2</table>3</div>", [["div", ["table", ["tr", ["td", "1", "2"]]], "3"]], None),
    ("<ul><li>1<ul><li>2</ul>3<li>4</ul>", [["ul", ["li", "1", ["ul", ["li", "2"]], "3"], ["li", "4"]]], None),
    ("<b><p>1</b>2</p>3", [["b", ["p", "1", "2"]], "3"], None),
    ("<a href=1>x<a href=2>y</a>z", [["a", "x"], ["a", "y"], "z"], None),
    ("<h1>a<h2>b</h2>c", [["h1", "a"], ["h2", "b"], "c"], None),
    ("<td><b>1<td>2", [["td", ["b", "1"]], ["td", "2"]], None),
    ("<br/><img>x<script>if(a<b)</script>", [["br"], ["img"], "x", ["script"]], None),
    ("", [], None), ("<!-- c --><!doctype html>", [], None), ("</p></b></td>", [], None),
]


def test_broken_pages_give_the_stated_tree(spark):
    for html, plain, again in BROKEN:
        assert outline(spark, html) == plain, html
        assert outline(spark, html, reopen=True) == (plain if again is None else again), html


def test_reopened_elements_are_bounded(spark):
    html = "<p>" + "".join(f"<font size={i}>" for i in range(40)) + "".join(f"<p>{i}" for i in range(30))
    n = H.shred(pages_df(spark, [("u", html)]), reopen=True)
    assert n.filter("tag = 'font' and is_elem").count() <= 40 + 3 * 30


def random_page(rng):
    tags = ["b", "i", "a", "p", "div", "ul", "li", "table", "tr", "td", "span", "h1", "br", "select", "option"]
    out = []
    for _ in range(rng.randint(0, 60)):
        t, k = rng.choice(tags), rng.random()
        out.append(f"<{t} class='{rng.choice('xy')}'>" if k < 0.45 else f"</{t}>" if k < 0.8 else rng.choice(["text", " ", "<!-- c -->"]))
    return "".join(out)


def matches(steps, x, above, before):
    """Does the selector match element ``x``? By trying all elements above and before it."""
    how, simple = steps[-1] if isinstance(steps[-1], tuple) else (" ", steps[-1])
    if simple.get("tag", x["tag"]) != x["tag"] or (simple.get("cls") and f"class='{simple['cls']}'" not in x["tok"]):
        return False
    if len(steps) == 1:
        return True
    near = {" ": above(x), ">": above(x)[:1], "+": before(x)}[how]
    return any(matches(steps[:-1], y, above, before) for y in near)


def test_random_pages_nest_and_selectors_match_brute_force(spark):
    import random
    rng = random.Random(11)
    pages = [("u", random_page(rng)) for _ in range(150)]
    select = {"one": [{"tag": "li"}], "two": [{"tag": "div"}, {"tag": "b", "cls": "x"}], "three": [{"cls": "x"}, {"tag": "td"}, (">", {"cls": "y"})],
              "four": [{"tag": "p"}, ("+", {}), {"tag": "i"}], "five": [{"tag": "div"}, {"tag": "div"}, {"tag": "div"}]}
    for again in (False, True):
        n = H.shred(pages_df(spark, pages), select=select, scopes=["one", "five"], reopen=again).collect()
        by_page = {}
        for r in n:
            by_page.setdefault(r["page_id"], []).append(r)
        for rows in by_page.values():
            rows.sort(key=lambda r: r["pos"])
            elems = {r["pos"]: r for r in rows if r["is_elem"]}
            assert [r["pos"] for r in rows] == list(range(rows[0]["n_tok"]))

            def above(x):
                out = []
                while x["parent"] is not None:
                    x = elems[x["parent"]]
                    out.append(x)
                return out

            def before(x):
                same = [y for y in elems.values() if y["parent"] == x["parent"] and y["pos"] < x["pos"]]
                return same[-1:]

            for x in rows:
                around = [y for y in elems.values() if y["pos"] < x["pos"] < y["end"]]
                assert [y["pos"] for y in reversed(around)] == [y["pos"] for y in above(x)] and x["level"] == len(around) + 1
                assert all(x["end"] <= y["end"] for y in around)
                if x["is_elem"]:
                    assert (x["prev"] is None) == (not before(x)) and (x["prev"] is None or before(x)[0]["pos"] == x["prev"])
                for name, steps in select.items():
                    assert x[name] == (x["is_elem"] and matches(steps, x, above, before)), (name, x)
                for name in ("one", "five"):
                    assert x[f"in_{name}"] == [y["pos"] for y in around if y[name]]


MARKUP = [  # page, its markup written again
    ("<P CLASS=x Title='a &quot;b&quot; > c'>1 &lt; 2 &amp;amp; 3 &nbsp;'q'<BR>", '<p class="x" title="a &#34;b&#34; &gt; c">1 &lt; 2 &amp;amp; 3 \u00a0&#39;q&#39;<br/></p>'),
    ("<ul><li>a<li disabled>b</ul>", '<ul><li>a</li><li disabled="">b</li></ul>'),
    ("<script>if (a < b && c) x('</p>')</script><style>p > a {}</style>", "<script>if (a < b && c) x('</p>')</script><style>p > a {}</style>"),
    ("<!DOCTYPE html><!-- a < b --><div>x</span></div></div>", "<!DOCTYPE html><!-- a < b --><div>x</div>"),
    ("<b>1<i>2</b>3", "<b>1<i>2</i></b><i>3</i>"), ("<div/>x<img src=a&amp;b>", '<div></div>x<img src="a&amp;b"/>'),
    ("<input value='&lt;a&gt;'><p>&eacute;&#x41;", '<input value="&lt;a&gt;"/><p>éA</p>'),
]


def test_markup_is_written_as_a_serialiser_does(spark):
    n = H.shred(pages_df(spark, [("u", p) for p, _ in MARKUP]), reopen=True)
    got = {r["page_id"]: r["html"] for r in H.page_html(n).collect()}
    for i, (page, want) in enumerate(MARKUP):
        assert got[i] == want, page
    # what is written is read as the same tree and written the same
    again = H.page_html(H.shred(pages_df(spark, [("u", got[i]) for i in range(len(MARKUP))]), reopen=True)).collect()
    assert {r["page_id"]: r["html"] for r in again} == got


def test_inner_markup_of_nested_owners(spark):
    n = H.shred(pages_df(spark, [("u", "<div id=a>x<div id=b>y<p>z</div></div><div></div>")]))
    got = sorted((r["pos"], r["html"]) for r in H.inner_html(n, H.sel(tag="div")).collect())
    assert [h for _, h in got] == ['x<div id="b">y<p>z</p></div>', "y<p>z</p>", ""]
