"""The registered queries: each operator of the inventory run over the test
tables (a test table stands in for the reference's input), with the same
query stated in DuckDB SQL as the oracle.

Every query reads whole tables and whole texts. Limits are the feature where they
stand: the first three terms (O1) and the sections of a group (O2).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dims as D
from ..operators import html as H
from ..operators import links as L
from ..operators import sections as S
from ..operators import segment as G
from ..session import spread
from ..sources import io as IO
from . import oracle as O
from .extract import joined_text, marked_texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_NODES: dict = {}


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The node table of the pages at ``sf`` (shred hash-partitions the pages
    itself). The DataFrame - a lazy plan, nothing materialised - is reused by
    every page query of the session, so its analysis is done once."""
    key = (spark.sparkContext.applicationId, sf)   # another session has another id
    if key not in _NODES:
        _NODES[key] = H.shred(IO.read_pages(spark, f"{sf}/pages.parquet"), keep=["url"])
    return _NODES[key]


NODES = "WITH " + O.nodes_cte()
TOKENS = "WITH " + O.tokens_cte()


# ------------------------------------------------------------------ H1-H21

@register("page_tokens", TOKENS + """
SELECT page_id, pos, kind, tag, tok FROM tk""")
def page_tokens(spark, sf):
    """H1: every page shredded into ordered tokens with kind and tag."""
    t = H.tokens(table(spark, sf, "pages"), cluster=False)
    return t.select("page_id", F.col("pos").cast("long").alias("pos"), "kind", "tag", "tok")


@register("element_extents", NODES + """
SELECT page_id, pos, tag, end_pos, level, parent, parent_tag FROM nodes WHERE is_elem""")
def element_extents(spark, sf):
    """H2 + H3: every element with its end, nesting level and parent."""
    n = nodes(spark, sf).filter("is_elem")
    return n.select("page_id", F.col("pos").cast("long").alias("pos"), "tag",
                    F.col("end").cast("long").alias("end_pos"), F.col("level").cast("long").alias("level"),
                    F.col("parent").cast("long").alias("parent"), "parent_tag")


@register("select_descendant_links", NODES + f"""
SELECT a.page_id, a.pos, {O.attr('a.tok', 'href')} AS href
FROM nodes a WHERE a.is_elem AND a.tag = 'a'
  AND {O.inside('a', "o.tag = 'li' AND " + O.inside('o', "o2.tag = 'nav'", 'o2'))}""")
def select_descendant_links(spark, sf):
    """H5-H8 + L1: ``nav li a`` -> href (descendant selector, no pair join)."""
    x = H.select_path(nodes(spark, sf), H.sel(tag="nav"), H.sel(tag="li"), H.sel(tag="a"))
    return x.select("page_id", F.col("pos").cast("long").alias("pos"), H.attr("href").alias("href"))


_SELECTORS = {"menu_link": [{"tag": "nav"}, {"tag": "li"}, {"tag": "a"}], "item": [{"tag": "ul"}, (">", {"tag": "li"})],
              "lead": [{"tag": "article"}, {"tag": "h1"}, ("+", {"tag": "p"})], "advert": [{"tag": "div", "cls": "ad"}], "article": [{"tag": "article"}]}


@register("selector_pass", NODES + f""",
el AS (SELECT n.*, lag(tag) OVER (PARTITION BY page_id, parent ORDER BY pos) AS prev_tag,
          CAST(lag(pos) OVER (PARTITION BY page_id, parent ORDER BY pos) AS BIGINT) AS prev_pos FROM nodes n WHERE is_elem)
SELECT a.page_id, a.pos, a.tag, a.prev_pos,
  a.tag = 'a' AND {O.inside('a', "o.tag = 'li' AND " + O.inside('o', "o2.tag = 'nav'", 'o2'))} AS menu_link,
  a.tag = 'li' AND coalesce(a.parent_tag = 'ul', false) AS item,
  a.tag = 'p' AND coalesce(a.prev_tag = 'h1', false) AND {O.inside('a', "o.tag = 'article'")} AS lead,
  a.tag = 'div' AND {"list_contains(string_split(trim(regexp_replace(" + O.attr("a.tok", "class") + ", '[\t\n\f\r ]+', ' ', 'g')), ' '), 'ad')"} AS advert,
  (SELECT count(*) FROM nodes o WHERE o.page_id = a.page_id AND o.is_elem AND o.tag = 'article' AND o.pos < a.pos AND a.pos < o.end_pos) AS n_articles,
  (SELECT CAST(max(o.pos) AS BIGINT) FROM nodes o WHERE o.page_id = a.page_id AND o.tag = 'li' AND o.parent_tag = 'ul'
     AND o.is_elem AND o.pos < a.pos AND a.pos < o.end_pos) AS in_item
FROM el a""")
def selector_pass(spark, sf):
    """H2 + H8 + H9: five selectors (inside, child, next sibling, class) marked in the pass that builds the tree, with
    the elements around each node; no sort and no window."""
    n = H.shred(IO.read_pages(spark, f"{sf}/pages.parquet"), select=_SELECTORS, scopes=["item", "article"], cluster=False).filter("is_elem")
    return n.select("page_id", F.col("pos").cast("long").alias("pos"), "tag", F.col("prev").cast("long").alias("prev_pos"), "menu_link", "item", "lead", "advert",
                    F.size("in_article").cast("long").alias("n_articles"), F.get("in_item", F.size("in_item") - 1).cast("long").alias("in_item"))


_CLS_AD = ("list_contains(string_split(trim(regexp_replace(" + O.attr("a.tok", "class")
           + ", '[\\t\\n\\f\\r ]+', ' ', 'g')), ' '), 'ad')")


@register("select_class_div", NODES + ", " + O.text_cte("x", "a.tag = 'div' AND " + _CLS_AD) + f"""
SELECT page_id, pos, {O.clean(O.decode('raw'))} AS text FROM x""")
def select_class_div(spark, sf):
    """H5: ``div.ad`` (class membership) -> cleaned text."""
    t = H.element_text(nodes(spark, sf), H.sel(tag="div", cls="ad"))
    return t.select("page_id", F.col("pos").cast("long").alias("pos"), T.clean("text").alias("text"))


@register("link_attr_text", NODES + ", " + O.text_cte("x", "a.tag = 'a'") + f"""
SELECT n.page_id, n.pos, {O.attr('n.tok', 'href')} AS href, {O.clean(O.decode('x.raw'))} AS label
FROM nodes n JOIN x ON x.page_id = n.page_id AND x.pos = n.pos""")
def link_attr_text(spark, sf):
    """H17 + H20 + T1: every link's href and cleaned label."""
    return L.extract_links(nodes(spark, sf))


@register("page_title_h1", NODES + ", " + O.text_cte("x", "a.tag IN ('title', 'h1')") + f"""
SELECT n.page_id,
       arg_min({O.clean(O.decode('x.raw'))}, n.pos) FILTER (WHERE n.tag = 'title') AS title,
       arg_min({O.clean(O.decode('x.raw'))}, n.pos) FILTER (WHERE n.tag = 'h1') AS h1
FROM nodes n JOIN x ON x.page_id = n.page_id AND x.pos = n.pos GROUP BY n.page_id""")
def page_title_h1(spark, sf):
    """H3 + H12 + T13: first title and first h1 of each page."""
    t = H.element_text(nodes(spark, sf), H.sel(tag="title") | H.sel(tag="h1"))
    t = t.withColumn("text", T.clean("text"))
    first = lambda tg: F.min_by(F.when(F.col("tag") == tg, F.col("text")),
                                F.when(F.col("tag") == tg, F.col("pos")))
    return t.groupBy("page_id").agg(first("title").alias("title"), first("h1").alias("h1"))


@register("sibling_next_prev", NODES + """,
s AS (SELECT page_id, pos, tag, lead(tag) OVER w AS next_tag, lag(tag) OVER w AS prev_tag,
             lead(pos) OVER w AS next_pos, lead(tag, 2) OVER w AS next2_tag
      FROM nodes WHERE is_elem WINDOW w AS (PARTITION BY page_id, parent ORDER BY pos))
SELECT page_id, pos, next_tag, prev_tag, next_pos, next2_tag FROM s WHERE tag = 'h1'""")
def sibling_next_prev(spark, sf):
    """H9 + H10 + W5: next / previous / second-next sibling of each h1."""
    e = nodes(spark, sf).filter("is_elem")
    w = Window.partitionBy("page_id", "parent").orderBy("pos")
    s = (H.siblings(e).withColumn("next2_tag", F.lead("tag", 2).over(w)))
    return s.filter("tag = 'h1'").select(
        "page_id", F.col("pos").cast("long").alias("pos"), "next_tag", "prev_tag",
        F.col("next_pos").cast("long").alias("next_pos"), "next2_tag")


@register("first_last_match", NODES + ", " + O.text_cte("x", "a.tag = 'p'") + f""",
y AS (SELECT page_id, pos, {O.clean(O.decode('raw'))} AS text FROM x)
SELECT page_id, arg_min(text, pos) AS first_p, arg_max(text, pos) AS last_p, count(*) AS n_p
FROM y GROUP BY page_id""")
def first_last_match(spark, sf):
    """H12 + H15 + H16: first and last paragraph text per page."""
    t = H.element_text(nodes(spark, sf), H.sel(tag="p")).withColumn("text", T.clean("text"))
    return t.groupBy("page_id").agg(F.min_by("text", "pos").alias("first_p"),
                                    F.max_by("text", "pos").alias("last_p"),
                                    F.count("*").alias("n_p"))


@register("nth_element_pivot", NODES + ", " + O.text_cte("x", "a.tag = 'li'") + f""",
y AS (SELECT n.page_id, n.parent, n.pos, {O.clean(O.decode('x.raw'))} AS text,
             row_number() OVER (PARTITION BY n.page_id, n.parent ORDER BY n.pos) - 2 AS i
      FROM nodes n JOIN x ON x.page_id = n.page_id AND x.pos = n.pos)
SELECT page_id, parent AS list_pos, max(text) FILTER (WHERE i = 0) AS c1,
       max(text) FILTER (WHERE i = 1) AS c2, max(text) FILTER (WHERE i = 2) AS c3
FROM y WHERE i >= 0 GROUP BY page_id, parent""")
def nth_element_pivot(spark, sf):
    """H13 + H14: list items of each list -> columns, first item skipped."""
    t = H.element_text(nodes(spark, sf), H.sel(tag="li")).withColumn("text", T.clean("text"))
    p = H.nth_cells(t, "parent", ["c1", "c2", "c3"], "text", skip_first=1)
    return p.select("page_id", F.col("parent").cast("long").alias("list_pos"), "c1", "c2", "c3")


@register("parent_element", NODES + f""",
y AS (SELECT page_id, parent, max(parent_tag) AS tag, string_agg(tok, '' ORDER BY pos) AS raw
      FROM nodes WHERE kind = 'text' AND parent IS NOT NULL GROUP BY page_id, parent)
SELECT page_id, parent AS pos, tag, {O.clean(O.decode('raw'))} AS own_text FROM y""")
def parent_element(spark, sf):
    """H11 + H19: each element's own text (text children only) and tag."""
    o = H.own_text(nodes(spark, sf))
    return o.select("page_id", F.col("pos").cast("long").alias("pos"), "tag",
                    T.clean("own_text").alias("own_text"))


@register("inner_markup", NODES + ", " + O.markup_ctes("a.tag IN ('article', 'p', 'nav')") + """
SELECT page_id, pos, raw AS html, len(string_split(raw, '<br/>')) AS n_parts FROM x""")
def inner_markup(spark, sf):
    """H18 + T10: inner markup of articles, menus and the paragraphs inside them, as a serialiser writes it, and the
    number of pieces split on ``<br/>``."""
    m = H.inner_html(nodes(spark, sf), H.sel(tag="article") | H.sel(tag="p") | H.sel(tag="nav"))
    return m.select("page_id", F.col("pos").cast("long").alias("pos"), "html",
                    F.size(T.split_literal("html", "<br/>")).cast("long").alias("n_parts"))


# ------------------------------------------------------------------ T1-T19

@register("clean_text", f"""SELECT page_id, {O.clean('html')} AS text FROM pages""")
def clean_text(spark, sf):
    """T1 (T2, T3, T4) over whole pages."""
    return table(spark, sf, "pages").select("page_id", T.clean("html").alias("text"))


@register("non_ascii_strip", """
SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g') AS ascii_space,
       CAST(length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS BIGINT) AS ascii_len
FROM documents""")
def non_ascii_strip(spark, sf):
    """T5: non-ASCII characters -> space, and -> "" (length)."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.non_ascii("text", " ").alias("ascii_space"),
                    F.length(T.non_ascii("text", "")).cast("long").alias("ascii_len"))


@register("strip_prefix_suffix", """
SELECT doc_id,
       regexp_replace(text, '[\\t\\n\\f\\r ]*\\([^\\n]*\\z', '') AS no_paren,
       CASE WHEN starts_with(text, 'The ') THEN substr(text, 5) ELSE text END AS no_prefix,
       CASE WHEN ends_with(text, '.') THEN left(text, length(text) - 1) ELSE text END AS no_suffix,
       CASE WHEN strpos(text, ' the ') = 0 THEN text
            ELSE left(text, strpos(text, ' the ') - 1) || substr(text, strpos(text, ' the ') + 5) END AS no_first_the,
       """ + O.utrim("replace(text, chr(10), ' ')") + """ AS one_line
FROM documents""")
def strip_prefix_suffix(spark, sf):
    """Trailing parenthetical, prefix/suffix once, first literal."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.strip_trailing_paren("text").alias("no_paren"),
                    T.trim_prefix("text", "The ").alias("no_prefix"),
                    T.trim_suffix("text", ".").alias("no_suffix"),
                    T.remove_first("text", " the ").alias("no_first_the"),
                    T.newline_to_space("text").alias("one_line"))


@register("regex_first_group", """
SELECT doc_id,
       regexp_extract(text, '([A-Z][a-z]+)', 1) AS first_cap,
       regexp_extract(text, '([0-9]+)', 1) AS first_number,
       regexp_extract(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,})', 1) AS email,
       CAST(len(regexp_extract_all(text, '([0-9]+)', 1)) AS BIGINT) AS n_numbers
FROM documents""")
def regex_first_group(spark, sf):
    """T13 + T14: first match groups and all matches."""
    d = table(spark, sf, "documents")
    d = d.withColumn("numbers", F.regexp_extract_all("text", F.lit(r"([0-9]+)"), 1))   # read twice below
    return d.select("doc_id",
                    F.regexp_extract("text", r"([A-Z][a-z]+)", 1).alias("first_cap"),
                    F.coalesce(F.get("numbers", F.lit(0)), F.when(F.col("text").isNotNull(), "")).alias("first_number"),
                    F.regexp_extract("text", r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})", 1).alias("email"),
                    F.size("numbers").cast("long").alias("n_numbers"))


_EMAIL = r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"
_PHONE = r"(\+[0-9] \([0-9]{3}\) [0-9]{3}-[0-9]{4})"
_LICENSE = r"(licensed under [^,.]+)"


@register("fallback_chain", f"""
SELECT doc_id, coalesce(nullif(regexp_extract(text, '{_EMAIL}', 1), ''),
                        nullif(regexp_extract(text, '{_PHONE}', 1), ''),
                        nullif(regexp_extract(text, '{_LICENSE}', 1), ''), '') AS contact
FROM documents""")
def fallback_chain(spark, sf):
    """Next rule only when the previous one gave ""."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.first_nonempty(F.regexp_extract("text", _EMAIL, 1),
                                               F.regexp_extract("text", _PHONE, 1),
                                               F.regexp_extract("text", _LICENSE, 1)).alias("contact"))


# Document line rules used by the cascade / segmentation queries.
HEADING = r"^[A-Z][^ .|]*\.\z"
LICENSE_LINE = r"(?i)(rights reserved|licen[cs]e|copyright)"


def _doc_lines(spark, sf):
    # lines() hash-clusters the documents by id itself: no spread first
    return G.lines(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")


_SQL_LINES = """WITH ls AS (SELECT doc_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS BIGINT) AS line_no,
                   unnest(string_split(text, chr(10))) AS line FROM documents)"""


@register("rule_cascade", _SQL_LINES + f""",
c AS (SELECT doc_id, line_no, line,
             CASE WHEN regexp_matches(line, '{LICENSE_LINE}') THEN 'license'
                  WHEN strpos(line, '|') > 0 THEN 'table'
                  WHEN regexp_matches(line, '{HEADING}') THEN 'heading' ELSE 'text' END AS kind FROM ls)
SELECT doc_id,
       coalesce(string_agg(line, ' ' ORDER BY line_no) FILTER (WHERE kind = 'text'), '') AS text,
       arg_max(line, line_no) FILTER (WHERE kind = 'license') AS license,
       arg_min(line, line_no) FILTER (WHERE kind = 'heading') AS heading,
       count(*) FILTER (WHERE kind = 'table') AS n_table
FROM c GROUP BY doc_id""")
def rule_cascade(spark, sf):
    """T17 + A5: lines classified by the first matching rule, folded into
    fields (text joined, last license wins, first heading wins)."""
    ls = _doc_lines(spark, sf)
    k = T.cascade("line", [("license", LICENSE_LINE, 0), ("table", r"\|", 0), ("heading", HEADING, 0)])
    c = ls.withColumn("kind", k.kind).withColumn("value", F.col("line"))
    out = G.collect_fields(c, ["doc_id"], "line_no", last_wins=["license"], first_wins=["heading"], counted={"table": "n_table"})
    return out.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), "license", "heading", "n_table")


@register("segment_lines", _SQL_LINES + f""",
b AS (SELECT *, sum(CASE WHEN regexp_matches(line, '{HEADING}') THEN 1 ELSE 0 END)
                  OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS blk FROM ls)
SELECT doc_id, CAST(blk AS BIGINT) AS blk, min(line_no) AS start_line, count(*) AS n_lines,
       string_agg(line, chr(10) ORDER BY line_no) AS text
FROM b GROUP BY doc_id, blk""")
def segment_lines(spark, sf):
    """S5 + W1: a heading line starts a block; preamble lines form block 0."""
    b = G.segment(_doc_lines(spark, sf), "doc_id", F.col("line").rlike(HEADING))
    return b.select("doc_id", F.col("blk").cast("long").alias("blk"),
                    F.col("start_line").cast("long").alias("start_line"), "n_lines", "text")


@register("asof_heading", _SQL_LINES + f""",
h AS (SELECT *, CASE WHEN regexp_matches(line, '{HEADING}') THEN line END AS hd FROM ls),
a AS (SELECT *, last_value(hd IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS asof_h,
             last_value(hd IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no
                 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_hd,
             first_value(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS first_line FROM h)
SELECT doc_id, line_no, coalesce(asof_h, last_hd, first_line) AS heading
FROM a WHERE hd IS NULL AND line <> ''""")
def asof_heading(spark, sf):
    """W3 + J4 + Q2: each body line gets the last heading before it; lines
    before the first heading get the document's last heading, and with no
    heading at all the first line (the page-title fallback)."""
    ls = _doc_lines(spark, sf).withColumn("hd", F.when(F.col("line").rlike(HEADING), F.col("line")))
    a = G.last_before(ls, ["doc_id"], ["line_no"], "hd", "asof")
    whole = Window.partitionBy("doc_id")   # one aggregate a document, not a frame a row
    a = (a.withColumn("last_hd", F.max_by("hd", F.when(F.col("hd").isNotNull(), F.col("line_no"))).over(whole))
          .withColumn("first_line", F.min_by("line", "line_no").over(whole)))
    return a.filter(F.col("hd").isNull() & (F.col("line") != "")).select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"),
        F.coalesce("asof", "last_hd", "first_line").alias("heading"))


# ------------------------------------------------------------------ L1-L11

@register("url_parts", """
SELECT page_id, regexp_replace(url, '#.*', '') AS no_frag,
       url_decode(replace(regexp_extract(url, '[?&]page=([^&#]*)', 1), '+', ' ')) AS page_param,
       url_decode(replace(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '+', ' ')) AS utm,
       regexp_replace(url, '^(.*?)\\.html', '\\1/courses.html') AS rewritten,
       lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host,
       'https://catalogue.example.org' || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS mirrored
FROM pages""")
def url_parts(spark, sf):
    """L2 + L4 + L5 + L6 on page URLs."""
    p = table(spark, sf, "pages")
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return p.select("page_id", L.drop_fragment("url").alias("no_frag"),
                    L.query_param("url", "page").alias("page_param"),
                    L.query_param("url", "utm_source").alias("utm"),
                    L.rewrite_first("url", r"\.html", "/courses.html").alias("rewritten"),
                    L.host("url").alias("host"),
                    L.prefix_url("https://catalogue.example.org", path).alias("mirrored"))


_SQL_LINKS = NODES + ", " + O.text_cte("x", "a.tag = 'a'") + f""",
lk AS (SELECT n.page_id, n.pos, {O.attr('n.tok', 'href')} AS href, {O.clean(O.decode('x.raw'))} AS label
       FROM nodes n JOIN x ON x.page_id = n.page_id AND x.pos = n.pos),
la AS (SELECT lk.*, p.url AS page_url, lower(regexp_extract(p.url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host,
              CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
                   WHEN starts_with(href, '//') THEN regexp_extract(p.url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) || ':' || href
                   WHEN starts_with(href, '/') THEN regexp_extract(p.url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href
                   WHEN href = '' THEN regexp_extract(p.url, '^([^#]*)', 1)
                   WHEN starts_with(href, '?') THEN regexp_extract(p.url, '^([^?#]*)', 1) || href
                   WHEN starts_with(href, '#') THEN regexp_extract(p.url, '^([^#]*)', 1) || href
                   ELSE regexp_extract(p.url, '^([^?#]*/)', 1) || href END AS url
       FROM lk JOIN pages p ON p.page_id = lk.page_id)"""


def _abs_links(spark, sf):
    la = L.extract_links(nodes(spark, sf), keep=["url"]).withColumnRenamed("url", "page_url")
    return la.withColumn("host", L.host("page_url")).withColumn("url", L.resolve_url("page_url", "href"))


@register("links_dedup_page", _SQL_LINKS + """
SELECT page_id, href, min(pos) AS pos, arg_min(label, pos) AS label, count(*) AS n_seen
FROM lk GROUP BY page_id, href""")
def links_dedup_page(spark, sf):
    """First occurrence of each href within a page."""
    lk = L.extract_links(nodes(spark, sf))
    return L.dedup_links_in_page(lk).select("page_id", "href", "pos", "label", "n_seen")


@register("links_dedup_global", _SQL_LINKS + """
SELECT host, url, arg_min(page_id, (page_id, pos)) AS page_id, arg_min(pos, (page_id, pos)) AS pos,
       count(*) AS n_seen
FROM la GROUP BY host, url""")
def links_dedup_global(spark, sf):
    """L2/L3 + L8: resolved link URLs, first occurrence per site."""
    la = _abs_links(spark, sf).select("host", "url", "page_id", "pos")
    return L.dedup_links_global(la, ["host", "url"], ["page_id", "pos"])


# The next level's targets: links, and each page's own address without its query
# (which is a landed page where the address had none).
_SQL_TARGETS = _SQL_LINKS + """,
d AS (SELECT regexp_replace(url, '#.*', '') AS url FROM la UNION SELECT regexp_replace(url, '[?#].*', '') FROM pages),
landed AS (SELECT DISTINCT regexp_replace(url, '#.*', '') AS url FROM pages)"""


def _targets(spark, sf):
    pages = table(spark, sf, "pages")
    la = _abs_links(spark, sf).select(L.drop_fragment("url").alias("url"))
    own = pages.select(F.regexp_replace("url", r"[?#].*", "").alias("url"))
    return la.union(own).distinct(), pages.select(L.drop_fragment("url").alias("url"))


@register("frontier_anti", _SQL_TARGETS + """
SELECT url, CASE WHEN url IN (SELECT url FROM landed) THEN 'landed' ELSE 'to_land' END AS status FROM d""")
def frontier_anti(spark, sf):
    """L11 + J6: link targets marked landed or still to land against the
    pages table (one left join with a flag, a single pass over the links)."""
    f = L.frontier(*_targets(spark, sf))
    return f.select("url", F.when(F.col("landed"), "landed").otherwise("to_land").alias("status"))


@register("frontier_to_land", _SQL_TARGETS + """
SELECT url FROM d WHERE url NOT IN (SELECT url FROM landed)""")
def frontier_to_land(spark, sf):
    """The link targets that aren't landed (anti join)."""
    return L.to_land(*_targets(spark, sf)).select("url")


@register("resolve_references", """
WITH p AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS o,
                  string_split(regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1), '/') AS seg FROM pages),
d AS (SELECT *, seg[1:-2] AS dir FROM p),
r AS (SELECT *, unnest(['x.html', './x', '../x?q=1', '../../../x/./y/../z', '/r/../s#f', '//h.example/p', '?a=b', '#t', '', 'mailto:a@b', '..']) AS href FROM d),
up AS (SELECT *, dir[1:greatest(len(dir) - 1, 1)] AS dir1, dir[1:greatest(len(dir) - 3, 1)] AS dir3 FROM r)
SELECT page_id, href, CASE href
  WHEN 'x.html' THEN o || array_to_string(list_append(dir, 'x.html'), '/')
  WHEN './x' THEN o || array_to_string(list_append(dir, 'x'), '/')
  WHEN '../x?q=1' THEN o || array_to_string(list_append(dir1, 'x'), '/') || '?q=1'
  WHEN '../../../x/./y/../z' THEN o || array_to_string(list_concat(dir3, ['x', 'z']), '/')
  WHEN '/r/../s#f' THEN o || '/s#f' WHEN '//h.example/p' THEN scheme || '://h.example/p'
  WHEN '?a=b' THEN split_part(split_part(url, '#', 1), '?', 1) || '?a=b' WHEN '#t' THEN split_part(url, '#', 1) || '#t'
  WHEN '' THEN split_part(url, '#', 1) WHEN 'mailto:a@b' THEN href
  ELSE o || array_to_string(dir1, '/') || '/' END AS resolved
FROM up""")
def resolve_references(spark, sf):
    """L3: references of every form against each page's URL, dot segments removed."""
    refs = ["x.html", "./x", "../x?q=1", "../../../x/./y/../z", "/r/../s#f", "//h.example/p", "?a=b", "#t", "", "mailto:a@b", ".."]
    p = table(spark, sf, "pages").select("page_id", "url", F.explode(F.array(*map(F.lit, refs))).alias("href"))
    return p.select("page_id", "href", L.resolve_url("url", "href").alias("resolved"))


@register("page_range_expand", """
WITH p AS (SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS base,
                  TRY_CAST(regexp_extract(url, '.*page=([0-9]+)', 1) AS INTEGER) AS last_page FROM pages)
SELECT page_id, CAST(g AS INTEGER) AS page_no, base || '?page=' || CAST(g AS VARCHAR) AS req_url
FROM p, range(1, last_page + 1) r(g) WHERE last_page >= 1""")
def page_range_expand(spark, sf):
    """L9 + L10 + X4: last page number -> one request URL per page."""
    p = table(spark, sf, "pages").select(
        "page_id", F.regexp_extract("url", r"^([^?#]*)", 1).alias("base"),
        L.last_page_number("url").alias("last_page"))
    e = L.expand_pages(p, "last_page")
    return e.select("page_id", "page_no", L.template_url("%s?page=%d", "base", "page_no").alias("req_url"))


@register("split_numbers", """
SELECT page_id, CAST(i - 1 AS BIGINT) AS idx, nums[i] AS number
FROM (SELECT page_id, regexp_extract_all(url, '([0-9]+)', 1) AS nums FROM pages), range(1, len(nums) + 1) r(i)""")
def split_numbers(spark, sf):
    """T14 + X1: one row per digit run of the page URL."""
    p = table(spark, sf, "pages").select("page_id", "url")
    return G.explode_numbers(p, "url").select("page_id", F.col("idx").cast("long").alias("idx"), "number")


@register("split_if_slash", """
WITH p AS (SELECT page_id, regexp_extract(url, '/([0-9]+(?:/[0-9]+)?)(?:[/?#.]|$)', 1) AS num FROM pages)
SELECT page_id, n AS number FROM p,
  unnest(CASE WHEN strpos(num, '/') > 0 THEN regexp_extract_all(num, '([0-9]+)', 1) ELSE [num] END) u(n)""")
def split_if_slash(spark, sf):
    """A ``301/302`` number becomes two rows, any other stays one."""
    p = table(spark, sf, "pages").select(
        "page_id", F.regexp_extract("url", r"/([0-9]+(?:/[0-9]+)?)(?:[/?#.]|$)", 1).alias("num"))
    return G.explode_if_slash(p, "num").select("page_id", "number")


# ------------------------------------------------------------ A1-A8, D1, J1

@register("dedup_key5", """
SELECT min(doc_id) AS doc_id, lang, source, CAST(length(text) AS BIGINT) AS n_chars, count(*) AS n_copies
FROM documents GROUP BY lang, source, text""")
def dedup_key5(spark, sf):
    """Keyed dedup, first (lowest id) kept, copies counted."""
    d = table(spark, sf, "documents").select("lang", "source", "text", "doc_id", F.length("text").cast("long").alias("n_chars"))
    return D.first_per_key(d, ["lang", "source", "text"], ["doc_id"], keep=["doc_id", "lang", "source", "n_chars"])


_SQL_SUBJ = """WITH c AS (SELECT doc_id AS ord, source AS SubjectName, lang AS courseCode,
                  text AS SubjectDescription FROM documents),
h AS (SELECT SubjectName, min(ord) AS first, arg_min(SubjectDescription, ord) AS description FROM c GROUP BY SubjectName),
cc AS (SELECT SubjectName, courseCode, min(ord) AS o FROM c GROUP BY SubjectName, courseCode),
cl AS (SELECT SubjectName, string_agg(courseCode, ',' ORDER BY o) AS codes FROM cc GROUP BY SubjectName),
dim AS (SELECT CAST(row_number() OVER (ORDER BY first) - 1 AS BIGINT) AS subjectId, h.SubjectName AS name,
               cl.codes, h.description FROM h JOIN cl USING (SubjectName))"""


def _courses_from_documents(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("ord"), F.col("source").alias("SubjectName"),
                    F.col("lang").alias("courseCode"), F.col("text").alias("SubjectDescription"))


@register("subject_dim", _SQL_SUBJ + """
SELECT subjectId, name, codes, description FROM dim""")
def subject_dim(spark, sf):
    """A1 + A2 + A3: subject dimension (first description, ordered distinct
    codes, dense id by first appearance from 0)."""
    d = D.subject_dim(_courses_from_documents(spark, sf))
    return d.select("subjectId", "name", F.array_join("codes", ",").alias("codes"), "description")


@register("ordered_codes", """
WITH f AS (SELECT source, lang, min(doc_id) AS o FROM documents GROUP BY source, lang)
SELECT source, string_agg(lang, ',' ORDER BY o) AS codes FROM f GROUP BY source""")
def ordered_codes(spark, sf):
    """A2: the distinct codes of each subject in first-seen order."""
    d = D.ordered_distinct(table(spark, sf, "documents"), ["source"], "lang", "doc_id", "codes")
    return d.select("source", F.array_join("codes", ",").alias("codes"))


@register("course_with_subject_id", _SQL_SUBJ + """
SELECT c.ord AS doc_id, d.subjectId FROM c JOIN dim d ON d.name = c.SubjectName""")
def course_with_subject_id(spark, sf):
    """Every course row gets its subject's id."""
    c = _courses_from_documents(spark, sf)
    d = D.subject_dim(c).withColumnRenamed("name", "SubjectName")
    return D.attach_ids(c, d, ["SubjectName"], "subjectId").select(F.col("ord").alias("doc_id"), "subjectId")


_SQL_TERMS = """WITH e AS (SELECT strftime(ts, '%Y%m%d') AS TermCode, event_type AS SubjectCode, ts FROM events),
t AS (SELECT TermCode, min(ts) AS f, count(*) AS n FROM e GROUP BY TermCode),
ti AS (SELECT TermCode, CAST(row_number() OVER (ORDER BY f, TermCode) AS BIGINT) AS TermID, n FROM t)"""


def _terms_from_events(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.date_format("ts", "yyyyMMdd").alias("TermCode"),
                    F.col("event_type").alias("SubjectCode"), "ts")


@register("term_subject_dim", _SQL_TERMS + """,
s AS (SELECT TermCode, SubjectCode, min(ts) AS f, count(*) AS n FROM e GROUP BY TermCode, SubjectCode)
SELECT s.TermCode AS term_code, ti.TermID AS term_id, s.SubjectCode AS subject_code,
       CAST(row_number() OVER (ORDER BY s.f, s.TermCode, s.SubjectCode) AS BIGINT) AS subject_id, s.n AS n_events
FROM s JOIN ti USING (TermCode)""")
def term_subject_dim(spark, sf):
    """A6 + A7 + A3: term dimension (ids from 1 by first appearance) and the
    subject dimension keyed by (term, subject code), ids from 1 by first
    appearance over all terms (one counter, as the reference keeps)."""
    e = _terms_from_events(spark, sf)
    t = e.groupBy("TermCode").agg(F.min("ts").alias("f"))
    t = D.dense_ids(t, ["f", "TermCode"], name="term_id", base=1)
    s = e.groupBy("TermCode", "SubjectCode").agg(F.min("ts").alias("f"), F.count("*").alias("n_events"))
    s = D.dense_ids(s, ["f", "TermCode", "SubjectCode"], name="subject_id", base=1)
    return s.join(t.select("TermCode", "term_id"), "TermCode").select(
        F.col("TermCode").alias("term_code"), "term_id", F.col("SubjectCode").alias("subject_code"),
        "subject_id", "n_events")


@register("first_three_terms", """
WITH t AS (SELECT strftime(ts, '%Y%m%d%H') AS term_code, min(ts) AS f, count(*) FILTER (WHERE event_type = 'error') AS n_errors
           FROM events GROUP BY 1)
SELECT term_code, n_errors FROM t WHERE n_errors > 0 ORDER BY f, term_code LIMIT 3""")
def first_three_terms(spark, sf):
    """O1 + F7: the first three terms (hours) in source order that aren't empty (hold
    an error event); the limit is the feature."""
    e = table(spark, sf, "events").select(F.date_format("ts", "yyyyMMddHH").alias("term_code"), "event_type", "ts")
    t = e.groupBy("term_code").agg(F.min("ts").alias("f"), F.count_if(F.col("event_type") == "error").alias("n_errors"))
    return S.first_terms(t.filter("n_errors > 0"), ["f", "term_code"]).select("term_code", "n_errors")


@register("section_cap", """
SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
  l_shipdate, l_quantity) AS rn FROM lineitem) WHERE rn <= 2""")
def section_cap(spark, sf):
    """O2: at most two sections of a group, in order (the cap is the feature)."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey", "l_shipdate")
    return S.cap_per_group(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity"], 2).select(
        "l_orderkey", "l_linenumber", "l_quantity")


@register("ordered_join_two_level", """
WITH r AS (SELECT conv_id, turn, concat_ws(' ', role, text) AS row FROM conversations)
SELECT conv_id, count(*) AS n_turns, string_agg(row, ';' ORDER BY turn) AS joined FROM r GROUP BY conv_id""")
def ordered_join_two_level(spark, sf):
    """A4: cells joined by " " per row, rows by ";" in order (the leading
    ";" of the reference's loop trimmed once)."""
    c = table(spark, sf, "conversations")
    return S.two_level_join(c, ["conv_id"], "turn", ["role", "text"]).select("conv_id", "n_turns", "joined")


@register("section_enrollment_struct", """
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS enrolled_actual, 50 AS enrolled_max,
       50 - CAST(l_quantity AS INTEGER) AS enrolled_available, l_linenumber AS waitlist_actual,
       7 AS waitlist_max, 7 - l_linenumber AS waitlist_available
FROM lineitem""")
def section_enrollment_struct(spark, sf):
    """Enrollment struct with Available = Max - Actual (flattened for
    the comparison)."""
    li = table(spark, sf, "lineitem")
    e = S.enrollment(li, F.col("l_quantity").cast("int"), F.lit(50), F.col("l_linenumber"), F.lit(7))
    return e.select("l_orderkey", "l_linenumber",
                    F.col("Enrollment.Enrolled.Actual").alias("enrolled_actual"),
                    F.col("Enrollment.Enrolled.Max").alias("enrolled_max"),
                    F.col("Enrollment.Enrolled.Available").alias("enrolled_available"),
                    F.col("Enrollment.Waitlist.Actual").alias("waitlist_actual"),
                    F.col("Enrollment.Waitlist.Max").alias("waitlist_max"),
                    F.col("Enrollment.Waitlist.Available").alias("waitlist_available"))


@register("section_enrich", """
SELECT l.l_orderkey, l.l_linenumber, o.o_orderpriority AS description, c.c_mktsegment AS prerequisite
FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey
LEFT JOIN customer c ON c.c_custkey = o.o_custkey""")
def section_enrich(spark, sf):
    """Sections enriched 1:1 with description and prerequisite."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey",
                                         F.col("o_orderpriority").alias("description"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"),
                                           F.col("c_mktsegment").alias("prerequisite"))
    return S.enrich(li, [(o, ["l_orderkey"]), (c, ["o_custkey"])]).select(
        "l_orderkey", "l_linenumber", "description", "prerequisite")


@register("json_payload", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")
def json_payload(spark, sf):
    """S3 + X3: typed nested JSON payload parsed with a fixed schema."""
    e = table(spark, sf, "events")
    return IO.parse_json_column(e, "props", "k int").select("event_id", "k")


@register("nonempty_filter", """
SELECT doc_id, CASE WHEN strpos(text, 'GNU') > 0 THEN 'GNU' ELSE '' END AS note
FROM documents WHERE text <> '' AND regexp_extract(text, '([A-Za-z]+) License', 1) <> '' AND lang <> '' AND regexp_matches(text, '^[A-Z]')
  AND strpos(lower(text), 'all rights reserved') = 0""")
def nonempty_filter(spark, sf):
    """F1-F4 + F6: non-empty text, a licence code present, header pattern, texts with
    a stop phrase dropped, note kept only with its phrase."""
    d = table(spark, sf, "documents").withColumn("code", F.regexp_extract("text", r"([A-Za-z]+) License", 1))
    f = d.filter((F.col("text") != "") & (F.col("code") != "") & (F.col("lang") != "")
                 & F.col("text").rlike("^[A-Z]") & ~F.lower("text").contains("all rights reserved"))
    return f.select("doc_id", F.when(F.col("text").contains("GNU"), "GNU").otherwise("").alias("note"))


@register("union_sources", """
WITH u AS (SELECT 'document' AS kind, source FROM documents
           UNION ALL SELECT 'page', lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) FROM pages)
SELECT kind, source, count(*) AS n_rows FROM u GROUP BY kind, source""")
def union_sources(spark, sf):
    """O3 + A8: rows of several sources appended by name, counted per source."""
    d = table(spark, sf, "documents").select(F.lit("document").alias("kind"), "source", "doc_id")
    p = table(spark, sf, "pages").select(F.lit("page").alias("kind"), L.host("url").alias("source"), "page_id")
    u = d.unionByName(p, allowMissingColumns=True)
    return D.stage_counts(u, "kind", "source")


@register("csv_json_roundtrip", """
SELECT doc_id, lang, source, n_chars, nullif(text, '') AS json_text, text AS csv_text, ' "' || lang || '", ' AS csv_odd FROM documents""")
def csv_json_roundtrip(spark, sf):
    """K6 + K8 + S2: whole texts written as JSON lines (empty strings omitted) and
    CSV (quotes, line breaks and outer white space kept), then read back with an
    explicit schema; the values of both are returned."""
    d = table(spark, sf, "documents").select(
        "doc_id", "lang", "source", "n_chars", "text", F.concat(F.lit(' "'), "lang", F.lit('", ')).alias("odd"))
    out = IO.scratch_path(spark, "roundtrip")
    IO.write_json(d, f"{out}/json", omit_empty=True)
    IO.write_csv(d, f"{out}/csv")
    schema = "doc_id long, lang string, source string, n_chars long, text string, odd string"
    back = IO.read_json_records(spark, f"{out}/json", schema)
    csv = IO.read_csv(spark, f"{out}/csv", schema)
    return back.select("doc_id", "lang", "source", "n_chars", F.col("text").alias("json_text")).join(
        csv.select("doc_id", F.col("text").alias("csv_text"), F.col("odd").alias("csv_odd")), "doc_id")


# ------------------------------------------------------- more of H and T

@register("attr_selectors", NODES + f"""
SELECT page_id, pos, tag, CASE WHEN tag = 'a' THEN {O.attr('tok', 'href')} ELSE {O.attr('tok', 'class')} END AS value
FROM nodes WHERE is_elem AND (
  (tag = 'a' AND {O.has_attr('tok', 'href')} AND starts_with({O.attr('tok', 'href')}, '/th'))
  OR (tag = 'div' AND {O.has_attr('tok', 'class')} AND {O.attr('tok', 'class')} = 'ad'))""")
def attr_selectors(spark, sf):
    """H6 + H7: ``a[href^="/th"]`` and ``div[class="ad"]``."""
    n = nodes(spark, sf)
    a = H.sel(tag="a", attr_prefix={"href": "/th"})
    d = H.sel(tag="div", attr_eq={"class": "ad"})
    x = n.filter(a | d)
    return x.select("page_id", F.col("pos").cast("long").alias("pos"), "tag",
                    F.when(F.col("tag") == "a", H.attr("href")).otherwise(H.attr("class")).alias("value"))


@register("page_attributes", TOKENS + f"""
, a AS (SELECT page_id, pos, unnest({O.attrs(O.START)}) AS x FROM tk WHERE kind IN ('open', 'raw'))
SELECT page_id, pos, x.name AS name, {O.decode("coalesce(x.value, '')")} AS value FROM a""")
def page_attributes(spark, sf):
    """Every attribute of every tag, decoded."""
    t = H.tokens(table(spark, sf, "pages")).filter(F.col("kind").isin("open", "raw"))
    # the start tag only: a raw token holds its content too
    a = t.select("page_id", F.col("pos").cast("long").alias("pos"), F.explode(H.all_attrs(F.regexp_extract("tok", H.START_TAG, 0))).alias("x"))
    return a.select("page_id", "pos", "x.name", "x.value")


@register("heading_container_next", NODES + ", " + O.text_cte("h", "a.tag = 'h1'") + ", "
          + O.text_cte("nx", "true") + f""",
own AS (SELECT c.page_id, c.pos AS cpos, n.pos AS hpos, {O.decode('h.raw')} AS htext
        FROM nodes c JOIN nodes n ON n.page_id = c.page_id AND n.pos > c.pos AND n.pos < c.end_pos
        JOIN h ON h.page_id = n.page_id AND h.pos = n.pos
        WHERE c.is_elem AND c.tag = 'article' AND n.is_elem AND n.tag = 'h1'),
hit AS (SELECT page_id, cpos FROM own GROUP BY page_id, cpos
        HAVING strpos(string_agg(htext, '' ORDER BY hpos), 'The') > 0),
sib AS (SELECT page_id, pos, lead(pos) OVER (PARTITION BY page_id, parent ORDER BY pos) AS next_pos
        FROM nodes WHERE is_elem),
nt AS (SELECT o.page_id, o.cpos, o.hpos, {O.decode('nx.raw')} AS t
       FROM own o JOIN hit USING (page_id, cpos) JOIN sib s ON s.page_id = o.page_id AND s.pos = o.hpos
       JOIN nx ON nx.page_id = s.page_id AND nx.pos = s.next_pos)
SELECT page_id, cpos AS pos, {O.clean("string_agg(t, '' ORDER BY hpos)")} AS next_text
FROM nt GROUP BY page_id, cpos""")
def heading_container_next(spark, sf):
    """Containers (``article``) whose headings (``h1``) contain a word
    -> text of the element after each such heading (the "Overview" rule)."""
    h1 = [{"tag": "article"}, {"tag": "h1"}]
    n = H.shred(IO.read_pages(spark, f"{sf}/pages.parquet"), select={"box": h1[:1], "h": h1, "after": [*h1, ("+", {})]}, scopes=["box", "h", "after"], cluster=False)
    t = marked_texts(n, ["h", "after"], boxes=F.col("in_box"), end=F.col("end")).filter("end > pos")
    g = t.select("page_id", "field", "pos", "text", F.explode("boxes").alias("owner")).groupBy("page_id", "owner").agg(
        joined_text("h", name="_t"), joined_text("after", name="_n"))
    g = g.filter(F.col("_t").contains("The") & F.col("_n").isNotNull())
    return g.select("page_id", F.col("owner").cast("long").alias("pos"), T.clean("_n").alias("next_text"))


@register("slice_markers", """
WITH p AS (SELECT page_id, html, strpos(html, '<article>') AS s,
                  length(regexp_extract(html, '(?s)^(.*</p>)', 1)) AS e FROM pages)
SELECT page_id, CASE WHEN s > 0 AND e >= s THEN substr(html, s, e - s + 1) ELSE '' END AS slice FROM p""")
def slice_markers(spark, sf):
    """T15 + T18: text from the first ``<article>`` to the end of the last
    ``</p>`` ("" when a marker is missing)."""
    p = table(spark, sf, "pages")
    return p.select("page_id", T.slice_between("html", "<article>", "</p>").alias("slice"))


# ------------------------------------------------ a reference pipeline

def _p11_sql() -> str:
    from . import pipelines as P
    q = O.q
    t = "b.text"
    fields = {
        "courseCode": f"regexp_extract({t}, {q(P.P11_CODE)}, 1)",
        "numericCode": f"regexp_extract({t}, {q(P.P11_CODE)}, 2)",
        "name": f"regexp_extract({t}, {q(P.P11_CODE)}, 3)",
        "prerequisite": f"regexp_extract({t}, {q(P.P11_PRE)}, 1)",
        "antirequisite": f"regexp_extract({t}, {q(P.P11_ANTI)}, 1)",
        "oneWayExclusion": f"regexp_extract({t}, {q(P.P11_ONEWAY)}, 1)",
    }
    d1 = O.utrim(f"regexp_extract({t}, {q(P.P11_DESC)}, 1)")
    d2 = O.utrim(f"regexp_extract({t}, {q(P.P11_DESC2)}, 1)")
    sel = ",\n       ".join(f"{O.utrim(v)} AS {k}" for k, v in fields.items())
    return _SQL_LINES + f""",
h AS (SELECT *, sum(CASE WHEN regexp_matches(line, {q(P.P11_CODE)}) THEN 1 ELSE 0 END)
                  OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS blk FROM ls),
b AS (SELECT doc_id, blk, string_agg(line, chr(10) ORDER BY line_no) AS text FROM h GROUP BY doc_id, blk)
SELECT doc_id, CAST(blk AS BIGINT) AS blk, {sel},
       coalesce(nullif({d1}, ''), nullif({d2}, ''), '') AS description
FROM b"""


@register("text_block_courses", _p11_sql())
def text_block_courses(spark, sf):
    """P11 (S5, W1, T13, T16) over whole documents: lines -> blocks opened by
    a course header line -> one course per block from the six fixed
    patterns, with the description fallback. The oracle runs the original
    RE2 patterns; Spark runs them ported to java.util.regex."""
    from .pipelines import text_courses
    c = text_courses(spark.read.parquet(f"{sf}/documents.parquet"))
    return c.select(F.col("ord")[0].alias("doc_id"), F.col("ord")[1].alias("blk"), "courseCode", "numericCode",
                    "name", "prerequisite", "antirequisite", "oneWayExclusion", "description")


# ------------------------------------------- the pipelines on rendered pages

from . import rendered  # noqa: E402

QUERIES.update(rendered.QUERIES)
ORACLE.update(rendered.ORACLE)


# ------------------------------------------------------------------ T15, L11, A3, S3 over whole tables

_CAPITALS = "[A-Z][a-z]+|[0-9]+"


@register("match_positions", f"""
WITH z AS (SELECT doc_id, unnest(list_zip(regexp_split_to_array(text, '{_CAPITALS}')[:len(h)], h)) AS z, unnest(range(len(h))) AS match_no
           FROM (SELECT doc_id, text, regexp_extract_all(text, '{_CAPITALS}') AS h FROM documents)),
e AS (SELECT doc_id, match_no, z[2] AS match, sum(length(z[1]) + length(z[2])) OVER (PARTITION BY doc_id ORDER BY match_no) AS e FROM z)
SELECT doc_id, match_no, CAST(e - length(match) AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", match FROM e""")
def match_positions(spark, sf):
    """T15 (and the base of W2): start and end of every match in every document."""
    return T.match_positions(table(spark, sf, "documents"), ["doc_id"], "text", _CAPITALS)


# A site of one page a part: every page links to two pages further down, the one before it (a cycle), a page
# that never landed and itself; pages of keys divisible by 7 link to the first one only.
_SITE_URL = "'https://site.example/p/' || p_partkey"
_SITE_EDGES = """
n AS (SELECT max(p_partkey) AS n FROM part),
e AS (SELECT DISTINCT p_partkey AS src, unnest(CASE WHEN p_partkey % 7 = 0 THEN [1] ELSE [p_partkey * 2, p_partkey * 3 + 1, p_partkey - 1, p_partkey] END) AS dst FROM part),
g AS (SELECT src, dst FROM e WHERE src <> dst AND dst IN (SELECT p_partkey FROM part))"""


@register("crawl_levels", f"""
WITH RECURSIVE {_SITE_EDGES},
r(page_id, level) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey = 1
    UNION SELECT g.dst, r.level + 1 FROM r JOIN g ON g.src = r.page_id WHERE r.level < 60),
f AS (SELECT page_id, min(level) AS level FROM r GROUP BY page_id)
SELECT f.page_id, f.level, min(p.page_id) AS parent FROM f LEFT JOIN (g JOIN f p ON p.page_id = g.src)
  ON g.dst = f.page_id AND p.level = f.level - 1 AND f.level > 0 GROUP BY f.page_id, f.level""")
def crawl_levels(spark, sf):
    """L11 + J3 + J6: links of rendered pages -> link graph -> levels of a crawl from the first page to its fixed point."""
    p = table(spark, sf, "part").select("p_partkey")
    down = F.expr("concat('<ul><li><a href=\"', p_partkey * 2, '#top\">two</a><li><a href=\"./', p_partkey * 3 + 1, '\">three</a><li><a href=/p/', p_partkey - 1, "
                  "'>back</a><li><a href=\"#me\">me</a><li><a href=\"/gone/', p_partkey, '\">gone</a></ul>')")
    html = F.when(F.col("p_partkey") % 7 == 0, F.lit("<p><a href='https://site.example/p/1'>home</a>")).otherwise(down)
    pages = IO.staged(p.select(F.col("p_partkey").cast("long").alias("page_id"), F.concat(F.lit("https://site.example/p/"), "p_partkey").alias("url"), html.alias("html")), "site")
    links = H.shred(spread(pages, "page_id", "html"), select={"link": [{"tag": "a"}]}, keep=["url"], cluster=False).filter("link").select("page_id", "url", H.attr("href").alias("href"))
    return L.crawl_levels(L.link_edges(links, pages), pages.filter("url = 'https://site.example/p/1'"))


@register("ids_two_landings", """
WITH k AS (SELECT p_brand AS brand, p_type AS type, min(p_partkey) AS o, min(CASE WHEN p_size % 3 = 0 THEN p_partkey END) AS o1 FROM part GROUP BY ALL),
a AS (SELECT *, row_number() OVER (ORDER BY o1, brand, type) AS id, 0 AS landing FROM k WHERE o1 IS NOT NULL),
b AS (SELECT *, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY o, brand, type) AS id, 1 AS landing FROM k WHERE o1 IS NULL)
SELECT brand, type, CAST(id AS BIGINT) AS id, landing FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def ids_two_landings(spark, sf):
    """A3 + J1 over landings: a second landing with all rows leaves the first one's ids as they are; the second one is run twice."""
    p = table(spark, sf, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), "p_partkey", "p_size")
    path = IO.scratch_path(spark, "registry")
    first = D.register_landing(path, 0, p.filter("p_size % 3 = 0"), ["brand", "type"], ["p_partkey"], base=1)
    D.register_landing(path, 1, p, ["brand", "type"], ["p_partkey"], base=1)
    ids = D.register_landing(path, 1, p, ["brand", "type"], ["p_partkey"], base=1)
    was = first.select("brand", "type", F.lit(0).alias("_was"))
    return ids.join(was, ["brand", "type"], "left").select("brand", "type", "id", F.when(F.col("_was").isNull(), 1).otherwise(0).alias("landing"))


# Payloads whose members change their type between rows.
_PAYLOAD = """concat('{"id":', o_orderkey, ',"crossList":', CASE o_orderkey % 6 WHEN 0 THEN 'null' WHEN 1 THEN '"A1"' WHEN 2 THEN '[1,"two",null]'
  WHEN 3 THEN '{"code":"B2","n":3}' WHEN 4 THEN '17' ELSE 'true' END, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat(',"seats":',
  CASE WHEN o_orderkey % 3 = 0 THEN concat('"', o_orderkey % 50, '"') ELSE cast(o_orderkey % 50 as varchar(9)) END) END, ',"note":"', o_orderpriority, '"}')"""
_BODY = f"CASE WHEN o_orderkey % 11 = 0 THEN '[1,2]' WHEN o_orderkey % 13 = 0 THEN 'no json' ELSE {_PAYLOAD} END"


@register("payload_members", f"""
WITH b AS (SELECT o_orderkey, {_BODY} AS body FROM orders),
j AS (SELECT o_orderkey, body FROM b WHERE json_valid(body) AND json_type(body) = 'OBJECT')
SELECT o_orderkey, e.key, CASE e.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean'
  WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind, CAST(e.value AS VARCHAR) AS value, TRY_CAST(json_extract_string(j.body, '$.seats') AS BIGINT) AS seats
FROM j, json_each(j.body) e""")
def payload_members(spark, sf):
    """S3 without a schema: members that are scalars, objects or arrays by turns; rows that hold no object are left out. ``seats`` is
    read as a number whether it came as one or as text."""
    o = table(spark, sf, "orders").select("o_orderkey", F.expr(_BODY.replace("varchar(9)", "string")).alias("body"))
    v = S.variant_payload(o, "body")
    return S.payload_members(v.withColumn("seats", S.member("payload", "$.seats", "bigint")), "payload", ["o_orderkey", "seats"]).select(
        "o_orderkey", "key", "kind", "value", "seats")


@register("payload_report", f"""
WITH b AS (SELECT {_BODY} AS body FROM orders)
SELECT count(*) FILTER (WHERE json_valid(body)) AS n_payloads, count(*) FILTER (WHERE CASE WHEN json_valid(body) THEN json_type(body) = 'OBJECT' END) AS n_objects,
  true AS mixed FROM b""")
def payload_report(spark, sf):
    """S3: the schema that all payloads fit; members (and here the payloads) of changing type stay VARIANT."""
    o = table(spark, sf, "orders").select(F.expr(_BODY.replace("varchar(9)", "string")).alias("body"))
    v = S.variant_payload(o, "body").filter("payload is not null").withColumn("object", F.when(S.variant_kind("payload") == "object", F.col("payload")))
    r = v.agg(
        F.count("payload").alias("n_payloads"), F.count("object").alias("n_objects"), F.schema_of_variant_agg("payload").alias("s"), F.schema_of_variant_agg("object").alias("o"))
    mixed = (F.col("s") == "VARIANT") & F.col("o").contains("crossList: VARIANT") & F.col("o").contains("id: BIGINT") & F.col("o").contains("note: STRING")
    return r.select("n_payloads", "n_objects", mixed.alias("mixed"))


@register("first_wins_landings", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn,
                  count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events)
SELECT user_id, event_type, event_id, n AS n_copies FROM r WHERE rn = 1""")
def first_wins_landings(spark, sf):
    """D1 + L8 over landings: three landings, the latest rows first, give the survivors of one run; one is replayed."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    path = IO.scratch_path(spark, "firsts")
    for landing in (2, 0, 1, 2):
        D.land_firsts(path, landing, e.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == landing), ["user_id", "event_type"], ["ts", "event_id"])
    return D.merged_firsts(spark, path, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "n_copies")


@register("ordered_parts", """
WITH f AS (SELECT l_returnflag, l_partkey, min(l_orderkey * 8 + l_linenumber) AS o FROM lineitem GROUP BY ALL),
a AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY o, l_partkey) - 1 AS i FROM f)
SELECT l_returnflag, CAST(i // 500 AS BIGINT) AS part, string_agg(l_partkey, ',' ORDER BY i) AS parts FROM a GROUP BY ALL""")
def ordered_parts(spark, sf):
    """A2 of hot keys: the distinct parts of each return flag in first-seen order, in arrays of at most 500."""
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_partkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("o"))
    p = D.ordered_parts(li, ["l_returnflag"], "l_partkey", "o", "keys", size=500)
    return p.select("l_returnflag", "part", F.array_join("keys", ",").alias("parts"))


@register("export_by_source", "SELECT p_partkey, p_name, p_brand AS source, p_size FROM part")
def export_by_source(spark, sf):
    """K3 + K8: rows written as JSON in a folder for each source, in files of bounded size, and read back whole."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", F.col("p_brand").alias("source"), "p_size")
    out = IO.scratch_path(spark, "by-source")
    IO.write_json_by(p, out, ["source"], rows_per_file=1000)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in p.schema.fields)
    return IO.read_json_records(spark, out, kinds)
