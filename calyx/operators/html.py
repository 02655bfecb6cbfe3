"""Page shredding and selectors.

A page is shredded into a token table (H1). One ordered pass over each page's tokens gives
element extents and the tree (H2) and marks compiled selectors (H8), see ``tree``. On the node table,
element text (H17), inner markup (H18) and selections that aren't known beforehand are
window passes over the rows of one page. Nothing pairs elements with each other: containment is a
running count of open intervals, and "which element owns this token" is the
last interval opened at the token's nesting level. Every pass is an
``explode`` (which keeps the child's partitioning) followed by a window
partitioned by ``page_id`` - so after the single hash exchange of the pages
on ``page_id`` no further shuffle is needed (see ``explain``).

The rules of the tree are those of the HTML standard as far as ``tree`` states them.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regex import WS, WS_BODY
from ..session import cluster_by, clustered_partitions
from ..functions.text import decode_entities, decode_sql, sql_str
from . import tree

PID = "page_id"

# The tokenizer (text run | comment | script block | style
# block | tag with quoted attributes | lone '<'; tag names matched without
# case, spelled out so the rest of the pattern runs case-sensitively), the
# void elements of HTML and the elements whose end tag may be omitted before
# a sibling of the same name.
TOKEN_RE = (r"""(?s)[^<]++|<!--.*?-->"""
            r"""|<[sS][cC][rR][iI][pP][tT]\b.*?</[sS][cC][rR][iI][pP][tT]>"""
            r"""|<[sS][tT][yY][lL][eE]\b.*?</[sS][tT][yY][lL][eE]>"""
            r"""|<(?:[^'">]++|"[^"]*+"|'[^']*+')*+>|<""")
START_TAG = r"""(?s)^<(?:[^'">]++|"[^"]*+"|'[^']*+')*+>"""
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link",
             "meta", "param", "source", "track", "wbr"]
# Fixed values (HTML standard): the containers of those elements, and for each
# element the tags whose start or end ends it, besides the container's end.
CONTAINERS = {"list": ["ul", "ol", "menu", "dir"], "table": ["table"], "dl": ["dl"], "select": ["select"]}
ROW_GROUPS = ["thead", "tbody", "tfoot"]
ENDED_BY = {
    "list": {"li": ["li"]},
    "dl": {"dt": ["dt", "dd"], "dd": ["dt", "dd"]},
    "table": {"td": ["td", "th", "tr", *ROW_GROUPS], "th": ["td", "th", "tr", *ROW_GROUPS], "tr": ["tr", *ROW_GROUPS],
              "thead": ROW_GROUPS, "tbody": ROW_GROUPS, "tfoot": ROW_GROUPS},
    "select": {"option": ["option", "optgroup"], "optgroup": ["optgroup"]},
}
# Fixed values (HTML standard): start tags that close an open p, and end tags
# of containers that end a p left open inside them.
P_CLOSING_START_TAGS = ["address", "article", "aside", "blockquote", "center", "dd", "details", "dialog",
                        "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
                        "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "listing",
                        "main", "menu", "nav", "ol", "p", "plaintext", "pre", "section", "summary",
                        "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "xmp"]
P_CLOSING_END_TAGS = ["address", "article", "aside", "blockquote", "body", "caption", "center", "dd",
                      "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
                      "footer", "form", "header", "hgroup", "html", "li", "main", "menu", "nav", "ol",
                      "p", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr",
                      "ul"]


# --------------------------------------------------------------------- H1

def tokens(pages: DataFrame, cluster: bool = True, partitions: int | None = None,
           id_col: str = PID, html_col: str = "html", keep: list[str] = ()) -> DataFrame:
    """H1: one row per token: page_id, pos, n_tok, tok, kind, tag.

    ``kind`` is comment / raw (script or style block) / decl / open / close /
    other / text. With ``cluster`` the pages are hash-partitioned on
    ``page_id`` *before* the explode, so the (smaller) html moves once and all
    per-page windows downstream run without another exchange.
    """
    p = pages.select(F.col(id_col).alias(PID), F.col(html_col).alias("html"), *keep)
    if cluster:
        # One exchange of compact html (none when the pages are bucketed by
        # page_id), sized explicitly: the token rows after it are larger.
        p = cluster_by(p, PID, partitions)
    t = p.select(PID, *keep, F.regexp_extract_all("html", F.lit(TOKEN_RE), 0).alias("toks"))
    t = t.select(PID, *keep, F.size("toks").alias("n_tok"), F.posexplode("toks").alias("pos", "tok"))
    tok = F.col("tok")
    return t.select(PID, "pos", "n_tok", "tok", _kind(tok).alias("kind"), _tag(tok).alias("tag"), *keep)


def _kind(tok: Column) -> Column:
    return (F.when(tok.startswith("<!--"), "comment")
            .when(tok.rlike(r"(?is)^<(script|style)\b.*</(script|style)>\z"), "raw")
            .when(tok.startswith("<!"), "decl")
            .when(tok.rlike(r"^</[A-Za-z]"), "close")
            .when(tok.rlike(r"^<[A-Za-z]"), "open")
            .when(tok.startswith("<") & (F.length(tok) > 1), "other")
            .otherwise("text"))


def _tag(tok: Column) -> Column:
    # open, close and raw tokens are exactly those starting "<x" or "</x"
    return F.when(tok.rlike(r"^</?[A-Za-z]"), F.lower(F.regexp_extract(tok, r"^</?([A-Za-z][A-Za-z0-9:-]*)", 1))).otherwise("")


# --------------------------------------------------------------------- H2

#: What start tags end, for ``tree``: p, and by family the open elements of its container.
_BLOCKS = frozenset([*P_CLOSING_START_TAGS, *tree.TABLE_PARTS, "body", "html", "head", "select", "option", "optgroup"])
_RULES = {"ends_p": frozenset(P_CLOSING_START_TAGS), "blocks": _BLOCKS,
          "families": [(frozenset(CONTAINERS[f]), {t: frozenset(x for x, by in ended.items() if t in by) for by in ended.values() for t in by})
                       for f, ended in ENDED_BY.items()]}


def shred(pages: DataFrame, partitions: int | None = None, keep: list[str] = (), select: dict[str, list] | None = None,
          scopes: list[str] = (), reopen: bool = False, cluster: bool = True) -> DataFrame:
    """H1+H2+H8: the node table of pages.

    Columns: page_id, pos, n_tok, tok, kind, tag, is_elem, end, level,
    parent, parent_tag, prev. ``end`` is the position of the token that ends the
    element (exclusive; the element's content is ``pos < x < end``);
    ``parent`` is the position of the enclosing element (NULL at top level), ``prev`` of the
    element before it among its siblings. ``keep`` names page columns (the URL) to carry along.

    ``select`` marks selectors in the same pass: a name and its steps, each the keywords of ``sel``, or (combinator, keywords) with
    ``" "`` (inside), ``">"`` (child) or ``"+"`` (next sibling). Each gives a boolean column of that name; those in ``scopes`` also
    a column ``in_<name>``, for every node the positions of the marked elements around it.

    The pages are hash-partitioned on page_id for the per-page passes that follow; without ``cluster`` they stay where they are.

    With ``reopen`` formatting elements that a block's end cut off go on in the next block, as rows of their own: positions
    then count nodes, not tokens.
    """
    p = pages.select(PID, "html", *keep).where("html is not null")
    p = p.select(PID, *keep, F.regexp_extract_all("html", F.lit(TOKEN_RE), 0).alias("toks"))
    p = p.select("*", F.transform("toks", _kind).alias("kinds"), F.transform("toks", _tag).alias("tags"))

    def code(tok, i):
        kind, tag = F.get("kinds", i), F.get("tags", i)
        leaf = (kind == "raw") | tag.isin(VOID_TAGS) | tok.endswith("/>")
        return (F.when(kind == "close", tree.CLOSE).when(kind.isin("open", "raw"), F.when(leaf, tree.LEAF).otherwise(tree.OPEN))
                .when((kind == "text") & tok.rlike(f"[^{WS_BODY}]"), tree.TEXT).otherwise(tree.NOTHING))

    p = p.withColumn("codes", F.transform("toks", code))
    p = tree.folded(p, select or {}, list(scopes), _RULES, _matches, reopen)
    if cluster:
        # One exchange of whole pages with their nodes, sized explicitly: the rows after it are larger. (A Python
        # call hides the partitioning of a bucketed table from Spark, so it stands before the exchange.)
        p = cluster_by(p, PID, partitions or clustered_partitions(pages))
    return tree.nodes_of(p, select or {}, list(scopes), list(keep))


# --------------------------------------------------------------- predicates

def attr(name: str, tok: Column | str = "tok") -> Column:
    """Value of attribute ``name`` of a tag token, entity-decoded; "" when missing."""
    pat = (_before(name) + rf"""{WS}*={WS}*(?:"([^"]*)"|'([^']*)'|([^\t\n\f\r >]+))""")
    if isinstance(tok, str):
        t, q = f"`{tok}`", sql_str(pat)
        raw = f"concat(regexp_extract({t}, {q}, 1), regexp_extract({t}, {q}, 2), regexp_extract({t}, {q}, 3))"
        return F.expr(decode_sql(raw))
    raw = F.concat(F.regexp_extract(tok, pat, 1), F.regexp_extract(tok, pat, 2),
                   F.regexp_extract(tok, pat, 3))
    return decode_entities(raw)


def has_attr(name: str, tok: Column | str = "tok") -> Column:
    tok = F.col(tok) if isinstance(tok, str) else tok
    return tok.rlike(_before(name) + rf"(?=[{WS_BODY}/=>])")


def _before(name: str) -> str:
    """A tag up to and with the first attribute called ``name``: the pattern
    steps over whole attributes, so nothing inside a quoted value counts."""
    a = re.escape(name)
    return (rf"(?i)^<[^{WS_BODY}/>]++(?:[{WS_BODY}/]+(?!{a}[{WS_BODY}/=>])[^{WS_BODY}/=>]++"
            rf"""(?:{WS}*+={WS}*+(?:"[^"]*+"|'[^']*+'|[^{WS_BODY}>"'][^{WS_BODY}>]*+))?+)*+[{WS_BODY}/]++{a}""")


def all_attrs(tok: Column | str = "tok") -> Column:
    """Every attribute of a tag token in order, as (name, value); the
    value is decoded, and "" where there is none."""
    tok = F.col(tok) if isinstance(tok, str) else tok
    one = (rf"""[{WS_BODY}/]+([^{WS_BODY}/=>]+)(?:{WS}*={WS}*("[^"]*"|'[^']*'|[^{WS_BODY}>"'][^{WS_BODY}>]*))?""")
    rest = F.regexp_replace(tok, rf"^<[^{WS_BODY}/>]+", "")
    value = lambda v: F.when(v.rlike("^[\"']"), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    pairs = F.arrays_zip(F.regexp_extract_all(rest, F.lit(one), F.lit(1)).alias("n"),
                         F.regexp_extract_all(rest, F.lit(one), F.lit(2)).alias("v"))
    return F.transform(pairs, lambda p: F.struct(F.lower(p["n"]).alias("name"), decode_entities(value(p["v"])).alias("value")))


def sel(tag: str | None = None, id: str | None = None, cls: str | list[str] | None = None,
        attr_eq: dict | None = None, attr_prefix: dict | None = None,
        attr_contains: dict | None = None, has: list[str] | None = None) -> Column:
    """H3-H7: a simple selector as a predicate over node rows.

    ``sel(tag="a", cls="x")`` is ``a.x``; ``attr_prefix={"href": "/c"}`` is
    ``[href^="/c"]``; ``attr_eq`` is ``[a="v"]``.
    """
    simple = {"tag": tag, "id": id, "cls": cls, "attr_eq": attr_eq, "attr_prefix": attr_prefix, "attr_contains": attr_contains, "has": has}
    return reduce(lambda a, b: a & b, [F.col("is_elem"), *_tests(simple, "tok", F.col("tag"))])


def _tests(simple: dict, tok: Column | str, tag: Column) -> list[Column]:
    whole = F.col(tok) if isinstance(tok, str) else tok

    def holds(value: str, test: Column) -> Column:
        # the attribute is looked for only in a tag that has the value somewhere, or a reference that may stand for it
        return (F.contains(whole, F.lit(value)) | F.contains(whole, F.lit("&"))) & test if value else test

    preds = []
    if simple.get("tag"):
        preds.append(tag == simple["tag"].lower())
    if simple.get("id") is not None:
        preds.append(holds(simple["id"], attr("id", tok) == simple["id"]))
    if cls := simple.get("cls"):
        classes = F.split(F.trim(F.regexp_replace(attr("class", tok), f"{WS}+", " ")), " ")
        preds += [holds(c, F.array_contains(classes, c)) for c in ([cls] if isinstance(cls, str) else cls)]
    preds += [holds(v, has_attr(k, tok) & (attr(k, tok) == v)) for k, v in (simple.get("attr_eq") or {}).items()]
    preds += [holds(v, has_attr(k, tok) & attr(k, tok).startswith(v)) for k, v in (simple.get("attr_prefix") or {}).items()]
    preds += [holds(v, has_attr(k, tok) & attr(k, tok).contains(v)) for k, v in (simple.get("attr_contains") or {}).items()]
    return preds + [has_attr(k, tok) for k in simple.get("has") or []]


def _matches(simple: dict, tok: Column, tag: Column) -> Column:
    return reduce(lambda a, b: a & b, _tests(simple, tok, tag), F.lit(True))


# --------------------------------------------------------------------- H8

def enclosing_count(nodes: DataFrame, outer: Column, name: str) -> DataFrame:
    """Add ``name`` = number of ``outer`` elements strictly containing each node.

    One explode + one per-page running sum: +1 where an outer element opens,
    -1 where it ends; queries sit between ends and opens at equal positions.
    """
    o = outer & F.col("is_elem") & (F.col("end") > F.col("pos"))
    ev = F.when(o, F.array(
        F.struct(F.col("pos").alias("ep"), F.lit(2).alias("eo"), F.lit(1).alias("dl"), F.lit(False).alias("me")),
        F.struct(F.col("end").alias("ep"), F.lit(0).alias("eo"), F.lit(-1).alias("dl"), F.lit(False).alias("me")),
        F.struct(F.col("pos").alias("ep"), F.lit(1).alias("eo"), F.lit(0).alias("dl"), F.lit(True).alias("me")),
    )).otherwise(F.array(
        F.struct(F.col("pos").alias("ep"), F.lit(1).alias("eo"), F.lit(0).alias("dl"), F.lit(True).alias("me"))))
    cols = nodes.columns
    x = nodes.select("*", F.explode(ev).alias("_e"))
    w = Window.partitionBy(PID).orderBy("_e.ep", "_e.eo").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn(name, F.sum("_e.dl").over(w)).filter("_e.me")
    return x.select(*cols, name)


def mark_path(nodes: DataFrame, *steps: Column, name: str = "matched") -> DataFrame:
    """H8: flag nodes matching the descendant selector ``s1 s2 ... sn``
    (match ``sn`` and lie inside an ``s(n-1)`` that lies inside ... ``s1``).

    Keeps every node row and adds the boolean ``name``, so later passes
    (text, markup, siblings) can use the flag on the same partitioned table.
    """
    cur = nodes
    flag = None
    for i, s in enumerate(steps[:-1]):
        pred = s if flag is None else (s & (F.col(flag) > 0))
        nxt = f"_in{i}"
        cur = enclosing_count(cur, pred, nxt)
        flag = nxt
    last = steps[-1] if flag is None else (steps[-1] & (F.col(flag) > 0))
    cur = cur.withColumn(name, last)
    return cur.drop(*[c for c in cur.columns if c.startswith("_in")])


def select_path(nodes: DataFrame, *steps: Column) -> DataFrame:
    """H8: the nodes matching a descendant selector, each element once."""
    return mark_path(nodes, *steps, name="_sel").filter("_sel").drop("_sel")


# --------------------------------------------------------------- H17/H18

def owned_tokens(nodes: DataFrame, owner: Column, member: Column, nested: bool = False) -> DataFrame:
    """Every (owner element, member token inside it) pair that the
    containment relation holds, owners included as their own rows.

    Output: all node columns + ``owner`` (position of the owning element) +
    ``is_owner``. Works for nested owners: a token inside k owners is
    emitted k times (the relation itself, not a cross product). With ``nested``
    owners are members of the owners around them, too.
    """
    o = owner & F.col("is_elem") & (F.col("end") > F.col("pos"))
    m = member & ~o
    cols = nodes.columns
    ev = (F.when(o, F.array(
        F.struct(F.col("pos").alias("ep"), F.lit(2).alias("eo"), F.lit(1).alias("dl"), F.lit(True).alias("me")),
        F.struct(F.col("end").alias("ep"), F.lit(0).alias("eo"), F.lit(-1).alias("dl"), F.lit(False).alias("me"))))
          .when(m, F.array(
        F.struct(F.col("pos").alias("ep"), F.lit(1).alias("eo"), F.lit(0).alias("dl"), F.lit(True).alias("me")))))
    x = nodes.withColumn("_o", o).select("*", F.explode(ev).alias("_e"))
    w = Window.partitionBy(PID).orderBy("_e.ep", "_e.eo").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_c", F.sum("_e.dl").over(w)).filter("_e.me")
    # owners sit at their own nesting level; a member inside c owners is
    # repeated once per level 1..c
    levels = F.when(F.col("_c") > 0, F.sequence(F.lit(1), F.col("_c")))
    x = x.withColumn("_k", levels if nested else F.when(F.col("_o"), F.array(F.col("_c"))).otherwise(levels))
    x = x.select("*", F.explode("_k").alias("_lv")).withColumn("_own", F.col("_o") & (F.col("_lv") == F.col("_c")))
    w2 = Window.partitionBy(PID, "_lv").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("owner", F.last(F.when(F.col("_own"), F.col("pos")), ignorenulls=True).over(w2))
    return x.select(*cols, "owner", F.col("_own").alias("is_owner"))


def raw_text(tok: str = "tok") -> Column:
    """The content of a script or style token, written so that decoding
    references later gives it back unchanged (it holds none)."""
    return F.replace(F.regexp_extract(tok, r"(?is)^<[^>]*>(.*)</[a-z]+>\z", 1), F.lit("&"), F.lit("&amp;"))


def element_text(nodes: DataFrame, owner: Column, with_raw: bool = True) -> DataFrame:
    """H17 ``Text()``: for each selected element, its text (entity-decoded
    concatenation of the text tokens inside it, in document order, script and
    style content included unless ``with_raw`` is off).

    Returns the selected element rows plus ``text``.
    """
    member = F.col("kind") == "text"
    if with_raw:
        member = member | (F.col("kind") == "raw")
    x = owned_tokens(nodes, owner, member)
    piece = F.when(F.col("kind") == "raw", raw_text()).otherwise(F.col("tok"))
    x = x.withColumn("_piece", F.when(~F.col("is_owner"), piece))
    cols = [c for c in nodes.columns if c != PID]
    g = x.groupBy(PID, "owner").agg(
        F.max(F.when(F.col("is_owner"), F.struct(*cols))).alias("_el"),
        F.expr("listagg(_piece, '') WITHIN GROUP (ORDER BY pos)").alias("_txt"))
    return g.select(PID, "_el.*", F.expr(decode_sql("coalesce(_txt, '')")).alias("text"))


# The characters that the serialiser of the pages' parser writes as references, in text and in attribute values.
ESCAPES = [("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("\r", "&#13;")]


def escaped(c: Column) -> Column:
    for char, ref in ESCAPES:
        c = F.replace(c, F.lit(char), F.lit(ref))
    return c


def start_markup(tok: Column) -> Column:
    """A start tag as it is written out again: its name in lower case, every attribute in quotes, void tags with ``/>``."""
    attrs = F.transform(all_attrs(tok), lambda a: F.concat(F.lit(" "), a["name"], F.lit('="'), escaped(a["value"]), F.lit('"')))
    return F.concat(F.lit("<"), F.col("tag"), F.when(F.contains(tok, F.lit("=")) | tok.rlike(f"{WS}"), F.array_join(attrs, "")).otherwise(""),
                    F.when(F.col("tag").isin(VOID_TAGS), "/>").otherwise(">"))


def markup_events(nodes: DataFrame) -> DataFrame:
    """What a serialiser writes for node rows, as rows with ``at``, ``ord``, ``inner`` (the order of writing) and ``piece``.

    By the kind of node: text with its references decoded and escaped again, script and style content as it is, comments and
    declarations as they are, elements as start and end tag - also where the page left the end tag out -, nothing for the page's own end tags.
    """
    tok, end_tag = F.col("tok"), F.concat(F.lit("</"), F.col("tag"), F.lit(">"))
    start = F.regexp_extract("tok", START_TAG, 0)
    leaf = F.col("end") <= F.col("pos")
    piece = (F.when(F.col("kind") == "text", escaped(decode_entities("tok")))
             .when(F.col("kind") == "raw", F.concat(start_markup(start), F.regexp_extract("tok", r"(?is)^<[^>]*>(.*)</[a-z]+>\z", 1), end_tag))
             .when(F.col("kind") == "open", F.concat(start_markup(tok), F.when(leaf & ~F.col("tag").isin(VOID_TAGS), end_tag).otherwise("")))
             .when(F.col("kind") == "close", "").otherwise(tok))

    def event(at, ord, inner, what):
        return F.struct(F.col(at).cast("long").alias("at"), F.lit(ord).alias("ord"), inner.cast("long").alias("inner"), what.alias("piece"))

    opens = event("pos", 1, F.lit(0), piece)
    both = F.when(F.col("is_elem") & ~leaf, F.array(opens, event("end", 0, -F.col("pos"), end_tag))).otherwise(F.array(opens))
    return nodes.select("*", F.explode(both).alias("_e")).select(*nodes.columns, "_e.*")


_WRITTEN = "listagg(piece, '') WITHIN GROUP (ORDER BY at, ord, inner)"


def inner_html(nodes: DataFrame, owner: Column) -> DataFrame:
    """H18 ``Html()``: inner markup of each selected element as a serialiser writes it."""
    x = markup_events(owned_tokens(nodes, owner, F.lit(True), nested=True))
    cols = [c for c in nodes.columns if c != PID]
    x = x.withColumn("piece", F.when(~F.col("is_owner"), F.col("piece")))
    g = x.groupBy(PID, "owner").agg(F.max(F.when(F.col("is_owner"), F.struct(*cols))).alias("_el"), F.expr(_WRITTEN).alias("_html"))
    return g.select(PID, "_el.*", F.coalesce("_html", F.lit("")).alias("html"))


def page_html(nodes: DataFrame, name: str = "html") -> DataFrame:
    """Whole pages as a serialiser writes them."""
    return markup_events(nodes).groupBy(PID).agg(F.expr(_WRITTEN).alias(name))


def own_text(nodes: DataFrame) -> DataFrame:
    """Text an element holds directly (its text children only):
    page_id, pos, tag, own_text."""
    t = nodes.filter((F.col("kind") == "text") & F.col("parent").isNotNull())
    g = t.groupBy(PID, "parent").agg(
        F.max("parent_tag").alias("tag"),
        F.expr("listagg(tok, '') WITHIN GROUP (ORDER BY pos)").alias("_t"))
    return g.select(PID, F.col("parent").alias("pos"), "tag", decode_entities("_t").alias("own_text"))


# ------------------------------------------------------------ H9-H16

def siblings(elems: DataFrame, n: int = 1) -> DataFrame:
    """H9/H10 (W5): next and previous element siblings, ``n`` steps away.

    Adds next_pos/next_tag/prev_pos/prev_tag over (page_id, parent) by pos.
    """
    w = Window.partitionBy(PID, "parent").orderBy("pos")
    return (elems.withColumn("next_pos", F.lead("pos", n).over(w))
            .withColumn("next_tag", F.lead("tag", n).over(w))
            .withColumn("prev_pos", F.lag("pos", n).over(w))
            .withColumn("prev_tag", F.lag("tag", n).over(w)))


def nth_cells(cells: DataFrame, row_col: str, names: list[str], value: Column | str,
              skip_first: int = 0) -> DataFrame:
    """I-th cell of each row -> named column (a pivot of
    ``row_number``); ``skip_first`` drops leading cells first."""
    value = F.col(value) if isinstance(value, str) else value
    w = Window.partitionBy(PID, row_col).orderBy("pos")
    c = cells.withColumn("_i", F.row_number().over(w) - 1 - skip_first).filter(F.col("_i") >= 0)
    return c.groupBy(PID, row_col).agg(*[
        F.max(F.when(F.col("_i") == i, value)).alias(nm) for i, nm in enumerate(names)])

