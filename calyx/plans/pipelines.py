"""The catalogue pipelines (P1-P12) and their shared export tail.

Each pipeline is a DataFrame program over landed inputs: the ``pages``
table (page_id, url, html) holds every level a crawl would have fetched
(listings, subject pages, detail pages); a level is reached from the one
before by joining extracted links to ``pages.url`` (J3). Output rows use the
common Course schema of ``extract.course_frame`` with a deterministic
``ord``, so ids assigned later do not depend on scheduling.

Regex rules are the reference's fixed patterns, written for RE2 and run
through ``java_re`` so Spark's Java engine gives RE2's matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regex import java_re as J
from ..functions.text import (clean, decode_entities, first_nonempty, newline_to_space, non_ascii,
                              remove_first, split_literal, strip_tags, strip_trailing_paren,
                              trim_prefix, trim_suffix, utrim)
from ..operators import dims as D
from ..operators import html as H
from ..operators import links as L
from ..operators import sections as S
from ..operators import segment as G
from ..sources import io as IO
from .extract import (PID, at_positions, staged_nodes, course_frame, document_html, document_text, first_of,
                      joined_text, marked, marked_texts, markup, owner_of, parents_of, scoped_texts, selection_text, texts)

sel = H.sel


def _x(c: Column | str, pattern: str, g: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract(c, J(pattern), g)


def _m(c: Column | str, pattern: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike(J(pattern))


def _at(pages: DataFrame, where: Column | str) -> DataFrame:
    """The index pages of a site: one URL, or all that a condition holds for."""
    return pages.filter(F.col("url") == where if isinstance(where, str) else where)


def _pages_at(pages: DataFrame, urls: DataFrame, url_col: str, how: str = "inner", name: str = PID) -> DataFrame:
    """Pages landed for the URLs in ``urls`` (J3: parent row -> child page). A
    URL that was landed several times counts once, as landed first."""
    first = pages.groupBy(F.col("url").alias(url_col)).agg(F.min(PID).alias(name))
    return urls.join(first, url_col, how)


def _fold_overwrite(rows: DataFrame, keys: list[str], idx: str, set_kind: str, set_val: str,
                    app_kind: str | None, app_val: str | None, kind: str = "kind",
                    sep: str = " ") -> DataFrame:
    """Value of a field that one kind of line sets (overwriting) and another
    appends to, folded in line order: the last set value followed by the
    appended values after it (Q4)."""
    w = Window.partitionBy(*keys)
    r = rows.withColumn("_last_set", F.max(F.when(F.col(kind) == set_kind, F.col(idx))).over(w))
    head = F.max_by(F.when(F.col(kind) == set_kind, F.col(set_val)),
                    F.when(F.col(kind) == set_kind, F.col(idx)))
    aggs = [head.alias("_head")]
    if app_kind:
        aggs.append(F.expr(
            f"listagg(CASE WHEN {kind} = '{app_kind}' AND {idx} > coalesce(_last_set, -1) "
            f"THEN {app_val} END, '{sep}') WITHIN GROUP (ORDER BY {idx})").alias("_tail"))
    g = r.groupBy(*keys).agg(*aggs)
    tail = F.col("_tail") if app_kind else F.lit(None)
    return g.withColumn("value", F.concat_ws(sep, F.col("_head"), F.nullif(tail, F.lit("")))) \
            .drop("_head", "_tail")


# ============================================================== P2

# The calendar patterns (courses anchor, block title, heading, prerequisite).
P2_START = r'<a\s*(?:name="courses")?\s*id=".*?courses">'
P2_BLOCK = r"^(?:<b>)?([A-Z]{4})\s*(\d+)<i>\s*(.*?)</i>"
P2_TITLE_OPEN = r"^(?:<b>)?[A-Z]{4}\s*\d+<i>"
P2_HEAD = r'<a\s*(?:name=".*?")\s*id=".*?"\s*>.*?</a>.*<br>'
P2_PREREQ = r"^(?:Prerequisite\s*:\s*)(.*?)\.(.*)"


def calendar_blocks(pages: DataFrame) -> DataFrame:
    """Calendar page -> course blocks with their subject heading.

    The page is cut from the courses anchor (else ``<b>Courses</b>``) to the
    end of its last ``<hr>`` (T18; no anchor -> no rows); a line starting
    with a course title (whose ``</i>`` may be on a later line) opens a
    block (W2, text before the first is dropped); each block takes the last
    heading before it, or the page's last heading when none precedes it
    (W3, Q2).
    """
    html = F.col("html")   # the landed markup: the patterns are the site's own
    s1 = F.regexp_instr(html, F.lit(J(P2_START)))
    s2 = F.regexp_instr(html, F.lit(J(r"<b>Courses</b>")))
    start = F.when(s1 > 0, s1).otherwise(s2)
    end = F.length(F.regexp_extract(html, r"(?s)^(.*<hr>)", 1))
    p = pages.select(PID, "url", F.when((start > 0) & (end > 0) & (end >= start - 1),
                                         F.substring(html, start, end - start + 1)).alias("slice"))
    p = p.filter(F.col("slice").isNotNull())
    ls = p.select(PID, F.posexplode(F.split("slice", "\n", -1)).alias("line_no", "line"))
    heads = F.regexp_extract_all("line", F.lit(J(P2_HEAD)), 0)
    # A title may run over lines (the pattern is (?s)): a line opens a block
    # when it starts a title and a "</i>" follows on it or on a later line
    # (running max over the lines in reverse order: linear, no
    # unbounded-following frame).
    w_rev = Window.partitionBy(PID).orderBy(F.col("line_no").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ls = ls.withColumn("_later_close", F.max(F.col("line").contains("</i>").cast("int")).over(w_rev))
    starts = _m("line", P2_TITLE_OPEN) & (_m("line", P2_BLOCK) | (F.coalesce("_later_close", F.lit(0)) == 1))
    ls = ls.withColumn("is_start", starts).withColumn(
        "head", F.when(F.size(heads) > 0, trim_suffix(clean(F.element_at(heads, -1)), ":")))
    w = Window.partitionBy(PID).orderBy("line_no")
    ls = (ls.withColumn("blk", F.sum(F.col("is_start").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("asof", F.last("head", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
            .withColumn("last_head", F.last("head", ignorenulls=True).over(
                Window.partitionBy(PID).orderBy("line_no").rowsBetween(Window.unboundedPreceding,
                                                                      Window.unboundedFollowing))))
    b = ls.filter("blk >= 1").groupBy(PID, "blk").agg(
        F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY line_no)").alias("text"),
        F.min_by("asof", "line_no").alias("asof"), F.max("last_head").alias("last_head"))
    return b.join(p.select(PID, "url"), PID)


def calendar(pages: DataFrame) -> DataFrame:
    """Calendar pages -> courses (title, prerequisite sentence, notes,
    description) with subject from the heading, else the page's h1."""
    nodes = staged_nodes(pages)
    h1 = selection_text(texts(nodes, sel(tag="h1"))).select(PID, clean("value").alias("h1"))
    b = calendar_blocks(pages)
    pc = b.select(PID, "blk", F.posexplode(split_literal("text", "<br>")).alias("i", "piece"))
    pc = pc.withColumn("cl", newline_to_space("piece")).filter(F.col("cl") != "")
    kind = (F.when(_m("cl", P2_BLOCK), "title").when(_m("cl", P2_PREREQ), "prereq")
            .when(F.col("cl").startswith("<i>NOTE:"), "note").otherwise("text"))
    pc = pc.withColumn("kind", kind)
    keys = [PID, "blk"]

    def last(kd, val):
        return F.max_by(F.when(F.col("kind") == kd, val), F.when(F.col("kind") == kd, F.col("i")))
    note_ok = (F.col("kind") == "note") & F.col("cl").contains("may not take this course")
    f = pc.groupBy(*keys).agg(
        last("title", clean(_x("cl", P2_BLOCK, 1))).alias("courseCode"),
        last("title", clean(_x("cl", P2_BLOCK, 2))).alias("numericCode"),
        last("title", clean(_x("cl", P2_BLOCK, 3))).alias("name"),
        last("prereq", _x("cl", P2_PREREQ, 1)).alias("prerequisite"),
        F.max_by(F.when(note_ok, clean(trim_prefix("cl", "<i>NOTE:"))), F.when(note_ok, F.col("i")))
        .alias("antirequisite"))
    d = pc.withColumn("p2", F.when(F.col("kind") == "prereq", _x("cl", P2_PREREQ, 2))).withColumn(
        "raw", F.when(F.col("kind") == "text", F.col("piece")))
    desc = _fold_overwrite(d, keys, "i", "prereq", "p2", "text", "raw", sep="")
    out = (b.join(f, keys, "left").join(desc, keys, "left").join(h1, PID, "left")
           .withColumn("description", clean(F.coalesce("value", F.lit(""))))
           .withColumn("SubjectName", F.coalesce("asof", "last_head", F.lit("")))
           .withColumn("SubjectName", F.when(F.col("SubjectName").isin("", "Courses"),
                                             F.coalesce("h1", F.lit(""))).otherwise(F.col("SubjectName")))
           .withColumn("SubjectDescription", F.coalesce("h1", F.lit("")))
           .withColumn("Link", F.col("url")))
    return course_frame(out, "calendar", [PID, "blk"])


# The site base, the link prefix and the index page.
P2_BASE = "https://www.concordia.ca"
P2_PREFIX = "/academics/undergraduate/calendar/current/sec"
P2_INDEX = "https://www.concordia.ca/academics/undergraduate/calendar/current/courses-quick-links.html"


def calendar_links(pages: DataFrame, index_url: Column | str = P2_INDEX, prefix: str = P2_PREFIX,
                   base: str = P2_BASE) -> DataFrame:
    """P2 links (L1, L5, L2, L8): section pages linked from the index, without
    their fragments, each once in order of its first link."""
    a = staged_nodes(_at(pages, index_url)).filter(sel(tag="a", attr_prefix={"href": prefix}))
    lk = a.select(F.col(PID).alias("index_page"), F.col("pos").cast("long").alias("link_pos"),
                  L.prefix_url(base, L.drop_fragment(H.attr("href"))).alias("link"))
    return L.dedup_links_global(lk, ["link"], ["index_page", "link_pos"])


def calendar_site(pages: DataFrame, index_url: Column | str = P2_INDEX) -> DataFrame:
    """The courses of all section pages that the index links to."""
    at = _pages_at(pages, calendar_links(pages, index_url), "link")
    return calendar(pages.join(at.select(PID), PID, "left_semi"))


# ============================================================== P11

# The six block patterns of the text calendar.
P11_CODE = r"^[^A-Z]?([A-Z]+)\s+(\d+/\d+)\.\d+\s*([A-Z][^\n]*)"
P11_DESC = r"(?s)^[^A-Z]?[A-Z]+\s+\d+/\d+\.\d+\s*[A-Z][^\n]*(.*?)(?:PREREQUISITE|EXCLUSION|ONE-WAY)"
P11_DESC2 = r"(?s)^[^A-Z]?[A-Z]+\s+\d+/\d+\.\d+\s*[A-Z][^\n]*(.*)"
P11_PRE = r"PREREQUISITE(.*)"
P11_ANTI = r"EXCLUSION\s*\(S\)\s*(.*)"
P11_ONEWAY = r"ONE-WAY\s*EXCLUSION\s*(.*)"


def text_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Text documents -> lines -> blocks (a course header line opens a
    block; the lines before the first header are a block of their own)."""
    ls = G.lines(docs.select(id_col, text_col), id_col, text_col)
    return G.segment(ls, id_col, _m("line", P11_CODE), keep_preamble=True)


def text_courses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One course per block, fields by six patterns with a fallback
    for the description; an unmatched preamble gives an empty course."""
    b = text_blocks(docs, id_col, text_col)
    t = F.col("text")
    out = b.select(
        id_col, "blk",
        utrim(_x(t, P11_CODE, 1)).alias("courseCode"), utrim(_x(t, P11_CODE, 2)).alias("numericCode"),
        utrim(_x(t, P11_CODE, 3)).alias("name"),
        first_nonempty(utrim(_x(t, P11_DESC, 1)), utrim(_x(t, P11_DESC2, 1))).alias("description"),
        utrim(_x(t, P11_PRE, 1)).alias("prerequisite"), utrim(_x(t, P11_ANTI, 1)).alias("antirequisite"),
        utrim(_x(t, P11_ONEWAY, 1)).alias("oneWayExclusion"))
    return course_frame(out, "text", [id_col, "blk"])


# ============================================================== P5

# Header, prerequisite, exclusion and corequisite patterns.
P5_TITLE = r".?([A-Z]{4})-([\d*/]+)\s*(.*)"
P5_PRE = r"PREREQUISITE:\s*(?:OR\s*COREQUISITES:)?\s*(.*)"
P5_EXCL = r"EXCLUSION:\s*(.*)"
P5_CO = r"COREQUISITE:\s*(.*)"
P5_PREFIX, P5_BASE = "/sgs/graduate-calendar/courses-instruction/", "https://www.queensu.ca"


def subject_links(pages: DataFrame, index_url: Column | str, href_prefix: str, base: str,
                  label=lambda t: t) -> DataFrame:
    """L1 + L2 on index pages: (link, name, index_page, link_pos) per matching anchor."""
    idx = _at(pages, index_url)
    t = texts(staged_nodes(idx), sel(tag="a", attr_prefix={"href": href_prefix}))
    return t.select(L.prefix_url(base, H.attr("href")).alias("link"), label(F.col("text")).alias("name"),
                    F.col(PID).alias("index_page"), F.col("pos").cast("long").alias("link_pos"))


def paragraph_courses(pages: DataFrame, index_url: Column | str, href_prefix: str = P5_PREFIX,
                      base: str = P5_BASE) -> DataFrame:
    """P5: subject pages -> ``p strong`` headers -> the parent's markup split
    on ``<br/>`` (first part skipped) -> rule cascade; a COREQUISITE line is
    appended to the prerequisite; ``891*/892*`` gives one row per number."""
    subj = subject_links(pages, index_url, href_prefix, base)
    sp = _pages_at(pages, subj, "link")
    nodes = staged_nodes(pages.join(sp.select(PID), PID, "left_semi"))
    st = texts(nodes, sel(tag="p"), sel(tag="strong")).withColumn("txt", utrim("text"))
    st = st.filter(_m("txt", P5_TITLE)).select(
        PID, F.col("pos").alias("spos"), "parent",
        _x("txt", P5_TITLE, 1).alias("courseCode"), _x("txt", P5_TITLE, 2).alias("numericCode"),
        clean(_x("txt", P5_TITLE, 3)).alias("name"))
    par = markup(at_positions(nodes, parents_of(st.withColumnRenamed("spos", "pos"))), F.col("_at"))
    par = par.select(PID, F.col("pos").alias("parent"), "html")
    pc = st.join(par, [PID, "parent"]).select(
        PID, "spos", F.posexplode(split_literal("html", "<br/>")).alias("i", "piece")).filter("i > 0")
    pc = pc.withColumn("v", utrim("piece"))
    pc = pc.withColumn("kind", F.when(_m("v", P5_PRE), "pre").when(_m("v", P5_EXCL), "excl")
                       .when(_m("v", P5_CO), "co").otherwise("text"))
    pc = (pc.withColumn("pre", F.when(F.col("kind") == "pre", clean(_x("v", P5_PRE, 1))))
            .withColumn("co", F.when(F.col("kind") == "co", _x("v", P5_CO, 1))))
    keys = [PID, "spos"]
    pre = _fold_overwrite(pc, keys, "i", "pre", "pre", "co", "co").withColumnRenamed("value", "_pre")
    rest = pc.groupBy(*keys).agg(
        F.max_by(F.when(F.col("kind") == "excl", clean(_x("v", P5_EXCL, 1))),
                 F.when(F.col("kind") == "excl", F.col("i"))).alias("antirequisite"),
        F.expr("listagg(CASE WHEN kind = 'text' THEN v END, ' ') WITHIN GROUP (ORDER BY i)").alias("_d"))
    c = (st.join(pre, keys, "left").join(rest, keys, "left")
           .withColumn("prerequisite", clean(F.coalesce("_pre", F.lit(""))))
           .withColumn("description", clean(F.coalesce("_d", F.lit("")))))
    c = c.join(sp.select(PID, F.col("name").alias("SubjectName"), "index_page", "link_pos"), PID)
    c = G.explode_numbers(c, "numericCode", "numericCode", "_k")   # X1: none -> no row
    return course_frame(c, "paragraphs", ["index_page", "link_pos", "spos", "_k"])


# ============================================================== P10

# The data-title pattern and the three markup patterns.
P10_TITLE = r"COMM\s*(.*):\s*(.*)"
P10_PRE = r"Prerequisite\s*-\s*(.*?)\s*(?:<br/>|</p>)"
P10_CO = r"Corequisite\s*-\s*(.*)\s*"
P10_EXCL = r"Exclusions\s*-\s*(.*)\s*"
P10_BASE = "https://smith.queensu.ca"


def modal_courses(pages: DataFrame, index_url: Column | str, base: str = P10_BASE) -> DataFrame:
    """P10: ``a.modal_frame`` links (number and name from ``data-title``) ->
    detail pages (first ``description p`` text; prerequisite, corequisite,
    exclusions from the ``description`` markup); code is the constant
    ``COMM``; a ``301/302`` number becomes one row per number (X2)."""
    a = staged_nodes(_at(pages, index_url)).filter(sel(tag="a", cls="modal_frame"))
    dt = H.attr("data-title")
    lk = a.select(F.col(PID).alias("index_page"), F.col("pos").cast("long").alias("link_pos"), L.prefix_url(base, H.attr("href")).alias("link"),
                  _x(dt, P10_TITLE, 1).alias("numericCode"), clean(_x(dt, P10_TITLE, 2)).alias("name"))
    dp = _pages_at(pages, lk, "link")
    nodes = staged_nodes(pages.join(dp.select(PID), PID, "left_semi"))
    desc = first_of(texts(nodes, sel(tag="description"), sel(tag="p")), "text", "description")
    h = first_of(markup(nodes, sel(tag="description")), "html", "h")
    c = dp.join(desc, PID, "left").join(h, PID, "left").withColumn("h", F.coalesce("h", F.lit("")))
    c = c.select("*", clean(_x("h", P10_PRE, 1)).alias("prerequisite"),
                 clean(_x("h", P10_CO, 1)).alias("corequisite"),
                 clean(_x("h", P10_EXCL, 1)).alias("antirequisite"),
                 F.lit("COMM").alias("courseCode")).drop("link")
    c = G.explode_if_slash(c, "numericCode", "numericCode", "_k")   # X2
    return course_frame(c, "modal", ["index_page", "link_pos", "_k"])


# ============================================================== P12

# Header, description-line and prerequisite patterns.
P12_TITLE = r"^([A-Z]{4})\s*([\d/\.]+)\s*(.*)"
P12_DESC = r"</strong>.*\n(.*)"
P12_PRE = r"PREREQUISITE:\s*(.*)"


def strong_courses(pages: DataFrame) -> DataFrame:
    """``p strong`` headers; description is the line after the header
    in the parent's markup, else the next sibling's markup; the
    prerequisite is searched in whichever markup gave the description."""
    nodes = staged_nodes(pages)
    st = markup(nodes, sel(tag="p"), sel(tag="strong")).withColumn("hh", clean("html"))
    st = st.filter(_m("hh", P12_TITLE)).select(
        PID, F.col("pos").alias("spos"), "parent", _x("hh", P12_TITLE, 3).alias("name"),
        _x("hh", P12_TITLE, 2).alias("numericCode"), _x("hh", P12_TITLE, 1).alias("courseCode"))
    el = H.siblings(nodes.filter("is_elem")).select(PID, "pos", F.col("next_pos"))
    st = st.join(el.withColumnRenamed("pos", "parent").withColumnRenamed("next_pos", "pnext"), [PID, "parent"], "left")
    want = st.select(PID, F.col("parent").alias("pos")).union(
        st.select(PID, F.col("pnext").alias("pos"))).filter(F.col("pos").isNotNull())
    mk = markup(at_positions(nodes, want), F.col("_at")).select(PID, "pos", "html")
    c = (st.join(mk.withColumnRenamed("pos", "parent").withColumnRenamed("html", "ph"), [PID, "parent"], "left")
           .join(mk.withColumnRenamed("pos", "pnext").withColumnRenamed("html", "nh"), [PID, "pnext"], "left"))
    d1 = clean(_x(F.coalesce("ph", F.lit("")), P12_DESC, 1))
    c = c.withColumn("_d1", d1)
    c = c.withColumn("h", F.when(F.col("_d1") != "", F.col("ph")).otherwise(F.coalesce("nh", F.lit(""))))
    c = c.withColumn("description", F.when(F.col("_d1") != "", F.col("_d1")).otherwise(clean("h")))
    c = c.withColumn("prerequisite", clean(_x("h", P12_PRE, 1)))
    return course_frame(c, "strong", [PID, "spos"])


# ============================================================== P8

# The course-code pattern.
P8_CODE = r"^([A-Z]+)\s*(\d+)"
P8_PREFIX, P8_BASE = "/content/ryerson/calendar/2020-2021/courses/", "http://www.ryerson.ca"


def list_item_courses(pages: DataFrame, index_url: Column | str, href_prefix: str = P8_PREFIX,
                      base: str = P8_BASE) -> DataFrame:
    """Subject links (label without its trailing parenthetical) ->
    ``li.courseListItem`` items; pre- and antirequisite links joined by
    ``;`` in order (A4), other fields from class-selected children."""
    subj = subject_links(pages, index_url, href_prefix, base,
                         label=lambda t: strip_trailing_paren(clean(t)))
    sp = _pages_at(pages, subj, "link")
    nodes = staged_nodes(pages.join(sp.select(PID), PID, "left_semi"))
    li = sel(tag="li", cls="courseListItem")
    items = nodes.filter(li).select(PID, F.col("pos").alias("owner"))

    def joined(container: str, name: str):
        m = H.mark_path(nodes, sel(cls=container), sel(tag="a"), name="_w")
        t = scoped_texts(m, li, F.col("_w"))
        return t.groupBy(PID, "owner").agg(
            F.expr("listagg(trim(text), ';') WITHIN GROUP (ORDER BY pos)").alias(name))

    def field(container: str, name: str, f):
        t = scoped_texts(nodes, li, sel(cls=container))
        g = t.groupBy(PID, "owner").agg(F.expr("listagg(text, '') WITHIN GROUP (ORDER BY pos)").alias("_v"))
        return g.select(PID, "owner", f(F.col("_v")).alias(name))

    c = items
    for df in (joined("courseListPrerequisites", "prerequisite"),
               joined("courseListAntirequisites", "antirequisite"),
               field("courseListDescription", "description", clean),
               field("courseListCourseCode", "_code", utrim),
               field("courseListCourseName", "name", clean)):
        c = c.join(df, [PID, "owner"], "left")
    code = F.coalesce("_code", F.lit(""))
    c = c.withColumn("courseCode", _x(code, P8_CODE, 1)).withColumn("numericCode", _x(code, P8_CODE, 2))
    c = c.join(sp.select(PID, F.col("name").alias("SubjectName"), "index_page", "link_pos"), PID)
    return course_frame(c, "list_items", ["index_page", "link_pos", "owner"])


# ============================================================== P9

# The outline name pattern and the outline link prefix.
P9_NAME = r"^([A-Z]{3})(\d{3})\s*-\s*(.*)$"
P9_OUTLINE = "https://apps.senecacollege.ca/ssos/findOutline.do?subjectCode="
P9_BASE, P9_PROGRAMS = "https://www.senecacollege.ca", "/programs/fulltime/"


def outline_courses(pages: DataFrame, index_url: Column | str, base: str = P9_BASE) -> DataFrame:
    """Programme list (``.html`` -> ``/courses.html`` once) -> outline
    links deduplicated per page with the programme's own h1 text as subject
    -> outline pages (description with two fallbacks, name by pattern);
    rows without a name dropped (F1, F4) and duplicates on five fields
    removed keeping the first (D1)."""
    a = staged_nodes(_at(pages, index_url)).filter(sel(tag="a", attr_prefix={"href": P9_PROGRAMS}))
    prog = a.select(F.col(PID).alias("index_page"), F.col("pos").cast("long").alias("prog_pos"),
                    L.prefix_url(base, L.rewrite_first(H.attr("href"), r"\.html", "/courses.html")).alias("link"))
    pp = _pages_at(pages, prog, "link")
    pn = staged_nodes(pages.join(pp.select(PID), PID, "left_semi"))
    own = H.own_text(pn).filter(F.col("tag") == "h1")
    subj = own.groupBy(PID).agg(F.expr("listagg(own_text, '') WITHIN GROUP (ORDER BY pos)").alias("_s")) \
              .select(PID, clean("_s").alias("SubjectName"))
    ol = pn.filter(sel(tag="a", attr_prefix={"href": P9_OUTLINE})).select(PID, "pos", H.attr("href").alias("href"))
    ol = L.dedup_links_in_page(ol)
    pairs = ol.join(subj, PID, "left").join(pp.select(PID, "index_page", "prog_pos"), PID).select(
        "index_page", "prog_pos", F.col("pos").cast("long").alias("olink_pos"), F.col("href").alias("Link"),
        F.coalesce("SubjectName", F.lit("")).alias("SubjectName"))
    op = _pages_at(pages, pairs, "Link")
    h1 = [{"tag": "h1"}]
    on = staged_nodes(pages.join(op.select(PID), PID, "left_semi"),
                      {"h1": h1, "hp": [*h1, {"tag": "p"}], "strong": [{"tag": "strong"}], "span": [{"tag": "span"}]}, ["h1", "hp", "strong", "span"])
    tx = IO.staged(marked_texts(on, ["h1", "hp", "strong", "span"], parent=F.col("parent")), "outline-texts")
    label = (F.col("field") == "strong") & (clean("text") == "Subject Description")
    page = tx.groupBy(PID).agg(joined_text("h1", name="h1all"), joined_text("hp"), F.min_by(F.when(label, F.col("parent")), F.when(label, F.col("pos"))).alias("par"))
    # the label's parent, the element after it and the one around it, each by its extent
    pos, end, par = F.col("pos"), F.col("end"), F.col("par")
    ext = lambda hit: F.max(F.when(hit, F.struct("pos", "end")))
    at = on.filter("is_elem").join(page.filter("par is not null").select(PID, "par"), PID).groupBy(PID).agg(
        ext(pos == par).alias("p"), ext(F.col("prev") == par).alias("n"), ext((pos < par) & (end > par)).alias("g"))
    at = IO.staged(at, "outline-extents")
    piece = F.when(F.col("kind") == "raw", H.raw_text()).otherwise(F.col("tok"))
    inside = lambda e: F.coalesce((pos > F.col(f"{e}.pos")) & (pos < F.col(f"{e}.end")), F.lit(False))
    d = on.filter(F.col("kind").isin("text", "raw")).join(at, PID).filter(inside("p") | inside("n"))
    d = d.select(PID, "pos", F.when(inside("p"), piece).alias("pt"), F.when(inside("n"), piece).alias("nt"))
    written = lambda c: decode_entities(F.expr(f"coalesce(listagg({c}, '') WITHIN GROUP (ORDER BY pos), '')")).alias(c)
    d = d.groupBy(PID).agg(written("pt"), written("nt"))
    sp = tx.filter("field = 'span'").join(at, PID).filter(inside("g")).groupBy(PID).agg(joined_text("span", name="span_t"))
    d = at.select(PID).join(d, PID, "left").join(sp, PID, "left")
    d1 = clean(non_ascii(remove_first(F.coalesce("pt", F.lit("")), "Subject Description"), " "))
    d2 = clean(F.coalesce("nt", F.lit("")))
    d3 = clean(non_ascii(F.coalesce("span_t", F.lit("")), ""))
    d = d.select(PID, first_nonempty(d1, d2, d3).alias("description"))
    c = op.join(page.select(PID, "h1all", clean("hp").alias("_nm")), PID, "left").join(d, PID, "left")
    no_outline = F.coalesce(F.col("h1all"), F.lit("")).contains("No Subject Outline could be found.")
    nmv = F.coalesce("_nm", F.lit(""))
    c = c.select("index_page", "prog_pos", "olink_pos",
                 F.when(no_outline, "").otherwise(F.col("SubjectName")).alias("SubjectName"),
                 F.when(no_outline, "").otherwise(F.col("Link")).alias("Link"),
                 F.when(no_outline, "").otherwise(F.coalesce("description", F.lit(""))).alias("description"),
                 F.when(no_outline, "").otherwise(_x(nmv, P9_NAME, 1)).alias("courseCode"),
                 F.when(no_outline, "").otherwise(_x(nmv, P9_NAME, 2)).alias("numericCode"),
                 F.when(no_outline, "").otherwise(_x(nmv, P9_NAME, 3)).alias("name"))
    c = course_frame(c, "outlines", ["index_page", "prog_pos", "olink_pos"]).filter(F.col("name") != "")
    keys = ["SubjectName", "name", "numericCode", "courseCode", "description"]
    return D.first_per_key(c, keys, ["ord"]).drop("n_copies").select(c.columns)


# ============================================================== P4

# Title (with and without credits), subject, prerequisite and restriction
# patterns, and the listing page URL.
P4_TITLE = r"([A-Z]{4})\s*([\dA-Za-z]+)\s*(.*?)\s*\d*\s*\("
P4_TITLE2 = r"([A-Z]{4})\s*([\dA-Za-z]+)\s*(.*)\s*"
P4_SUBJ = r"^(.*?)\s*:\s*(.*)"
P4_PRE = r"^Prerequisite\s*:\s*(.*)"
P4_RESTR = r"^Restriction.*?:\s*(.*)"
P4_PAGE_URL = "https://www.mcgill.ca/study/2020-2021/courses/search?page=%d"
P4_BASE = "https://www.mcgill.ca"


def listing_links(pages: DataFrame, listing_url: str, page_url: str = P4_PAGE_URL,
                  base: str = P4_BASE) -> DataFrame:
    """P4 listing: row links of page 0, the last page number from the pager
    (L9), pages 1..last (L10) whose row links are deduplicated first-wins
    (L8). Page 0's links are not entered in the seen set (as in the
    reference), so they can repeat."""
    first = pages.filter(F.col("url") == listing_url)
    pg = marked(first, {"pager": [{"cls": ["pager-last", "last"]}, {"tag": "a"}]}).filter("pager")
    maxp = pg.groupBy(PID).agg(F.min_by(H.attr("href"), "pos").alias("_h")) \
             .select(L.last_page_number("_h").alias("last_page")).filter("last_page >= 1")
    nums = IO.staged(L.expand_pages(maxp, "last_page").select("page_no", L.template_url(page_url, "page_no").alias("url")), "page-numbers")
    lp = IO.staged(_pages_at(pages, nums, "url").select(PID, "page_no").unionByName(
        first.select(PID, F.lit(0).alias("page_no"))), "listing")
    row = [{"cls": "view-search-courses"}, {"cls": "views-row"}]
    ln = marked(pages.join(lp.select(PID).distinct(), PID, "left_semi"), {"row": row, "link": [*row, {"tag": "a"}]}, ["row"])
    a = ln.filter("link").select(PID, "pos", H.attr("href").alias("href"), F.explode("in_row").alias("owner"))
    firsta = a.groupBy(PID, "owner").agg(F.min_by("href", "pos").alias("href"))
    lk = firsta.join(lp, PID)
    lk = lk.select("page_no", F.col("owner").cast("long").alias("row_pos"),
                   L.prefix_url(base, F.col("href")).alias("link"), "href")
    p0 = lk.filter("page_no = 0")
    rest = D.first_per_key(lk.filter("page_no > 0"), ["href"], ["page_no", "row_pos"]).drop("n_copies")
    return p0.unionByName(rest.select(p0.columns))


def detail_courses(pages: DataFrame, listing_url: str, page_url: str = P4_PAGE_URL) -> DataFrame:
    """Listing links -> detail pages: title by two patterns, subject and
    description from the "Overview" block (last match wins), prerequisite
    and restriction from the notes (last wins); rows without a name dropped."""
    lk = listing_links(pages, listing_url, page_url)
    dp = IO.staged(_pages_at(pages, lk, "link"), "details")
    h3 = [{"cls": "content"}, {"tag": "h3"}]
    dn = marked(pages.join(dp.select(PID).distinct(), PID, "left_semi"),
                {"title": [{"id": "page-title"}], "content": h3[:1], "h3": h3, "after": [*h3, ("+", {})],
                 "note": [{"cls": "catalog-notes"}, {"tag": "p"}]}, ["title", "content", "h3", "after", "note"])
    tx = IO.staged(marked_texts(dn, ["title", "h3", "after", "note"], contents=F.col("in_content")), "detail-texts")
    tx = tx.withColumn("tx", clean("text"))

    def last_rule(p, name):
        hit = (F.col("field") == "note") & _m("tx", p)
        return F.max_by(F.when(hit, clean(_x("tx", p, 1))), F.when(hit, F.col("pos"))).alias(name)
    page = tx.filter(F.col("field").isin("title", "note")).groupBy(PID).agg(
        joined_text("title"), last_rule(P4_PRE, "prerequisite"), last_rule(P4_RESTR, "antirequisite"))
    block = tx.filter(F.col("field").isin("h3", "after")).select(PID, "field", "pos", "text", F.explode("contents").alias("owner"))
    block = block.groupBy(PID, "owner").agg(joined_text("h3"), joined_text("after")).filter(F.col("h3").contains("Overview") & F.col("after").isNotNull())
    dsc = block.groupBy(PID).agg(F.max_by(clean("after"), "owner").alias("desc"))
    c = dp.join(page, PID, "left").join(dsc, PID, "left")
    c = c.withColumn("t", clean("title"))
    t = F.coalesce("t", F.lit(""))
    hit1 = _m(t, P4_TITLE)
    desc = F.coalesce("desc", F.lit(""))
    hit2 = _m(desc, P4_SUBJ)
    c = c.select("page_no", "row_pos", F.col("link").alias("Link"), "prerequisite", "antirequisite",
                 F.when(hit1, _x(t, P4_TITLE, 1)).otherwise(_x(t, P4_TITLE2, 1)).alias("courseCode"),
                 F.when(hit1, _x(t, P4_TITLE, 2)).otherwise(_x(t, P4_TITLE2, 2)).alias("numericCode"),
                 F.when(hit1, _x(t, P4_TITLE, 3)).otherwise(_x(t, P4_TITLE2, 3)).alias("name"),
                 F.when(hit2, clean(_x(desc, P4_SUBJ, 1))).otherwise(clean(desc)).alias("SubjectName"),
                 F.when(hit2, clean(_x(desc, P4_SUBJ, 2))).otherwise(F.lit("")).alias("description"))
    return course_frame(c, "detail", ["page_no", "row_pos"]).filter(F.col("name") != "")


# ============================================================== P6

# The site base and the course-code pattern.
P6_BASE = "https://courses.students.ubc.ca"
P6_CODE = r"^([A-Z]+)\s*(\d.*)"
def _p6_select(href_prefix: str | None = None) -> dict[str, list]:
    """The marked selectors of a table page: its course rows, their cells, and the cells with their links."""
    row = {"tag": "tr", "attr_prefix": {"class": "section"}}
    link = {"tag": "a", "attr_prefix": {"href": href_prefix}} if href_prefix else {"tag": "a"}
    return {"row": [row], "cell": [row, {"tag": "td"}], "td": [{"tag": "td"}], "link": [{"tag": "td"}, link]}


_P6_SCOPES = ["row", "cell", "td"]


def _row_cells(nodes: DataFrame) -> DataFrame:
    """Cells of ``tr[class^=section]`` rows: (page_id, owner, i, text,
    href of the first matching link in the cell)."""
    cells = marked_texts(nodes, ["cell"], rows=F.col("in_row")).select(PID, "pos", "text", F.explode("rows").alias("owner"))
    cells = cells.withColumn("i", F.row_number().over(Window.partitionBy(PID, "owner").orderBy("pos")) - 1)
    first = nodes.filter("link").select(PID, F.col("pos").alias("at"), H.attr("href").alias("href"), F.explode("in_td").alias("pos")) \
                 .groupBy(PID, "pos").agg(F.min_by("href", "at").alias("href"))
    return cells.join(first, [PID, "pos"], "left")


def table_courses(pages: DataFrame, start_url: Column | str, base: str = P6_BASE) -> DataFrame:
    """Subject rows (cells by position, F2) -> subject page (description
    = element before the first pagination div; course rows) -> course page
    (``h4+p`` description, first "Pre-reqs:" / "Equivalents:" paragraph)."""
    c0 = _row_cells(staged_nodes(_at(pages, start_url), _p6_select(), _P6_SCOPES))
    rows = c0.groupBy(PID, "owner").agg(
        F.max(F.when(F.col("i") == 0, utrim("text"))).alias("code"),
        F.max(F.when(F.col("i") == 0, F.concat(F.lit(base), F.coalesce("href", F.lit(""))))).alias("link"),
        F.max(F.when(F.col("i") == 1, utrim("text"))).alias("SubjectName"))
    rows = rows.filter((F.coalesce("code", F.lit("")) != "") & (F.col("link") != base)) \
               .select(F.col(PID).alias("start_page"), F.col("owner").cast("long").alias("row_pos"), "link", "SubjectName")
    p1 = IO.staged(_pages_at(pages, rows, "link"), "subjects")
    n1 = staged_nodes(pages.join(p1.select(PID).distinct(), PID, "left_semi"),
                      {**_p6_select("/cs/courseschedule?pname="), "pag": [{"tag": "div", "cls": "pagination"}]}, _P6_SCOPES)
    pag = n1.filter("pag").groupBy(PID).agg(F.min_by("prev", "pos").alias("pos"))
    dtx = texts(at_positions(n1, pag.filter(F.col("pos").isNotNull())), F.col("_at"))
    desc = dtx.select(PID, clean("text").alias("SubjectDescription"))
    c1 = _row_cells(n1)
    cr = c1.groupBy(PID, "owner").agg(
        F.max(F.when(F.col("i") == 0, F.concat(F.lit(base), F.coalesce("href", F.lit(""))))).alias("clink"),
        F.max(F.when(F.col("i") == 0, clean("text"))).alias("_t0"),
        F.max(F.when(F.col("i") == 1, clean("text"))).alias("name"))
    cr = cr.select(PID, F.col("owner").cast("long").alias("crow_pos"), "clink", "name",
                   _x(F.coalesce("_t0", F.lit("")), P6_CODE, 1).alias("courseCode"),
                   _x(F.coalesce("_t0", F.lit("")), P6_CODE, 2).alias("numericCode"))
    lvl1 = cr.join(p1.select(PID, "start_page", "row_pos", "SubjectName"), PID).join(desc, PID, "left").drop(PID)
    p2 = IO.staged(_pages_at(pages, lvl1, "clink", "left", "p2"), "courses")
    n2 = marked(pages.join(p2.select(F.col("p2").alias(PID)).distinct(), PID, "left_semi"),
                {"after": [{"tag": "h4"}, ("+", {"tag": "p"})], "main": [{"tag": "div", "attr_eq": {"role": "main"}}, {"tag": "p"}]}, ["after", "main"])
    tx = marked_texts(n2, ["after", "main"]).withColumn("tx", clean("text"))

    def first_prefixed(prefix, name):
        hit = (F.col("field") == "main") & F.col("tx").startswith(prefix)
        return F.min_by(F.when(hit, utrim(trim_prefix("tx", prefix))), F.when(hit, F.col("pos"))).alias(name)
    pq = tx.groupBy(F.col(PID).alias("p2")).agg(joined_text("after", name="description"), first_prefixed("Pre-reqs:", "prerequisite"),
                                                first_prefixed("Equivalents:", "oneWayExclusion"))
    c = p2.join(pq, "p2", "left")
    return course_frame(c, "tables", ["start_page", "row_pos", "crow_pos"])


# ============================================================== P7

# The outline prefix and the description pattern.
P7_PREFIX = "https://ulysses.sheridanc.on.ca/coutline/"
P7_DESC = r"(?s)Detailed Description(.*?)Program Context"


def outline_link_list(pages: DataFrame, listing_url: Column | str, code: str = "") -> DataFrame:
    """P7 listing -> link list (K5): ``#detail_table a`` with the subject
    label taken two element siblings after the link's parent."""
    n = staged_nodes(_at(pages, listing_url))
    a = H.mark_path(n, sel(id="detail_table"), sel(tag="a"), name="_a").filter("_a")
    el = n.filter("is_elem")
    w = Window.partitionBy(PID, "parent").orderBy("pos")
    nn = el.select(PID, "pos", F.lead("pos", 2).over(w).alias("nn"))
    a = a.select(PID, F.col("pos").alias("apos"), F.col("parent").alias("pos"), H.attr("href").alias("Link"))
    a = a.join(nn, [PID, "pos"], "left")
    t = texts(at_positions(n, a.select(PID, F.col("nn").alias("pos")).filter(F.col("pos").isNotNull())),
              F.col("_at")).select(PID, F.col("pos").alias("nn"), utrim("text").alias("SubjectName"))
    out = a.join(t, [PID, "nn"], "left")
    return out.select(F.col(PID).alias("list_page"), F.col("apos").cast("long").alias("link_pos"), "Link",
                      F.coalesce("SubjectName", F.lit("")).alias("SubjectName"), F.lit(code).alias("Code"))


def link_file_courses(links: DataFrame, pages: DataFrame, prefix: str = P7_PREFIX) -> DataFrame:
    """Link file rows (Link, SubjectName, Code; S2) -> outline pages:
    code and number from the query string (L4), name with a fallback
    selector (T16), description by pattern over the page text; the subject
    name and code come from the link row."""
    lk = links.select("list_page", "link_pos", F.concat(F.lit(prefix), F.col("Link")).alias("full"),
                      "SubjectName", F.col("Code").alias("SubjectCode"))
    lk = lk.withColumn("numericCode", L.query_param("full", "courseCode")) \
           .withColumn("courseCode", L.query_param("full", "subjectCode"))
    dp = _pages_at(pages, lk, "full", "left")
    n = staged_nodes(pages.join(dp.select(PID), PID, "left_semi"))
    h = selection_text(texts(n, sel(cls="CourseTitleHeading"))).select(PID, clean("value").alias("_h"))
    f5 = selection_text(texts(n, sel(tag="font", attr_eq={"size": "5"}))).select(PID, clean("value").alias("_f"))
    dt = document_text(n)
    c = dp.join(h, PID, "left").join(f5, PID, "left").join(dt, PID, "left")
    c = c.select("*", first_nonempty(F.coalesce("_h", F.lit("")), F.coalesce("_f", F.lit(""))).alias("name"),
                 clean(_x(F.coalesce("doc_text", F.lit("")), P7_DESC, 1)).alias("description"),
                 F.col("full").alias("Link"))
    return course_frame(c, "link_file", ["list_page", "link_pos"])


# ============================================================== P3

# The site base, the listing URL around the prefix, the detail URL template
# and its display-options value.
P3_BASE = "https://calendar.engineering.queensu.ca/"
P3_LISTING = ("https://calendar.engineering.queensu.ca/content.php?filter%5B27%5D=",
              "&filter%5B29%5D=&filter%5Bcourse_type%5D=-1&filter%5Bkeyword%5D=&filter%5B32%5D=1"
              "&filter%5Bcpage%5D=1&cur_cat_oid=9&expand=&navoid=233&search_database=Filter"
              "#acalog_template_course_filter")
P3_DETAIL = "https://calendar.engineering.queensu.ca/ajax/preview_course.php?catoid=%s&coid=%s&display_options=%s&show"
P3_OPTIONS = "a:2:{s:8:~location~;s:8:~template~;s:28:~course_program_display_field~;N;})"
P3_H3 = r"^([A-Z]+)\s*([A-Z]?\d+)\s*(.*?)\s*$"
P3_DESC = r"(?s)Tutorial:.*?<br/>(.*?)(?:<br/>)+Academic"
P3_PRE = r"PREREQUISITE\(S\):\s*(.*?)EXCLUSION\(S\)"
P3_PRE2 = r"(?m)PREREQUISITE\(S\):\s*(.*?)$"
P3_EXCL = r"(?m)EXCLUSION\(S\):\s*(.*?)$"


def catalog_courses(pages: DataFrame, index_url: Column | str) -> DataFrame:
    """Prefix options (first skipped, H14) -> listing per prefix
    (subject = last header cell, H12) -> detail pages (L3 + L4 + L10)
    with h3 and text patterns, prerequisite with a fallback (T16)."""
    n0 = staged_nodes(_at(pages, index_url))
    op = H.mark_path(n0, sel(id="courseprefix"), sel(tag="option"), name="_o").filter("_o")
    op = op.withColumn("_i", F.row_number().over(Window.partitionBy(PID).orderBy("pos")))
    ab = op.filter((F.col("_i") > 1) & H.has_attr("value")).select(
        F.col(PID).alias("index_page"), F.col("pos").cast("long").alias("abbr_pos"), H.attr("value").alias("abbr"))
    ab = ab.withColumn("lurl", F.concat(F.lit(P3_LISTING[0]), F.col("abbr"), F.lit(P3_LISTING[1])))
    lp = IO.staged(_pages_at(pages, ab, "lurl"), "prefixes")
    n1 = staged_nodes(pages.join(lp.select(PID).distinct(), PID, "left_semi"), {
        "subject": [{"tag": "table", "cls": "table_default"}, {"tag": "td", "attr_eq": {"colspan": "2"}}, {"tag": "strong"}],
        "course": [{"tag": "a", "attr_prefix": {"href": "preview_course_nopop.php?catoid="}}]}, ["subject"])
    subj = first_of(marked_texts(n1, ["subject"]), "text", "SubjectName", last=True)
    u = L.resolve_url(F.lit(P3_BASE), H.attr("href"))
    a = n1.filter("course").select(PID, F.col("pos").cast("long").alias("link_pos"),
                 F.format_string(P3_DETAIL, L.query_param(u, "catoid"), L.query_param(u, "coid"),
                                 F.lit(P3_OPTIONS)).alias("clink"))
    rows = a.join(subj, PID, "left").join(lp.select(PID, "index_page", "abbr_pos"), PID).drop(PID)
    dp = IO.staged(_pages_at(pages, rows, "clink", "left"), "courses")
    # heading, markup and text of a page in one grouping
    e = H.markup_events(marked(pages.join(dp.select(PID).distinct(), PID, "left_semi"), {"h3": [{"tag": "h3"}]}, ["h3"]))
    said = F.when(F.col("ord") == 1, F.when(F.col("kind") == "raw", H.raw_text()).when(F.col("kind") == "text", F.col("tok")))
    e = e.select(PID, "at", "ord", "inner", "piece", said.alias("said"), F.when(F.size("in_h3") > 0, said).alias("heading"))
    joined = lambda c: decode_entities(F.expr(f"coalesce(listagg({c}, '') WITHIN GROUP (ORDER BY at), '')"))
    page = e.groupBy(PID).agg(F.expr("listagg(piece, '') WITHIN GROUP (ORDER BY at, ord, inner)").alias("doc_html"),
                              joined("said").alias("doc_text"), utrim(joined("heading")).alias("h3"))
    c = dp.join(page, PID, "left")
    h3c, hh, tt = (F.coalesce(x, F.lit("")) for x in ("h3", "doc_html", "doc_text"))
    c = c.select("index_page", "abbr_pos", "link_pos", F.coalesce("SubjectName", F.lit("")).alias("SubjectName"),
                 _x(h3c, P3_H3, 1).alias("courseCode"), _x(h3c, P3_H3, 2).alias("numericCode"),
                 _x(h3c, P3_H3, 3).alias("name"), clean(_x(hh, P3_DESC, 1)).alias("description"),
                 first_nonempty(clean(_x(tt, P3_PRE, 1)), clean(_x(tt, P3_PRE2, 1))).alias("prerequisite"),
                 clean(_x(tt, P3_EXCL, 1)).alias("antirequisite"))
    return course_frame(c, "catalog", ["index_page", "abbr_pos", "link_pos"])


# ============================================================== P1

def html_description(docs: DataFrame) -> DataFrame:
    """Description page -> text: document text, tags stripped, trimmed and
    unescaped once more (as the reference does)."""
    n = staged_nodes(docs.select(PID, "html"))
    return document_text(n).select(PID, decode_entities(utrim(strip_tags("doc_text"))).alias("Description"))


def html_prerequisites(docs: DataFrame) -> DataFrame:
    """A4 over a prerequisite table: non-empty cells of a row joined by " ",
    rows joined by ";" (a row without cells still counts), one leading ";"
    dropped."""
    n = staged_nodes(docs.select(PID, "html"))
    cells = scoped_texts(n, sel(tag="tr"), sel(tag="td")).withColumn("cell", decode_entities(utrim("text")))
    rows = n.filter(sel(tag="tr")).select(PID, F.col("pos").alias("owner"))
    cg = cells.filter(F.col("cell") != "").groupBy(PID, "owner").agg(
        F.expr("listagg(cell, ' ') WITHIN GROUP (ORDER BY pos)").alias("_r"))
    r = rows.join(cg, [PID, "owner"], "left").withColumn("row", utrim(F.coalesce("_r", F.lit(""))))
    g = r.groupBy(PID).agg(F.expr("listagg(row, ';') WITHIN GROUP (ORDER BY owner)").alias("_j"))
    return g.select(PID, trim_prefix("_j", ";").alias("Prerequisite"))


def section_courses(terms: DataFrame, classes: DataFrame, searches: DataFrame,
                    descriptions: DataFrame, prerequisites: DataFrame, n_terms: int = 3,
                    max_per_subject: int | None = None) -> DataFrame:
    """The first ``n_terms`` terms (O1) x their subjects (terms without
    subjects skipped, F7) x search sections (S3) enriched 1:1 by
    (term, CRN) with description and prerequisite (J2); enrollment with
    Available = Max - Actual (T19)."""
    t = S.code_pairs(terms).select(F.col("o").alias("t_ord"), F.col("code").alias("TermCode"),
                                            F.col("description").alias("TermName"))
    t = S.first_terms(t, "t_ord", n_terms)
    cl = S.code_pairs(classes, keep=["term_code"]).select(
        F.col("term_code").alias("TermCode"), F.col("o").alias("c_ord"),
        F.col("code").alias("SubjectCode"), F.col("description").alias("SubjectName"))
    tc = t.join(cl, "TermCode")
    sr = searches.select(F.col("term_code").alias("TermCode"), F.col("subject_code").alias("SubjectCode"),
                         "body")
    sr = S.search_sections(sr, keep=["TermCode", "SubjectCode"])
    s = tc.join(sr, ["TermCode", "SubjectCode"])
    s = S.cap_per_group(s, ["TermCode", "SubjectCode"], ["s_ord"], max_per_subject)   # O2, off by default
    s = S.enrollment(s, F.col("enrollment"), F.col("maximumEnrollment"), F.col("waitCount"), F.col("waitCapacity"))
    dsc = html_description(descriptions).join(descriptions.select(PID, "term", "crn"), PID).drop(PID)
    pre = html_prerequisites(prerequisites).join(prerequisites.select(PID, "term", "crn"), PID).drop(PID)
    key = [F.col("term").alias("term"), F.col("courseReferenceNumber").alias("crn")]
    s = s.select("*", *key)
    s = S.enrich(s, [(dsc, ["term", "crn"]), (pre, ["term", "crn"])])
    return s.select(
        F.struct(F.col("t_ord").cast("long").alias("o0"), F.col("c_ord").cast("long").alias("o1"),
                 F.col("s_ord").cast("long").alias("o2")).alias("ord"),
        "TermCode", "TermName", "SubjectCode", "SubjectName", F.col("id").alias("CourseID"),
        F.col("subject").alias("CourseCode"), F.col("courseNumber").alias("NumericCode"),
        F.col("campusDescription").alias("Campus"), decode_entities("courseTitle").alias("CourseTitle"),
        F.col("courseReferenceNumber").alias("CourseReferenceNumber"), F.col("sequenceNumber").alias("Section"),
        F.coalesce("Description", F.lit("")).alias("Description"),
        F.coalesce("Prerequisite", F.lit("")).alias("Prerequisite"), F.lit("").alias("CrossListed"),
        "Enrollment")


def section_export(courses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """P1 export: term ids and (term, subject) ids from 1 by first
    appearance (A6, A7, A3); course rows keep ids and lose the term and
    subject texts. Returns (courses, terms, subjects)."""
    t = courses.groupBy("TermCode").agg(F.min("ord").alias("_f"), F.min_by("TermName", "ord").alias("TermName"))
    t = D.dense_ids(t, ["_f"], name="TermID", base=1)
    sj = courses.groupBy("TermCode", "SubjectCode").agg(
        F.min("ord").alias("_f"), F.min_by("SubjectName", "ord").alias("SubjectName"))
    sj = D.dense_ids(sj, ["_f"], name="subjectId", base=1)
    sj = sj.join(t.select("TermCode", "TermID"), "TermCode")
    c = courses.join(t.select("TermCode", "TermID"), "TermCode").join(
        sj.select("TermCode", "SubjectCode", "subjectId"), ["TermCode", "SubjectCode"])
    c = c.drop("TermCode", "TermName", "SubjectCode", "SubjectName")
    terms = t.select("TermID", "TermName", "TermCode")
    subjects = sj.select("subjectId", F.col("TermID").alias("termID"),
                         decode_entities("SubjectName").alias("name"), F.array("SubjectCode").alias("codes"))
    return c, terms, subjects


def write_section_export(courses: DataFrame, out: str, prefix: str = "sections") -> None:
    """K1 + K3 + K4 + K2 for P1: raw rows, courses with ids (term and
    subject texts blanked), terms and term-scoped subjects as JSON lines."""
    courses = IO.staged(courses, f"{prefix}-rows")
    c, t, sj = section_export(courses)
    IO.write_json(courses.drop("ord"), f"{out}/{prefix}-raw", omit_empty=False)
    IO.write_json(c.drop("ord"), f"{out}/{prefix}-courses", omit_empty=False)
    IO.write_json(t, f"{out}/{prefix}-terms", omit_empty=False)
    IO.write_json(sj, f"{out}/{prefix}-subjects", omit_empty=False)


# ============================================================== P0

# The JSON fields of a course, those left out when empty, and the CSV columns.
COURSE_JSON = ["subjectId", "SubjectName", "Link", "name", "numericCode", "courseCode", "description",
               "prerequisite", "antirequisite", "corequisite", "oneWayExclusion", "crosslisted"]
OMIT_EMPTY = {"SubjectName", "Link", "corequisite", "oneWayExclusion", "crosslisted"}
ENROLLMENT = "struct<Enrolled:struct<Actual:int,Max:int,Available:int>,Waitlist:struct<Actual:int,Max:int,Available:int>>"
CSV_COLUMNS = [("SubjectID", "subjectId"), ("SubjectName", "SubjectName"),
               ("SubjectDescription", None), ("Name", "name"), ("NumericCode", "numericCode"),
               ("CourseCode", "courseCode"), ("Description", "description"),
               ("Prerequisite", "prerequisite"), ("Antirequisite", "antirequisite"),
               ("Corequisite", "corequisite"), ("OneWayExclusion", "oneWayExclusion"),
               ("CrossListed", "crosslisted")]


def export(courses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Subject dimension (A1-A3: ids from 0 by first appearance,
    first description, codes distinct in first-seen order; all rows
    without a subject share the subject ``""``) and every course with its
    subject id (J1). Returns (courses, subjects)."""
    subj = D.subject_dim(courses, name_col="SubjectName", code_col="courseCode",
                         desc_col="SubjectDescription", order="ord")
    c = D.attach_ids(courses, subj.select(F.col("name").alias("SubjectName"), "subjectId"),
                     ["SubjectName"], "subjectId")
    return c, subj.drop("_first")


def courses_json(courses: DataFrame, keep: list[str] = ()) -> DataFrame:
    """K1/K3/K8: the JSON shape of a course: hidden fields dropped, omitempty
    fields NULL when empty (the writer then leaves them out), an enrollment only
    where the source has one, and subject 0 before ids are given."""
    have = {c.lower(): c for c in courses.columns}
    own = courses if "subjectid" in have else courses.withColumn("subjectId", F.lit(0).cast("long"))
    enrollment = F.col(have["enrollment"]) if "enrollment" in have else F.lit(None).cast(ENROLLMENT)
    return own.select(*[(F.nullif(F.col(c), F.lit("")) if c in OMIT_EMPTY else F.col(c)).alias(c)
                        for c in COURSE_JSON], enrollment.alias("enrollment"), *keep)


def subjects_json(subjects: DataFrame) -> DataFrame:
    """K2: subjectId, name, codes, description (omitted when empty)."""
    return subjects.select("subjectId", "name", "codes",
                           F.nullif(F.coalesce("description", F.lit("")), F.lit("")).alias("description"))


def write_export(courses: DataFrame, out: str, prefix: str, rows_per_file: int | None = None) -> tuple[DataFrame, DataFrame]:
    """K1-K3: ``<prefix>-raw`` (rows before ids), ``<prefix>-subjects`` and
    ``<prefix>-courses`` as JSON lines under ``out``. With ``rows_per_file`` the courses lie in a folder for each
    source, in files of at most that many rows."""
    courses = IO.staged(courses, f"{prefix}-rows")   # computed once; the rest reads it back
    c, s = export(courses)
    IO.write_json(courses_json(courses), f"{out}/{prefix}-raw", omit_empty=False)
    IO.write_json(subjects_json(s), f"{out}/{prefix}-subjects", omit_empty=False)
    if rows_per_file:
        IO.write_json_by(courses_json(c, ["source"]), f"{out}/{prefix}-courses", ["source"], rows_per_file, omit_empty=False)
    else:
        IO.write_json(courses_json(c), f"{out}/{prefix}-courses", omit_empty=False)
    return c, s


def courses_csv(courses_with_ids: DataFrame) -> DataFrame:
    """K6: the 12 flat CSV columns, headed by the field names."""
    return courses_with_ids.select(*[(F.col(src) if src else F.lit("")).alias(h) for h, src in CSV_COLUMNS])


def filter_code(courses: DataFrame, code: str) -> DataFrame:
    """K7: courses of one code, projected to (Name, NumericCode)."""
    return courses.filter(F.col("courseCode") == code).select(
        F.col("name").alias("Name"), F.col("numericCode").alias("NumericCode"))
