"""The pipelines P0-P12 as registered queries.

The test tables hold no catalogue pages, so each query first renders its input:
rows of ``part`` (or ``orders``) written out as the listing, detail, table, list, text and JSON
shapes that a pipeline reads, with end tags left out, awkward attributes, character
references, missing fields, repeated links and pages that never landed. Rendering
gives rows only; the pipeline does all the work on them. The oracle is a plain
SELECT over the source columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import io as IO
from . import pipelines as P

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# Expressions that both engines read: a part's key, code, number and name, and
# the name as markup; the group (subject) and the site section that it is in.
K = "p_partkey"
CODE = "upper(left(p_type, 4))"
NUM = f"cast(100 + {K} as string)"
NAME = f"concat(p_name, case when {K} % 6 = 0 then ' & co' else '' end)"
NAME_HTML = f"concat(p_name, case when {K} % 6 = 0 then ' &amp; co' else '' end)"
SUBJ = f"cast(floor({K} / 40) as bigint)"
SITE = f"cast(floor({K} / 800) as bigint)"


def register(name: str, sql: str):
    def deco(fn):
        QUERIES[name] = fn
        ORACLE[name] = sql
        return fn
    return deco


def parts(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select("*", *[F.expr(e).alias(n) for n, e in (
        ("k", K), ("code", CODE), ("num", NUM), ("name_html", NAME_HTML), ("s", SUBJ), ("site", SITE))])


def page(df: DataFrame, kind: int, key: str, url: str, html: str) -> DataFrame:
    """Pages of one kind: ids that no other kind has, url and html by expression."""
    return df.select((F.expr(f"cast({key} as bigint)") * 10 + kind).alias("page_id"), F.expr(url).alias("url"), F.expr(html).alias("html"))


def joined(df: DataFrame, by: list[str], block: str) -> DataFrame:
    """One row for each value of ``by`` with the blocks of its rows, in order, as ``body``."""
    return df.withColumn("_b", F.expr(block)).groupBy(*by).agg(F.expr("listagg(_b, '') within group (order by k)").alias("body"))


def union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def landed(render):
    """The rendered pages as a landed table: a pipeline that reads several levels doesn't render them again for each."""
    def pages(spark, sf):
        return IO.staged(render(spark, sf), "rendered")
    return pages


def subjects(p: DataFrame) -> DataFrame:
    return p.groupBy("s", "site").agg(F.min("k").alias("k"))


# ------------------------------------------------------------------ P2

def _p2_pages(spark, sf):
    p = parts(spark, sf)
    block = (
        "concat(case when k % 5 = 0 and s % 4 != 3 then concat('<a name=\"m\" id=\"m\">Area</a> Area ', k, ':<br>\\n') else '' end, "
        "code, ' ', num, case when k % 9 = 8 then concat('<i> Part\\n', name_html) else concat('<i> Part ', name_html) end, '</i> (3 credits)<br>\\n', "
        "'About ', p_brand, '.<br>\\n', "
        "case when k % 3 = 0 then concat('Prerequisite: PRE ', p_size, '. After it.<br>\\n') else '' end, 'More text.<br>\\n', "
        "case when k % 4 = 0 then concat('<i>NOTE: Holders of ', p_size, ' may not take this course.</i><br>\\n') "
        "when k % 4 = 1 then '<i>NOTE: Another note.</i><br>\\n' else '' end)")
    # the last section page has no marker of its courses: it gives no rows
    body = joined(p, ["s"], block)
    head = "case when s % 11 = 10 then '' else '<a name=\"courses\" id=\"art-courses\"></a>\\n' end"
    sections = page(body, 1, "s", f"concat('{P.P2_BASE}{P.P2_PREFIX}', s, '.html')",
                    f"concat('<html><body><h1>Subject ', s, '</h1>\\n<p>intro</p>\\n', {head}, body, '<hr>\\n</body></html>')")
    links = joined(subjects(p), ["site"], (
        f"concat('<a href=\"{P.P2_PREFIX}', s, '.html#a\">x</a><a title=\"a > b\" href=\"{P.P2_PREFIX}', s, '.html#b\">y</a>', "
        "'<a href=\"/other\">z</a>')"))
    return union(sections, page(links, 2, "site", f"concat('{P.P2_INDEX}?part=', site)", "concat('<html><body>', body, '</body></html>')"))


_P2_NEXT_HEAD = f"{K} + 1 <= (select max({K}) from part) and ({K} + 1) % 40 != 0 and ({K} + 1) % 5 = 0 and {SUBJ} % 4 != 3"


@register("p2_calendar", f"""
SELECT {CODE} AS "courseCode", {NUM} AS "numericCode", 'Part ' || {NAME} AS name,
  CASE WHEN {K} % 3 = 0 THEN 'PRE ' || p_size ELSE '' END AS prerequisite,
  CASE WHEN {K} % 4 = 0 THEN 'Holders of ' || p_size || ' may not take this course.' ELSE '' END AS antirequisite,
  (CASE WHEN {K} % 3 = 0 THEN 'After it. More text.' ELSE 'About ' || p_brand || '. More text.' END)
    || CASE WHEN {_P2_NEXT_HEAD} THEN ' Area Area ' || ({K} + 1) || ':' ELSE '' END AS description,
  CASE WHEN {SUBJ} % 4 = 3 THEN 'Subject ' || {SUBJ} ELSE 'Area Area ' || ({K} - {K} % 5) END AS "SubjectName",
  'Subject ' || {SUBJ} AS "SubjectDescription"
FROM part WHERE {SUBJ} % 11 != 10""")
def p2_calendar(spark, sf):
    """P2 with its link stage: index links (fragments dropped, repeats once) ->
    calendar pages -> blocks with headings, prerequisites and notes."""
    c = P.calendar_site(_p2_pages(spark, sf), F.col("url").startswith(P.P2_INDEX))
    return c.select("courseCode", "numericCode", "name", "prerequisite", "antirequisite", "description", "SubjectName",
                    "SubjectDescription")


# ------------------------------------------------------------------ P3

_P3_INDEX = "https://calendar.engineering.queensu.ca/index"


@landed
def _p3_pages(spark, sf):
    p = parts(spark, sf)
    options = joined(subjects(p), ["site"], "concat('<option value=\"S', s, '\">S', s, case when s % 2 = 0 then '</option>' else '' end)")
    index = page(options, 3, "site", f"concat('{_P3_INDEX}', site)",
                 "concat('<html><body><select id=\"courseprefix\"><option value=\"\">Select', body, '</select></body></html>')")
    rows = joined(p, ["s"], "concat('<a href=\"preview_course_nopop.php?catoid=9&amp;coid=', k, '\">', code, '</a>')")
    listing = page(rows, 4, "s", f"concat('{P.P3_LISTING[0]}S', s, '{P.P3_LISTING[1]}')", (
        "concat('<html><body><table class=\"table_default wide\"><tr><td colspan=\"2\"><strong>Old</strong>', "
        "case when s % 2 = 0 then '</td></tr>' else '' end, '<tr><td colspan=\"2\"><strong>Field &amp; ', s, '</strong></td></tr></table>', "
        "body, '</body></html>')"))
    url = P.P3_DETAIL % ("9", "%s", P.P3_OPTIONS)
    detail = page(p.where("k % 8 != 7"), 5, "k", f"replace('{url}', '%s', cast(k as string))", (
        "concat('<html><body><h3>', code, ' ', num, ' ', name_html, '</h3>', "
        "case when k % 2 = 0 then concat('<p>Lecture: 3<br>Tutorial: 1<br>Practical ', p_brand, '.<br><br>Academic Units: 3</p>"
        "<p>PREREQUISITE(S): PRE ', p_size, ' EXCLUSION(S): EX ', p_size, '</p>') "
        "else concat('<p>PREREQUISITE(S): PRE ', p_size, '</p>') end, '</body></html>')"))
    return union(index, listing, detail)


@register("p3_catalog", f"""
SELECT 'Field & ' || {SUBJ} AS "SubjectName", {K} % 8 = 7 AS missing,
  CASE WHEN {K} % 8 = 7 THEN '' ELSE {CODE} END AS "courseCode", CASE WHEN {K} % 8 = 7 THEN '' ELSE {NUM} END AS "numericCode",
  CASE WHEN {K} % 8 = 7 THEN '' ELSE {NAME} END AS name, CASE WHEN {K} % 2 = 0 THEN 'Practical ' || p_brand || '.' ELSE '' END AS description,
  CASE WHEN {K} % 8 = 7 THEN '' ELSE 'PRE ' || p_size END AS prerequisite, CASE WHEN {K} % 2 = 0 THEN 'EX ' || p_size ELSE '' END AS antirequisite
FROM part""")
def p3_catalog(spark, sf):
    """Prefix options -> listing per prefix -> detail pages; a course whose
    page never landed keeps its subject."""
    c = P.catalog_courses(_p3_pages(spark, sf), F.col("url").startswith(_P3_INDEX))
    return c.select("SubjectName", (F.col("name") == "").alias("missing"), "courseCode", "numericCode", "name", "description",
                    "prerequisite", "antirequisite")


# ------------------------------------------------------------------ P4

_P4_LIST = "https://www.mcgill.ca/study/2020-2021/courses/search"


@landed
def _p4_pages(spark, sf):
    p = parts(spark, sf).withColumn("pg", F.expr("cast(floor(k / 20) as bigint)"))
    rows = joined(p, ["pg"], (
        "concat('<div class=\"odd views-row\"><a href=\"/study/2020-2021/courses/c-', k, '\">x</a><a href=\"/no\">y</a></div>', "
        # a repeated link: the first of the page before
        "case when k % 20 = 0 then concat('<div class=\"views-row\"><a href=\"/study/2020-2021/courses/c-', greatest(k - 20, 0), '\">x</a></div>') "
        "else '' end)"))
    last = p.agg(F.max("pg").alias("last"))
    rows = rows.join(last.withColumn("pg", F.lit(0).cast("long")), "pg", "left")
    pages = page(rows, 1, "pg", f"concat('{_P4_LIST}', case when pg = 0 then '' else concat('?page=', pg) end)", (
        "concat('<html><body><div class=\"view-search-courses\">', body, '</div><ul><li class=\"pager-last last\"><a href=\"/study/search?page=', "
        "coalesce(last, 0), '\">last</a></ul></body></html>')"))
    detail = page(p.where("k % 11 != 10"), 2, "k", f"concat('{P.P4_BASE}/study/2020-2021/courses/c-', k)", (
        "concat('<html><body><h1 id=\"page-title\">', case when k % 17 = 16 then '' else concat(code, ' ', num, ' ', name_html, "
        "case when k % 2 = 0 then ' (3 credits)' else '' end) end, '</h1>', "
        "case k % 3 when 0 then concat('<div class=\"content\"><h3>Overview</h3><p>Field ', s, ' : History of ', p_brand, '.</p></div>') "
        "when 1 then concat('<div class=\"content\"><h3>Overview</h3><p>Only ', p_brand, '</p></div>') else '<div class=\"content\"><h3>Else</h3><p>x</p></div>' end, "
        "'<div class=\"catalog-notes\"><p>Prerequisite: OLD<p>Prerequisite: PRE ', p_size, '<p>Restriction (part): R ', p_size, '</div></body></html>')"))
    return union(pages, detail)


@register("p4_listing_detail", f"""
WITH links AS (SELECT {K} FROM part UNION ALL SELECT 0 UNION ALL SELECT 0 FROM part WHERE {K} = 20)
SELECT {CODE} AS "courseCode", {NUM} AS "numericCode", {NAME} AS name,
  CASE {K} % 3 WHEN 0 THEN 'Field ' || {SUBJ} WHEN 1 THEN 'Only ' || p_brand ELSE '' END AS "SubjectName",
  CASE {K} % 3 WHEN 0 THEN 'History of ' || p_brand || '.' ELSE '' END AS description,
  'PRE ' || p_size AS prerequisite, 'R ' || p_size AS antirequisite
FROM links JOIN part USING ({K}) WHERE {K} % 11 != 10 AND {K} % 17 != 16""")
def p4_listing_detail(spark, sf):
    """Pager -> listing pages -> row links (repeats dropped but for those of
    the first page) -> detail pages with title, overview and notes."""
    c = P.detail_courses(_p4_pages(spark, sf), _P4_LIST)
    return c.select("courseCode", "numericCode", "name", "SubjectName", "description", "prerequisite", "antirequisite")


# ------------------------------------------------------------------ P5

_P5_INDEX = "https://www.queensu.ca/sgs/index"


@landed
def _p5_pages(spark, sf):
    p = parts(spark, sf)
    links = joined(subjects(p), ["site"], f"concat('<a href=\"{P.P5_PREFIX}s', s, '\">Field ', s, ' &amp; more</a><a href=\"/elsewhere\">x</a>')")
    index = page(links, 1, "site", f"concat('{_P5_INDEX}', site)", "concat('<html><body>', body, '</body></html>')")
    block = (
        "concat(case when k % 5 = 4 then '<p><strong>Not a course header</strong><br/>ignored</p>' else '' end, '<p><strong>', code, '-', "
        "case when k % 4 = 0 then concat(num, '*/', 200000 + k, '*') when k % 7 = 3 then '**' else num end, '  ', name_html, '</strong><br/>', "
        "case when k % 5 = 4 then 'Law description.' else concat('First ', p_brand, '.<br>PREREQUISITE: ', code, '-1.<br />More text.<br/>"
        "COREQUISITE: CO-', p_size, '.<BR>EXCLUSION: EX-', p_size, '.') end, case when k % 2 = 0 then '</p>\\n' else '' end)")
    body = joined(p, ["s"], block)
    url = f"concat('{P.P5_BASE}{P.P5_PREFIX}s', s)"
    landed = page(body, 2, "s", url, "concat('<html><body>', body, '</body></html>')")
    again = page(body.where("s % 3 = 0"), 9, "s + 1000000", url, "concat('<html><body>stale', body, body, '</body></html>')")
    return union(index, landed, again)


@register("p5_paragraphs", f"""
WITH c AS (SELECT *, unnest(CASE WHEN {K} % 4 = 0 THEN [{NUM}, CAST(200000 + {K} AS VARCHAR)] WHEN {K} % 7 = 3 THEN [] ELSE [{NUM}] END) AS n FROM part)
SELECT {CODE} AS "courseCode", n AS "numericCode", {NAME} AS name,
  CASE WHEN {K} % 5 = 4 THEN 'Law description.' ELSE 'First ' || p_brand || '. More text.' END AS description,
  CASE WHEN {K} % 5 = 4 THEN '' ELSE {CODE} || '-1. CO-' || p_size || '.' END AS prerequisite,
  CASE WHEN {K} % 5 = 4 THEN '' ELSE 'EX-' || p_size || '.' END AS antirequisite, 'Field ' || {SUBJ} || ' & more' AS "SubjectName"
FROM c""")
def p5_paragraphs(spark, sf):
    """P5 (X1): paragraph headers, rule cascade over the markup's lines, one row a
    number; a page landed twice counts once."""
    c = P.paragraph_courses(_p5_pages(spark, sf), F.col("url").startswith(_P5_INDEX))
    return c.select("courseCode", "numericCode", "name", "description", "prerequisite", "antirequisite", "SubjectName")


# ------------------------------------------------------------------ P6

_P6_START = "https://courses.students.ubc.ca/start"


@landed
def _p6_pages(spark, sf):
    p = parts(spark, sf)
    rows = joined(subjects(p), ["site"], (
        "concat(case when s % 2 = 0 then concat('<tr class=\"section1\"><td><a href=\"/cs/dept?d=S', s, '\">S', s, '</a></td><td>Field ', s, "
        "'</td><td>Sc</td></tr>') else concat('<tr class=section2><td><a title=\"see href=x\" href=\"/cs/dept?d=S', s, '\">S', s, '</a><td>Field ', s, "
        "'<td>Sc') end, '<tr class=\"section2\"><td></td><td>No code</td><td>x</td></tr>')"))
    start = page(rows, 1, "site", f"concat('{_P6_START}', site)", "concat('<html><body><table>', body, '</table></body></html>')")
    courses = joined(p, ["s"], (
        "concat('<tr class=\"section1 x\"><td><a href=\"/cs/courseschedule?pname=subjarea&amp;course=', k, '\">', code, ' ', num, '</a>', "
        "case when k % 2 = 0 then '</td>' else '' end, '<td>', name_html, case when k % 3 = 0 then '</td></tr>' else '' end)"))
    dept = page(courses, 2, "s", f"concat('{P.P6_BASE}/cs/dept?d=S', s)", (
        "concat('<html><body><p>Dept ', s, ' courses.</p><div class=\"pagination\">1 2</div><table>', body, '</table></body></html>')"))
    course = page(p.where("k % 7 != 6"), 3, "k", f"concat('{P.P6_BASE}/cs/courseschedule?pname=subjarea&course=', k)", (
        "concat('<html><body><h4>Description</h4><p>Design ', p_brand, '.</p><div role=\"main\"><p>Credits: 4</p><p>Pre-reqs: PRE ', p_size, "
        "'</p><p>Pre-reqs: second</p>', case when k % 2 = 0 then concat('<p>Equivalents: EQ ', p_size, '</p>') else '' end, '</div></body></html>')"))
    return union(start, dept, course)


@register("p6_tables", f"""
SELECT 'Field ' || {SUBJ} AS "SubjectName", 'Dept ' || {SUBJ} || ' courses.' AS "SubjectDescription", {CODE} AS "courseCode",
  {NUM} AS "numericCode", {NAME} AS name, CASE WHEN {K} % 7 = 6 THEN '' ELSE 'Design ' || p_brand || '.' END AS description,
  CASE WHEN {K} % 7 = 6 THEN '' ELSE 'PRE ' || p_size END AS prerequisite,
  CASE WHEN {K} % 7 = 6 OR {K} % 2 = 1 THEN '' ELSE 'EQ ' || p_size END AS "oneWayExclusion"
FROM part""")
def p6_tables(spark, sf):
    """P6 (F2): table rows by position, also where cells and rows aren't closed."""
    pages = _p6_pages(spark, sf)
    c = P.table_courses(pages, F.col("url").startswith(_P6_START))
    return c.select("SubjectName", "SubjectDescription", "courseCode", "numericCode", "name", "description", "prerequisite",
                    "oneWayExclusion")


# ------------------------------------------------------------------ P7

_P7_LIST = "https://ulysses.sheridanc.on.ca/coutline/results.jsp"


@landed
def _p7_pages(spark, sf):
    p = parts(spark, sf)
    href = "concat('coutline.jsp?', case when k % 5 = 4 then '' else concat('subjectCode=', code, '{amp}') end, 'courseCode=', k)"
    rows = joined(p, ["s"], "concat('<tr><td><a href=\"', " + href.format(amp="&amp;") + ", '\">link</a>', "
                  "case when k % 2 = 0 then '</td><td>x</td><td> ' else '<td>x<td> ' end, 'Field ', s, case when k % 3 = 0 then ' </td></tr>' else '' end)")
    listing = page(rows, 1, "s", f"concat('{_P7_LIST}?s=', s)",
                   "concat('<html><body><table><tr><td><a href=\"no\">n</a></table><table id=\"detail_table\">', body, '</table></body></html>')")
    outline = page(p.where("k % 9 != 8"), 2, "k", f"concat('{P.P7_PREFIX}', " + href.format(amp="&") + ")", (
        "concat('<html><body>', case when k % 4 = 3 then concat('<span class=\"CourseTitleHeading\"></span><font size=\"5\">', name_html, '</font>') "
        "else concat('<span class=\"CourseTitleHeading\">', name_html, '</span>') end, "
        "case when k % 3 = 0 then concat('<p>Detailed Description</p><p>Learn ', p_brand, '.</p><p>Program Context</p>') else '' end, '</body></html>')"))
    return union(listing, outline)


@register("p7_link_file", f"""
SELECT CASE WHEN {K} % 5 = 4 THEN '' ELSE {CODE} END AS "courseCode", CAST({K} AS VARCHAR) AS "numericCode",
  CASE WHEN {K} % 9 = 8 THEN '' ELSE {NAME} END AS name,
  CASE WHEN {K} % 9 != 8 AND {K} % 3 = 0 THEN 'Learn ' || p_brand || '.' ELSE '' END AS description, 'Field ' || {SUBJ} AS "SubjectName"
FROM part""")
def p7_link_file(spark, sf):
    """Listing tables -> link file (written and read back, K5, S2) -> outline pages."""
    pages = _p7_pages(spark, sf)
    lk = P.outline_link_list(pages, F.col("url").startswith(_P7_LIST), code="X")
    out = IO.scratch_path(spark, "links")
    IO.write_json(lk, out, omit_empty=False)
    lk = IO.read_json_records(spark, out, "list_page long, link_pos long, Link string, SubjectName string, Code string")
    c = P.link_file_courses(lk, pages)
    return c.select("courseCode", "numericCode", "name", "description", "SubjectName")


# ------------------------------------------------------------------ P8

_P8_INDEX = "http://www.ryerson.ca/index"


@landed
def _p8_pages(spark, sf):
    p = parts(spark, sf)
    links = joined(subjects(p), ["site"], f"concat('<a href=\"{P.P8_PREFIX}s', s, '\">Field ', s, ' (F', s, ')</a>')")
    index = page(links, 1, "site", f"concat('{_P8_INDEX}', site)", "concat('<html><body>', body, '</body></html>')")
    items = joined(p, ["s"], (
        "concat('<li class=\"x courseListItem\"><span class=\"courseListCourseCode\"> ', code, ' ', num, ' </span><span class=''courseListCourseName''>', name_html, "
        "'</span><div class=\"courseListDescription\">About ', p_brand, '.</div>', "
        "case when k % 3 != 2 then concat('<div class=\"courseListPrerequisites\"><a> PRE ', p_size, ' </a><a>PRE x</a></div>') else '' end, "
        "case when k % 5 = 0 then concat('<div class=\"courseListAntirequisites\"><ul><li><a>ANTI ', p_size, '</a></ul></div>') else '' end, "
        "case when k % 2 = 0 then '</li>' else '' end)"))
    subject = page(items, 2, "s", f"concat('{P.P8_BASE}{P.P8_PREFIX}s', s)", "concat('<html><body><ul>', body, '</ul></body></html>')")
    return union(index, subject)


_P8_SQL = f"""
SELECT {CODE} AS "courseCode", {NUM} AS "numericCode", {NAME} AS name, 'About ' || p_brand || '.' AS description,
  CASE WHEN {K} % 3 != 2 THEN 'PRE ' || p_size || ';PRE x' ELSE '' END AS prerequisite,
  CASE WHEN {K} % 5 = 0 THEN 'ANTI ' || p_size ELSE '' END AS antirequisite, 'Field ' || {SUBJ} AS "SubjectName" FROM part"""


@register("p8_list_items", _P8_SQL)
def p8_list_items(spark, sf):
    """List items, closed or not, with nested lists; links joined by ";"."""
    c = P.list_item_courses(_p8_pages(spark, sf), F.col("url").startswith(_P8_INDEX))
    return c.select("courseCode", "numericCode", "name", "description", "prerequisite", "antirequisite", "SubjectName")


# ------------------------------------------------------------------ P9

_P9_INDEX = "https://www.senecacollege.ca/programs/alphabetical.html"


@landed
def _p9_pages(spark, sf):
    p = parts(spark, sf)
    links = joined(subjects(p), ["site"], f"concat('<a href=\"{P.P9_PROGRAMS}G', s, '.html\">G</a><a href=\"/other\">o</a>')")
    index = page(links, 1, "site", f"concat('{_P9_INDEX}?', site)", "concat('<html><body>', body, '</body></html>')")
    outlines = joined(p, ["s"], (
        f"concat('<a href=\"{P.P9_OUTLINE}X', k, '\">a</a>', case when k % 3 = 0 then concat('<a href=\"{P.P9_OUTLINE}X', k, '\">again</a>') else '' end, "
        f"case when k % 4 = 0 then concat('<a href=\"{P.P9_OUTLINE}X', k, '&amp;v=2\">same</a>') else '' end)"))
    program = page(outlines, 2, "s", f"concat('{P.P9_BASE}{P.P9_PROGRAMS}G', s, '/courses.html')",
                   "concat('<html><body><h1>Program ', s, ' <span>(G)</span></h1>', body, '</body></html>')")
    html = (
        "concat('<html><body>', case when k % 10 = 9 then '<h1>No Subject Outline could be found.</h1>' else concat('<h1><p>', "
        "upper(left(p_type, 3)), lpad(cast(k % 1000 as string), 3, '0'), ' - ', name_html, ' ', k, '</p></h1>', "
        "case k % 3 when 0 then concat('<div><p><strong>Subject Description</strong> Learn ', p_brand, ' – basics.</p></div>') "
        "when 1 then concat('<div><p><strong>Subject Description</strong></p><p>Tools of ', p_brand, '.</p></div>') "
        "else concat('<div><p><strong>Subject Description</strong></p><div></div><span>Span of ', p_brand, '.</span></div>') end) end, '</body></html>')")
    first = page(p, 3, "k", f"concat('{P.P9_OUTLINE}X', k)", html)
    second = page(p.where("k % 4 = 0"), 4, "k", f"concat('{P.P9_OUTLINE}X', k, '&v=2')", html)
    return union(index, program, first, second)


@register("p9_outlines", f"""
SELECT upper(left(p_type, 3)) AS "courseCode", lpad(CAST({K} % 1000 AS VARCHAR), 3, '0') AS "numericCode", {NAME} || ' ' || {K} AS name,
  CASE {K} % 3 WHEN 0 THEN 'Learn ' || p_brand || ' basics.' WHEN 1 THEN 'Tools of ' || p_brand || '.' ELSE 'Span of ' || p_brand || '.' END AS description,
  'Program ' || {SUBJ} AS "SubjectName", '{P.P9_OUTLINE}X' || {K} AS "Link"
FROM part WHERE {K} % 10 != 9""")
def p9_outlines(spark, sf):
    """P9 (F1, F4, D1): programme pages -> outline links once a page -> outlines with two
    fallbacks; missing outlines dropped, equal courses once."""
    c = P.outline_courses(_p9_pages(spark, sf), F.col("url").startswith(_P9_INDEX))
    return c.select("courseCode", "numericCode", "name", "description", "SubjectName", "Link")


# ------------------------------------------------------------------ P10

_P10_INDEX = "https://smith.queensu.ca/bcom/courses"


@landed
def _p10_pages(spark, sf):
    p = parts(spark, sf)
    links = joined(p, ["s"], (
        "concat('<a class=\"x modal_frame y\" title=\"a > b\" href=\"/c/', k, '.php\" data-title=\"COMM ', case when k % 4 = 0 then concat(num, '/', 200000 + k) "
        "else num end, ': ', name_html, '\">x</a><a class=\"modal_frames\" href=\"/c/no\" data-title=\"COMM 999: no\">z</a>')"))
    index = page(links, 1, "s", f"concat('{_P10_INDEX}', s)", "concat('<html><body>', body, '</body></html>')")
    detail = page(p.where("k % 13 != 12"), 2, "k", f"concat('{P.P10_BASE}/c/', k, '.php')", (
        "concat('<html><body><description><p>About ', p_brand, '.</p>', case when k % 2 = 0 then concat('<p>Prerequisite - PRE ', p_size, '<br>Corequisite - CO ', p_size, "
        "'</p>') else concat('<p>Exclusions - EX ', p_size, '</p>') end, '</description></body></html>')"))
    return union(index, detail)


@register("p10_modal", f"""
WITH c AS (SELECT *, unnest(CASE WHEN {K} % 4 = 0 THEN [{NUM}, CAST(200000 + {K} AS VARCHAR)] ELSE [{NUM}] END) AS n FROM part)
SELECT 'COMM' AS "courseCode", n AS "numericCode", {NAME} AS name, 'About ' || p_brand || '.' AS description,
  CASE WHEN {K} % 2 = 0 THEN 'PRE ' || p_size ELSE '' END AS prerequisite, CASE WHEN {K} % 2 = 0 THEN 'CO ' || p_size ELSE '' END AS corequisite,
  CASE WHEN {K} % 2 = 1 THEN 'EX ' || p_size ELSE '' END AS antirequisite
FROM c WHERE {K} % 13 != 12""")
def p10_modal(spark, sf):
    """P10 (X2): link data and detail markup; ``301/302`` gives two rows."""
    c = P.modal_courses(_p10_pages(spark, sf), F.col("url").startswith(_P10_INDEX))
    return c.select("courseCode", "numericCode", "name", "description", "prerequisite", "corequisite", "antirequisite")


# ------------------------------------------------------------------ P11

@register("p11_text_blocks", f"""
SELECT {CODE} AS "courseCode", {NUM} || '/3' AS "numericCode", 'Part ' || p_name AS name,
  CASE WHEN {K} % 3 = 2 THEN 'Only ' || p_brand || '.' ELSE 'Intro to ' || p_brand || '.' END AS description,
  CASE WHEN {K} % 3 = 2 THEN '' ELSE 'Bio ' || p_size || '.' END AS prerequisite,
  CASE WHEN {K} % 3 = 2 THEN '' ELSE 'EX ' || p_size || '.' END AS antirequisite,
  CASE WHEN {K} % 3 = 0 THEN '(S) OW ' || p_size || '.' ELSE '' END AS "oneWayExclusion" FROM part
UNION ALL SELECT '', '', '', '', '', '', '' FROM (SELECT DISTINCT {SUBJ} FROM part)""")
def p11_text_blocks(spark, sf):
    """Text calendars -> blocks -> courses by six patterns; the lines before
    the first header give an empty course."""
    p = parts(spark, sf)
    body = joined(p, ["s"], (
        "concat('\\n', code, ' ', num, '/3.0 Part ', p_name, '\\n', case when k % 3 = 2 then concat('Only ', p_brand, '.') else concat('Intro to ', p_brand, "
        "'.\\nPREREQUISITE Bio ', p_size, '.\\nEXCLUSION(S) EX ', p_size, '.', case when k % 3 = 0 then concat('\\nONE-WAY EXCLUSION(S) OW ', p_size, '.') else '' end) end)"))
    docs = body.select(F.col("s").alias("doc_id"), F.concat(F.lit("Preamble line "), F.col("s"), F.col("body")).alias("text"))
    c = P.text_courses(docs)
    return c.select("courseCode", "numericCode", "name", "description", "prerequisite", "antirequisite", "oneWayExclusion")


# ------------------------------------------------------------------ P12

def _p12_pages(spark, sf):
    p = parts(spark, sf)
    head = "concat('<p><strong>', code, ' ', num, ' ', name_html, '</strong>')"
    body = joined(p, ["s"], (
        f"concat({head}, case k % 3 when 0 then concat('\\nAbout ', p_brand, '.\\nPREREQUISITE: PRE ', p_size, '.</p>') "
        "when 1 then concat('</p>\\n<p>Theory of ', p_brand, '.<br>PREREQUISITE: PRE ', p_size, '.</p>') "
        "else concat('\\n<p>Theory of ', p_brand, '.<br>More.') end, '\\n', case when k % 5 = 0 then '<p><strong>not a header</strong></p>' else '' end)"))
    return page(body, 1, "s", "concat('https://www.queensu.ca/concurrent', s)", "concat('<html><body>', body, '</body></html>')")


@register("p12_strong_headers", f"""
SELECT {CODE} AS "courseCode", {NUM} AS "numericCode", {NAME} AS name,
  CASE {K} % 3 WHEN 0 THEN 'About ' || p_brand || '.' WHEN 1 THEN 'Theory of ' || p_brand || '. PREREQUISITE: PRE ' || p_size || '.'
    ELSE 'Theory of ' || p_brand || '. More.' END AS description,
  CASE WHEN {K} % 3 = 2 THEN '' ELSE 'PRE ' || p_size || '.' END AS prerequisite
FROM part""")
def p12_strong_headers(spark, sf):
    """Strong headers; the description from the header's own paragraph or the next."""
    c = P.strong_courses(_p12_pages(spark, sf))
    return c.select("courseCode", "numericCode", "name", "description", "prerequisite")


@register("filter_code_csv", f"""SELECT {NAME} AS "Name", {NUM} AS "NumericCode" FROM part WHERE {CODE} = 'ECON'""")
def filter_code_csv(spark, sf):
    """K7: the courses of one code, two columns, written as CSV and read back."""
    out = IO.scratch_path(spark, "code")
    IO.write_csv(P.filter_code(P.strong_courses(_p12_pages(spark, sf)), "ECON"), out)
    return IO.read_csv(spark, out, "Name string, NumericCode string")


# ------------------------------------------------------------------ P1

_TERM = "strftime(o_orderdate, '%Y')"


def _p1_inputs(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyy").alias("term"), "o_orderpriority",
        F.concat(F.lit("S"), F.expr("floor(o_orderkey / 300)")).alias("subject"))
    pair = "to_json(sort_array(collect_list(struct(code, description))))"
    terms = o.select("term").distinct().select(F.col("term").alias("code"), F.concat(F.lit("Term "), "term").alias("description"))
    terms = terms.agg(F.expr(pair).alias("body"))
    classes = o.select("term", "subject").distinct().select(
        F.col("term").alias("term_code"), F.col("subject").alias("code"), F.concat("subject", F.lit(" &amp; more")).alias("description"))
    classes = classes.groupBy("term_code").agg(F.expr(pair).alias("body"))
    classes = classes.withColumn("body", F.when(F.col("term_code") == "1996", "[]").otherwise(F.col("body")))
    data = F.expr("struct(k as id, term, cast(k as string) as courseReferenceNumber, concat('N', k % 90) as courseNumber, subject, 'A' as sequenceNumber, "
                  "'West' as campusDescription, concat('Title &amp; ', k) as courseTitle, 50 as maximumEnrollment, cast(k % 50 as int) as enrollment, "
                  "999 as seatsAvailable, 7 as waitCapacity, cast(k % 7 as int) as waitCount, "
                  "array(struct('C' as category, struct('0900' as beginTime, true as monday) as meetingTime)) as meetingsFaculty, "
                  "array(struct('AT' as code)) as sectionAttributes)")
    searches = o.groupBy(F.col("term").alias("term_code"), F.col("subject").alias("subject_code")).agg(
        F.to_json(F.struct(F.lit(True).alias("success"), F.sort_array(F.collect_list(data)).alias("data"))).alias("body"))
    descriptions = o.where("k % 2 = 0").select(F.col("k").alias("page_id"), "term", F.col("k").cast("string").alias("crn"), F.concat(
        F.lit("<html><body><p>Intro to &lt;b&gt;order&lt;/b&gt; "), "o_orderpriority", F.lit(". </p></body></html>")).alias("html"))
    prerequisites = o.where("k % 3 = 0").select(F.col("k").alias("page_id"), "term", F.col("k").cast("string").alias("crn"), F.expr(
        "concat('<html><body><table><tr><th>Header</th></tr><tr><td> CP ', k, case when k % 2 = 0 then ' </td><td></td><td>Min D</td></tr><tr><td>or</td></tr>' "
        "else '<td><td>Min D<tr><td>or' end, '</table></body></html>')").alias("html"))
    return terms, classes, searches, descriptions, prerequisites


@register("p1_sections", f"""
SELECT {_TERM} AS "TermCode", 'S' || CAST(floor(o_orderkey / 300) AS BIGINT) AS "CourseCode", 'S' || CAST(floor(o_orderkey / 300) AS BIGINT) || ' & more' AS subject,
  CAST(o_orderkey AS VARCHAR) AS "CourseReferenceNumber", 'N' || o_orderkey % 90 AS "NumericCode", 'Title & ' || o_orderkey AS "CourseTitle",
  CASE WHEN o_orderkey % 2 = 0 THEN 'Intro to order ' || o_orderpriority || '.' ELSE '' END AS "Description",
  CASE WHEN o_orderkey % 3 = 0 THEN 'CP ' || o_orderkey || ' Min D;or' ELSE '' END AS "Prerequisite",
  CAST(50 - o_orderkey % 50 AS INTEGER) AS available, CAST(7 - o_orderkey % 7 AS INTEGER) AS waitlist_available,
  CAST(dense_rank() OVER (ORDER BY {_TERM}) AS BIGINT) AS "TermID"
FROM orders WHERE {_TERM} IN (SELECT t FROM (SELECT DISTINCT {_TERM} AS t FROM orders ORDER BY 1 LIMIT 3)) AND {_TERM} <> '1996'""")
def p1_sections(spark, sf):
    """P1 (S3, S4, O1, F7, J2, T19, A4, A6, A7, K1-K4): JSON payloads -> sections of the first
    three terms, enriched; written with term and subject ids, and read back. The limit is the feature."""
    out = IO.scratch_path(spark, "sections")
    P.write_section_export(P.section_courses(*_p1_inputs(spark, sf)), out, "x")
    terms = IO.read_json_records(spark, f"{out}/x-terms", "TermID long, TermName string, TermCode string")
    sj = IO.read_json_records(spark, f"{out}/x-subjects", "subjectId long, termID long, name string, codes array<string>")
    c = IO.read_json_records(spark, f"{out}/x-courses", (
        "TermID long, subjectId long, CourseID int, CourseCode string, NumericCode string, CourseTitle string, CourseReferenceNumber string, "
        f"Description string, Prerequisite string, Enrollment {P.ENROLLMENT}"))
    got = c.join(terms, "TermID").join(sj.select("subjectId", F.col("name").alias("subject")), "subjectId")
    return got.select("TermCode", "CourseCode", "subject", "CourseReferenceNumber", "NumericCode", "CourseTitle", "Description", "Prerequisite",
                      F.col("Enrollment.Enrolled.Available").alias("available"),
                      F.col("Enrollment.Waitlist.Available").alias("waitlist_available"), "TermID")


# ------------------------------------------------------------------ P0

@register("p0_export", f"""
WITH c AS ({_P8_SQL})
SELECT CAST(dense_rank() OVER (ORDER BY CAST(substr("SubjectName", 7) AS BIGINT)) - 1 AS BIGINT) AS "subjectId", c.*,
  "SubjectName" AS csv_subject, description AS csv_description, false AS raw_hidden FROM c""")
def p0_export(spark, sf):
    """P0 (K1, K2, K3, K6, K8, A1-A3, J1): courses written as raw, subject and course
    JSON and as CSV, and read back: the subject by its id, the CSV by its values."""
    c = P.list_item_courses(_p8_pages(spark, sf), F.col("url").startswith(_P8_INDEX))
    out = IO.scratch_path(spark, "export")
    courses, _ = P.write_export(c, out, "x")
    IO.write_csv(P.courses_csv(courses), f"{out}/csv")
    fields = "numericCode string, courseCode string, name string, description string, prerequisite string, antirequisite string"
    back = IO.read_json_records(spark, f"{out}/x-courses", f"subjectId long, {fields}")
    subj = IO.read_json_records(spark, f"{out}/x-subjects", "subjectId long, name string, codes array<string>")
    raw = IO.read_json_records(spark, f"{out}/x-raw", "numericCode string, SubjectDescription string, source string, subjectId long")
    csv = IO.read_csv(spark, f"{out}/csv", ", ".join(f"{h} {'long' if h == 'SubjectID' else 'string'}" for h, _ in P.CSV_COLUMNS))
    raw = raw.select("numericCode", (F.col("SubjectDescription").isNotNull() | F.col("source").isNotNull()).alias("raw_hidden"))
    csv = csv.select(F.col("NumericCode").alias("numericCode"), F.col("SubjectName").alias("csv_subject"), F.col("Description").alias("csv_description"))
    return (back.join(subj.select("subjectId", F.col("name").alias("SubjectName")), "subjectId").join(csv, "numericCode").join(raw, "numericCode")
            .select("subjectId", "courseCode", "numericCode", "name", "description", "prerequisite", "antirequisite", "SubjectName",
                    "csv_subject", "csv_description", "raw_hidden"))
