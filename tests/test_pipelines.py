"""One hand-made fixture per pipeline (P1-P12) with the rows the
reference's rules give for it."""

from pyspark.sql import functions as F

from calyx.plans import pipelines as P

from . import fixtures as X
from .conftest import pages_df, rows

C = ("courseCode", "numericCode", "name")


def test_p2_calendar_blocks_headings_and_notes(spark):
    c = P.calendar(pages_df(spark, X.CALENDAR))
    got = {r["numericCode"]: r for r in c.collect()}
    assert sorted(got) == ["200", "300", "400", "450"]   # page without markers: no rows
    assert got["450"]["name"] == "Studio Practice"       # title over two lines
    assert got["450"]["description"] == "Long title text."
    a = got["200"]
    assert (a["courseCode"], a["name"]) == ("ARTH", "Survey of Art")
    assert a["prerequisite"] == "ARTH 100"
    assert a["description"] == "An introduction. More text here. Modern Modern Art:"
    assert a["antirequisite"].startswith("Students who have received credit for ARTH 201")
    assert a["SubjectName"] == "Art History"             # before first heading -> last ("Courses") -> h1
    assert got["300"]["SubjectName"] == "Modern Modern Art"
    assert got["300"]["antirequisite"] == ""             # note without the phrase is dropped
    assert got["300"]["description"] == "Some description. Courses"
    assert got["400"]["SubjectName"] == "Art History"    # heading "Courses" -> h1
    assert got["400"]["description"] == "Advanced work."  # prerequisite line overwrites (Q4)
    assert got["400"]["prerequisite"] == "ARTH 300"
    assert {r["SubjectDescription"] for r in got.values()} == {"Art History"}


def test_p11_text_blocks(spark):
    d = spark.createDataFrame([(7, X.TEXT_DOC)], "doc_id long, text string")
    c = P.text_courses(d).orderBy("ord").collect()
    assert len(c) == 3
    assert all(c[0][k] == "" for k in C)                  # preamble -> empty course
    assert (c[1]["courseCode"], c[1]["numericCode"], c[1]["name"]) == ("ANAT", "100/3", "Anatomy Basics")
    assert c[1]["description"] == "Intro to anatomy."
    assert c[1]["prerequisite"] == "Biology 12."
    assert c[1]["antirequisite"] == "ANAT 101."
    assert c[1]["oneWayExclusion"] == "(S) ANAT 099."   # the pattern keeps "(S)"
    assert c[2]["description"] == "Only a description here."   # fallback pattern


def test_p5_paragraphs_double_codes(spark):
    c = P.paragraph_courses(pages_df(spark, X.GRADUATE), X.GRAD_INDEX)
    got = rows(c, "numericCode", "name", "prerequisite", "antirequisite", "description", "SubjectName")
    assert got == [
        ("824", "Planning Law", "", "", "Law description.", "Urban Planning"),
        ("891", "Directed Study", "SURP-800. SURP-810.", "SURP-893.",
         "First line of description. More description.", "Urban Planning"),
        ("892", "Directed Study", "SURP-800. SURP-810.", "SURP-893.",
         "First line of description. More description.", "Urban Planning"),
    ]


def test_p10_modal_links(spark):
    c = P.modal_courses(pages_df(spark, X.COMMERCE), X.COMM_INDEX)
    got = rows(c, "courseCode", "numericCode", "name", "description", "prerequisite", "corequisite", "antirequisite")
    assert got == [
        ("COMM", "301", "Business Law", "Law description.", "COMM 201", "COMM 202", ""),
        ("COMM", "302", "Business Law", "Law description.", "COMM 201", "COMM 202", ""),
        ("COMM", "317", "Marketing & Sales", "Marketing text.", "", "", "COMM 318"),
    ]


def test_p12_strong_headers(spark):
    c = P.strong_courses(pages_df(spark, X.CONCURRENT))
    got = rows(c, "courseCode", "numericCode", "name", "description", "prerequisite")
    assert got == [
        ("EDUC", "101/3.0", "Teaching Basics", "Basics of teaching.", "None."),
        ("EDUC", "102", "Learning", "Learning theory. PREREQUISITE: EDUC 101.", "EDUC 101."),
    ]


def test_p8_list_items(spark):
    c = P.list_item_courses(pages_df(spark, X.RYERSON), X.RYE_INDEX)
    got = rows(c, "courseCode", "numericCode", "name", "description", "prerequisite", "antirequisite", "SubjectName")
    assert got == [
        ("ACC", "100", "Intro Accounting", "Basics & more.", "ACC 050;MTH 110", "ACC 101", "Accounting"),
        ("ACC", "200", "Advanced", "", "", "", "Accounting"),
    ]


def test_p9_outlines_dedup(spark):
    c = P.outline_courses(pages_df(spark, X.SENECA), X.SEN_INDEX)
    got = rows(c, "courseCode", "numericCode", "name", "description", "SubjectName")
    assert got == [
        ("IPC", "144", "Introduction to Programming", "Learn C the basics.", "Computer Programming"),
        ("ULI", "101", "Unix", "Unix tools.", "Computer Programming"),
    ]
    assert rows(c.filter("courseCode = 'IPC'"), "Link") == [(X._OL + "IPC144",)]   # first kept


def test_p4_listing_and_detail(spark):
    pg = pages_df(spark, X.MCGILL)
    lk = P.listing_links(pg, X.MCG_LIST)
    assert rows(lk, "page_no", "link") == [(0, X._MC + "urbp-201"), (0, X._MC + "urbp-501"),
                                           (1, X._MC + "urbp-601")]
    c = P.detail_courses(pg, X.MCG_LIST)
    got = rows(c, "courseCode", "numericCode", "name", "SubjectName", "description", "prerequisite", "antirequisite")
    assert got == [
        ("URBP", "201", "Planning History", "Urban Planning", "History of planning.", "URBP 101", "Not open to X."),
        ("URBP", "501", "Seminar", "", "", "", ""),
    ]


def test_p6_three_levels(spark):
    c = P.table_courses(pages_df(spark, X.UBC), X.UBC_START)
    got = rows(c, "SubjectName", "SubjectDescription", "courseCode", "numericCode", "name", "description",
               "prerequisite", "oneWayExclusion")
    assert got == [("Computer Science", "Computer science courses.", "CPSC", "110", "Computation",
                    "Program design.", "None.", "CPSC 103")]


def test_p7_link_file(spark):
    pg = pages_df(spark, X.SHERIDAN)
    lk = P.outline_link_list(pg, X.SHER_LIST, code="ACCG")
    assert rows(lk, "Link", "SubjectName") == [("coutline.jsp?courseCode=123", "Missing Subject"),
                                               ("coutline.jsp?subjectCode=ACCG&courseCode=16971", "Accounting Basics")]
    c = P.link_file_courses(lk, pg)
    got = rows(c, "courseCode", "numericCode", "name", "description", "SubjectName")
    assert got == [("", "123", "Fallback Name", "", "Missing Subject"),
                   ("ACCG", "16971", "Accounting 1", "Learn accounting.", "Accounting Basics")]


def test_p3_catalog(spark):
    c = P.catalog_courses(pages_df(spark, X.applied()), X.APP_INDEX)
    got = rows(c, "SubjectName", "courseCode", "numericCode", "name", "description", "prerequisite", "antirequisite")
    assert got == [
        ("Applied Science", "APSC", "100", "Engineering Practice", "Practical design work.", "None", "APSC 101"),
        ("Applied Science", "APSC", "200", "Design", "", "APSC 100", ""),
    ]


def test_p1_sections_and_export(spark):
    terms = spark.createDataFrame([(X.TERMS,)], "body string")
    classes = spark.createDataFrame(X.CLASSES, "term_code string, body string")
    searches = spark.createDataFrame(X.SEARCHES, "term_code string, subject_code string, body string")
    descs = spark.createDataFrame(X.DESCRIPTIONS, "page_id long, term string, crn string, html string")
    pre = spark.createDataFrame(X.PREREQS, "page_id long, term string, crn string, html string")
    s = P.section_courses(terms, classes, searches, descs, pre)
    got = {r["CourseReferenceNumber"]: r for r in s.collect()}
    assert sorted(got) == ["1001", "2001", "3001"]       # 4th term beyond the first three
    a = got["1001"]
    assert a["CourseTitle"] == "Data & Structures"
    assert a["Description"] == "Intro to data structures."
    assert a["Prerequisite"] == "CP 104 Minimum Grade D;or"
    assert (a["Enrollment"]["Enrolled"]["Available"], a["Enrollment"]["Waitlist"]["Available"]) == (20, 8)
    c, t, sj = P.section_export(s)
    assert rows(t, "TermID", "TermCode") == [(1, "202301"), (2, "202309")]
    assert rows(sj, "subjectId", "termID", "name") == [(1, 1, "Computer Science & Physics"),
                                                      (2, 2, "Computer Science & Physics"), (3, 2, "Math")]
    assert "TermCode" not in c.columns and "SubjectName" not in c.columns


def test_p0_export_subjects(spark):
    c = P.strong_courses(pages_df(spark, X.CONCURRENT)).unionByName(
        P.modal_courses(pages_df(spark, X.COMMERCE), X.COMM_INDEX))
    courses, subj = P.export(c)
    # every row here has no subject: one subject named "" holding all codes in first-seen order
    s = subj.collect()
    assert len(s) == 1 and s[0]["name"] == "" and s[0]["subjectId"] == 0
    assert sorted(s[0]["codes"]) == ["COMM", "EDUC"]
    assert {r["subjectId"] for r in courses.collect()} == {0}
    csv = P.courses_csv(courses)
    assert csv.columns[:4] == ["SubjectID", "SubjectName", "SubjectDescription", "Name"]
    assert rows(P.filter_code(courses, "EDUC"), "NumericCode") == [("101/3.0",), ("102",)]


def test_p11_from_text_file_and_p1_writer(spark, tmp_path):
    from calyx.sources import io as IO
    f = tmp_path / "calendar.txt"
    f.write_text(X.TEXT_DOC)
    ls = IO.read_text_lines(spark, str(f))                      # S5: whole file, order kept
    assert [r["line"] for r in ls.orderBy("line_no").collect()] == X.TEXT_DOC.split("\n")
    docs = spark.read.text(str(f), wholetext=True).selectExpr("0L as doc_id", "value as text")
    assert P.text_courses(docs).count() == 3
    terms = spark.createDataFrame([(X.TERMS,)], "body string")
    classes = spark.createDataFrame(X.CLASSES, "term_code string, body string")
    searches = spark.createDataFrame(X.SEARCHES, "term_code string, subject_code string, body string")
    descs = spark.createDataFrame(X.DESCRIPTIONS, "page_id long, term string, crn string, html string")
    pre = spark.createDataFrame(X.PREREQS, "page_id long, term string, crn string, html string")
    s = P.section_courses(terms, classes, searches, descs, pre, max_per_subject=1)
    out = str(tmp_path / "out")
    P.write_section_export(s, out)
    t = spark.read.json(f"{out}/sections-terms")
    assert rows(t, "TermID", "TermName") == [(1, "Winter 2023"), (2, "Fall 2023")]


def test_courses_by_source_in_files_of_bounded_size(spark, tmp_path):
    import glob
    import json

    from pyspark.sql import functions as F

    from calyx.sources import io as IO
    big = spark.range(0, 1000).select(F.col("id"), F.lit("big").alias("source"), F.when(F.col("id") % 2 == 0, "x").otherwise("").alias("note"))
    rows = big.unionByName(spark.range(0, 30).select(F.col("id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.lit("y").alias("note"))).repartition(7)
    IO.write_json_by(rows, str(tmp_path / "o"), ["source"], rows_per_file=100)
    files = {s: glob.glob(str(tmp_path / "o" / f"source={s}" / "*.json")) for s in ("big", "s0", "s1", "s2")}
    assert 10 <= len(files["big"]) <= 16 and all(len(files[s]) == 1 for s in ("s0", "s1", "s2"))
    lines = [json.loads(x) for f in files["big"] for x in open(f)]
    assert len(lines) == 1000 and max(sum(1 for _ in open(f)) for f in files["big"]) <= 100
    assert all(("note" in x) == (x["id"] % 2 == 0) and "source" not in x for x in lines)
    back = IO.read_json_records(spark, str(tmp_path / "o"), "id long, source string, note string").select("id", "source", "note").fillna("")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    IO.write_json_by(rows.limit(0), str(tmp_path / "none"), ["source"])
