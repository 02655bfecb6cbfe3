"""Hand-made inputs, one small set per pipeline (shapes follow the
selectors and patterns each pipeline reads)."""

CALENDAR = [
    ("https://cal.example.edu/art.html", """<html><body><h1>Art History</h1>
<p>intro</p>
<a name="courses" id="art-courses"></a>
<b>ARTH 200<i> Survey of Art</i> (3 credits)<br>
Prerequisite: ARTH 100. An introduction.<br>
More text here.<br>
<i>NOTE: Students who have received credit for ARTH 201 may not take this course for credit.</i><br>
<a name="mod" id="mod">Modern</a> Modern Art:<br>
ARTH 300<i> Modern Art</i><br>
Some description.<br>
<i>NOTE: Other note.</i><br>
<a name="c" id="c"></a>Courses<br>
ARTH 400<i> Seminar</i><br>
Seminar text.<br>
Prerequisite: ARTH 300. Advanced work.<br>
ARTH 450<i> Studio
Practice</i><br>
Long title text.<br>
<hr>
</body></html>"""),
    ("https://cal.example.edu/none.html", "<html><body><h1>Nothing</h1><p>No courses</p></body></html>"),
]

TEXT_DOC = """Preamble line
ANAT 100/3.0 Anatomy Basics
Intro to anatomy.
PREREQUISITE Biology 12.
EXCLUSION(S) ANAT 101.
ONE-WAY EXCLUSION(S) ANAT 099.
ANAT 200/6.0 Advanced Anatomy
Only a description here."""

GRAD_INDEX = "https://www.queensu.ca/sgs/index"
GRADUATE = [
    (GRAD_INDEX, '<html><body><a href="/sgs/graduate-calendar/courses-instruction/surp">Urban Planning</a>'
                 '<a href="/elsewhere">x</a></body></html>'),
    ("https://www.queensu.ca/sgs/graduate-calendar/courses-instruction/surp", """<html><body>
<p><strong>SURP-891*/892*  Directed Study</strong><br/>First line of description.<br/>PREREQUISITE: SURP-800.<br/>More description.<br/>COREQUISITE: SURP-810.<br/>EXCLUSION: SURP-893.</p>
<p><strong>Not a course header</strong><br/>ignored</p>
<p><strong>SURP-824 Planning Law</strong><br/>Law description.</p>
</body></html>"""),
]

COMM_INDEX = "https://smith.queensu.ca/bcom/courses"
COMMERCE = [
    (COMM_INDEX, '<html><body>'
                 '<a class="modal_frame" href="/c/COMM301.php" data-title="COMM 301/302: Business Law">x</a>'
                 '<a class="modal_frame" href="/c/COMM317.php" data-title="COMM 317: Marketing &amp; Sales">y</a>'
                 '<a href="/c/other.php" data-title="COMM 999: Not modal">z</a></body></html>'),
    ("https://smith.queensu.ca/c/COMM301.php",
     "<html><body><description><p>Law description.</p><p>Prerequisite - COMM 201<br>"
     "Corequisite - COMM 202</p></description></body></html>"),
    ("https://smith.queensu.ca/c/COMM317.php",
     "<html><body><description><p>Marketing text.</p><p>Exclusions - COMM 318</p></description></body></html>"),
]

CONCURRENT = [
    ("https://www.queensu.ca/concurrent", """<html><body>
<p><strong>EDUC 101/3.0 Teaching Basics</strong>
Basics of teaching.
PREREQUISITE: None.</p>
<p><strong>EDUC 102 Learning</strong></p>
<p>Learning theory.<br>PREREQUISITE: EDUC 101.</p>
<p><strong>not a header</strong></p>
</body></html>"""),
]

RYE_INDEX = "http://www.ryerson.ca/index"
RYERSON = [
    (RYE_INDEX, '<html><body><a href="/content/ryerson/calendar/2020-2021/courses/acc">Accounting (ACC)</a>'
                '</body></html>'),
    ("http://www.ryerson.ca/content/ryerson/calendar/2020-2021/courses/acc", """<html><body><ul>
<li class="courseListItem"><span class="courseListCourseCode"> ACC 100 </span><span class="courseListCourseName">Intro Accounting</span><div class="courseListDescription">Basics &amp; more.</div><div class="courseListPrerequisites"><a> ACC 050 </a><a>MTH 110</a></div><div class="courseListAntirequisites"><a>ACC 101</a></div></li>
<li class="courseListItem"><span class="courseListCourseCode">ACC 200</span><span class="courseListCourseName">Advanced</span></li>
</ul></body></html>"""),
]

SEN_INDEX = "https://www.senecacollege.ca/programs/alphabetical.html"
_OL = "https://apps.senecacollege.ca/ssos/findOutline.do?subjectCode="
SENECA = [
    (SEN_INDEX, '<html><body><a href="/programs/fulltime/CPA.html">CPA</a></body></html>'),
    ("https://www.senecacollege.ca/programs/fulltime/CPA/courses.html",
     f'<html><body><h1>Computer Programming <span>(CPA)</span></h1>'
     f'<a href="{_OL}IPC144">a</a><a href="{_OL}IPC144">again</a><a href="{_OL}ULI101">b</a>'
     f'<a href="{_OL}XYZ999">c</a><a href="{_OL}IPC144&amp;v=2">d</a></body></html>'),
    (f"{_OL}IPC144", '<html><body><h1><p>IPC144 - Introduction to Programming</p></h1>'
                     '<div><p><strong>Subject Description</strong> Learn C – the basics.</p></div></body></html>'),
    (f"{_OL}IPC144&v=2", '<html><body><h1><p>IPC144 - Introduction to Programming</p></h1>'
                         '<div><p><strong>Subject Description</strong> Learn C – the basics.</p></div></body></html>'),
    (f"{_OL}ULI101", '<html><body><h1><p>ULI101 - Unix</p></h1><div><p><strong>Subject Description</strong></p>'
                     '<p>Unix tools.</p></div></body></html>'),
    (f"{_OL}XYZ999", '<html><body><h1>No Subject Outline could be found.</h1></body></html>'),
]

MCG_LIST = "https://www.mcgill.ca/study/2020-2021/courses/search"
_MC = "https://www.mcgill.ca/study/2020-2021/courses/"
MCGILL = [
    (MCG_LIST, '<html><body><div class="view-search-courses">'
               '<div class="views-row"><a href="/study/2020-2021/courses/urbp-201">URBP 201</a></div>'
               '<div class="views-row"><a href="/study/2020-2021/courses/urbp-501">x</a></div></div>'
               '<ul><li class="pager-last last"><a href="/study/2020-2021/courses/search?page=1">last</a></li></ul>'
               '</body></html>'),
    (MCG_LIST + "?page=1", '<html><body><div class="view-search-courses">'
                           '<div class="views-row"><a href="/study/2020-2021/courses/urbp-601">a</a></div>'
                           '<div class="views-row"><a href="/study/2020-2021/courses/urbp-601">b</a></div>'
                           '</div></body></html>'),
    (_MC + "urbp-201", '<html><body><h1 id="page-title">URBP 201 Planning History (3 credits)</h1>'
                       '<div class="content"><h3>Overview</h3><p>Urban Planning : History of planning.</p></div>'
                       '<div class="catalog-notes"><p>Prerequisite: URBP 101</p><p>Restriction: Not open to X.</p>'
                       '</div></body></html>'),
    (_MC + "urbp-501", '<html><body><h1 id="page-title">URBP 501 Seminar</h1></body></html>'),
    (_MC + "urbp-601", '<html><body><h1 id="page-title"></h1></body></html>'),
]

UBC_START = "https://courses.students.ubc.ca/start"
UBC = [
    (UBC_START, '<html><body><table><tr class="section1"><td><a href="/cs/dept?d=CPSC">CPSC</a></td>'
                '<td>Computer Science</td><td>Science</td></tr>'
                '<tr class="section2"><td></td><td>No code</td><td>x</td></tr></table></body></html>'),
    ("https://courses.students.ubc.ca/cs/dept?d=CPSC",
     '<html><body><p>Computer science courses.</p><div class="pagination">1 2</div>'
     '<table><tr class="section1"><td><a href="/cs/courseschedule?pname=subjarea&amp;course=110">CPSC 110</a></td>'
     '<td>Computation</td></tr></table></body></html>'),
    ("https://courses.students.ubc.ca/cs/courseschedule?pname=subjarea&course=110",
     '<html><body><h4>Description</h4><p>Program design.</p><div role="main"><p>Credits: 4</p>'
     '<p>Pre-reqs: None.</p><p>Pre-reqs: second</p><p>Equivalents: CPSC 103</p></div></body></html>'),
]

SHER_LIST = "https://ulysses.sheridanc.on.ca/coutline/results.jsp"
_SP = "https://ulysses.sheridanc.on.ca/coutline/"
SHERIDAN = [
    (SHER_LIST, '<html><body><table id="detail_table">'
                '<tr><td><a href="coutline.jsp?subjectCode=ACCG&amp;courseCode=16971">link</a></td><td>x</td>'
                '<td> Accounting Basics </td></tr>'
                '<tr><td><a href="coutline.jsp?courseCode=123">l2</a></td><td>y</td><td>Missing Subject</td></tr>'
                '</table></body></html>'),
    (_SP + "coutline.jsp?subjectCode=ACCG&courseCode=16971",
     '<html><body><span class="CourseTitleHeading">Accounting 1</span>'
     '<p>Detailed Description</p><p>Learn accounting.</p><p>Program Context</p></body></html>'),
    (_SP + "coutline.jsp?courseCode=123",
     '<html><body><span class="CourseTitleHeading"></span><font size="5">Fallback Name</font></body></html>'),
]

APP_INDEX = "https://calendar.engineering.queensu.ca/index"


def applied():
    from calyx.plans.pipelines import P3_DETAIL, P3_LISTING, P3_OPTIONS
    listing = P3_LISTING[0] + "APSC" + P3_LISTING[1]
    d1 = P3_DETAIL % ("9", "101", P3_OPTIONS)
    d2 = P3_DETAIL % ("9", "102", P3_OPTIONS)
    return [
        (APP_INDEX, '<html><body><select id="courseprefix"><option value="">Select</option>'
                    '<option value="APSC">APSC</option></select></body></html>'),
        (listing, '<html><body><table class="table_default"><tr><td colspan="2"><strong>Old</strong></td></tr>'
                  '<tr><td colspan="2"><strong>Applied Science</strong></td></tr></table>'
                  '<a href="preview_course_nopop.php?catoid=9&amp;coid=101">APSC 100</a>'
                  '<a href="preview_course_nopop.php?catoid=9&amp;coid=102">APSC 200</a></body></html>'),
        (d1, '<html><body><h3>APSC 100 Engineering Practice</h3><p>Lecture: 3<br>Tutorial: 1<br>'
             'Practical design work.<br><br>Academic Units: 3</p>'
             '<p>PREREQUISITE(S): None EXCLUSION(S): APSC 101</p></body></html>'),
        (d2, '<html><body><h3>APSC 200 Design</h3><p>PREREQUISITE(S): APSC 100</p></body></html>'),
    ]


TERMS = ('[{"code":"202301","description":"Winter 2023"},{"code":"202305","description":"Spring 2023"},'
         '{"code":"202309","description":"Fall 2023"},{"code":"202401","description":"Winter 2024"}]')
CLASSES = [
    ("202301", '[{"code":"CP","description":"Computer Science &amp; Physics"}]'),
    ("202305", "[]"),
    ("202309", '[{"code":"CP","description":"Computer Science &amp; Physics"},{"code":"MA","description":"Math"}]'),
    ("202401", '[{"code":"CP","description":"Computer Science &amp; Physics"}]'),
]


def _search(rows):
    import json
    return json.dumps({"success": True, "totalCount": len(rows), "data": rows})


SEARCHES = [
    ("202301", "CP", _search([{"id": 1, "term": "202301", "courseReferenceNumber": "1001", "courseNumber": "212",
                                "subject": "CP", "sequenceNumber": "A", "campusDescription": "Waterloo",
                                "courseTitle": "Data &amp; Structures", "maximumEnrollment": 100, "enrollment": 80,
                                "seatsAvailable": 999, "waitCapacity": 10, "waitCount": 2}])),
    ("202309", "CP", _search([{"id": 2, "term": "202309", "courseReferenceNumber": "2001", "courseNumber": "312",
                                "subject": "CP", "sequenceNumber": "B", "campusDescription": "Brantford",
                                "courseTitle": "Algorithms", "maximumEnrollment": 50, "enrollment": 50,
                                "waitCapacity": 5, "waitCount": 0}])),
    ("202309", "MA", _search([{"id": 3, "term": "202309", "courseReferenceNumber": "3001", "courseNumber": "101",
                                "subject": "MA", "sequenceNumber": "A", "campusDescription": "Waterloo",
                                "courseTitle": "Calculus", "maximumEnrollment": 30, "enrollment": 10,
                                "waitCapacity": 0, "waitCount": 0}])),
    ("202401", "CP", _search([{"id": 4, "term": "202401", "courseReferenceNumber": "4001", "courseNumber": "400",
                                "subject": "CP", "sequenceNumber": "A", "campusDescription": "Waterloo",
                                "courseTitle": "Late", "maximumEnrollment": 1, "enrollment": 0,
                                "waitCapacity": 0, "waitCount": 0}])),
]
DESCRIPTIONS = [(0, "202301", "1001", "<html><body><p>Intro to &lt;b&gt;data&lt;/b&gt; structures. </p></body></html>")]
PREREQS = [(0, "202301", "1001", "<html><body><table><tr><th>Header</th></tr><tr><td> CP 104 </td><td></td>"
                                 "<td>Minimum Grade D</td></tr><tr><td>or</td></tr></table></body></html>")]
