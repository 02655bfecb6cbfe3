"""URL and link operators (L2-L11) on explicit cases."""

from pyspark.sql import functions as F

from calyx.operators import links as L


def test_resolve_url_forms(spark):
    base = "https://www.example.edu/cal/2020/index.html?x=1#top"
    cases = [("https://other.org/a", "https://other.org/a"),
             ("//cdn.example.edu/s.css", "https://cdn.example.edu/s.css"),
             ("/courses/a-1", "https://www.example.edu/courses/a-1"),
             ("page2.html", "https://www.example.edu/cal/2020/page2.html"),
             ("?p=2", "https://www.example.edu/cal/2020/index.html?p=2"),
             ("#sec", "https://www.example.edu/cal/2020/index.html?x=1#sec"),
             ("", "https://www.example.edu/cal/2020/index.html?x=1"),
             ("../d.html", "https://www.example.edu/cal/d.html"), ("./e", "https://www.example.edu/cal/2020/e"),
             ("../../../up", "https://www.example.edu/up"), ("a/../b/./c?q=../x", "https://www.example.edu/cal/2020/b/c?q=../x"),
             ("..", "https://www.example.edu/cal/"), ("/x/../y/.", "https://www.example.edu/y/")]
    df = spark.createDataFrame([(base, h) for h, _ in cases], "u string, h string")
    got = [r[0] for r in df.select(L.resolve_url("u", "h")).collect()]
    assert got == [w for _, w in cases]
    bare = spark.createDataFrame([("https://x.org", "a.html"), ("https://x.org", "../a"), ("https://x.org?q", "a")], "u string, h string")
    assert [r[0] for r in bare.select(L.resolve_url("u", "h")).collect()] == ["https://x.org/a.html", "https://x.org/a", "https://x.org/a"]


def test_query_fragment_rewrite(spark):
    df = spark.createDataFrame([("https://x.org/a.html?subjectCode=AC%20G&courseCode=1+2#f",),
                                ("https://x.org/{bad}?coid=7",), ("https://x.org/a.html/b.html",)], "u string")
    r = df.select(L.query_param("u", "subjectCode").alias("s"), L.query_param("u", "courseCode").alias("c"),
                  L.query_param("u", "missing").alias("m"), L.drop_fragment("u").alias("d"),
                  L.rewrite_first("u", r"\.html", "/courses.html").alias("w")).collect()
    assert (r[0]["s"], r[0]["c"], r[0]["m"]) == ("AC G", "1 2", "")
    assert r[0]["d"] == "https://x.org/a.html?subjectCode=AC%20G&courseCode=1+2"
    assert r[1]["s"] == ""                                   # unparsable URL -> "" (no error)
    assert r[2]["w"] == "https://x.org/a/courses.html/b.html"  # first occurrence only


def test_pages_and_frontier(spark):
    df = spark.createDataFrame([("https://x.org/search?page=3",), ("https://x.org/search",)], "href string")
    e = L.expand_pages(df.withColumn("last", L.last_page_number("href")), "last")
    urls = [r[0] for r in e.select(L.template_url("https://x.org/search?page=%d", "page_no")).collect()]
    assert urls == ["https://x.org/search?page=1", "https://x.org/search?page=2", "https://x.org/search?page=3"]
    links = spark.createDataFrame([("https://x.org/a",), ("https://x.org/b",), ("https://x.org/a",)], "url string")
    pages = spark.createDataFrame([("https://x.org/a",)], "url string")
    got = sorted(tuple(r) for r in L.frontier(links, pages).collect())
    assert got == [("https://x.org/a", True), ("https://x.org/a", True), ("https://x.org/b", False)]
    assert [r[0] for r in L.to_land(links, pages).collect()] == ["https://x.org/b"]


def test_link_dedup_first_wins(spark):
    lk = spark.createDataFrame([(1, 5, "/a", "x"), (1, 2, "/a", "y"), (2, 1, "/a", "z")],
                               "page_id long, pos long, href string, label string")
    inpage = sorted(tuple(r) for r in L.dedup_links_in_page(lk).collect())
    assert inpage == [(1, "/a", 2, "y", 2), (2, "/a", 1, "z", 1)]
    glob = L.dedup_links_global(lk.withColumn("host", F.lit("x.org")), ["host", "href"], ["page_id", "pos"]).collect()
    assert [(r["page_id"], r["pos"], r["label"], r["n_seen"]) for r in glob] == [(1, 2, "y", 3)]


def plain_levels(edges, seeds):
    out, now, k = {s: (0, None) for s in seeds}, set(seeds), 0
    while now:
        k += 1
        nxt = {}
        for a, b in edges:
            if a in now and b not in out and a != b:
                nxt[b] = min(nxt.get(b, a), a)
        out.update({b: (k, a) for b, a in nxt.items()})
        now = set(nxt)
    return sorted((p, *x) for p, x in out.items())


def test_crawl_reaches_its_fixed_point(spark, monkeypatch):
    import random
    rng = random.Random(3)
    monkeypatch.setattr(L, "_LEVELS", 3)
    chain = [(i, i + 1) for i in range(9)] + [(9, 0), (4, 4), (200, 0)]
    hub = [(5, i) for i in range(20, 60)] + [(i, 5) for i in range(20, 60)] + [(rng.randrange(20, 60), rng.randrange(20, 90)) for _ in range(60)]
    edges = chain + hub + chain
    e = spark.createDataFrame(edges, "src long, dst long")
    seeds = spark.createDataFrame([(0,), (0,)], "page_id long")
    got = L.crawl_levels(e, seeds)
    assert got.columns == ["page_id", "level", "parent"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == plain_levels(edges, [0])
    monkeypatch.setattr(L, "LOOKUP_ROWS", 0)
    two = spark.createDataFrame([(3,), (200,)], "page_id long")
    assert sorted(map(tuple, L.crawl_levels(e, two).collect()), key=lambda r: r[0]) == plain_levels(edges, [3, 200])
    assert sorted(r["level"] for r in L.crawl_levels(e, seeds, most=2).collect()) == [0, 1, 2]
    assert L.crawl_levels(e, seeds.limit(0)).collect() == []


def test_link_graph_of_landed_pages(spark):
    pages = spark.createDataFrame([(1, "https://x.org/a"), (2, "https://x.org/b"), (9, "https://x.org/b")], "page_id long, url string")
    links = spark.createDataFrame([(1, "https://x.org/a", "b#x"), (1, "https://x.org/a", "/b"), (1, "https://x.org/a", "/gone"),
                                   (2, "https://x.org/b", "https://x.org/a"), (2, "https://x.org/b", "#here")], "page_id long, url string, href string")
    assert sorted(map(tuple, L.link_edges(links, pages).collect())) == [(1, 2), (2, 1), (2, 2)]
