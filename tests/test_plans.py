"""Physical-plan properties that matter at scale (checked with explain)."""

from calyx.operators import html as H
from calyx.operators import links as L
from calyx.operators import segment as G
from calyx.session import is_clustered_by
from calyx.sources import io as IO

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_page_pipeline_has_one_exchange(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    x = L.extract_links(H.shred(pages))
    assert exchanges(x) == 1                       # the pages, hashed on page_id, once
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_bucketed_pages_need_no_shuffle(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    b = IO.land_bucketed(pages, "pages_bucketed_test", "page_id", 4)
    assert is_clustered_by(b, "page_id") and not is_clustered_by(pages, "page_id")
    counts = b.groupBy("page_id").count()
    assert exchanges(counts) == 0
    x = L.extract_links(H.shred(b))
    assert exchanges(x) == 1                       # the pages with their nodes: a Python call hides the buckets
    y = L.extract_links(H.shred(pages))
    assert sorted(map(tuple, x.collect())) == sorted(map(tuple, y.collect()))


def test_marked_pages_are_neither_moved_nor_sorted(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    n = H.shred(pages, select={"a": [{"tag": "li"}, {"tag": "a"}]}, scopes=["a"], cluster=False)
    plan = n._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan and plan.count("ArrowEvalPython") == 1


def test_document_windows_share_one_exchange(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ls = G.lines(docs, "doc_id")
    b = G.segment(ls, "doc_id", ls["line"].rlike("^[A-Z][^ .|]*\\.\\z"))
    assert exchanges(b) == 1


def test_nodes_are_sized_from_the_pages_and_stored_in_columns(spark, monkeypatch):
    import calyx.session as S
    from calyx.plans.extract import staged_nodes
    monkeypatch.setattr(S, "CLUSTER_TARGET_BYTES", 4096)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    some = pages.join(pages.where("page_id % 2 = 0").select("page_id"), "page_id", "left_semi")   # no size of its own
    n = staged_nodes(some)
    assert n.rdd.getNumPartitions() > S.shuffle_partitions(spark)
    assert is_clustered_by(n, "page_id")
    plan = n.select("page_id", "tag")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,tag:string>" in plan and "RDD" not in plan


def test_links_carry_the_url(spark):
    from calyx.plans.queries import QUERIES
    plan = QUERIES["links_dedup_global"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "RoundRobin" not in plan and plan.count("Exchange") == 2
    plan = QUERIES["heading_container_next"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and set(x.split(",")[0] for x in plan.split("hashpartitioning(")[1:]) and plan.count("hashpartitioning(page_id") == plan.count("Exchange")


def test_cascade_counts_in_one_aggregate(spark):
    from calyx.plans.queries import QUERIES
    plan = QUERIES["rule_cascade"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    import pytest

    import calyx.session as S

    class Conf:
        def get(self, key, default=None):
            return "yarn" if key == "spark.master" else default

    class Context:
        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        S.checkpoint_dir(Session())


def test_scan_prunes_columns(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    x = H.tokens(pages, cluster=False).select("page_id", "tag")
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "url" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_batches_of_pages_are_folded_in_bounded_pieces(spark, monkeypatch):
    import pyarrow as pa

    from calyx.operators import tree as T
    monkeypatch.setattr(T, "NODES", 100)
    codes = [[T.OPEN, T.TEXT, T.CLOSE] * (i % 7) for i in range(300)] + [[T.OPEN] * 500, [], [T.TEXT]]
    tags = [["li" if c != T.TEXT else "" for c in page] for page in codes]
    bits = [[int(c == T.OPEN) for c in page] for page in codes]
    arrays = pa.array(codes, pa.list_(pa.int32())), pa.array(tags, pa.list_(pa.string())), pa.array(bits, pa.list_(pa.int64())), pa.array([len(x) for x in codes], pa.int32())
    f = T.fold({"li": [{"tag": "li"}]}, ["li"], H._RULES, True).func
    out = list(f(iter([arrays, tuple(a.slice(4, 9) for a in arrays), tuple(a.slice(0, 0) for a in arrays)])))
    assert all(len(x.flatten()) < 100 + 18 or len(x.flatten()) < 100 + 500 and len(x[-1]) == 500 for x in out) and len(out) > 15
    got = [page for x in out for page in x.to_pylist()]
    alone = [next(f(iter([tuple(a.slice(i, 1) for a in arrays)]))).to_pylist()[0] for i in range(len(codes))]
    assert got == alone + alone[4:13]


def test_a_long_page_is_folded_in_little_memory(spark):
    import tracemalloc

    import pyarrow as pa

    from calyx.operators import tree as T
    n = 60_000
    codes, tags, bits = [T.OPEN, T.TEXT, T.CLOSE] * (n // 3), ["li", "", "li"] * (n // 3), [1, 0, 0] * (n // 3)
    arrays = pa.array([codes], pa.list_(pa.int32())), pa.array([tags], pa.list_(pa.string())), pa.array([bits], pa.list_(pa.int64())), pa.array([n], pa.int32())
    f = T.fold({"li": [{"tag": "li"}]}, ["li"], H._RULES, True).func
    tracemalloc.start()
    try:
        (out,) = f(iter([arrays]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    nodes = out.flatten()
    assert len(nodes) == n and peak < 200 * n
    assert nodes.slice(n - 4, 4).to_pylist() == [
        {"src": n - 4, "end": n - 4, "level": 1, "parent": None, "parent_tag": "", "prev": n - 6, "hits": 0, "in_li": []},
        {"src": n - 3, "end": n - 1, "level": 1, "parent": None, "parent_tag": "", "prev": n - 6, "hits": 1, "in_li": []},
        {"src": n - 2, "end": n - 2, "level": 2, "parent": n - 3, "parent_tag": "li", "prev": None, "hits": 0, "in_li": [n - 3]},
        {"src": n - 1, "end": n - 1, "level": 1, "parent": None, "parent_tag": "", "prev": n - 3, "hits": 0, "in_li": []}]


def test_batches_of_pages_are_bounded_by_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    try:
        spark.conf.unset(key)
        H.shred(pages)
        assert 0 < int(spark.conf.get(key)) <= 64 << 20
        spark.conf.set(key, "12345")   # what the session says holds
        n = H.shred(pages).count()
        assert spark.conf.get(key) == "12345"
        spark.conf.set(key, "100000000")
        assert H.shred(pages).count() == n
    finally:
        spark.conf.unset(key)


def test_crawled_pages_are_dealt_over_tasks_whatever_their_files(spark, monkeypatch, tmp_path):
    import calyx.session as S
    from calyx.plans import queries as Q
    spark.range(1, 400, 1, 1).selectExpr("id as p_partkey").write.parquet(f"{tmp_path}/part.parquet")   # one file
    monkeypatch.setattr(S, "CLUSTER_TARGET_BYTES", 4096)
    seen, shred = [], Q.H.shred
    monkeypatch.setattr(Q.H, "shred", lambda pages, *a, **k: seen.append(pages) or shred(pages, *a, **k))
    got = Q.QUERIES["crawl_levels"](spark, str(tmp_path)).collect()
    size = sum(len(r["html"]) for r in seen[0].collect())
    assert seen[0].rdd.getNumPartitions() == -(-size // 4096) > S.shuffle_partitions(spark)
    edges = [(k, d) for k in range(1, 400) for d in ([1] if k % 7 == 0 else [2 * k, 3 * k + 1, k - 1, k]) if 0 < d < 400]
    from .test_links import plain_levels
    assert sorted(map(tuple, got), key=lambda r: r[0]) == plain_levels(edges, [1])
    none = spark.createDataFrame([], "page_id long, html string")
    assert S.spread(none, "page_id", "html").count() == 0
