"""Pages landing in a folder are processed batch by batch (availableNow)."""

import tempfile

from calyx.streaming.landing import start_landing

from . import fixtures as X
from .conftest import pages_df


def test_landing_stream_extracts_links(spark):
    base = tempfile.mkdtemp(prefix="calyx-stream-")
    land, out = f"{base}/land", f"{base}/out"
    pages_df(spark, X.MCGILL[:2]).coalesce(1).write.mode("append").parquet(land)
    pages_df(spark, X.UBC[:1]).selectExpr("page_id + 100 as page_id", "url", "html") \
        .coalesce(1).write.mode("append").parquet(land)
    q = start_landing(spark, land, out, checkpoint=f"{base}/ckpt", max_files_per_trigger=1)
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    assert got.count() == 6                  # 3 + 2 links on the listing pages, 1 on the table page
    assert got.filter("url like 'https://www.mcgill.ca/study/%'").count() == 5


def test_landing_stream_replay_adds_nothing(spark):
    base = tempfile.mkdtemp(prefix="calyx-stream-")
    land, out, ck = f"{base}/land", f"{base}/out", f"{base}/ckpt"
    pages_df(spark, X.MCGILL[:1]).coalesce(1).write.mode("append").parquet(land)
    start_landing(spark, land, out, checkpoint=ck).awaitTermination(300)
    first = spark.read.parquet(out).count()
    start_landing(spark, land, out, checkpoint=ck).awaitTermination(300)   # same checkpoint: no new files
    assert spark.read.parquet(out).count() == first == 3


def test_first_wins_over_a_stream(spark):
    from calyx.operators import dims as D
    from calyx.streaming.landing import start_first_wins
    base = tempfile.mkdtemp(prefix="calyx-stream-")
    land, out, ck = f"{base}/land", f"{base}/out", f"{base}/ckpt"
    schema = "href string, page_id long, pos long"
    for rows in ([("/a", 5, 1), ("/b", 5, 2)], [("/a", 1, 9), ("/c", 2, 1), ("/c", 2, 0)], [("/b", 9, 9)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(land)
    for _ in range(2):
        start_first_wins(spark, land, schema, out, ["href"], ["page_id", "pos"], checkpoint=ck, max_files_per_trigger=1).awaitTermination(300)
        got = D.merged_firsts(spark, out, ["href"], ["page_id", "pos"]).collect()
        assert sorted(map(tuple, got)) == [("/a", 1, 9, 2), ("/b", 5, 2, 2), ("/c", 2, 0, 2)]
