"""Dimensions, ids and dedup: invariants, and a dimension rebuilt from its rows."""

import pytest
from pyspark.sql import functions as F

from calyx.operators import dims as D

SUBJECTS = [(0, "Art", ["ARTH", "ARTT"], "About art"), (1, "", ["", "COMM"], ""), (2, "Biology & more", ["BIOL"], "Life"),
            (3, "Art History", ["ARTH", "", "HIST"], ""), (4, "Computing", ["CISC", "CMPE", "ELEC"], "Machines")]


def test_subject_dim_rebuilds_its_rows(spark):
    rows = [(s * 10 + k, name, code, desc if k == 0 else "later") for s, name, codes, desc in SUBJECTS for k, code in enumerate(codes)]
    rows += [(100 + i, name, codes[0], "again") for i, (_, name, codes, _) in enumerate(SUBJECTS)]   # repeats change nothing
    courses = spark.createDataFrame(rows[::-1], "ord long, SubjectName string, courseCode string, SubjectDescription string").repartition(3)
    got = D.subject_dim(courses).select("subjectId", "name", "codes", "description")
    assert sorted(map(tuple, got.collect())) == SUBJECTS


@pytest.mark.parametrize("most", [100_000, 2])
def test_attach_ids_small_and_large_dimension(spark, monkeypatch, most):
    monkeypatch.setattr(D, "LOOKUP_ROWS", most)
    rows = spark.range(0, 900).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("k"), "id")
    dim = spark.createDataFrame([("hot", 0), ("k0", 1), ("k1", 2), ("k2", 3), ("k3", 4)], "k string, subjectId int")
    got = D.attach_ids(rows, dim, ["k"], "subjectId")
    want = {"hot": 0, "k0": 1, "k1": 2, "k2": 3, "k3": 4}
    assert sorted((r.id, r.subjectId) for r in got.collect()) == [
        (i, want.get("hot" if i % 3 else f"k{i % 5}")) for i in range(900)]


def test_dense_ids_hot_partition_key(spark):
    # one partition key holds most rows: ids stay dense per key across tasks
    df = spark.range(0, 5000).select(F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("k"),
                                     (F.col("id") * 7 % 5000).alias("o"))
    out = D.dense_ids(df, ["o"], name="i", partition=["k"], base=1, partitions=7)
    for k in ("a", "b"):
        got = [r["i"] for r in out.filter(F.col("k") == k).orderBy("o").collect()]
        assert got == list(range(1, len(got) + 1))


def test_first_per_key_survivor(spark):
    df = spark.createDataFrame([(3, "x", "a"), (1, "x", "b"), (2, "y", "c"), (5, "x", "d")],
                               "ord int, key string, v string")
    got = sorted(map(tuple, D.first_per_key(df, ["key"], ["ord"]).collect()))
    assert got == [(1, "x", "b", 3), (2, "y", "c", 1)]
    none = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (3, "", "c"), (4, "-", "d")], "ord int, key string, v string")
    assert sorted(map(tuple, D.first_per_key(none, ["key"], ["ord"], keep=["ord", "v"]).collect())) == [(1, "a", 2), (3, "c", 1), (4, "d", 1)]


def test_ordered_distinct(spark):
    df = spark.createDataFrame([(1, "s", "B"), (2, "s", "A"), (3, "s", "B"), (4, "s", "")],
                               "ord int, k string, code string")
    got = D.ordered_distinct(df, ["k"], "code", "ord", "codes").collect()[0]["codes"]
    assert got == ["B", "A", ""]                          # first-seen order, "" kept


def test_dense_ids_repeatable(spark):
    df = spark.range(0, 3000).select((F.col("id") % 97).cast("string").alias("k"), (F.col("id") * 13 % 3000).alias("o"))
    a = D.dense_ids(df, ["o"], name="i", partition=["k"], partitions=5).select("k", "o", "i")
    b = D.dense_ids(df, ["o"], name="i", partition=["k"], partitions=9).select("k", "o", "i")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_ids_of_later_landings_go_on(spark, tmp_path):
    def landing(rows):
        return spark.createDataFrame(rows, "k string, at long")

    path = str(tmp_path / "registry")
    one = D.register_landing(path, 0, landing([("b", 1), ("a", 2), ("b", 3), (None, 4)]), ["k"], ["at"], base=10)
    assert sorted(map(tuple, one.collect()), key=str) == sorted([("b", 10), ("a", 11), (None, 12)], key=str)
    more = landing([("z", 1), ("a", 2), (None, 3), ("c", 0), ("z", 0), ("b", 0), ("c", 9)])
    for _ in range(2):   # running a landing again changes nothing
        two = D.register_landing(path, 1, more, ["k"], ["at"], base=10)
        assert sorted(map(tuple, two.collect()), key=str) == sorted([("b", 10), ("a", 11), (None, 12), ("c", 13), ("z", 14)], key=str)
    three = D.register_landing(path, 2, landing([("a", 1)]), ["k"], ["at"], base=10)   # nothing new
    assert three.count() == 5
    four = D.register_landing(path, 3, landing([("q", 1)]), ["k"], ["at"], base=10)
    assert {r["k"]: r["id"] for r in four.collect()}["q"] == 15
    empty = D.register_landing(str(tmp_path / "empty"), 0, landing([]), ["k"], ["at"])
    assert empty.collect() == []
    assert [tuple(r) for r in D.register_landing(str(tmp_path / "empty"), 1, landing([("x", 1)]), ["k"], ["at"], base=3).collect()] == [("x", 3)]


def test_first_wins_whatever_the_split(spark, tmp_path):
    import random
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot", "hot", "a", "b", None]), rng.randrange(40), f"v{i}") for i in range(200)]
    whole = D.first_per_key(spark.createDataFrame(rows, "id long, k string, at long, v string"), ["k"], ["at", "id"])
    want = sorted(map(tuple, whole.collect()), key=str)
    for seed in (1, 2):
        path = str(tmp_path / f"s{seed}")
        parts = [[r for r in rows if (r[0] * 7 + seed) % 4 == n] for n in range(4)]
        rng.shuffle(parts)
        for n in (0, 1, 2, 1, 3):   # the second landing is replayed
            D.land_firsts(path, n, spark.createDataFrame(parts[n], "id long, k string, at long, v string"), ["k"], ["at", "id"])
        assert sorted(map(tuple, D.merged_firsts(spark, path, ["k"], ["at", "id"]).collect()), key=str) == want


def test_hot_key_is_ranked_by_many_tasks_into_bounded_parts(spark):
    rows = spark.range(0, 4000).select(F.when(F.col("id") % 10 > 0, "").otherwise(F.concat(F.lit("s"), F.col("id") % 3)).alias("subject"),
                                       F.concat(F.lit("c"), F.col("id") % 1500).alias("code"), (4000 - F.col("id")).alias("ord"))
    parts = D.ordered_parts(rows, ["subject"], "code", "ord", "codes", size=100)
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("Scan parquet")[0] or "_tid" in plan      # ranks come from the tasks, not from one window a subject
    got = parts.collect()
    assert max(len(r["codes"]) for r in got) <= 100 and sum(r["subject"] == "" for r in got) > 10
    whole = {r["subject"]: r["codes"] for r in D.ordered_distinct(rows, ["subject"], "code", "ord", "codes").collect()}
    joined = {}
    for r in sorted(got, key=lambda r: (r["subject"], r["part"])):
        joined.setdefault(r["subject"], []).extend(r["codes"])
    assert joined == whole
