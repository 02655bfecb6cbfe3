"""Operator 11 against a plain Merkle tree."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from calyx.llm import merkle
from tests.llm.data import documents, rows

COLS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, n_chars):
    return h(*map(enc, (r[0], r[3], r[2], n_chars, r[1])))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([h(*low[i:i + 2]) for i in range(0, len(low), 2)])
    return levels


def way(levels, i):
    """(sibling stands left, its digest) of each level below the top."""
    out = []
    for low in levels[:-1]:
        s = i ^ 1
        out.append((s < i, low[s] if s < len(low) else None))
        i //= 2
    return out


def brute(table):
    groups = {}
    for r in table:
        groups.setdefault(r[2], []).append((r, leaf(r, r[4])))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[g] = tree([d for _, d in groups[g]])
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, (r, d) in enumerate(groups[g]):
            path = way(trees[g], i) + way(top, k)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            acc = leaf(r, r[4] + 1) if bad else d
            for left, s in path:
                acc = h(acc) if s is None else h(s, acc) if left else h(acc, s)
            root = top[-1][0]
            out.append((r[0], d, trees[g][-1][0], root, h(*(s for _, s in path if s is not None)), acc, acc == root))
    return out


@pytest.mark.parametrize("bits", [2])
def test_manifest_against_plain_tree(spark, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BITS", bits)
    table = rows() + [rows()[4]] * 3 + [(900 + i, "x", "en", None, i) + rows()[0][5:] for i in range(150)]
    got = merkle.verify(documents(spark, table))
    assert got.columns == COLS
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(table), key=repr)


@pytest.mark.parametrize("n", [1, 64, 65])
def test_sizes_at_block_bounds(spark, n):
    table = [(i, f"t{i}", "en", "s", i, 7, 0.5, "c", "c", "c") for i in range(n)]
    assert sorted(map(tuple, merkle.verify(documents(spark, table)).collect())) == sorted(brute(table))


def test_unsent_tables_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SENT", 0)
    assert sorted(map(tuple, merkle.verify(documents(spark)).collect()), key=repr) == sorted(brute(rows()), key=repr)


def test_nodes_cover_nested_intervals(spark):
    rng = random.Random(1)
    table = [(i, f"t{i}", rng.choice(("en", "de")), "s", i, 7, 0.5, "c", "c", "c") for i in range(201)]
    nodes = merkle.manifest(merkle.leaves_of(documents(spark, table)))[1].collect()
    for g in ("=en", "=de"):
        mine = [r for r in nodes if r["grp"] == g]
        levels = tree([leaf(r, r[4]) for r in table if "=" + r[2] == g])
        assert len(mine) == sum(map(len, levels))
        for r in mine:
            assert r["digest"] == levels[r["level"]][r["lo"] >> r["level"]]
            assert r["hi"] == min(r["lo"] + 2 ** r["level"], len(levels[0]))


def test_empty_table_and_widest_integer(spark):
    assert merkle.verify(documents(spark, [])).collect() == []
    table = [(7 * i, "é", None, None, 2 ** 63 - 1, 7, 0.5, "c", "c", "c") for i in range(9)]
    assert sorted(map(tuple, merkle.verify(documents(spark, table)).collect())) == sorted(brute(table))


def test_one_changed_text_is_found(spark):
    docs = documents(spark)
    good, _, _ = merkle.manifest(merkle.leaves_of(docs), "good")
    changed = merkle.leaves_of(docs.withColumn("text", F.when(F.col("doc_id") == 9, "other").otherwise(F.col("text")))).where("doc_id = 9")
    checked = good.select("doc_id", "path", "root").join(changed.select("doc_id", F.col("leaf").alias("now")), "doc_id")
    assert checked.select(merkle.fold(F.col("now"), F.col("path")) == F.col("root")).collect() == [(False,)]
