"""Operator 13 against a plain trie with a node for every prefix."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from calyx.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, key string, n int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], SCHEMA)


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(abs(c) % 100 * (1 if c >= 0 else -1)), [])[:h] + ts[h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        path = tuple(convs[c])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for p in members:
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += not kids[p]
    return sorted(((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), kids[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p in members), key=repr)


def made(seed, convs, words="ab", longest=9):
    """Conversations of few different turns, so that they share prefixes, part inside edges and contain each other."""
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for turn in range(rng.choice((1, 2, 3, 4, longest))):
            rows.append((c * 7 % 250 if c % 3 else c, turn, "user", rng.choice(words)))
    return rows


AWKWARD = [(None, 0, "user", "lost"), (None, None, None, None), (3, None, "system", "first"), (3, 0, None, "x"), (3, 1, "user", None), (3, 1, "user", "é" * 5000),
           (3, 1, "user", "tie"), (3, 1, "user", "tie"), (4, -5, "", ""), (100, 0, "user", "a"), (101, 0, "user", "a"), (-1, 0, "user", "minus"), (-101, 0, "user", "minus"),
           (2 ** 62, 9, "user", "high"), *((5, t, "user", "same") for t in range(40)), *((6, t, "user", "same") for t in range(33))]


def check(spark, rows):
    got = trie.report(table(spark, rows))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_random_and_awkward_conversations(spark):
    check(spark, made(1, 150) + AWKWARD)


def test_salted_lookups_and_chunked_ids(spark, monkeypatch):
    monkeypatch.setattr(trie, "SENT", 0)
    monkeypatch.setattr(trie, "CHUNK_BITS", 1)
    check(spark, made(2, 120) + [(c, 0, "user", "copy") for c in range(300, 340)])


def test_empty_and_only_lost_rows(spark):
    assert trie.report(table(spark, [])).collect() == []
    assert trie.report(table(spark, AWKWARD[:2])).collect() == []


def test_conversations_without_turns(spark):
    bare = spark.createDataFrame([(1, []), (2, []), (3, [(b"x" * 16, 4)])], "conv_id long, turns array<struct<digest:binary,size:bigint>>")
    got = sorted(map(tuple, trie.trie_of(bare).select("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens").collect()))
    assert got == [(1, 0, 3, 1, 1, 0), (3, 1, 1, 0, 1, 0)]


def test_fattest_numbers(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", trie.fattest(F.col("a"), F.col("b"))).collect()
    for a, b, f in got:
        assert f == max(range(a + 1, b + 1), key=lambda x: x & -x)


@pytest.mark.parametrize("seed", [5])
def test_batches_give_the_compacted_trie_and_exits(spark, seed):
    rows = made(seed, 90)
    strings = trie.strings_of(trie.chained(trie.rebuilt(table(spark, rows)))).cache()
    longest = strings.agg(F.max("len")).first()[0]
    nodes = trie.build(strings, longest)
    convs = {tuple(t) for t in rebuilt(rows).values()}
    prefixes = {t[:d] for t in convs for d in range(1, len(t) + 1)}
    explicit = {p for p in prefixes if p in convs or len({q[len(p)] for q in prefixes if len(q) == len(p) + 1 and q[:len(p)] == p}) > 1}
    got = nodes.select("depth", "up", F.size("edge").alias("n")).collect()
    ups = sorted((len(p), max(d for d in range(len(p)) if d == 0 or p[:d] in explicit)) for p in explicit)
    assert sorted((r["depth"], r["up"]) for r in got) == ups and all(r["n"] == r["depth"] - r["up"] for r in got)
    # every string ends at its own node; a longer one leaves below it
    found = trie.locate(strings, nodes, longest, True).select("len", "low", "child_key").collect()
    assert all(r["low"] == r["len"] and r["child_key"] is None for r in found)
