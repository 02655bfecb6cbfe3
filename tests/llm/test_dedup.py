"""Operators 1 and 7 against brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from calyx.llm import embed_dedup, minhash
from calyx.llm.common import components
from tests.llm.data import documents, rows


def shingle_set(t, width=2):
    w = t.encode().lower().split() if t else []
    if not w:
        return frozenset()
    return frozenset(zip(*(w[k:] for k in range(min(width, len(w))))))


def union_find(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(table, width=2):
    live = [(i, shingle_set(t, width)) for i, t in table if i is not None and shingle_set(t, width)]
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(live, 2) if 100 * len(x & y) >= 80 * len(x | y)]
    return union_find({i for i, _ in table if i is not None}, links)


def check(spark, docs, table, width=2):
    got = minhash.link(docs, width).collect()
    want = brute(table, width)
    assert len(got) == len(table)
    assert sorted((r.doc_id, r.n_shingles) for r in got if r.doc_id is not None) == sorted(
        (i, len(shingle_set(t, width))) for i, t in table if i is not None)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept is False
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id), r


def test_near_copies_match_brute_force(spark):
    table = [(r[0], r[1]) for r in rows()]
    check(spark, documents(spark), table)


def test_group_of_near_copies_and_chain(spark):
    rng = random.Random(1)
    base = [f"w{k}" for k in range(80)]
    table = []
    for i in range(60):  # variants of one text, and steps away from it
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(80)] = f"v{rng.randrange(1000)}"
        table.append((i, " ".join(w)))
    chain = list(base)
    for i in range(100, 130):
        chain[(i * 7) % 80] = f"c{i}"
        table.append((i, " ".join(chain)))
    table += [(200, "of the"), (201, "OF  the"), (202, "of the x"), (203, "a"), (204, "A"), (205, "a b")]
    rng.shuffle(table)
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    check(spark, df, table)
    check(spark, df, table, width=5)


def test_empty_documents(spark):
    assert minhash.link(documents(spark, [])).collect() == []
    assert minhash.drop_near_copies(documents(spark, [])).collect() == []


def test_one_of_each_group_stays(spark):
    docs = documents(spark)
    kept = minhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    table = [(r[0], r[1]) for r in rows()]
    want = brute(table, 5)
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({i for i, c in want.items() if i == c})
    assert ids.count(None) == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(k, k + 1) for k in range(200, 260)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "src long, dst long"), "test").collect()}
    want = union_find({x for e in edges for x in e}, edges)
    assert got == {i: c for i, c in want.items() if any(i in e and e[0] != e[1] for e in edges)}


def vectors(n=300, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    out = []
    for i in range(n):
        v = centres[i % 12] + rng.standard_normal(dim) * (0.05 if i % 3 else 0.6)
        out.append((i, [float(x) for x in v.astype(np.float32)], i % 12 % 4))
    out += [(n + k, out[5][1], out[5][2]) for k in range(30)]  # one large group of equal vectors
    out += [(n + 40, None, 1), (n + 41, [], 1), (n + 42, [0.0] * dim, 1), (n + 43, [float("nan")] + [1.0] * (dim - 1), 1),
            (n + 44, [None] + [1.0] * (dim - 1), 1), (n + 45, out[5][1], None), (n + 46, [1.0, 2.0], 1), (n + 47, [2.0, 4.0], 1),
            (n + 48, [float("inf")] * dim, 1), (None, out[5][1], out[5][2]), out[7]]
    return out


@pytest.mark.parametrize("block", [4, 1024])
def test_embeddings_match_brute_force(spark, block):
    table = vectors()
    df = spark.createDataFrame([(*r, "x", 1) for r in table], "vec_id long, embedding array<float>, label int, key string, n long")
    got = embed_dedup.link(df, block=block).collect()
    ok = []
    for k, (_, v, label) in enumerate(table):
        if label is not None and v and None not in v and np.isfinite(v).all() and any(v):
            x = np.array(v, np.float32).astype(float)
            ok.append((k, x / np.linalg.norm(x), label))
    links = [(a, b) for (a, x, p), (b, y, q) in itertools.combinations(ok, 2) if p == q and len(x) == len(y) and x @ y >= 0.98]
    assert len(links) > 300
    n = np.bincount([x for e in links for x in e], minlength=len(table))
    comp = union_find(range(len(table)), links)
    least = {}
    for k, c in comp.items():
        if table[k][0] is not None:
            least[c] = min(table[k][0], least.get(c, table[k][0]))
    want = sorted((table[k][0], int(n[k]), least.get(comp[k]), least.get(comp[k]) == table[k][0]) for k in range(len(table)) if table[k][0] is not None)
    assert sorted(tuple(r) for r in got if r.vec_id is not None) == want
    assert [tuple(r)[1:] for r in got if r.vec_id is None] == [(int(n[-2]), least[comp[len(table) - 2]], False)]


def test_bounds_hold():
    rng = np.random.default_rng(5)
    x, y = (v / np.linalg.norm(v, axis=1)[:, None] for v in rng.standard_normal((2, 200, 32)))
    a, b = embed_dedup.quantise(x), embed_dedup.quantise(y)
    cos = x @ y.T
    for t in (0.0, 0.2, 0.4):
        assert embed_dedup.possible(a, b, t)[cos >= t].all()


def test_empty_embeddings(spark):
    assert embed_dedup.link(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
