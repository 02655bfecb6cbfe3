"""Near-duplicate embeddings by int8 tile products (operator 7).

Vectors of one label are compared by cosine. Equal vectors are one class. A unit
vector x becomes int8 steps q of size s = max|x| / 127 with x = s q + e; the norm of e is
kept. The integer product of two steps bounds the cosine:

    |x.y - s_x s_y q_x.q_y| <= |s_x q_x| |e_y| + |e_x| |s_y q_y| + |e_x| |e_y|

Only pairs whose upper bound reaches the threshold are computed again, in double
precision from the full vectors, and only these figures decide.

Linked unit vectors lie within r = sqrt(2 - 2 threshold) of each other, so their projections
on any unit direction differ by r at most. Classes of a label are dealt into cells of
width r along a fixed direction and into blocks of about ``BLOCK`` inside a cell; tiles are
pairs of blocks of one cell or of two neighbouring cells. A tile is one group of at most
about two blocks. It returns a row for each linked class (its number of links and the
smallest class it is connected to within the tile), never its pairs.

Null, empty or zero vectors, vectors with null or non-finite components, and null labels link with
nothing. Vectors of different length aren't compared. Repeated rows are equal vectors, and so
are linked. A row with a null vec_id counts as a vector; its component is the smallest id it
reaches, or null. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calyx.llm.common import components, stage

THRESHOLD = 0.98
BLOCK = 1024
#: Above the rounding errors of single and double precision sums of a unit vector's products.
SLACK = 1e-5


def direction(dim: int) -> np.ndarray:
    d = np.random.default_rng(dim).standard_normal(dim)
    return d / np.linalg.norm(d)


def prepare(vectors: DataFrame, threshold: float) -> DataFrame:
    """(vec_id, key, grp, cell, vec): key is null for vectors that link with nothing."""
    width = math.sqrt(2 - 2 * threshold) + SLACK

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            key, grp, cell, vec = [], [], [], []
            for v, label in zip(b.column(1), b.column(2).to_pylist()):
                x = None
                if v.is_valid and label is not None and not v.values.null_count and len(v.values):
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                    n = np.linalg.norm(x)
                    x = x if np.isfinite(x).all() and np.isfinite(n) and n > 0 else None
                if x is None:
                    key.append(None), grp.append(None), cell.append(None), vec.append(None)
                    continue
                g = f"{label}/{len(x)}"
                key.append(hashlib.blake2b(g.encode() + b"/" + x.tobytes(), digest_size=16).hexdigest())
                grp.append(g)
                cell.append(math.floor(float((x / n) @ direction(len(x))) / width))
                vec.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key, pa.string()), pa.array(grp, pa.string()),
                                              pa.array(cell, pa.int64()), pa.array(vec, pa.binary())],
                                             ["vec_id", "key", "grp", "cell", "vec"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"),
                          F.col("label").cast("string").alias("label"))
    return rows.mapInArrow(run, "vec_id long, key string, grp string, cell long, vec binary")


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of ``x`` (unit vectors): steps, step size, norm of the steps' vector, norm of the error."""
    s = np.abs(x).max(1) / 127
    q = np.rint(x / s[:, None])
    back = q * s[:, None]
    return q.astype(np.int8), s, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def possible(a, b, threshold: float) -> np.ndarray:
    """Pairs whose cosine may reach the threshold, from the quantised rows."""
    (qa, sa, na, ea), (qb, sb, nb, eb) = a, b
    # products of int8 add up exactly in single precision below 2 ** 24, in double beyond
    kind = np.float32 if 127 * 127 * qa.shape[1] < 1 << 24 else np.float64
    dot = qa.astype(kind) @ qb.astype(kind).T
    bound = dot * np.outer(sa, sb) + np.outer(na + ea, eb) + np.outer(ea, nb)
    return bound >= threshold - SLACK


def links_of(x: np.ndarray, y: np.ndarray, threshold: float, step: int = 256) -> np.ndarray:
    """The links between the rows of ``x`` and ``y`` (full vectors) as a matrix of truth values."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    b = quantise(y / ny[:, None])
    out = np.zeros((len(x), len(y)), bool)
    for at in range(0, len(x), step):
        part, n = x[at:at + step], nx[at:at + step]
        maybe = possible(quantise(part / n[:, None]), b, threshold)
        i, j = np.nonzero(maybe)
        for k in range(0, len(i), 1 << 14):
            p, q = i[k:k + (1 << 14)], j[k:k + (1 << 14)]
            cos = np.einsum("ij,ij->i", part[p], y[q]) / (n[p] * ny[q])
            out[at + p[cos >= threshold], q[cos >= threshold]] = True
    return out


def tile(threshold: float):
    """Of one tile: each linked class with its number of links and the smallest class it reaches."""

    def run(g: pa.Table) -> pa.Table:
        g = g.sort_by("key")
        own = g.column("own")[0].as_py()
        vec = np.vstack([np.frombuffer(v, np.float64) for v in g.column("vec").to_pylist()])
        side, weight = g.column("side").to_numpy(), g.column("n").to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if own else 1))
        n, root = np.zeros(len(vec), np.int64), np.arange(len(vec))
        if len(left) and len(right):
            hit = links_of(vec[left], vec[right], threshold)
            if own:
                np.fill_diagonal(hit, False)
            n[left] = hit @ weight[right]
            if not own:
                n[right] = hit.T @ weight[left]
            while True:  # the smallest class reached, over all links of the tile
                old = root.copy()
                root[left] = np.minimum(root[left], np.where(hit, root[right][None, :], len(vec)).min(1))
                root[right] = np.minimum(root[right], np.where(hit, root[left][:, None], len(vec)).min(0))
                root = root[root]
                if (old == root).all():
                    break
        some = np.flatnonzero(n)
        key = g.column("key")
        return pa.table({"key": key.take(some), "links": n[some], "root": key.take(root[some])})

    return run


def link(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors(vec_id, embedding, label)``."""
    rows = stage(prepare(vectors, threshold), "embed-rows")
    classes = rows.where("key is not null").groupBy("key").agg(
        F.first("grp").alias("grp"), F.first("cell").alias("cell"), F.first("vec").alias("vec"),
        F.count("*").alias("n"), F.min("vec_id").alias("low"))
    classes = stage(classes, "embed-classes")
    cells = classes.groupBy("grp", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    before = cells.select("grp", (F.col("cell") + 1).alias("cell"), F.col("blocks").alias("below"))
    after = cells.select("grp", (F.col("cell") - 1).alias("cell"), F.col("blocks").alias("above"))
    near = cells.join(before, ["grp", "cell"], "left").join(after, ["grp", "cell"], "left")
    at = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")

    def tiles(a, i, b, j, side, own):
        return F.struct(a.alias("c1"), i.alias("b1"), b.alias("c2"), j.alias("b2"), F.lit(side).alias("side"), own.alias("own"))

    def each(n, make):
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), make)).otherwise(F.array().cast(
            "array<struct<c1:bigint,b1:int,c2:bigint,b2:int,side:int,own:boolean>>"))

    c, i, no = F.col("cell"), F.col("i"), F.lit(False)
    where = F.concat(
        # blocks of the cell itself: left of itself and of later blocks, right of earlier ones
        each(F.col("blocks") - i, lambda k: tiles(c, i, c, i + k, 0, k == 0)),
        each(i, lambda k: tiles(c, k, c, i, 1, no)),
        each(F.coalesce("above", F.lit(0)), lambda k: tiles(c, i, c + 1, k, 0, no)),
        each(F.coalesce("below", F.lit(0)), lambda k: tiles(c - 1, k, c, i, 1, no)))
    dealt = (classes.join(near, ["grp", "cell"]).withColumn("i", at)
             .select("grp", "key", "vec", "n", F.explode(where).alias("t")).select("grp", "key", "vec", "n", "t.*"))
    found = stage(dealt.groupBy("grp", "c1", "b1", "c2", "b2").applyInArrow(tile(threshold), "key string, links long, root string"),
                  "embed-found")
    comp = components(found.select(F.col("key").alias("src"), F.col("root").alias("dst")), "embed").toDF("key", "component")
    total = found.groupBy("key").agg(F.sum("links").alias("links"))
    every = stage(classes.select("key", "n", "low").join(total, "key", "left").join(comp, "key", "left").select(
        "key", "low", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
        F.coalesce("component", "key").alias("component")), "embed-decided")
    least = every.groupBy("component").agg(F.min("low").alias("component_id"))
    decided = every.join(least, "component").select("key", "links", "component_id")
    out = rows.select("vec_id", "key").join(decided, "key", "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"),
                      F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))
