"""MinHash near-duplicates by a signature-coordinate inverted join (operator 1).

A document is the set of its distinct ``width``-word shingles (lower-cased A-Z,
words between ASCII white space; with fewer words the whole sequence is one
shingle). Two documents are linked when their sets' Jaccard similarity is at
least ``percent`` / 100, confirmed on the full sets. The steps:

1. Documents with equal sets are one class; its smallest doc_id stands for it.
2. Each class is posted under its ``COORDS`` (coordinate, minimum) pairs. Posting
   lists of one class are dropped, and so are classes that are left with fewer
   than ``MATCH`` postings: they can't reach the match threshold with any other.
3. Skip merging: each list names its smallest class as hub, and classes that meet
   the same hub in ``HUB`` lists or more form a family. Inside a family collisions are
   counted from the signatures themselves, block against block, and its posting lists
   are skipped. A large family is first linked to its hubs; blocks whose members
   are one unit by these links are skipped too.
4. Prefix merging: lists that span families are joined, but only under each class's
   size - MATCH + 1 rarest postings: two classes with MATCH common postings share one of them.
5. Pairs with MATCH or more collisions are confirmed on the full sets; components over
   all links.

No list, family or pair is capped or sampled. A task holds two blocks at most; it returns for each
class the smallest one that it is connected to, never a group's pairs. With 48 coordinates
and 28 matches, a pair of similarity 0.8 passes with a chance of 0.9998, more similar ones nearly always.

Null, empty and blank texts have no shingle and link with nothing; rows with a
null doc_id link with nothing. Repeated rows get equal results. Rows that share a
doc_id but not the text count as one document with the links of all. An empty
table gives an empty result. Other columns are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calyx.llm.common import batches, components, mix64, sent, stage, words

WIDTH, PERCENT = 2, 80
COORDS, MATCH = 48, 28
#: Lists with the same hub that put a class into the hub's family.
HUB = 11
#: Classes of a block.
BLOCK = 512
#: Ids of at most this number are sent to every task to pick their texts.
SENT = 2_000_000
#: Rows that are worked on at once in Python.
ROWS = 500
_SEEDS = mix64(np.arange(1, 2 * COORDS + 1, dtype=np.uint64))
_MUL, _ADD = _SEEDS[:COORDS] | np.uint64(1), _SEEDS[COORDS:]


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingles of a text as 64-bit hashes."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = min(width, len(h))
    out = h[:len(h) - n + 1]
    for k in range(1, n):
        out = mix64(out) + h[k:len(h) - n + 1 + k]
    return np.unique(mix64(out + np.uint64(n)))


def signature(sh: np.ndarray) -> np.ndarray:
    """The least value of each coordinate's hash over a set."""
    low = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    x = sh >> np.uint64(16)
    for at in range(0, len(x), 4096):
        low = np.minimum(low, (x[at:at + 4096, None] * _MUL + _ADD).min(0))
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, sig) of whole texts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(parts, ROWS):
            n, key, sig = [], [], []
            for t in b.column(1).to_pylist():
                sh = shingles(t, width)
                n.append(len(sh))
                key.append(hashlib.blake2b(sh.tobytes(), digest_size=16).digest() if len(sh) else None)
                sig.append(signature(sh) if len(sh) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()),
                                              pa.array(sig, pa.list_(pa.int32()))],
                                             ["doc_id", "n_shingles", "set_key", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, set_key binary, sig array<int>")


def full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of the documents in ``ids(id)``: the whole set as one binary value."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(parts, ROWS):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, width).tobytes() for t in b.column(1).to_pylist()],
                                                                    pa.binary())], ["id", "shingles"])

    # few ids go to the texts; beyond the bound texts and ids meet in a shuffle
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(sent(ids, SENT), "id", "left_semi")
    return texts.mapInArrow(run, "id long, shingles binary").dropDuplicates(["id", "shingles"])


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):  # no pair of such sizes reaches the bound
        return False
    both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs(src, dst)`` whose full sets are similar enough."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(parts, ROWS):
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                  for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["src", "dst"]).filter(pa.array(ok, pa.bool_()))

    one = sets.select(F.col("id").alias("src"), F.col("shingles").alias("x"))
    two = sets.select(F.col("id").alias("dst"), F.col("shingles").alias("y"))
    return pairs.join(one, "src").join(two, "dst").select("src", "dst", "x", "y").mapInArrow(run, "src long, dst long")


def shared_postings(classes: DataFrame) -> DataFrame:
    """(id, postings): each class's postings that another class has too, as
    structs (n, key, hub) in order of rarity, where they reach MATCH."""
    post = classes.select("id", F.posexplode("sig").alias("c", "v")).select(
        "id", F.shiftleft(F.col("c").cast("long"), 32).bitwiseOR(F.col("v").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key"))
    lists = post.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("hub")).where("n > 1")
    own = post.join(lists, "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "key", "hub"))).alias("postings"))
    return own.where(F.size("postings") >= MATCH)


def groups(parts: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The groups of rows that are sorted by their first ``keys`` columns."""
    held, last = [], None
    for b in parts:
        if not b.num_rows:
            continue
        t = pa.table([b.column(i) for i in range(keys)], names=[str(i) for i in range(keys)])
        rows = list(zip(*(c.to_pylist() for c in t.columns)))
        cut = [0, *(i for i in range(1, len(rows)) if rows[i] != rows[i - 1]), len(rows)]
        for at, end in zip(cut, cut[1:]):
            if rows[at] != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(at, end - at))
            last = rows[at]
    if held:
        yield pa.Table.from_batches(held)


def tile_maps(member: DataFrame) -> DataFrame:
    """(fam, b1, b2, side, id, unit) of ``member(id, fam, unit)``: which blocks of
    each family meet. Blocks are parts of one large unit, or of all the rest; two
    blocks of the same unit needn't meet."""
    big = member.groupBy("fam", "unit").count().where(F.col("count") >= BLOCK).select("fam", "unit", F.col("unit").alias("part"))
    m = member.join(big, ["fam", "unit"], "left").withColumn("part", F.coalesce(F.col("part").cast("string"), F.lit("")))
    many = m.groupBy("fam", "part").agg(F.ceil(F.count("*") / BLOCK).alias("many"))
    m = stage(m.join(many, ["fam", "part"]).select("id", "fam", "unit", "part", F.pmod(F.xxhash64("id"), "many").alias("k"))
              .withColumn("block", F.concat_ws("/", "part", "k")), "minhash-blocks")
    blocks = m.groupBy("fam", "block").agg(F.first("part").alias("part"))
    meet = blocks.toDF("fam", "b1", "p1").join(blocks.toDF("fam", "b2", "p2"), "fam").where("b1 <= b2 and (p1 != p2 or p1 = '')")
    meet = meet.select("fam", "b1", "b2")
    left = m.join(meet.withColumn("block", F.col("b1")), ["fam", "block"]).select("fam", "b1", "b2", F.lit(0).alias("side"), "id", "unit")
    right = m.join(meet.where("b1 != b2").withColumn("block", F.col("b2")), ["fam", "block"]).select(
        "fam", "b1", "b2", F.lit(1).alias("side"), "id", "unit")
    return left.union(right)


def sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of the two blocks of a tile, and whether it is one block against itself."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return (left, right, False) if len(right) else (left, left, True)


def candidates(tiles: DataFrame) -> DataFrame:
    """The rows of ``tiles(fam, b1, b2, side, id, unit, sig)`` that have MATCH
    collisions with a class of another unit in the tile, without the signature."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(parts, 3):
            sig = g.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, COORDS)
            unit, (left, right, own) = g.column("unit").to_numpy(), sides(g.column("side").to_numpy())
            hits = np.zeros((len(left), len(right)), np.int8)
            for c in range(COORDS):
                hits += sig[left, None, c] == sig[None, right, c]
            hit = (hits >= MATCH) & (unit[left, None] != unit[None, right])
            some = np.zeros(len(unit), bool)
            some[left] |= hit.any(1)
            some[right] |= hit.any(0)
            yield from g.select(["fam", "b1", "b2", "side", "id", "unit"]).filter(pa.array(some)).to_batches()

    dealt = tiles.repartition("fam", "b1", "b2").sortWithinPartitions("fam", "b1", "b2", "side", "id")
    return dealt.mapInArrow(run, "fam long, b1 string, b2 string, side int, id long, unit long")


def tile_links(tiles: DataFrame, percent: int) -> DataFrame:
    """(src, dst) that connect what the full sets of ``tiles(fam, b1, b2, side, id, unit,
    shingles)`` link: a row for a class and the smallest it reaches in its tile."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(parts, 3):
            ids, unit = g.column("id").to_numpy(), g.column("unit").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in g.column("shingles").to_pylist()]
            left, right, own = sides(g.column("side").to_numpy())
            size = np.array([len(x) for x in sets])
            # an inverted index of the right block: each shingle's classes
            every = np.concatenate([sets[j] for j in right])
            order = np.argsort(every, kind="stable")
            place = np.repeat(np.arange(len(right)), size[right])[order]
            every = every[order]
            up = {int(u): int(i) for i, u in sorted(zip(ids, unit), reverse=True)}  # the smallest class of each unit here
            root = {u: u for u in up}

            def find(u):
                while root[u] != u:
                    root[u] = root[root[u]]
                    u = root[u]
                return u

            for i in left:
                low, high = np.searchsorted(every, sets[i]), np.searchsorted(every, sets[i], "right")
                n = high - low
                at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                both = np.bincount(place[at], minlength=len(right))
                ok = np.flatnonzero(100 * both >= percent * (size[i] + size[right] - both))
                for j in right[ok]:
                    a, b = find(int(unit[i])), find(int(unit[j]))
                    if a != b:
                        root[max(a, b)] = min(a, b)
            src = [up[u] for u in up if find(u) != u]
            dst = [up[find(u)] for u in up if find(u) != u]
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    dealt = tiles.repartition("fam", "b1", "b2").sortWithinPartitions("fam", "b1", "b2", "side", "id")
    return dealt.mapInArrow(run, "src long, dst long")


def spanning_pairs(member: DataFrame, percent: int) -> DataFrame:
    """(src, dst) of classes of different families with MATCH common postings, of
    ``member(id, fam, n, keys)``; keys in order of rarity."""
    prefix = F.slice("keys", 1, F.size("keys") - MATCH + 1)
    post = member.select("id", "fam", "n", F.explode(prefix).alias("key"))
    mixed = post.groupBy("key").agg(F.min("fam").alias("lo"), F.max("fam").alias("hi")).where("lo < hi").select("key")
    post = post.join(mixed, "key", "left_semi")
    a, b = post.select(*(F.col(c).alias(f"{c}1") for c in ("id", "fam", "n")), "key"), post.select(
        *(F.col(c).alias(f"{c}2") for c in ("id", "fam", "n")), "key")
    near = (a.key == b.key) & F.expr(f"id1 < id2 and fam1 != fam2 and 100 * least(n1, n2) >= {percent} * greatest(n1, n2)")
    meet = a.join(b, near).select(F.col("id1").alias("src"), F.col("id2").alias("dst")).distinct()
    keys = member.select("id", "keys")
    return (meet.join(keys.toDF("src", "k1"), "src").join(keys.toDF("dst", "k2"), "dst")
            .where(F.size(F.array_intersect("k1", "k2")) >= MATCH).select("src", "dst"))


def links_of(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(src, dst) that connect all linked ``classes(id, n, sig)``."""
    shared = stage(shared_postings(classes.select("id", "sig")), "minhash-shared")
    near = stage(shared.select("id", F.explode("postings.hub").alias("hub")).where("hub != id").groupBy("id", "hub").count()
                 .where(F.col("count") >= HUB).select(F.col("id").alias("src"), F.col("hub").alias("dst")), "minhash-near")
    fam = components(near, "minhash-families").select("id", F.col("component").alias("fam"))
    member = stage(shared.select("id", F.col("postings.key").alias("keys")).join(fam, "id", "left").join(classes, "id").select(
        "id", F.coalesce("fam", "id").alias("fam"), "n", "keys", "sig"), "minhash-members")
    cross = stage(spanning_pairs(member, percent), "minhash-spanning")

    size = member.groupBy("fam").count().where(F.col("count") > 1)
    inside = member.join(size.select("fam"), "fam", "left_semi").select("id", "fam", "sig")
    wanted = inside.select("id").union(cross.select("src")).union(cross.select("dst")).distinct()
    sets = stage(full_sets(docs, wanted, width), "minhash-sets")

    # in families of several blocks, what is linked to its hubs is one unit
    large = member.join(size.where(F.col("count") > BLOCK).select("fam"), "fam", "left_semi").select(F.col("id").alias("src"))
    links = stage(confirm(near.join(large, "src", "left_semi"), sets, percent).union(confirm(cross, sets, percent)), "minhash-links")
    unit = components(links, "minhash-units").select("id", F.col("component").alias("unit"))
    place = inside.select("id", "fam").join(unit, "id", "left").select("id", "fam", F.coalesce("unit", "id").alias("unit"))
    tiles = stage(tile_maps(place), "minhash-tiles")
    some = stage(candidates(tiles.join(inside.select("id", "sig"), "id").select("fam", "b1", "b2", "side", "id", "unit", "sig")), "minhash-candidates")
    more = tile_links(some.join(sets, "id").select("fam", "b1", "b2", "side", "id", "unit", "shingles"), percent)
    return links.union(stage(more, "minhash-tile-links"))


def link(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs(doc_id, text)``."""
    sk = stage(sketch(docs, width), "minhash-sketch")
    live = sk.where("set_key is not null and doc_id is not null")
    classes = stage(live.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")),
                    "minhash-classes")
    comp = components(links_of(docs, classes.select("id", "n", "sig"), width, percent), "minhash-components")
    found = classes.select("set_key", "id").join(comp, "id", "left").select("set_key", F.coalesce("component", "id").alias("component_id"))
    out = sk.select("doc_id", "n_shingles", "set_key").join(found, "set_key", "left")
    own = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"),
                      F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the smallest
    doc_id stays, once. Rows with a null doc_id all stay."""
    found = stage(link(docs, width, percent).where("doc_id is not null").groupBy("doc_id")
                  .agg(F.max("kept").alias("kept"), F.count("*").alias("rows")), "minhash-decisions")
    gone = sent(found.where("not kept").select(F.col("doc_id").alias("_gone")), SENT)
    out = docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    if found.where("kept and rows > 1").limit(1).count():  # repeated rows: one of them stays
        out = out.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(out.where("doc_id is null"))
    return out
