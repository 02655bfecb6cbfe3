"""Merkle dataset manifest by nested-interval labels (operator 11).

A leaf is the digest of a row's fields; per group the leaves stand in order, and every two
consecutive nodes of a level become their digest until one is left, the group's root. The roots of all
groups, in order, give the root of the dataset in the same way.

Every node carries the interval [lo, hi) of the leaf ranks that it covers. Nodes are kept in blocks,
one for ``2 ** BITS`` neighbouring nodes of a bottom level with all levels above them up to the block's own top, so a
tree of n leaves has about n / 2 ** BITS rows. A node finds its ancestors by containment joins: a block's
level and the bucket of its interval are the key, one join for each ``BITS`` levels, and the interval must
lie inside. The sibling of a node is what its parent's interval has beyond the node's own (nothing where the run has one node).

Ranks come from a range shuffle by (group, order): rows are numbered inside each task and the counts of
the tasks before are added, so a group that holds most rows is spread over all tasks. Nothing is collected
per group; the roots of groups are sent to all tasks behind a count.

Nulls: a null field is written ``-``; a null group stands before all others, a null doc_id before
all others of its group; a null doc_id isn't tampered with. Rows of one doc_id are ordered by their leaf, equal rows are
leaves of their own. Empty texts have the length 0; texts are digested whole. A group of one row has its leaf as root and an empty proof.
Columns that are not named are not looked at. An empty table gives an empty result. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calyx.llm.common import crc32_sql, sent, stage

#: Levels of a block, and rows (groups, runs of ranks) that may be sent to every task.
BITS, SENT = 6, 200_000
#: The fields of a leaf, in order (fixed by the contract of the manifest).
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value as it enters a digest: ``-`` if null, else its UTF-8 length, ``:`` and the value."""
    s = value.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values), 256)


def leaf_of(fields: Sequence[Column]) -> Column:
    return digest(*map(field, fields))


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows(grp, ...)`` with ``lo``, the rank in its group by ``order``, and ``n``, the group's rows."""
    key = ["grp", *order]
    placed = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    placed = stage(placed.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), f"{name}-placed")
    runs = placed.groupBy("grp", "part").agg(F.count("*").alias("c"), F.min("row").alias("first"))
    by = Window.partitionBy("grp")
    before = F.sum("c").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    runs = stage(runs.select("grp", "part", (before - F.col("first")).alias("shift"), F.sum("c").over(by).alias("n")), f"{name}-runs")
    return placed.join(sent(runs, SENT), ["grp", "part"]).withColumn("lo", F.col("row") + F.col("shift")).drop("part", "row", "shift")


def _up(tier: Column) -> Column:
    """The next level: the digest of every two neighbours, or of a last one alone."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(tier) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: digest(F.get(tier, 2 * i), F.coalesce(F.get(tier, 2 * i + 1), F.lit(""))))


def blocks_of(nodes: DataFrame, level: int) -> DataFrame:
    """Blocks over ``nodes(grp, lo, n, digest)`` of ``level``: (grp, lo, hi, n, tiers, top).

    ``tiers[k]`` holds the digests of level ``level + k`` in the block, ``top`` the one that is left.
    """
    width = 1 << (level + BITS)
    b = nodes.groupBy("grp", F.shiftright("lo", level + BITS).alias("bucket")).agg(
        F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("lo", "digest"))), lambda x: x["digest"]).alias("t0"))
    for k in range(BITS):  # a level of one node in the whole group is the last one
        b = b.withColumn(f"t{k + 1}", F.when(F.col("n") > 1 << (level + k), _up(F.col(f"t{k}"))))
    tops = [F.get(F.col(f"t{k}"), F.lit(0)) for k in range(BITS, -1, -1)]
    lo = F.col("bucket") * width
    return b.select("grp", lo.alias("lo"), F.least(lo + width, "n").alias("hi"), "n", F.array(*(f"t{k}" for k in range(BITS))).alias("tiers"),
                    F.coalesce(*tops).alias("top"))


def build(leaves: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of all bands of levels over ``leaves(grp, lo, n, digest)``, and (grp, n, top) of all groups."""
    largest = leaves.agg(F.max("n")).first()[0] or 0
    bands, tops, nodes, level = [], None, leaves, 0
    while not bands or largest > 1 << level:
        b = stage(blocks_of(nodes, level), f"{name}-blocks")
        bands.append(b)
        level += BITS
        done = b.where(F.col("n") <= 1 << level).select("grp", "n", "top")
        tops = done if tops is None else tops.union(done)
        nodes = b.where(F.col("n") > 1 << level).select("grp", "lo", "n", F.col("top").alias("digest"))
    return bands, tops


def nodes_of(bands: list[DataFrame]) -> DataFrame:
    """All nodes with their labels: (grp, level, lo, hi, digest)."""
    out = None
    for j, b in enumerate(bands):
        t = b.select("grp", "lo", "n", F.posexplode("tiers").alias("k", "tier")).select("grp", "lo", "n", "k", F.posexplode("tier").alias("i", "digest"))
        width = F.expr(f"shiftleft(1L, {j * BITS} + k)")
        t = t.select("grp", (F.lit(j * BITS) + F.col("k")).alias("level"), (F.col("lo") + F.col("i") * width).alias("lo"), "n", width.alias("w"), "digest")
        top = b.where(F.col("n") <= 1 << ((j + 1) * BITS)).select("grp", F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0).alias("level"), F.lit(0).cast("long"), F.col("n"), F.col("n"), "top")
        t = t.union(top).select("grp", "level", "lo", F.least(F.col("lo") + F.col("w"), "n").alias("hi"), "digest").distinct()
        out = t if out is None else out.union(t)
    return out


def steps(lo: Column, n: Column, tiers: Column, block_lo: Column, level: int) -> Column:
    """From a node of ``level`` to the top of its block: for each level whether the sibling stands left, and its digest (null: none)."""
    def step(k):
        bits = F.lit(level) + k
        width = F.call_function("shiftleft", F.lit(1).cast("long"), bits)
        own = lo - F.pmod(lo, width)
        parent = lo - F.pmod(lo, 2 * width)
        other = 2 * parent + width - own  # the parent's interval without the node's own
        at = F.call_function("shiftright", other - block_lo, bits).cast("int")
        return F.struct((other < own).alias("left"), F.when(other < n, F.get(F.get(tiers, k), at)).alias("digest"))

    below = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda k: n > F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(level) + k))
    return F.transform(below, step)


def attach(nodes: DataFrame, blocks: DataFrame, level: int) -> DataFrame:
    """``nodes(grp, lo, n, ...)`` of ``level`` with ``path``, to the group's root and from there by the block's own ``path``,
    and the block's columns ``subroot`` and ``root``: a join by (group, bucket of the level) and containment."""
    bits = level + BITS
    b = blocks.select(F.col("grp").alias("_g"), F.shiftright("lo", bits).alias("_bucket"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
                      F.col("tiers").alias("_tiers"), F.col("path").alias("_path"), "subroot", "root")
    inside = (F.col("grp") == F.col("_g")) & (F.shiftright("lo", bits) == F.col("_bucket")) & (F.col("lo") >= F.col("_lo")) & (F.col("lo") < F.col("_hi"))
    path = F.concat(steps(F.col("lo"), F.col("n"), F.col("_tiers"), F.col("_lo"), level), "_path")
    return nodes.join(b, inside).select(*nodes.columns, path.alias("path"), "subroot", "root")


def proofs(leaves: DataFrame, bands: list[DataFrame], groups: DataFrame, name: str) -> DataFrame:
    """``leaves`` with ``path`` to the root of the dataset, ``subroot`` and ``root``; ``groups(grp, path, subroot, root)``."""
    above = None
    for j in range(len(bands) - 1, -1, -1):
        level = (j + 1) * BITS
        b = bands[j].select("grp", "lo", "hi", "n", "tiers")
        done = b.where(F.col("n") <= 1 << level).join(sent(groups, SENT), "grp")
        if above is not None:
            done = done.unionByName(attach(b.where(F.col("n") > 1 << level), above, level))
        above = stage(done, f"{name}-paths")
    return attach(leaves, above, 0)


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: s["digest"]), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its way."""
    return F.aggregate(path, leaf, lambda acc, s: F.when(s["digest"].isNull(), digest(acc)).when(s["left"], digest(s["digest"], acc))
                       .otherwise(digest(acc, s["digest"])))


def manifest(rows: DataFrame, name: str = "merkle") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``rows(grp, doc_id, leaf, ...)``: the rows with path, subroot and root; the nodes of all groups' trees, and those of the tree
    over the groups (its leaves are the groups' roots)."""
    placed = rows.withColumn("tie", F.monotonically_increasing_id())
    leaves = stage(ranked(stage(placed, f"{name}-leaves"), ["doc_id", "leaf", "tie"], name).drop("tie"), f"{name}-ranked")
    bands, tops = build(leaves.select("grp", "lo", "n", F.col("leaf").alias("digest")), name)
    roots = tops.select(F.lit("").alias("grp"), F.col("grp").alias("of"), F.col("top").alias("digest"))
    roots = stage(ranked(stage(roots, f"{name}-roots"), ["of"], f"{name}-groups"), f"{name}-group-ranks")
    over, top = build(roots.select("grp", "lo", "n", "digest"), f"{name}-groups")
    end = top.select("grp", F.array().cast("array<struct<left:boolean,digest:string>>").alias("path"), F.col("top").alias("subroot"), F.col("top").alias("root"))
    groups = proofs(roots, over, end, f"{name}-groups").select(F.col("of").alias("grp"), "path", F.col("digest").alias("subroot"), "root")
    return proofs(leaves, bands, stage(groups, f"{name}-group-paths"), name), nodes_of(bands), nodes_of(over)


def leaves_of(docs: DataFrame) -> DataFrame:
    """(grp, doc_id, leaf, tampered) of documents; ``tampered`` is the leaf with n_chars one higher, where 7 divides the crc32 of doc_id."""
    own = [F.col(c) for c in FIELDS]
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    false = leaf_of([more if c == "n_chars" else F.col(c) for c in FIELDS])
    group = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), "lang"))
    return docs.select(group.alias("grp"), "doc_id", leaf_of(own).alias("leaf"), F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, false).alias("tampered"))


def verify(docs: DataFrame) -> DataFrame:
    """The manifest of documents by lang, and each leaf checked against it, some of them after tampering."""
    p = manifest(leaves_of(docs))[0]
    p = p.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return p.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified"))


_ENC = {c: f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')" for c in FIELDS}
_BAD = {**_ENC, "n_chars": "coalesce(strlen(cast(n_chars + 1 as varchar)) || ':' || cast(n_chars + 1 as varchar), '-')"}

#: The same in DuckDB: levels by a recursive query, siblings by index, the fold by another recursive query.
ORACLE = f"""with recursive own as (select doc_id, coalesce('=' || lang, '') as grp, sha256({' || '.join(_ENC.values())}) as leaf,
    case when {crc32_sql('cast(doc_id as varchar)')} % 7 = 0 then sha256({' || '.join(_BAD.values())}) end as bad from documents),
leaves as (select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as k, row_number() over () as r from own),
up as (select grp, 0 as lvl, k as i, leaf as digest, count(*) over (partition by grp) as n from leaves
    union all select grp, lvl + 1, i // 2, sha256(string_agg(digest, '' order by i)), (max(n) + 1) // 2 from up where n > 1 group by grp, lvl, i // 2),
subs as (select grp, digest as subroot, lvl as depth, row_number() over (order by grp) - 1 as k, count(*) over () as n from up where n = 1),
top as (select 0 as lvl, k as i, subroot as digest, n from subs
    union all select lvl + 1, i // 2, sha256(string_agg(digest, '' order by i)), (max(n) + 1) // 2 from top where n > 1 group by lvl, i // 2),
path as (select l.r, u.lvl, s.i < u.i as is_left, s.digest from leaves l join up u on u.grp = l.grp and u.i = l.k >> u.lvl and u.n > 1
        left join up s on s.grp = u.grp and s.lvl = u.lvl and s.i = xor(u.i, 1)
    union all select l.r, b.depth + u.lvl, s.i < u.i, s.digest from leaves l join subs b on b.grp = l.grp join top u on u.i = b.k >> u.lvl and u.n > 1
        left join top s on s.lvl = u.lvl and s.i = xor(u.i, 1)),
folded as (select r, 0 as lvl, coalesce(bad, leaf) as acc from leaves
    union all select f.r, f.lvl + 1, sha256(case when p.digest is null then f.acc when p.is_left then p.digest || f.acc else f.acc || p.digest end)
        from folded f join path p on p.r = f.r and p.lvl = f.lvl),
last as (select r, arg_max(acc, lvl) as folded_root from folded group by r),
proof as (select r, string_agg(digest, '' order by lvl) as p from path group by r)
select l.doc_id, l.leaf, b.subroot, t.digest as root, sha256(coalesce(p.p, '')) as proof_sha256, f.folded_root, f.folded_root = t.digest as verified
from leaves l join subs b using (grp) cross join (select digest from top where n = 1) t join last f using (r) left join proof p using (r)"""
