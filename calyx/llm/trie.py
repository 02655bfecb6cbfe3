"""Conversation prefix trie, kept as a z-fast trie (operator 13).

A conversation is a string of turns. Every prefix of it has a digest, chained over the turns, so prefixes
are compared by one key wherever they are. The trie is compacted: a node is explicit where a
conversation ends or where conversations part, and carries the edge from its parent's depth ``up`` to its own ``depth``. Its handle
is its prefix at the two-fattest depth of (up, depth], the one with the most trailing zeros.

* ``locate`` finds the exit node of every string by fat binary search: a round joins each string's
  prefix at the two-fattest depth of the depths left with the handles, and log2(longest) rounds settle all strings.
* ``insert`` takes a batch: only the part of a string below its deepest matched node is looked at, together with the
  edges on which strings leave the trie. A depth becomes a node where a string of the batch ends or continuations differ (a grouped
  minimum and maximum), and the parts between are the new edges.
* ``build`` inserts batches that grow, so prefixes that many strings share are nodes before most strings come.
* ``expand`` turns edges into one row for each depth.

Equal conversations are one string with a count from the start. Lookups are hash joins with a node table that is sent to every
task while it has at most ``SENT`` rows, and salted beyond. The largest unit is one conversation's digests (24 bytes a turn) in one row.

Turns are ordered by ``turn``, null first; turns of one number by the digest of role and text. Null role or text is empty.
Rows without conv_id belong to no conversation and are left out. Repeated rows are turns of their own. Texts of any length count whole. Other
columns are not looked at. An empty table gives an empty result: without a conversation there is no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calyx.llm.common import crc32_sql, stage

#: Rows of a node table that may be sent to every task; salts of a lookup beyond.
SENT, SALTS = 200_000, 16
#: A string belongs to the first batch whose bound its slice (of 16) is below.
BATCHES = (1, 4, 16)
#: Conversations whose ids share all but these bits are joined to one text before a node's ids are.
CHUNK_BITS = 8
_PATH = "array<struct<digest:binary,upto:bigint>>"
_NODE = ["depth", "key", "up", "up_key", "base", "edge", "handle_at", "handle", "name"]


def turns_of(table: DataFrame) -> DataFrame:
    """(conv_id, turns): the ordered turns of each conversation, as (digest, code points)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    t = table.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(
        F.col("turn").isNotNull().alias("has"), F.col("turn").alias("at"), digest.alias("digest"), F.char_length(text).cast("long").alias("size")).alias("t"))
    turns = F.transform(F.array_sort(F.collect_list("t")), lambda x: F.struct(x["digest"].alias("digest"), x["size"].alias("size")))
    return t.groupBy("conv_id").agg(turns.alias("turns"))


def rebuilt(table: DataFrame, step: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, turns) after the rebuild: the first h = crc32(conv_id) % ``most`` turns of conversation conv_id - conv_id % ``step``,
    then the own turns after the first h."""
    own = stage(turns_of(table), "trie-turns")
    base = own.where(F.col("conv_id") % step == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % step).join(base, "base", "left").withColumn("h", h)
    head = F.slice(F.coalesce("first", F.array().cast("array<struct<digest:binary,size:bigint>>")), F.lit(1), F.col("h"))
    return both.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def _chained(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in frames:
        turns = b.column("turns")
        n = turns.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = turns.flatten()
        digests, sizes = flat.field("digest").to_pylist(), flat.field("size").to_pylist()
        keys, upto, last, at = [], [], [], 0
        for k in n.tolist():
            key, total = b"", 0
            for i in range(at, at + k):
                key = hashlib.sha256(key + digests[i]).digest()[:16]
                total += sizes[i]
                keys.append(key)
                upto.append(total)
            at += k
            last.append(key)
        offsets = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
        path = pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(upto, pa.int64())], ["digest", "upto"])
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(n, pa.int64()), pa.array(last, pa.binary()),
                                          pa.ListArray.from_arrays(offsets, path)], ["conv_id", "len", "last", "path"])


def chained(conversations: DataFrame) -> DataFrame:
    """(conv_id, len, last, path): the digests and code points of every prefix; ``last`` is the digest of the whole."""
    return conversations.select("conv_id", "turns").mapInArrow(_chained, f"conv_id long, len long, last binary, path {_PATH}")


def strings_of(seqs: DataFrame) -> DataFrame:
    """Equal conversations as one: (len, last, n, conv_id, path), conv_id the smallest of them."""
    return seqs.groupBy("len", "last").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.min_by("path", "conv_id").alias("path"))


def fattest(low: Column, high: Column) -> Column:
    """The number of (low, high] with the most trailing zeros."""
    return high - F.pmod(high, F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(low.bitwiseXOR(high))) - 1))


def at_depth(path: Column, depth: Column) -> Column:
    """The digest of a path's prefix; empty at depth 0."""
    return F.when(depth == 0, F.lit(b"")).otherwise(F.get(path, (depth - 1).cast("int"))["digest"])


def is_small(table: DataFrame) -> bool:
    return table.limit(SENT + 1).count() <= SENT


def lookup(rows: DataFrame, table: DataFrame, on: dict[str, str], small: bool, how: str = "left", salt: str = "last") -> DataFrame:
    """``rows`` joined with the unique keys of ``table``; one key may be asked for by any number of rows."""
    if small:
        return rows.join(F.broadcast(table), [F.col(a) == F.col(b) for a, b in on.items()], how)
    many = table.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_s", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(
        many, [*(F.col(a) == F.col(b) for a, b in on.items()), F.col("_s") == F.col("_t")], how).drop("_s", "_t")


def locate(strings: DataFrame, nodes: DataFrame, longest: int, small: bool) -> DataFrame:
    """``strings(len, last, path, ...)`` with ``low``, the depth of the deepest node whose prefix they start with, and the depth
    and key of the child on whose edge they leave the trie (null: none)."""
    handles = nodes.select(F.col("handle_at").alias("_at"), F.col("handle").alias("_handle"), F.col("depth").alias("_depth"),
                           F.col("key").alias("_key"), F.col("up").alias("_up"))
    own = strings.columns
    s = strings.withColumn("low", F.lit(0).cast("long")).withColumn("high", F.col("len"))
    for _ in range(longest.bit_length()):
        s = s.withColumn("probe_at", F.when(F.col("low") < F.col("high"), fattest(F.col("low"), F.col("high"))))
        s = lookup(s.withColumn("probe", at_depth(F.col("path"), F.col("probe_at"))), handles, {"probe_at": "_at", "probe": "_handle"}, small)
        found = F.col("_depth").isNotNull()
        whole = found & (F.col("_depth") <= F.col("len")) & F.coalesce(at_depth(F.col("path"), F.col("_depth")) == F.col("_key"), F.lit(False))
        low = F.when(whole, F.col("_depth")).when(found, F.col("_up")).otherwise(F.col("low"))
        high = F.when(whole, F.col("high")).when(found, F.col("_up")).otherwise(F.coalesce(F.col("probe_at") - 1, F.col("high")))
        s = s.select(*own, low.alias("low"), high.alias("high"))
    children = nodes.select(F.col("up").alias("_up"), F.col("name").alias("_name"), F.col("depth").alias("child_depth"), F.col("key").alias("child_key"))
    s = s.withColumn("next", at_depth(F.col("path"), F.when(F.col("low") < F.col("len"), F.col("low") + 1)))
    return lookup(s, children, {"low": "_up", "next": "_name"}, small).select(*own, "low", "child_depth", "child_key")


def with_handles(nodes: DataFrame) -> DataFrame:
    n = nodes.withColumn("handle_at", fattest(F.col("up"), F.col("depth")))
    n = n.withColumn("handle", F.get("edge", (F.col("handle_at") - F.col("up") - 1).cast("int"))["digest"])
    return n.withColumn("name", F.get("edge", F.lit(0))["digest"]).select(*_NODE)


def insert(nodes: DataFrame, strings: DataFrame, longest: int, name: str) -> DataFrame:
    """The trie of ``nodes`` and a batch of ``strings(len, last, path)``."""
    new = stage(locate(strings.select("len", "last", "path"), nodes, longest, is_small(nodes)).where("low < len"), f"{name}-located")
    touched = stage(new.where("child_key is not null").select(F.col("child_depth").alias("depth"), F.col("child_key").alias("key")).distinct()
                    .join(nodes, ["depth", "key"]), f"{name}-touched")
    # the paths to be compacted anew: what is below the matched node of a string, and the edges on which strings leave
    tail = F.slice("path", (F.col("low") + 1).cast("int"), F.greatest(F.col("len") - F.col("low"), F.lit(0)).cast("int"))
    base = F.when(F.col("low") == 0, 0).otherwise(F.get("path", (F.col("low") - 1).cast("int"))["upto"]).cast("long")
    paths = stage(new.select("len", "last", "low", at_depth(F.col("path"), F.col("low")).alias("low_key"), base.alias("base"), tail.alias("tail")).union(
        touched.select("depth", "key", "up", "up_key", "base", "edge")), f"{name}-paths")
    steps = paths.select("len", "last", "low", "low_key", F.posexplode("tail").alias("i", "x"), F.col("tail").alias("_tail"))
    steps = steps.select("len", "last", "low", "low_key", (F.col("low") + 1 + F.col("i")).alias("d"), F.col("x.digest").alias("p"),
                         F.get("_tail", F.col("i") + 1)["digest"].alias("next"))
    marks = steps.groupBy("d", "p").agg(F.min("next").alias("a"), F.max("next").alias("b"), F.max(F.col("next").isNull()).alias("end"))
    marks = stage(marks.where("end or a != b").select(F.col("d").alias("_d"), F.col("p").alias("_p")), f"{name}-marks")
    kept = lookup(steps, marks, {"d": "_d", "p": "_p"}, is_small(marks), "inner")
    by = Window.partitionBy("len", "last").orderBy("d")
    kept = kept.select("len", "last", "low", F.col("d").alias("depth"), F.col("p").alias("key"), F.coalesce(F.lag("d").over(by), "low").alias("up"),
                       F.coalesce(F.lag("p").over(by), "low_key").alias("up_key"))
    one = kept.groupBy("depth", "key").agg(F.min(F.struct("len", "last", "low", "up", "up_key")).alias("s")).select("depth", "key", "s.*")
    first = (F.col("up") - F.col("low")).cast("int")
    fresh = one.join(paths.select("len", "last", F.col("base").alias("_base"), "tail"), ["len", "last"]).select(
        "depth", "key", "up", "up_key", F.when(first == 0, F.col("_base")).otherwise(F.get("tail", first - 1)["upto"]).alias("base"),
        F.slice("tail", first + 1, (F.col("depth") - F.col("up")).cast("int")).alias("edge"))
    return stage(nodes.join(touched.select("depth", "key"), ["depth", "key"], "left_anti").select(*_NODE).union(with_handles(fresh)), f"{name}-nodes")


def build(strings: DataFrame, longest: int) -> DataFrame:
    """The compacted trie of ``strings``, in batches: (depth, key, up, up_key, base, edge, handle_at, handle, name)."""
    empty = f"depth long, key binary, up long, up_key binary, base long, edge {_PATH}, handle_at long, handle binary, name binary"
    nodes = strings.sparkSession.createDataFrame([], empty)
    low, part = 0, F.pmod(F.xxhash64("last"), F.lit(BATCHES[-1]))
    for k, high in enumerate(BATCHES):
        nodes = insert(nodes, strings.where((part >= low) & (part < high) & (F.col("len") > 0)), longest, f"trie-{k}")
        low = high
    return nodes


def summed(nodes: DataFrame, strings: DataFrame) -> DataFrame:
    """``nodes`` with conv_id, n_convs, n_children, and of the nodes strictly below: leaves and saved code points of their edges."""
    small = is_small(nodes)
    at = strings.select("len", "last", "n", "conv_id", F.posexplode("path").alias("i", "x")).select(
        "len", "last", "n", "conv_id", (F.col("i") + 1).cast("long").alias("d"), F.col("x.digest").alias("p"))
    stops = stage(lookup(at, nodes.select(F.col("depth").alias("_d"), F.col("key").alias("_p")), {"d": "_d", "p": "_p"}, small, "inner")
                  .drop("_d", "_p"), "trie-stops")
    through = stops.groupBy("d", "p").agg(F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min(F.struct("len", "last")).alias("one"))
    children = nodes.groupBy(F.col("up").alias("c_up"), F.col("up_key").alias("c_key")).agg(F.count("*").alias("n_children"))
    known = nodes.join(through.withColumnsRenamed({"d": "depth", "p": "key"}), ["depth", "key"])
    known = known.join(children, (F.col("depth") == F.col("c_up")) & (F.col("key") == F.col("c_key")), "left").drop("c_up", "c_key")
    size = F.get("edge", F.size("edge") - 1)["upto"] - F.col("base")
    known = stage(known.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
                  .withColumn("saved", (F.col("n_convs") - 1) * size).withColumn("leaf", (F.col("n_children") == 0).cast("long")), "trie-known")
    # each node counts on the path of one of its strings
    own = known.select(F.col("depth").alias("_d"), F.col("key").alias("_p"), "one", "saved", "leaf")
    run = lookup(stops.select("len", "last", "d", "p"), own, {"d": "_d", "p": "_p"}, small, "inner")
    mine = F.col("one") == F.struct("len", "last")
    below = Window.partitionBy("len", "last").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, -1)
    run = run.select(F.col("d").alias("depth"), F.col("p").alias("key"), *(F.sum(F.when(mine, F.col(c)).otherwise(0)).over(below).alias(c) for c in ("saved", "leaf")))
    run = run.groupBy("depth", "key").agg(F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_below"), F.coalesce(F.sum("leaf"), F.lit(0)).alias("leaves_below"))
    return stage(known.drop("one").join(run, ["depth", "key"]), "trie-summed")


def _hashed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of (len, last, part) rows in order to the digest of their parts; one part is held at a time."""
    now, state = None, None

    def row():
        return pa.RecordBatch.from_pydict({"len": pa.array([now[0]], pa.int64()), "last": pa.array([now[1]], pa.binary()), "ends": pa.array([state.hexdigest()])})

    for b in frames:
        for n, last, part in zip(b.column("len").to_pylist(), b.column("last").to_pylist(), b.column("part").to_pylist()):
            if (n, last) != now:
                if now:
                    yield row()
                now, state = (n, last), hashlib.sha256(part.encode())
            else:
                state.update(b"," + part.encode())
    if now:
        yield row()


def ends_of(seqs: DataFrame) -> DataFrame:
    """(len, last, ends): the digest of the ascending ids of the conversations that are equal to a string.

    Ids are joined by neighbourhoods first; a string with several of them is digested part by part.
    """
    key = ["len", "last", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")]
    parts = seqs.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("part"))
    parts = stage(parts, "trie-parts")
    many = parts.groupBy("len", "last").agg(F.count("*").alias("c"), F.min("part").alias("part"))
    alone = many.where("c = 1").select("len", "last", F.sha2("part", 256).alias("ends"))
    rest = parts.join(many.where("c > 1").select("len", "last"), ["len", "last"])
    rest = rest.repartition("len", "last").sortWithinPartitions("len", "last", "chunk").select("len", "last", "part")
    return alone.union(rest.mapInArrow(_hashed, "len long, last binary, ends string"))


def expand(nodes: DataFrame, root: DataFrame, ends: DataFrame) -> DataFrame:
    """One row for every depth of every edge, and the root's."""
    small = is_small(nodes)
    above = nodes.select(F.col("depth").alias("_d"), F.col("key").alias("_p"), F.col("conv_id").alias("_conv")).union(
        root.select(F.lit(0).cast("long"), F.lit(b""), "conv_id"))
    n = lookup(nodes, above, {"up": "_d", "up_key": "_p"}, small, "inner", "key").drop("_d", "_p")
    n = n.join(ends.withColumnsRenamed({"len": "depth", "last": "key"}), ["depth", "key"], "left")
    n = n.withColumn("whole", F.get("edge", F.size("edge") - 1)["upto"])
    # a turn's own code points count from the sum before it
    before = F.concat(F.array("base"), F.transform("edge", lambda x: x["upto"]))
    n = n.select("*", F.posexplode(F.slice(before, F.lit(1), F.size("edge"))).alias("i", "before"))
    top, bottom = F.col("i") == 0, F.col("i") == F.size("edge") - 1
    nothing = F.sha2(F.lit(""), 256)
    inner = n.select("conv_id", (F.col("up") + 1 + F.col("i")).alias("depth"), F.when(top, F.col("_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
                     "n_convs", F.when(bottom, F.col("n_children")).otherwise(1).alias("n_children"), (F.col("leaves_below") + F.col("leaf")).alias("n_leaves"),
                     (F.col("saved_below") + (F.col("n_convs") - 1) * (F.col("whole") - F.col("before"))).alias("saved_tokens"),
                     F.when(bottom, F.coalesce("ends", nothing)).otherwise(nothing).alias("ends_sha256"))
    sums = nodes.agg(F.count(F.when(F.col("up") == 0, 1)).alias("n_children"), F.sum("leaf").alias("leaf"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"))
    at_root = ends.where("len = 0").agg(F.max("ends").alias("ends"))
    r = root.withColumn("k", F.lit(1)).join(sums.withColumn("k", F.lit(1)), "k").join(at_root.withColumn("k", F.lit(1)), "k")
    first = r.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
                     F.coalesce("leaf", F.lit(1)).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", nothing).alias("ends_sha256"))
    return inner.union(first)


def trie_of(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie over ``conversations(conv_id, turns)``."""
    seqs = stage(chained(conversations), "trie-seqs")
    strings = stage(strings_of(seqs), "trie-strings")
    longest = strings.agg(F.max("len")).first()[0] or 0
    nodes = summed(build(strings, longest), strings)
    root = strings.agg(F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    return expand(nodes, root, stage(ends_of(seqs.select("conv_id", "len", "last")), "trie-ends"))


def report(table: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of ``table(conv_id, turn, role, text)``."""
    return trie_of(rebuilt(table))


_TURN = "sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))"
#: The uncompacted trie in DuckDB: a group for every prefix; sums over subtrees by the prefixes of each node's smallest conversation.
ORACLE = f"""with own as (select conv_id, {_TURN} as s, length(coalesce(text, '')) as size,
        row_number() over (partition by conv_id order by turn nulls first, {_TURN}) as i from conversations where conv_id is not null),
ids as (select conv_id, conv_id - conv_id % 100 as base, {crc32_sql('cast(conv_id as varchar)')} % 6 as h from (select distinct conv_id from own)),
seq as (select c.conv_id, o.i, o.s, o.size from ids c join own o on o.conv_id = c.base and o.i <= c.h
    union all select c.conv_id, o.i, o.s, o.size from ids c join own o on o.conv_id = c.conv_id and o.i > c.h),
pre as (select conv_id, row_number() over (partition by conv_id order by i) as d, size,
        sha256(string_agg(s, '' order by i) over (partition by conv_id order by i rows unbounded preceding)) as p from seq
    union all select conv_id, 0, 0, '' from ids),
long as (select *, max(d) over (partition by conv_id) as len from pre),
node as (select d, p, count(*) as n, min(conv_id) as c, max(size) as size,
        sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where d = len), '')) as ends from long group by d, p),
up as (select n.*, u.d as ud, u.p as uk from node n join pre u on u.conv_id = n.c and u.d <= n.d),
kids as (select ud, uk, count(*) as k from up where ud = d - 1 group by ud, uk),
leaf as (select n.d, n.p from node n left join kids on ud = n.d and uk = n.p where k is null),
sub as (select ud, uk, count(l.d) as leaves, sum((n - 1) * size) as saved from up left join leaf l using (d, p) group by ud, uk),
parent as (select u.d, u.p, m.c as pc from up u join node m on m.d = u.ud and m.p = u.uk where u.ud = u.d - 1)
select n.c as conv_id, n.d as depth, pc as parent_conv_id, n.n as n_convs, coalesce(k, 0) as n_children, s.leaves as n_leaves,
    cast(s.saved as bigint) as saved_tokens, n.ends as ends_sha256
from node n join sub s on s.ud = n.d and s.uk = n.p left join kids q on q.ud = n.d and q.uk = n.p left join parent r on r.d = n.d and r.p = n.p"""
