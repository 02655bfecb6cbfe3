"""Secret scans by multipart credential linking (operator 4).

Base spans, by the patterns below, leftmost and non-overlapping per kind: ``assign`` (a
keyword, a separator and a value of 12 characters or more), ``access`` (an access key id of 18
or more) and ``hex`` (16 or more hexadecimal digits).

Weak candidates are parts that alone prove nothing: ``value`` (20 or more characters with
capital, small letter and digit), ``short`` (a keyword assigned a value of 6 to 11
characters), ``ident`` (a user or client id that is assigned) and ``endpoint`` (an address). Parts of
one text are interval-joined within a scope of ``SCOPE`` characters between the end of one
and the start of the other, and a weak part is reported only with its complement:

* ``value`` and ``short`` with an access id, an ``ident`` or an ``endpoint`` in scope;
* ``ident`` and ``endpoint`` with a secret in scope (assign, hex, value or short).

A part and its complement don't overlap: a value that begins inside an address is a part of that address and no value. The join runs over
the parts of texts that hold both sides: an ordered pass in each direction over their starts and ends keeps the nearest
complement, so its work is in proportion to the parts.

Positions are code points, ends exclusive. Null texts are empty. Empty texts have no span.
Repeated rows get equal results; rows with a null doc_id are kept. Other columns are not
looked at. An empty table gives an empty result. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calyx.llm.common import sent, stage

# Fixed by the contract of the scan.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

# Weak parts.
VALUE = (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])"
         r"[A-Za-z0-9+/_-]{20,}={0,2}")
IDENT = r"""(?i)\b(?:client_?id|user(?:name)?|login|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}"""
ENDPOINT = r"""(?i)\b[a-z][a-z0-9+.-]*://[^\s"'<>]+"""

KINDS = ("assign", "access", "hex", "value", "short", "ident", "endpoint")
SECRET, OWNER = ("assign", "hex", "value", "short"), ("access", "ident", "endpoint")
#: What every match of a kind holds.
HOLDS = {"access": "AKIA", "endpoint": "://"}
SCOPE = 200
#: Texts with secrets of at most this number are sent to every task to be rewritten.
SENT = 200_000
#: Matches whose positions are summed up one after the other, and characters of a text that are rewritten together.
BLOCK, STRETCH = 256, 4096
_FOUND = "array<struct<start:bigint,kind:int,end:bigint,n:int>>"


def located(d: DataFrame, patterns: dict[str, tuple[str, str, int | None]], text: str = "text") -> DataFrame:
    """``d`` with a column of spans for each of ``patterns``: name -> (kind, pattern, group whose length is ``n``).

    Lengths of the matches and of the gaps between them are summed up within blocks of ``BLOCK`` matches, after the sums of
    the blocks before, so the work grows with the matches. Each step is a column that is read more than once, so that Spark keeps it.
    """
    t = F.col(text)
    size = lambda c: F.char_length(F.coalesce(c, F.lit("")))

    def parts(kind, pattern, value):
        hits = [F.regexp_extract_all(t, F.lit(pattern), F.lit(g)) for g in ([0] if value is None else [0, value])]
        z = F.arrays_zip(F.split(t, pattern, -1).alias("gap"), *(h.alias(f"h{k}") for k, h in enumerate(hits)))
        z = F.transform(z, lambda x: F.struct(size(x["gap"]).alias("gap"), size(x["h0"]).alias("hit"), size(x[f"h{len(hits) - 1}"]).alias("n")))
        some = F.contains(t, F.lit(HOLDS[kind])) & t.rlike(pattern) if kind in HOLDS else t.rlike(pattern)
        return F.when(some, z).otherwise(F.array().cast("array<struct<gap:int,hit:int,n:int>>"))

    def blocks(c):
        starts = F.sequence(F.lit(0), F.floor((F.size(c) - 1) / BLOCK).cast("int"))
        return F.when(F.size(c) > 0, F.transform(starts, lambda b: F.slice(c, b * BLOCK + 1, F.lit(BLOCK)))).otherwise(
            F.array().cast("array<array<struct<gap:int,hit:int,n:int>>>"))

    def sums(c):
        whole = F.transform(c, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x["gap"] + x["hit"]))
        return F.aggregate(whole, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))

    def spans(c, before, kind):
        def add(acc, x):
            start = acc["at"] + x["gap"]
            span = F.struct(start.cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + x["hit"]).cast("long").alias("end"), x["n"].alias("n"))
            return F.struct((start + x["hit"]).alias("at"), F.array_append(acc["found"], span).alias("found"))

        found = F.transform(c, lambda b, i: F.aggregate(b, F.struct(F.get(before, i).alias("at"), F.array().cast(_FOUND).alias("found")), add)["found"])
        return F.filter(F.flatten(found), lambda s: s["end"] > s["start"])  # the last gap has no match after it

    own = d.columns
    d = d.select(*own, *(parts(*of).alias(f"_p_{n}") for n, of in patterns.items()))
    d = d.select(*own, *(blocks(F.col(f"_p_{n}")).alias(f"_b_{n}") for n in patterns))
    d = d.select(*own, *(f"_b_{n}" for n in patterns), *(sums(F.col(f"_b_{n}")).alias(f"_s_{n}") for n in patterns))
    return d.select(*own, *(spans(F.col(f"_b_{n}"), F.col(f"_s_{n}"), k).alias(n) for n, (k, _, _) in patterns.items()))


def plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def parts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, base, weak): sorted base spans and weak parts of whole texts."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = located(d.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), {
        "a": ("assign", ASSIGN, 2), "access": ("access", ACCESS, None), "hex": ("hex", HEX, None), "v": ("value", VALUE, None),
        "i": ("ident", IDENT, None), "e": ("endpoint", ENDPOINT, None)})

    def keep(low, high, kind):
        return F.transform(F.filter("a", lambda s: (s["n"] >= low) & (s["n"] <= high)), lambda s: F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))

    longest = 1 << 30
    return d.select("doc_id", "text_hash", F.array_sort(F.concat(keep(12, longest, "assign"), plain(F.col("access")), plain(F.col("hex")))).alias("base"),
                    F.concat(keep(6, 11, "short"), *(plain(F.col(c)) for c in "vie")).alias("weak"))


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, text_hash, extra): the weak parts whose complement is in scope."""
    secret = [KINDS.index(k) for k in SECRET]
    p = (parts.where(F.size("weak") > 0).select("doc_id", "text_hash", F.concat("base", "weak").alias("all"))
         .where(F.exists("all", lambda s: s["kind"].isin(secret)) & F.exists("all", lambda s: ~s["kind"].isin(secret)))
         .dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", F.inline("all")))
    is_secret, weak = F.col("kind").isin(secret), F.col("kind") >= KINDS.index("value")
    by = Window.partitionBy("doc_id", "text_hash")
    # a value that begins inside an address is a part of that address
    reach = F.max(F.when(F.col("kind") == KINDS.index("endpoint"), F.col("end"))).over(by.orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    inside = (F.col("kind") == KINDS.index("value")) & F.coalesce(F.col("start") < reach, F.lit(False))
    p = p.withColumn("inside", inside).where("not inside").drop("inside")
    # nearest before: the furthest end of those that end before this start; nearest after: the first start at or after this end
    ends = F.struct(F.col("end").alias("at"), F.lit(0).alias("asks"))
    events = F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("asks")), ends)
    p = p.select("*", F.explode(events).alias("ev")).select("*", "ev.*")
    # at one place ends come before the starts that ask for them; in the other direction starts before the ends
    up = by.orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    down = by.orderBy(F.desc("at"), F.desc("asks")).rowsBetween(Window.unboundedPreceding, 0)

    def near(other):
        before = F.max(F.when(other & (F.col("asks") == 0), F.col("end"))).over(up)
        after = F.min(F.when(other & (F.col("asks") == 1), F.col("start"))).over(down)
        asked = F.when(F.col("asks") == 1, F.col("start") - before).otherwise(after - F.col("end"))
        return F.coalesce(asked <= scope, F.lit(False))

    found = p.withColumn("ok", F.when(is_secret, near(~is_secret)).otherwise(near(is_secret))).where(weak & F.col("ok"))
    return found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("extra"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans) as sorted arrays of (start, kind, end), a row for each row of ``docs``."""
    parts = stage(parts_of(docs, id_col, text_col), "secret-parts")
    extra = linked(parts).toDF("_id", "_hash", "extra")
    both = parts.join(extra, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return both.select("doc_id", "text_hash", "base", F.when(F.col("extra").isNull(), F.col("base"))
                       .otherwise(F.array_sort(F.concat("base", "extra"))).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """The digest of the scan: counts by base kind, the base spans' hash and all spans as text."""
    s = scan(docs)
    return s.select("doc_id", *(count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:3]),
                    F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def pieces_of(found: DataFrame) -> DataFrame:
    """(_id, _hash, pieces): the spans of ``found(_id, _hash, spans)`` that touch or overlap as one, cut at the bounds of stretches of ``STRETCH`` characters."""
    s = found.select("_id", "_hash", F.inline("spans"))
    by = Window.partitionBy("_id", "_hash").orderBy("start", "end", "kind")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(by))
    s = s.groupBy("_id", "_hash", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    s = s.select("*", F.explode(F.sequence(F.floor(F.col("start") / STRETCH), F.floor((F.col("end") - 1) / STRETCH))).alias("at"))
    low = F.greatest(F.col("start") - F.col("at") * STRETCH, F.lit(0))
    piece = F.struct(F.col("at").cast("int").alias("at"), low.cast("int").alias("start"),
                     F.least(F.col("end") - F.col("at") * STRETCH, F.lit(STRETCH)).cast("int").alias("end"),
                     (F.col("start") >= F.col("at") * STRETCH).alias("first"))
    return s.groupBy("_id", "_hash").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))


def rewritten(text: Column, pieces: Column, mark: str) -> Column:
    """``text`` with ``mark`` for the spans of ``pieces``: each stretch is rewritten by itself."""
    ats = F.transform(pieces, lambda p: p["at"])

    def one(stretch, i):
        k = F.array_position(ats, i)
        mine = F.filter(F.slice(pieces, F.greatest(k, F.lit(1)).cast("int"), F.lit(STRETCH)), lambda p: p["at"] == i)
        end = F.aggregate(mine, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda acc, p: F.struct(
            p["end"].alias("at"), F.concat(acc["out"], F.substring(stretch, acc["at"] + 1, p["start"] - acc["at"]), F.when(p["first"], mark).otherwise("")).alias("out")))
        whole = F.transform(F.array(end), lambda e: F.concat(e["out"], F.substring(stretch, e["at"] + 1, F.lit(STRETCH))))[0]
        return F.when(k == 0, stretch).otherwise(whole)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0)), one), "")


def drop_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark`` (overlapping spans as one), and
    n_chars, where it is a column, counted again. All rows stay."""
    found = (scan(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "spans")
             .dropDuplicates(["_id", "_hash"]))
    cut = sent(stage(pieces_of(found).withColumnRenamed("pieces", "_pieces"), "secret-spans"), SENT)
    both = docs.join(cut, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left")
    text = F.when(F.col("_pieces").isNull(), F.col("text")).otherwise(rewritten(F.col("text"), F.col("_pieces"), mark))
    out = both.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_pieces").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return out.select(*docs.columns)
