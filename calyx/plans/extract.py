"""Page-level extraction helpers the pipelines are written with.

All of them run on the node table of ``html.shred`` (hash-partitioned by
page once) and return DataFrames keyed by ``page_id`` (and ``pos``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import html as H
from ..session import clustered_partitions, scan_bytes
from ..sources import io as IO

PID = H.PID


def staged_nodes(pages: DataFrame, select: dict[str, list] | None = None, scopes: list[str] = ()) -> DataFrame:
    """The node table of ``pages``, computed once and written to the shared
    folder as Parquet, bucketed by ``page_id``.

    A pipeline reads the node table from many branches (texts, markup,
    siblings, ownership). The written table cuts the lineage, so shredding runs
    once and survives executor loss; each branch reads only its columns; and
    the bucketed scan keeps the hash partitioning on ``page_id`` (the per-page
    windows downstream still need no exchange).

    The buckets follow the bytes of the pages. A subset of pages (a filter, a
    semi-join, a union) has no known size, so it is written first. ``select`` and ``scopes`` mark
    selectors in the same pass (see ``html.shred``).
    """
    pages = pages.select(PID, "html")
    if scan_bytes(pages, plain=True) is None:
        pages = IO.staged(pages, "pages")
    n = clustered_partitions(pages)
    return IO.land_bucketed(H.shred(pages, partitions=n, reopen=True, select=select, scopes=scopes), f"calyx_nodes_{uuid.uuid4().hex}", PID, n, keep=False)


def marked(pages: DataFrame, select: dict[str, list], scopes: list[str] = ()) -> DataFrame:
    """The node table of ``pages`` with selectors marked in the same pass, for a level that is read once: the pages aren't
    moved, and only what is selected is shuffled afterwards."""
    return H.shred(pages, select=select, scopes=scopes, reopen=True, cluster=False)


def marked_texts(nodes: DataFrame, names: list[str], **own: Column) -> DataFrame:
    """``Text()`` of the elements that each of the scopes ``names`` marks, all in one grouping: (page_id, field, pos, text),
    and the columns ``own`` of the element's row."""
    piece = F.when(F.col("kind") == "raw", H.raw_text()).when(F.col("kind") == "text", F.col("tok"))

    def within(n: str) -> Column:
        return F.transform(f"in_{n}", lambda o: F.struct(F.lit(n).alias("field"), o.alias("at")))

    inside = F.flatten(F.array(*map(within, names)))
    itself = F.array_compact(F.array(*(F.when(F.col(n), F.struct(F.lit(n).alias("field"), F.col("pos").alias("at"))) for n in names)))
    # a script or style element is its own text's token
    at = F.when(F.col("kind") == "text", inside).when(F.col("kind") == "raw", F.concat(inside, itself)).when(F.col("is_elem"), itself)
    x = nodes.select(PID, "pos", piece.alias("_piece"), F.explode(at).alias("_at"), *(c.alias(k) for k, c in own.items()))
    mine = F.col("pos") == F.col("_at.at")
    g = x.groupBy(PID, F.col("_at.field").alias("field"), F.col("_at.at").alias("pos")).agg(
        F.expr("listagg(_piece, '') WITHIN GROUP (ORDER BY pos)").alias("_t"), *(F.max(F.when(mine, F.col(k))).alias(k) for k in own))
    return g.select(PID, "field", "pos", H.decode_entities(F.coalesce("_t", F.lit(""))).alias("text"), *own)


def joined_text(field: str, text: str = "text", name: str | None = None) -> Column:
    """An aggregate of ``marked_texts``: the texts of one field in document order."""
    return F.expr(f"listagg(CASE WHEN field = '{field}' THEN {text} END, '') WITHIN GROUP (ORDER BY pos)").alias(name or field)

COURSE_FIELDS = ["SubjectName", "SubjectDescription", "SubjectCode", "Link", "name", "numericCode",
                 "courseCode", "description", "prerequisite", "antirequisite", "corequisite",
                 "oneWayExclusion", "crosslisted"]


def texts(nodes: DataFrame, *path: Column, raw: bool = True) -> DataFrame:
    """``Text()`` of every element matching the selector path: the element
    rows plus ``text`` (entity-decoded)."""
    m = H.mark_path(nodes, *path, name="_m")
    return H.element_text(m, F.col("_m"), with_raw=raw).drop("_m")


def markup(nodes: DataFrame, *path: Column) -> DataFrame:
    """``Html()`` of every element matching the selector path (+ ``html``)."""
    m = H.mark_path(nodes, *path, name="_m")
    return H.inner_html(m, F.col("_m")).drop("_m")


def selection_text(rows: DataFrame, col: str = "text", name: str = "value") -> DataFrame:
    """``Selection.Text()`` of a set: the members' texts joined in document
    order, per page."""
    return rows.groupBy(PID).agg(
        F.expr(f"listagg({col}, '') WITHIN GROUP (ORDER BY pos)").alias(name))


def first_of(rows: DataFrame, col: str, name: str, last: bool = False) -> DataFrame:
    """``First()`` / ``Last()`` of a set (H12) - by document order."""
    f = F.max_by if last else F.min_by
    return rows.groupBy(PID).agg(f(col, "pos").alias(name))


def owner_of(nodes: DataFrame, scope: Column, member: Column) -> DataFrame:
    """(page_id, pos, owner) for elements matching ``member`` inside an
    element matching ``scope`` (``s.Find(..)`` within each scope)."""
    o = H.owned_tokens(nodes, scope, member & F.col("is_elem"))
    return o.filter(~F.col("is_owner")).select(PID, "pos", "owner")


def scoped_texts(nodes: DataFrame, scope: Column, member: Column) -> DataFrame:
    """Text of every ``member`` element with the position of its enclosing
    ``scope`` element: (page_id, owner, pos, tok, text)."""
    t = texts(nodes, member).select(PID, "pos", "tok", "text")
    return owner_of(nodes, scope, member).join(t, [PID, "pos"])


def document_text(nodes: DataFrame, name: str = "doc_text") -> DataFrame:
    """``doc.Text()``: every text node of the page in order (script and
    style content included), entity-decoded."""
    piece = F.when(F.col("kind") == "raw", H.raw_text()).otherwise(F.col("tok"))
    t = nodes.filter(F.col("kind").isin("text", "raw")).withColumn("_p", piece)
    g = t.groupBy(PID).agg(F.expr("listagg(_p, '') WITHIN GROUP (ORDER BY pos)").alias("_t"))
    return g.select(PID, H.decode_entities("_t").alias(name))


def document_html(nodes: DataFrame, name: str = "doc_html") -> DataFrame:
    """``doc.Html()``: the page serialised again."""
    return H.page_html(nodes, name)


def parents_of(rows: DataFrame) -> DataFrame:
    """(page_id, pos) of the parents of ``rows`` (with the child's pos as
    ``child``)."""
    return rows.select(PID, F.col("parent").alias("pos"), F.col("pos").alias("child")) \
               .filter(F.col("pos").isNotNull())


def at_positions(nodes: DataFrame, keys: DataFrame, flag: str = "_at") -> DataFrame:
    """Flag the nodes whose (page_id, pos) is in ``keys``."""
    k = keys.select(PID, "pos").distinct().withColumn(flag, F.lit(True))
    return nodes.join(k, [PID, "pos"], "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def course_frame(df: DataFrame, source: str, ord_cols: list[str]) -> DataFrame:
    """The common Course schema: missing text fields are ``""`` (the zero
    value), plus ``source`` and a deterministic ``ord`` (first-seen order)."""
    cols = []
    for f in COURSE_FIELDS:
        cols.append((F.coalesce(F.col(f), F.lit("")) if f in df.columns else F.lit("")).alias(f))
    o = F.array(*[F.col(c).cast("long") for c in ord_cols])   # arrays of all sources compare, whatever their depth
    return df.select(F.lit(source).alias("source"), o.alias("ord"), *cols)
