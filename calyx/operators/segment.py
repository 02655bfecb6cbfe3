"""Line segmentation and block fields.

A document is one row; its lines are exploded in order, blocks are a
running count of header lines, and block text is an ordered aggregate.
Every window is partitioned by the document id, so one document's lines
(bounded by the row size) are the largest unit any task holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cluster_by

ColumnOrName = Column | str


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def lines(df: DataFrame, id_col: str, text_col: str = "text", cluster: bool = True) -> DataFrame:
    """Text -> (id, line_no, line) split on ``\\n``, order kept.

    With ``cluster`` the documents are hash-partitioned on the id before the
    explode (nothing moves when they are bucketed by it), so every later
    window or aggregate by document reuses that one exchange.
    """
    d = df.select(id_col, text_col)
    if cluster:
        d = cluster_by(d, id_col)
    return d.select(id_col, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line"))


def segment(ls: DataFrame, id_col: str, is_header: Column, keep_preamble: bool = True) -> DataFrame:
    """A header line starts a block; block 0 holds the lines before
    the first header (kept for W1, dropped for W2).

    Output: id, blk, start_line, n_lines, text (lines joined by ``\\n``).
    """
    w = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = ls.withColumn("blk", F.sum(F.when(is_header, 1).otherwise(0)).over(w))
    if not keep_preamble:
        x = x.filter("blk >= 1")
    return x.groupBy(id_col, "blk").agg(
        F.min("line_no").alias("start_line"),
        F.count("*").alias("n_lines"),
        F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY line_no)").alias("text"))


def last_before(df: DataFrame, part: list[str], order: list[str], value: ColumnOrName,
                name: str) -> DataFrame:
    """As-of: the last non-NULL ``value`` at or before each row."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(_c(value), ignorenulls=True).over(w))


def collect_fields(classified: DataFrame, keys: list[str], order: str, kind_col: str = "kind",
                   value_col: str = "value", text_kind: str = "text", sep: str = " ",
                   last_wins: list[str] = (), first_wins: list[str] = (),
                   appended: dict | None = None, counted: dict | None = None) -> DataFrame:
    """A5: fold classified lines of a block into fields.

    Lines of ``text_kind`` are joined in order (the description); for a kind
    in ``last_wins`` the last line's value is kept, ``first_wins`` the
    first; ``appended`` maps a kind to the field its values are appended to,
    ``counted`` a kind to the field with its number of lines.
    """
    k, v = F.col(kind_col), F.col(value_col)
    aggs = [F.expr(f"listagg(CASE WHEN {kind_col} = '{text_kind}' THEN {value_col} END, '{sep}') "
                   f"WITHIN GROUP (ORDER BY {order})").alias(text_kind)]
    for kd in last_wins:
        aggs.append(F.max_by(F.when(k == kd, v), F.when(k == kd, F.col(order))).alias(kd))
    for kd in first_wins:
        aggs.append(F.min_by(F.when(k == kd, v), F.when(k == kd, F.col(order))).alias(kd))
    for kd, _target in (appended or {}).items():
        aggs.append(F.expr(f"listagg(CASE WHEN {kind_col} = '{kd}' THEN {value_col} END, '{sep}') "
                           f"WITHIN GROUP (ORDER BY {order})").alias(f"_app_{kd}"))
    aggs += [F.count_if(k == kd).alias(name) for kd, name in (counted or {}).items()]
    out = classified.groupBy(*keys).agg(*aggs)
    for kd, target in (appended or {}).items():
        out = out.withColumn(target, F.concat_ws(sep, F.nullif(F.col(target), F.lit("")),
                                                 F.nullif(F.col(f"_app_{kd}"), F.lit("")))).drop(f"_app_{kd}")
    return out


def explode_numbers(df: DataFrame, col: str, name: str = "number", index: str = "idx") -> DataFrame:
    """One row per digit run of ``col`` (``891*/892*`` -> 891, 892) with its
    place ``index``; no digits -> no row."""
    return _exploded(df, F.regexp_extract_all(F.col(col), F.lit(r"(\d+)"), 1), name, index)


def explode_if_slash(df: DataFrame, col: str, name: str = "number", index: str = "idx") -> DataFrame:
    """Split into digit runs only when the value has ``/``; otherwise
    keep it as one row unchanged."""
    c = F.col(col)
    return _exploded(df, F.when(c.contains("/"), F.regexp_extract_all(c, F.lit(r"(\d+)"), 1)).otherwise(F.array(c)), name, index)


def _exploded(df: DataFrame, parts: Column, name: str, index: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in (name, index)], F.posexplode(parts).alias(index, name))
