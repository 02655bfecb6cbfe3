"""Scalar text functions (T1-T19) as Spark Column expressions.

Everything here is a composition of built-in functions, so it stays inside
whole-stage codegen; there is no Python UDF. Patterns are written for
java.util.regex with the RE2 meaning the reference relies on (see
``calyx.functions.regex``).
"""

from __future__ import annotations

import json
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import WS, UNICODE_SPACE

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Named character references: the HTML5 table of the standard library. Names
# without ";" are the older ones that need none; where a reference has no
# full match, the longest of these that it starts with counts.
ENTITY_TABLE: dict[str, str] = dict(html5)
BARE_ENTITIES = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
# The references that make up nearly all of a page's: looked up first.
COMMON_ENTITIES = ("amp;", "lt;", "gt;", "quot;", "nbsp;", "copy;")
# Code points 0x80-0x9F name Windows-1252 characters.
C1_POINTS = "".join(map(chr, range(0x80, 0xA0)))
C1_CHARS = "".join(bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(0x80, 0xA0))
# A reference that ends itself: decimal, hexadecimal (";" may be missing), or a name with ";".
ENTITY_RE = r"^(#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]*;)"
BARE_RE = "^(" + "|".join(BARE_ENTITIES) + ")"


def sql_str(s: str) -> str:
    """A Spark SQL string literal for ``s`` (backslashes and quotes escaped)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


@cache
def _entity_map_sql() -> str:
    # one string literal parsed as a map: a two-node expression that the
    # optimizer folds to a constant
    return f"from_json({sql_str(json.dumps(ENTITY_TABLE, sort_keys=True))}, 'map<string,string>')"


def decode_sql(x: str) -> str:
    """SQL text of ``decode_entities`` over the SQL expression ``x``.

    The text is split on ``&``; each piece after the first starts where an
    ampersand was. Per piece: ``m`` is a reference that ends itself, ``n`` the
    longest name that needs no ";", ``z`` the digits of a number.
    """
    m = f"regexp_extract(p, {sql_str(ENTITY_RE)}, 1)"
    n = f"regexp_extract(p, {sql_str(BARE_RE)}, 1)"
    parts = (f"transform(transform(split({x}, '&', -1), p -> named_struct('p', p, 'm', {m}, 'n', {n})), y -> named_struct("
             "'p', y.p, 'm', y.m, 'n', y.n, 'z', ltrim('0', regexp_replace(y.m, '[#xX;]', ''))))")
    # more digits than any code point has: U+FFFD, as for NUL, surrogates and all beyond U+10FFFF
    cp = ("(CASE WHEN length(x.z) > 9 THEN 0 WHEN x.m RLIKE '^#[xX]' THEN CAST(conv(x.z, 16, 10) AS BIGINT) "
          "ELSE try_cast(x.z AS BIGINT) END)")
    ok = (f"transform(array({cp}), c -> CASE WHEN c > 0 AND c <= 1114111 AND NOT (c BETWEEN 55296 AND 57343) THEN c ELSE 65533 END)[0]")
    ch = f"translate(decode(unhex(lpad(hex({ok}), 8, '0')), 'UTF-32'), {sql_str(C1_POINTS)}, {sql_str(C1_CHARS)})"
    common = " ".join(f"WHEN x.m = '{k}' THEN {sql_str(ENTITY_TABLE[k])}" for k in COMMON_ENTITIES)
    tail = "substring(x.p, length(x.m) + 1)"
    # the name itself, else the longest bare name, each with what follows it
    named = (f"filter(transform(array(x.m, x.n), k -> concat(try_element_at({_entity_map_sql()}, k), substring(x.p, length(k) + 1))), "
             "v -> v IS NOT NULL)")
    piece = (f"CASE WHEN i = 0 THEN x.p WHEN startswith(x.m, '#') THEN concat({ch}, {tail}) "
             f"WHEN x.m = '' AND x.n = '' THEN concat('&', x.p) "
             f"WHEN x.m IN ({', '.join(map(sql_str, COMMON_ENTITIES))}) THEN concat(CASE {common} END, {tail}) "
             f"ELSE coalesce(get({named}, 0), concat('&', x.p)) END")
    return f"(CASE WHEN instr({x}, '&') = 0 THEN {x} ELSE array_join(transform({parts}, (x, i) -> {piece}), '') END)"


def utrim_sql(x: str) -> str:
    return f"regexp_replace({x}, {sql_str(f'^[{UNICODE_SPACE}]+|[{UNICODE_SPACE}]+\\z')}, '')"


def clean_sql(x: str) -> str:
    y = f"regexp_replace({x}, '<[^>]*>', ' ')"
    y = decode_sql(y)
    y = f"replace({y}, {sql_str(chr(0xA0))}, ' ')"
    y = f"regexp_replace({y}, {sql_str(WS + '+')}, ' ')"
    return utrim_sql(y)


def _name(c) -> str | None:
    """SQL reference of a plain column name, else None."""
    return f"`{c}`" if isinstance(c, str) else None


def decode_entities(c: ColumnOrName) -> Column:
    """HTML character references decoded in a single left-to-right pass,
    so ``&amp;lt;`` gives ``&lt;``.

    All HTML5 names; the older names also without ``;``; numbers of any length,
    with 0x80-0x9F as Windows-1252. An unknown reference stays as it is.
    """
    if _name(c):
        return F.expr(decode_sql(_name(c)))
    return F.call_function("transform", F.array(_c(c)), F.expr("v -> " + decode_sql("v")))[0]


def strip_tags(c: ColumnOrName, repl: str = "") -> Column:
    """Remove markup ``<...>``."""
    return F.regexp_replace(_c(c), "<[^>]*>", repl)


def utrim(c: ColumnOrName) -> Column:
    """T4: trim Unicode white space on both ends (Spark's trim only takes spaces)."""
    if _name(c):
        return F.expr(utrim_sql(_name(c)))
    return F.regexp_replace(_c(c), f"^[{UNICODE_SPACE}]+|[{UNICODE_SPACE}]+\\z", "")


def clean(c: ColumnOrName) -> Column:
    """Tags -> space, entity decode, U+00A0 -> space, white-space runs -> one space, trim."""
    if _name(c):
        return F.expr(clean_sql(_name(c)))
    x = strip_tags(c, " ")
    x = decode_entities(x)
    x = F.regexp_replace(x, "\u00a0", " ")
    x = F.regexp_replace(x, f"{WS}+", " ")
    return utrim(x)


def non_ascii(c: ColumnOrName, repl: str = " ") -> Column:
    """T5: every non-ASCII character -> ``repl``."""
    return F.regexp_replace(_c(c), "[^\\x00-\\x7F]", repl)


def newline_to_space(c: ColumnOrName) -> Column:
    """Newlines -> space, then trim."""
    return utrim(F.translate(_c(c), "\n", " "))


def strip_trailing_paren(c: ColumnOrName) -> Column:
    """Drop a trailing ``(..)`` that starts on the last line (``\\s*\\(.*$``)."""
    c = _c(c)
    last = F.substring_index(c, "\n", -1)
    at = F.instr(last, "(")
    return F.when(at > 0, F.rtrim(F.left(c, F.length(c) - F.length(last) + at - 1), F.lit("\t\n\f\r "))).otherwise(c)


def trim_prefix(c: ColumnOrName, prefix: str) -> Column:
    """Remove ``prefix`` once if the text starts with it."""
    c = _c(c)
    return F.when(c.startswith(prefix), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)


def trim_suffix(c: ColumnOrName, suffix: str) -> Column:
    """Remove ``suffix`` once if the text ends with it."""
    c = _c(c)
    return F.when(c.endswith(suffix), F.left(c, F.length(c) - F.lit(len(suffix)))).otherwise(c)


def remove_first(c: ColumnOrName, literal: str) -> Column:
    """Remove the first occurrence of a literal."""
    c = _c(c)
    i = F.instr(c, literal)
    return F.when(i == 0, c).otherwise(
        F.concat(F.left(c, i - 1), F.substr(c, i + F.lit(len(literal)))))


def split_literal(c: ColumnOrName, literal: str) -> Column:
    """Split on a literal separator, keeping empty pieces."""
    import re
    return F.split(_c(c), re.escape(literal), -1)


def to_int(c: ColumnOrName) -> Column:
    """String -> int, NULL when it is not a number."""
    return _c(c).try_cast("int")


def first_nonempty(*cols: ColumnOrName) -> Column:
    """Fallback chain - next value only if the previous one is ``""``."""
    return F.coalesce(*[F.nullif(_c(x), F.lit("")) for x in cols], F.lit(""))


def cascade(c: ColumnOrName, rules: list[tuple[str, str, int]],
            default_kind: str = "text") -> Column:
    """First matching rule wins -> ``struct(kind, value)``.

    ``rules`` is ``[(kind, pattern, group), ...]`` in priority order; a line
    no rule matches gets ``default_kind`` and its own text.
    """
    c = _c(c)
    kind = F.lit(default_kind)
    value = c
    for k, pat, g in reversed(rules):
        hit = F.regexp_like(c, F.lit(pat))
        kind = F.when(hit, F.lit(k)).otherwise(kind)
        value = F.when(hit, F.regexp_extract(c, pat, g)).otherwise(value)
    return F.struct(kind.alias("kind"), value.alias("value"))


def slice_between(c: ColumnOrName, start_pattern: str, end_pattern: str) -> Column:
    """Text from the first match of ``start_pattern`` to the end of the
    last match of ``end_pattern``; ``""`` when either is missing."""
    c = _c(c)
    s = F.regexp_instr(c, F.lit(start_pattern))
    last_end = F.regexp_extract(c, f"(?s)^(.*{end_pattern})", 1)
    e = F.length(last_end)
    return F.when((s > 0) & (e >= s), F.substring(c, s, e - s + 1)).otherwise(F.lit(""))


def match_positions(df, key: list[str], text: str, pattern: str):
    """Every match of ``pattern`` in the texts, one row each: the key, ``match_no`` from 0, ``start`` and ``end`` (code
    points from 0, end exclusive) and ``match``.

    The lengths of the gaps and matches before a match are summed by a running window over the text's rows, so the work
    grows with the matches. ``key`` must name one text. The pattern must not match the empty string.
    """
    from pyspark.sql import Window

    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    m = df.where(F.regexp_like(text, F.lit(pattern))).select(*key, F.posexplode(parts).alias("match_no", "p"))
    upto = Window.partitionBy(*key).orderBy("match_no").rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("end", F.sum(F.char_length("p.gap") + F.coalesce(F.char_length("p.hit"), F.lit(0))).over(upto)).where("p.hit is not null")
    return m.select(*key, F.col("match_no").cast("long").alias("match_no"), (F.col("end") - F.char_length("p.hit")).alias("start"), "end", F.col("p.hit").alias("match"))
