"""DuckDB SQL builders for the correctness oracle.

The oracle states each query a second time in plain SQL (RE2 regexes,
DuckDB window functions, correlated EXISTS for containment) so that the
Spark plans can be checked value by value. Nothing here runs on Spark.
"""

from __future__ import annotations

from html.entities import html5

from ..operators.html import P_CLOSING_END_TAGS, P_CLOSING_START_TAGS, VOID_TAGS


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def lst(xs) -> str:
    return "(" + ", ".join(q(x) for x in xs) + ")"


WS = r"[\t\n\f\r ]"
SPACES = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
TOK_RE2 = (r"""(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"""
           r"""|<(?:"[^"]*"|'[^']*'|[^'">])*>|[^<]+|<""")


def _entity_map() -> str:
    # a name as it stands in text; DuckDB's own table is the standard library's
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in sorted(html5.items())) + "}"


def decode(e: str) -> str:
    """Character references, each found by one pattern and looked up by the
    longest of its prefixes that is a name (the Spark side splits on "&")."""
    ref = r"&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]*;?)"
    names = f"list_filter(list_transform(range(length(m) - 1, 1, -1), lambda k: m[2:k + 1]), lambda p: map_contains({_entity_map()}, p))"
    num = (r"CASE WHEN regexp_matches(m, '^&#[xX]') THEN TRY_CAST('0x' || regexp_extract(m, '^&#[xX]0*([0-9A-Fa-f]*)', 1) AS BIGINT) "
           r"ELSE TRY_CAST(regexp_extract(m, '^&#0*([0-9]*)', 1) AS BIGINT) END")
    c1 = "".join(bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(0x80, 0xA0))
    char = (f"list_transform([{num}], lambda n: CASE WHEN n BETWEEN 128 AND 159 THEN {q(c1)}[n - 127] WHEN n > 0 AND n <= 1114111 AND NOT (n BETWEEN 55296 AND 57343) "
            f"THEN chr(n::INTEGER) ELSE chr(65533) END)[1]")
    one = (f"CASE WHEN m[2] = '#' THEN {char} ELSE coalesce(list_transform({names}[1:1], lambda p: map_extract_value({_entity_map()}, p) "
           f"|| m[length(p) + 2:])[1], m) END")
    found = f"regexp_extract_all({e}, {q(ref)})"
    gaps = f"regexp_split_to_array({e}, {q(ref)})"
    return (f"(CASE WHEN strpos({e}, '&') = 0 THEN {e} ELSE array_to_string(list_transform(list_zip({gaps}, {found}), "
            f"lambda z: z[1] || CASE WHEN z[2] IS NULL THEN '' ELSE list_transform([z[2]], lambda m: {one})[1] END), '') END)")


def utrim(e: str) -> str:
    return f"regexp_replace({e}, '^[{SPACES}]+|[{SPACES}]+\\z', '', 'g')"


def clean(e: str) -> str:
    x = f"regexp_replace({e}, '<[^>]*>', ' ', 'g')"
    x = decode(x)
    x = f"replace({x}, chr(160), ' ')"
    x = f"regexp_replace({x}, '{WS}+', ' ', 'g')"
    return utrim(x)


ATTR = r"""[\t\n\f\r />]+([^\t\n\f\r />=]+)(?:[\t\n\f\r ]*=[\t\n\f\r ]*("[^"]*"|'[^']*'|[^\t\n\f\r >"'][^\t\n\f\r >]*))?"""


def attrs(tok: str) -> str:
    """All attributes of a tag as a list of (name, value) structs, by matching
    them one after the other (the Spark side steps up to the one it wants)."""
    rest = rf"regexp_replace({tok}, '^<[^\t\n\f\r />]+', '')"
    value = "CASE WHEN regexp_matches(v, '^[\"'']') THEN v[2:length(v) - 1] ELSE v END"
    return (f"list_transform(list_zip(regexp_extract_all({rest}, {q(ATTR)}, 1), regexp_extract_all({rest}, {q(ATTR)}, 2)), "
            f"lambda z: {{'name': lower(z[1]), 'value': list_transform([z[2]], lambda v: {value})[1]}})")


def attr(tok: str, name: str) -> str:
    got = f"list_filter({attrs(tok)}, lambda x: x.name = {q(name)})[1].value"
    return decode(f"coalesce({got}, '')")


#: The start tag of a token (a script's token holds its content too).
START = r"""regexp_extract(tok, '(?s)^<(?:"[^"]*"|''[^'']*''|[^''">])*>')"""


def has_attr(tok: str, name: str) -> str:
    return f"(len(list_filter({attrs(tok)}, lambda x: x.name = {q(name)})) > 0)"


def tokens_cte() -> str:
    kind = (r"CASE WHEN starts_with(tok, '<!--') THEN 'comment' "
            r"WHEN regexp_matches(tok, '(?is)^<(script|style)\b.*</(script|style)>\z') THEN 'raw' "
            r"WHEN starts_with(tok, '<!') THEN 'decl' "
            r"WHEN regexp_matches(tok, '^</[A-Za-z]') THEN 'close' "
            r"WHEN regexp_matches(tok, '^<[A-Za-z]') THEN 'open' "
            r"WHEN starts_with(tok, '<') AND length(tok) > 1 THEN 'other' ELSE 'text' END")
    return f"""
tk0 AS (SELECT page_id, regexp_extract_all(html, {q(TOK_RE2)}, 0) AS toks FROM pages),
tk1 AS (SELECT page_id, CAST(len(toks) AS BIGINT) AS n_tok, unnest(toks) AS tok,
               CAST(unnest(range(len(toks))) AS BIGINT) AS pos FROM tk0),
tk2 AS (SELECT *, {kind} AS kind FROM tk1),
tk AS (SELECT *, CASE WHEN kind IN ('open','close','raw')
            THEN lower(regexp_extract(tok, '^</?([A-Za-z][A-Za-z0-9:-]*)', 1)) ELSE '' END AS tag FROM tk2)"""


def nodes_cte() -> str:
    # an element whose end tag may be left out ends at the first later token of
    # its kind with as many container starts as ends in between
    families = {"li": (["li"], "ul ol menu dir"), "dt": (["dt", "dd"], "dl"), "dd": (["dt", "dd"], "dl"),
                "option": (["option", "optgroup"], "select"), "optgroup": (["optgroup"], "select")}
    rows = ["thead", "tbody", "tfoot"]
    families |= {t: (["td", "th", "tr", *rows], "table") for t in ("td", "th")} | {"tr": (["tr", *rows], "table")}
    families |= {t: (rows, "table") for t in rows}
    ends = []
    for t, (by, box) in families.items():
        inside = (f"(SELECT coalesce(sum(CASE WHEN x.kind = 'open' THEN 1 ELSE -1 END), 0) FROM tk x WHERE x.page_id = a.page_id "
                  f"AND x.pos > a.pos AND x.pos < b.pos AND x.tag IN {lst(box.split())} AND x.kind IN ('open', 'close'))")
        ends.append(f"SELECT a.page_id, a.pos, min(b.pos) AS fam_end FROM tk a JOIN tk b ON b.page_id = a.page_id AND b.pos > a.pos "
                    f"AND b.kind IN ('open', 'close') AND (b.tag IN {lst(by)} OR (b.kind = 'close' AND b.tag IN {lst(box.split())})) "
                    f"WHERE a.kind = 'open' AND a.tag = {q(t)} AND {inside} = 0 GROUP BY a.page_id, a.pos")
    v, imp = lst(VOID_TAGS), lst(["p", "a", *families])
    return tokens_cte() + f""",
fam AS ({' UNION ALL '.join(ends)}),
e0 AS (SELECT *, kind IN ('open','raw') AS is_elem,
          CASE WHEN kind NOT IN ('open','raw') THEN NULL
               WHEN kind = 'raw' OR tag IN {v} OR (kind = 'open' AND regexp_matches(tok, '/>\\z')) THEN 'void'
               WHEN tag IN {imp} THEN 'implied' ELSE 'paired' END AS ecls FROM tk),
e1 AS (SELECT *, (tag <> '' AND tag NOT IN {v} AND tag NOT IN {imp}
                  AND (ecls = 'paired' OR kind = 'close')) AS pe FROM e0),
e2 AS (SELECT *, sum(CASE WHEN pe AND kind = 'open' THEN 1 WHEN pe AND kind = 'close' THEN -1 ELSE 0 END)
                   OVER (PARTITION BY page_id, tag ORDER BY pos ROWS UNBOUNDED PRECEDING) AS d,
              lead(pos) OVER (PARTITION BY page_id, tag ORDER BY pos) AS nt,
              first_value(CASE WHEN (kind = 'open' AND tag IN {lst(P_CLOSING_START_TAGS)})
                                 OR (kind = 'close' AND tag IN {lst(P_CLOSING_END_TAGS)}) THEN pos END IGNORE NULLS)
                OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS npt
       FROM e1),
e3 AS (SELECT *, CASE WHEN kind = 'close' THEN d + 1 ELSE d END AS lvl FROM e2),
e4 AS (SELECT e3.*, fam_end, lead(kind) OVER (PARTITION BY page_id, tag, lvl ORDER BY pos) AS nk,
                 lead(pos) OVER (PARTITION BY page_id, tag, lvl ORDER BY pos) AS np FROM e3 LEFT JOIN fam USING (page_id, pos)),
e5 AS (SELECT *, CASE WHEN ecls = 'void' THEN pos WHEN ecls = 'implied' AND tag = 'p' THEN npt
                      WHEN ecls = 'implied' AND tag = 'a' THEN nt
                      WHEN ecls = 'implied' THEN fam_end
                      WHEN ecls = 'paired' AND nk = 'close' THEN np END AS end_k FROM e4),
e6 AS (SELECT *, (is_elem AND ecls <> 'void' AND end_k IS NOT NULL) AS st FROM e5),
ev AS (SELECT page_id, pos, pos AS ep, 1 AS eo, CASE WHEN st THEN 1 ELSE 0 END AS dl, true AS me FROM e6
       UNION ALL SELECT page_id, pos, end_k, 0, -1, false FROM e6 WHERE st),
ev2 AS (SELECT page_id, pos, me, sum(dl) OVER (PARTITION BY page_id ORDER BY ep, eo ROWS UNBOUNDED PRECEDING) AS s FROM ev),
e7 AS (SELECT e6.*, CASE WHEN st THEN s ELSE s + 1 END AS level
       FROM e6 JOIN ev2 ON ev2.page_id = e6.page_id AND ev2.pos = e6.pos AND ev2.me),
pr AS (SELECT page_id, pos, level AS k, 0 AS q, pos AS cp, end_k AS ce, tag AS ct FROM e7 WHERE st
       UNION ALL SELECT page_id, pos, level - 1, 1, NULL, NULL, NULL FROM e7),
pr2 AS (SELECT page_id, pos, q, last_value(cp IGNORE NULLS) OVER w AS par_p,
               last_value(ce IGNORE NULLS) OVER w AS par_e, last_value(ct IGNORE NULLS) OVER w AS par_t
        FROM pr WINDOW w AS (PARTITION BY page_id, k ORDER BY pos, q ROWS UNBOUNDED PRECEDING)),
extent AS (SELECT e7.page_id, e7.pos, n_tok, tok, kind, tag, is_elem,
            CASE WHEN NOT is_elem THEN e7.pos
                 ELSE coalesce(end_k, CASE WHEN level > 1 THEN par_e END, n_tok) END AS end_pos
          FROM e7 JOIN pr2 ON pr2.page_id = e7.page_id AND pr2.pos = e7.pos AND pr2.q = 1),
around AS (SELECT x.page_id, x.pos, count(*) AS n, max(a.pos) AS par, arg_max(a.tag, a.pos) AS par_t FROM extent x JOIN extent a
           ON a.page_id = x.page_id AND a.is_elem AND a.pos < x.pos AND x.pos < a.end_pos GROUP BY x.page_id, x.pos),
nodes AS (SELECT x.*, CAST(1 + coalesce(n, 0) AS BIGINT) AS level, par AS parent, par_t AS parent_tag
          FROM extent x LEFT JOIN around USING (page_id, pos))"""


RAW = r"""regexp_extract(t.tok, '(?is)^<[^>]*>(.*)</[a-z]+>\z', 1)"""


def escaped(e: str) -> str:
    for char, ref in (("&", "&amp;"), ("\'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;")):
        e = f"replace({e}, {q(char)}, {q(ref)})"
    return f"replace({e}, chr(13), '&#13;')"


def markup_ctes(owner_pred: str) -> str:
    """CTEs ``written`` (what stands for each node, twice for an element) and ``x``: (page_id, pos, raw), the markup inside each owner."""
    v = lst(VOID_TAGS)

    def start(tok):
        one = f"list_transform({attrs(tok)}, lambda y: ' ' || y.name || '=\"' || {escaped(decode('coalesce(y.value, chr(0))'))} || '\"')"
        one = one.replace("chr(0)", "''")
        return f"'<' || tag || array_to_string({one}, '') || CASE WHEN tag IN {v} THEN '/>' ELSE '>' END"

    end_tag = "'</' || tag || '>'"
    piece = (f"CASE kind WHEN 'text' THEN {escaped(decode('tok'))} WHEN 'raw' THEN {start(START)} || {RAW.replace('t.tok', 'tok')} || {end_tag} "
             f"WHEN 'open' THEN {start('tok')} || CASE WHEN end_pos <= pos AND tag NOT IN {v} THEN {end_tag} ELSE '' END WHEN 'close' THEN '' ELSE tok END")
    return (f"written AS (SELECT page_id, pos, pos AS at, 1 AS ord, 0 AS inner_first, {piece} AS piece FROM nodes "
            f"UNION ALL SELECT page_id, pos, end_pos, 0, -pos, {end_tag} FROM nodes WHERE is_elem AND end_pos > pos), "
            f"x AS (SELECT a.page_id, a.pos, coalesce(string_agg(w.piece, '' ORDER BY w.at, w.ord, w.inner_first), '') AS raw FROM nodes a "
            f"LEFT JOIN written w ON w.page_id = a.page_id AND w.pos > a.pos AND w.pos < a.end_pos "
            f"WHERE a.is_elem AND a.end_pos > a.pos AND ({owner_pred}) GROUP BY a.page_id, a.pos)")


def text_cte(name: str, owner_pred: str, member: str = "t.kind IN ('text', 'raw')",
             piece: str = f"CASE WHEN t.kind = 'raw' THEN replace({RAW}, '&', '&amp;') ELSE t.tok END") -> str:
    """CTE ``name``: (page_id, pos, raw) - concatenated members strictly
    inside each owner element, in document order (brute-force join)."""
    return (f"{name} AS (SELECT a.page_id, a.pos, coalesce(string_agg({piece}, '' ORDER BY t.pos), '') AS raw "
            f"FROM nodes a LEFT JOIN nodes t ON t.page_id = a.page_id AND t.pos > a.pos "
            f"AND t.pos < a.end_pos AND {member} WHERE a.is_elem AND a.end_pos > a.pos AND ({owner_pred}) "
            f"GROUP BY a.page_id, a.pos)")


def inside(alias: str, outer_pred: str, outer: str = "o") -> str:
    """``alias`` lies strictly inside some element satisfying ``outer_pred``."""
    return (f"EXISTS (SELECT 1 FROM nodes {outer} WHERE {outer}.page_id = {alias}.page_id AND {outer}.is_elem "
            f"AND {outer}.pos < {alias}.pos AND {alias}.pos < {outer}.end_pos AND {outer_pred})")
