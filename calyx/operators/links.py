"""Links, URLs and paging as tables (L1-L11): the crawl frontier is data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, to_int
from ..sources.io import staged
from .dims import LOOKUP_ROWS, first_per_key
from .html import PID, attr, element_text, mark_path, sel

ColumnOrName = Column | str


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def extract_links(nodes: DataFrame, *scope: Column, link: Column | None = None,
                  href_attr: str = "href", keep: list[str] = ()) -> DataFrame:
    """L1: links of pages -> (page_id, pos, href, label, and page columns that
    the node table carries in ``keep``).

    ``scope`` are ancestor selectors (``nav``, ``li`` gives ``nav li a``);
    ``label`` is the cleaned text of the link element.
    """
    link = link if link is not None else sel(tag="a")
    marked = mark_path(nodes, *scope, link, name="_lnk")
    t = element_text(marked, F.col("_lnk"))
    return t.select(PID, F.col("pos").cast("long").alias("pos"),
                    attr(href_attr).alias("href"), clean("text").alias("label"), *keep)


def origin(url: ColumnOrName) -> Column:
    """scheme://host[:port] of an absolute URL ("" when not absolute)."""
    return F.regexp_extract(_c(url), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def host(url: ColumnOrName) -> Column:
    return F.lower(F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def prefix_url(base: str, href: ColumnOrName) -> Column:
    """L2: absolute link by prefixing a fixed base."""
    return F.concat(F.lit(base), _c(href))


def resolve_url(page_url: ColumnOrName, href: ColumnOrName) -> Column:
    """L3: resolve a reference against the page URL (RFC 3986): absolute,
    scheme-relative, root-relative and relative forms, dot segments removed,
    a base without a path taken as its root."""
    u, h = _c(page_url), _c(href)
    scheme = F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    base_dir = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*/)", 1)
    path = F.regexp_extract(h, r"^([^?#]*)", 1)
    rest = F.substr(h, F.length(path) + 1)
    full = F.when(h.startswith("/"), path).otherwise(F.concat(F.when(base_dir == "", "/").otherwise(base_dir), path))
    return (F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
            .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
            .when(h == "", F.regexp_extract(u, r"^([^#]*)", 1))
            .when(h.startswith("?"), F.concat(F.regexp_extract(u, r"^([^?#]*)", 1), h))
            .when(h.startswith("#"), F.concat(F.regexp_extract(u, r"^([^#]*)", 1), h))
            .otherwise(F.concat(origin(u), drop_dot_segments(full), rest)))


def drop_dot_segments(path: ColumnOrName) -> Column:
    """An absolute path without its ``.`` and ``..`` segments (RFC 3986, 5.2.4)."""
    path = _c(path)
    parts = F.split(path, "/", -1)

    def step(kept, s):  # the first part is the empty one before the leading "/"
        return (F.when(s == ".", kept).when(s == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1))))
                .otherwise(F.concat(kept, F.array(s))))

    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.lit("")), step)
    out = F.array_join(kept, "/")
    out = F.when(path.rlike(r"/\.\.?\z"), F.concat(out, F.lit("/"))).otherwise(out)
    return F.when(path.rlike(r"(^|/)\.\.?(/|\z)"), out).otherwise(path)


def query_param(url: ColumnOrName, key: str) -> Column:
    """L4: URL-decoded query parameter, "" when absent or unparsable."""
    return F.coalesce(F.try_url_decode(F.try_parse_url(_c(url), F.lit("QUERY"), F.lit(key))), F.lit(""))


def drop_fragment(url: ColumnOrName) -> Column:
    """Remove ``#...``."""
    return F.regexp_replace(_c(url), r"#.*", "")


def rewrite_first(url: ColumnOrName, old_regex: str, new: str) -> Column:
    """Replace only the first occurrence (anchored lazy prefix)."""
    return F.regexp_replace(_c(url), rf"(?s)^(.*?){old_regex}", "$1" + new.replace("$", "\\$"))


def dedup_links_in_page(links: DataFrame, key: str = "href") -> DataFrame:
    """First occurrence of each link within a page.

    A page's links are together already (the node table is partitioned by
    page), so the first one is kept by the least position.
    """
    rest = [c for c in links.columns if c not in (PID, key, "pos")]
    return links.groupBy(PID, key).agg(F.min("pos").alias("pos"), *[F.min_by(c, "pos").alias(c) for c in rest],
                                       F.count("*").alias("n_seen"))


def dedup_links_global(links: DataFrame, key_cols: list[str], order_cols: list[str]) -> DataFrame:
    """First occurrence of each link over all pages of a source (by
    ``order_cols``), with the number of times it was seen."""
    return first_per_key(links, key_cols, order_cols, "n_seen")


def last_page_number(href: ColumnOrName, pattern: str = r".*page=(\d+)") -> Column:
    """L9 (T12): last page number of a pager link; NULL when absent."""
    return to_int(F.regexp_extract(_c(href), pattern, 1))


def expand_pages(df: DataFrame, last_col: str, first: int = 1, name: str = "page_no") -> DataFrame:
    """One row per page number ``first..last``."""
    return df.filter(F.col(last_col) >= first).withColumn(
        name, F.explode(F.sequence(F.lit(first), F.col(last_col))))


def template_url(fmt: str, *cols: ColumnOrName) -> Column:
    """Request URL from row values (``%s``/``%d`` format)."""
    return F.format_string(fmt, *[_c(c) for c in cols])


def frontier(links: DataFrame, landed: DataFrame, url_col: str = "url") -> DataFrame:
    """Every link with ``landed`` = its target is already a page.

    One left join against the distinct landed URLs gives both sides of the
    frontier in a single pass over the links (the anti and semi joins would
    each recompute them).
    """
    pages = landed.select(F.col(url_col)).distinct().withColumn("_landed", F.lit(True))
    return links.join(pages, url_col, "left").withColumn(
        "landed", F.coalesce(F.col("_landed"), F.lit(False))).drop("_landed")


def to_land(links: DataFrame, landed: DataFrame, url_col: str = "url") -> DataFrame:
    """Links whose target is not landed yet (anti join): the next
    crawl level's inputs."""
    return links.join(landed.select(F.col(url_col)).distinct(), url_col, "left_anti")


def link_edges(links: DataFrame, pages: DataFrame) -> DataFrame:
    """The link graph of landed pages: (src, dst) page ids, each pair once, of ``links(page_id, url, href)`` resolved
    against the page's URL without fragments. A URL that was landed several times is the page that was landed first."""
    first = pages.groupBy("url").agg(F.min(PID).alias("dst"))
    to = links.select(F.col(PID).alias("src"), drop_fragment(resolve_url("url", "href")).alias("url"))
    return to.distinct().join(first, "url").select("src", "dst").distinct()


#: Levels whose pages are kept as tables of their own before they are written as one.
_LEVELS = 16


def crawl_levels(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """L11 to a fixed point: (page_id, level, parent) of all pages that can be reached from ``seeds(page_id)`` along
    ``edges(src, dst)``: the level at which a page is found first, and the least page of the level before that links to it.

    Each round joins the newest level with the edges, reduces what is found to one row a page before the shuffle, and
    leaves out the pages of earlier levels by an anti join; cycles end there. The levels needn't be known; ``most`` bounds them.
    A level is written to the shared folder, so a round starts from tables and not from the rounds before.
    """
    e = staged(edges.where("src != dst"), "crawl-edges")
    level = staged(seeds.select(PID).distinct().select(PID, F.lit(0).alias("level"), F.lit(None).cast("long").alias("parent")), "crawl-level")
    seen, k, n = [level], 0, level.count()
    while n and (most is None or k < most):
        k += 1
        found = e.join(_small(level.select(F.col(PID).alias("src")), n), "src").groupBy(F.col("dst").alias(PID)).agg(F.min("src").alias("parent"))
        before = _union(seen).select(PID)
        level = staged(found.join(before, PID, "left_anti").select(PID, F.lit(k).alias("level"), "parent"), "crawl-level")
        n = level.count()
        seen.append(level)
        if len(seen) > _LEVELS:
            seen = [staged(_union(seen), "crawl-seen")]
    return _union(seen)


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= LOOKUP_ROWS else df


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out
