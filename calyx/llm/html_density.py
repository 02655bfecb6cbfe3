"""Main text of web pages by composite text density (operator 2).

A page is parsed into a tree: tags with quoted attributes, void elements, raw text
elements, and the end tags that HTML lets authors leave out. Elements that never belong to an
article are cut off: head, script, style, forms, menus, sidebars, page headers and footers, and
containers whose class, id or role names an advert, a notice or reader comments - but for those that
hold an article or main element, and unless nothing else is left. Headings aren't cut by a name. In an article or main
element only whole classes, ids and roles count and, but for sections (whose ids are often made from headings), names that have a kind as first or last part, as
``site-footer``.

Each remaining block element gets the composite density (Sun, Song and Liao 2011)

    C / T * log(C / LC * T / LT, base ln(C / (C - LC) * LC + LCb / Cb * C + e))

of its characters C, tags T, characters LC and tags LT in links, and those of the body (b).
A node's density sum adds the densities of its children and, by its share of the characters, of its own direct text; the node
with the greatest sum holds the main text, and the least density on the path from it to the
body is the threshold. An article or main element around it is taken whole, with the articles beside it whose density reaches the threshold; otherwise
siblings along the path whose density reaches the threshold are added, and inside these, blocks other than
headings and paragraphs most of whose characters are links and whose density is under the threshold are left
out, as menus without a name are.

Text comes in page order, a line for each block; character references are decoded, white
space inside a block is one space. Null, empty and textless pages have ''. Repeated
rows are done each by itself; other columns are not looked at; an empty table gives
an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead tr ul".split())
#: Start tags that end an open paragraph.
ENDS_P = BLOCK - frozenset("body html caption dd dt legend li optgroup option tbody td tfoot th thead tr".split()) | {"dd", "dt", "li"}
#: Start tag -> open elements it ends, and the containers beyond which it doesn't look.
_ROWS, _TABLE = frozenset(["td", "th"]), frozenset(["table"])
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "td": (_ROWS, _TABLE | {"tr"}), "th": (_ROWS, _TABLE | {"tr"}),
    "tr": (_ROWS | {"tr", "caption"}, _TABLE), "tbody": (_ROWS | {"tr", "thead", "tbody", "tfoot", "caption"}, _TABLE),
    "tfoot": (_ROWS | {"tr", "thead", "tbody", "tfoot"}, _TABLE), "thead": (_ROWS | {"tr", "thead", "tbody", "caption"}, _TABLE),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
}
#: An end tag of an inline element doesn't reach beyond these.
SCOPE = BLOCK - {"p"}

#: Elements without text of their own to read.
CUT = frozenset("head script style noscript template iframe object embed applet canvas svg math audio video select textarea button "
                "input label title xmp noembed noframes datalist".split())
#: Elements beside the article, unless the article is inside them.
BESIDE = frozenset("form fieldset nav aside menu dialog search footer".split())
#: Words of class, id or role that name something else than the article.
OTHER = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adsbygoogle adslot adbox adunit adbanner banner banners "
    "sponsor sponsors sponsored promo promos promoted promotion outbrain taboola "
    "nav navbar navigation sidenav topnav mainnav menu menus menubar breadcrumb breadcrumbs sidebar sidebars aside widget widgets "
    "toolbar footer footers masthead "
    "cookie cookies cookiebar cookiebanner cookieconsent consent gdpr notice notices notification notifications announcement alert alerts "
    "popup modal overlay newsletter subscribe subscription signup login paywall "
    "comment comments commentlist commentform disqus respond replies reply "
    "share sharing social related recommended recommendations pagination pager skip "
    "contentinfo complementary search form".split())
#: The same for what stands outside of any article.
OTHER_OUTSIDE = frozenset("header headers topbar".split())
#: Whole classes and ids that name the same kinds inside an article, and of an article itself.
INSIDE = frozenset(
    "ad ads advert adverts advertisement advertisements adsense adsbygoogle ad-slot adslot ad-box adbox ad-unit adunit ad-banner adbanner "
    "ad-container ad-wrapper sponsored outbrain taboola banner banners newsletter newsletters "
    "nav navbar menu menus breadcrumb breadcrumbs share-buttons sharing-buttons social-buttons social-share sidebar sidebars footer masthead site-header "
    "notice notices cookie-notice cookie-bar cookiebar cookie-banner cookiebanner cookie-consent cookieconsent gdpr-notice "
    "comment comments comment-list commentlist comment-form commentform comments-section comments-area comment-section "
    "disqus disqus-thread".split())
#: The same as the first or last part of a name with hyphens: site-footer, menu-main, newsletter-signup.
FIRST = frozenset("nav navbar menu sidebar footer advert advertisement newsletter banner breadcrumb cookie".split())
LAST = FIRST | {"ad", "ads", "adverts", "notice", "menus", "comments", "breadcrumbs"}
#: Whole roles of the same kinds inside an article.
ROLES = frozenset("navigation menu menubar complementary search form contentinfo alert alertdialog dialog".split())
OTHER_ARTICLE = INSIDE | {"promo", "reply", "replies"}
#: Elements that no name cuts, anywhere and inside an article.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTS = HEADINGS | {"p"}

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>", re.S)
MARKS = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|[\s\"'/])(?:hidden(?![\w-])|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
PIECE = re.compile(r"[A-Za-z]+")


def named(attrs: str) -> set[str]:
    """The words in class, id and role."""
    return {p.lower() for found in MARKS.finditer(attrs)
            for p in PIECE.findall(CAMEL.sub(" ", found[2] or found[3] or found[4] or ""))}


def kinds(attrs: str, names: frozenset[str] = INSIDE, parts: bool = False) -> bool:
    """Whether a whole class, id or role is one of ``names`` or ROLES, or with ``parts`` has such a kind as its first or last part."""
    for found in MARKS.finditer(attrs):
        whole = CAMEL.sub("-", found[2] or found[3] or found[4] or "").lower().replace("_", "-").split()
        if not (ROLES if found[1].lower() == "role" else names).isdisjoint(whole):
            return True
        for name in whole if parts else ():
            first, *rest = name.split("-")
            if rest and (first in FIRST or rest[-1] in LAST):
                return True
    return False


class Tree:
    """The elements of a page in page order, and its pieces of text.

    Node 0 is the page. ``beside`` tells what seems to be something else than the article. ``parts``
    holds (node, text, in a link) and (node, None, False) for the start or end of a block."""

    def __init__(self, page: str):
        self.tag, self.parent, self.beside, self.parts = ["html"], [0], [False], []
        stack: list[tuple[str, int]] = [("html", 0)]  # (tag, node), -1 for what is cut off
        at, links = 0, 0
        for m in TOKEN.finditer(page):
            if m.start() < at:  # inside raw text
                continue
            if m.start() > at:
                self.text(stack, page[at:m.start()], links)
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                links -= self.close(stack, name)
                continue
            links -= self.implied(stack, name)
            node = self.open(stack, name, m[3])
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
                inner, at = (page[at:end.start()], end.end()) if end else (page[at:], len(page))
                if node >= 0:
                    self.text([(name, node)], inner, links)
            elif name not in VOID:
                stack.append((name, node))
                links += name == "a"
            elif name == "br" and node >= 0:
                self.parts.append((node, " ", links > 0))
        if at < len(page):
            self.text(stack, page[at:], links)

    def text(self, stack, raw, links):
        if stack[-1][1] >= 0:
            self.parts.append((stack[-1][1], html.unescape(raw) if "&" in raw else raw, links > 0))

    def open(self, stack, name, attrs) -> int:
        up = stack[-1][1]
        if up < 0 or name in CUT:
            return -1
        if name == "html" or name == "body" and (up or "body" in self.tag[:3]):
            return up
        inside = any(t in ("article", "main") for t, _ in stack)
        beside = name in BESIDE or name == "header" and not inside
        if attrs and not beside and name not in ("body", "main"):
            beside = bool(HIDDEN.search(attrs))
            if name == "article":
                beside |= kinds(attrs, OTHER_ARTICLE)
            elif inside:  # ids of sections are often made from headings: only whole ones count there
                beside |= name not in HEADINGS and kinds(attrs, parts=name != "section")
            elif name not in HEADINGS:
                words = named(attrs)
                beside |= not words.isdisjoint(OTHER) or not words.isdisjoint(OTHER_OUTSIDE)
        self.tag.append(name)
        self.parent.append(up)
        self.beside.append(beside)
        node = len(self.tag) - 1
        if name in BLOCK:
            self.parts.append((node, None, False))
        return node

    def pop(self, stack, k) -> int:
        """Close the elements from place ``k`` of the stack on; how many were links."""
        links = 0
        for name, node in reversed(stack[k:]):
            links += name == "a"
            if node >= 0 and name in BLOCK:
                self.parts.append((self.parent[node], None, False))
        del stack[k:]
        return links

    def close(self, stack, name) -> int:
        if name in ("html", "body"):
            return 0
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == name:
                return self.pop(stack, k)
            if name not in BLOCK and stack[k][0] in SCOPE:
                return 0
            if name in BLOCK and stack[k][0] in ("article", "main", "body") and name in ("p", "li", "dd", "dt", "td", "th", "tr"):
                return 0
        return 0

    def implied(self, stack, name) -> int:
        links = 0
        if name in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    links += self.pop(stack, k)
                    break
                if stack[k][0] in SCOPE:
                    break
        if name == "a":
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "a":
                    return links + self.pop(stack, k)
                if stack[k][0] in SCOPE:
                    break
        if name in ENDS:
            ended, beyond = ENDS[name]
            last = None
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ended:
                    last = k
                elif stack[k][0] in beyond:
                    break
            if last is not None:
                links += self.pop(stack, last)
        return links


def composite(c, t, lc, lt, body_ratio) -> float:
    """The composite text density; counts of zero stand as one."""
    if not c:
        return 0.0
    t, lt, rest, link = max(t, 1), max(lt, 1), max(c - lc, 1), max(lc, 1)
    base = math.log(c / rest * lc + body_ratio * c + math.e)
    value = c / link * t / lt
    return max(0.0, c / t * math.log(max(value, 1.0)) / max(base, 1e-9)) if value > 1 else 0.0


def main_text(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    tree = Tree(page)
    size = len(tree.tag)
    holds = [t in ("article", "main") for t in tree.tag]  # an article inside
    for k in range(size - 1, 0, -1):
        holds[tree.parent[k]] |= holds[k] and not (tree.beside[k] and tree.tag[k] == "article")
    cut = [False] * size
    for k in range(1, size):
        own = tree.beside[k] and (not holds[k] or tree.tag[k] == "article")
        cut[k] = own or cut[tree.parent[k]]
    # a page of nothing but such elements has its text in them
    return densest(tree, cut) or densest(tree, [False] * size)


def densest(tree: Tree, cut: list[bool]) -> str:
    """The text of the subtree with the greatest density sum, without the nodes that are ``cut``."""
    size = len(tree.tag)
    chars, tags, lchars, ltags, direct = [0] * size, [0] * size, [0] * size, [0] * size, [0] * size
    holder = [0] * size  # the nearest block around a node
    for k in range(1, size):
        holder[k] = k if tree.tag[k] in BLOCK else holder[tree.parent[k]]
    for node, text, link in tree.parts:
        if text and not cut[node]:
            n = len(" ".join(text.split()))
            chars[node] += n
            direct[holder[node]] += n
            if link:
                lchars[node] += n
    for k in range(size - 1, 0, -1):
        if not cut[k]:
            up = tree.parent[k]
            chars[up] += chars[k]
            lchars[up] += lchars[k]
            tags[up] += tags[k] + 1
            ltags[up] += ltags[k] + (tree.tag[k] == "a")
    if not chars[0]:
        return ""
    ratio = lchars[0] / chars[0]
    density = [0.0 if cut[k] else composite(chars[k], tags[k], lchars[k], ltags[k], ratio) for k in range(size)]
    total = [0.0] * size
    for k in range(size - 1, -1, -1):
        if holder[k] == k:
            total[k] += density[k] * direct[k] / max(chars[k], 1)
            if k:
                total[holder[tree.parent[k]]] += density[k]
    best = max((k for k in range(size) if holder[k] == k and not cut[k]), key=lambda k: (total[k], -k))
    path = [best]
    while path[-1]:
        path.append(holder[tree.parent[path[-1]]])
    limit = min(density[k] for k in path)
    around = [k for k in path if tree.tag[k] in ("article", "main")]
    keep = [False] * size
    if around:
        keep[around[-1]] = True
        for k in range(1, size):  # articles beside it that go on with it
            if tree.tag[k] == "article" and tree.parent[k] == tree.parent[around[-1]] and tree.tag[around[-1]] == "article":
                keep[k] = keep[k] or density[k] >= limit and not cut[k]
    else:
        keep[best] = True
        on_path = set(path)
        for k in range(1, size):
            if holder[k] == k and k not in on_path and holder[tree.parent[k]] in on_path and holder[tree.parent[k]] != best:
                keep[k] = density[k] >= limit and 2 * lchars[k] < chars[k]
    whole = list(keep)
    for k in range(1, size):
        whole[k] = (whole[k] or whole[tree.parent[k]]) and not cut[k]
        keep[k] = (keep[k] or keep[tree.parent[k]]) and not cut[k]
        if keep[k] and not around and tree.tag[k] not in TEXTS and holder[k] == k and 2 * lchars[k] > chars[k] and density[k] < limit:
            keep[k] = False
    if not any(text and text.strip() and keep[node] for node, text, _ in tree.parts):
        keep = whole  # a page of links
    lines, line = [], []
    for node, text, _ in tree.parts:
        if text is None:
            if line:
                lines.append(" ".join("".join(line).split()))
                line = []
        elif keep[node]:
            line.append(text)
    if line:
        lines.append(" ".join("".join(line).split()))
    return "\n".join(x for x in lines if x)


def extract(page: Column) -> Column:
    """The main text of a column of pages; '' for null."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in parts:
            yield pages.map(main_text).astype(object) if len(pages) else pd.Series([], dtype=object)

    return run(F.coalesce(page, F.lit("")))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages(page_id, url, html)``."""
    return (pages.select("page_id", "url", extract(F.col("html")).alias("text"))
            .select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars")))
