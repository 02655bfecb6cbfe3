"""Element tree and selectors in one ordered pass over a page's tokens (H2, H8).

A page is one row with its token array (``html.shred``). ``fold`` goes over the tokens once with the stack of open
elements, so no sort and no window is needed, and a page's nodes stay in its row until they are inlined. Selectors are
compiled to one automaton: every step is a bit, the bits that an element matches are carried down the stack
(descendant, child) and along siblings (adjacent), and for chosen selectors each node gets the positions of all
matched elements around it, so text and scoped selections are a plain explode and group.

The tree (deviations from the HTML standard's tree builder are stated here):

* void tags, self-closing tags, script and style blocks are leaves;
* a start tag ends what the standard lets it end: an open ``p`` (in its scope), the items of its list, cells, rows and row groups of
  its table, options, ``dt``/``dd``, a heading directly above it, an open ``a``;
* an end tag ends the nearest open element of its name and all above it; it doesn't reach out of a table cell, caption, button or
  object, and a tag of a table's structure not out of its table. An end tag without such an element is left out (also ``</p>``: no empty
  ``p`` is made);
* formatting elements (``b``, ``i``, ``a``, ``font``, ...) that were ended by something else are opened again before the next text or
  phrasing element where ``again`` asks for it, as copies of their start tag and rows of their own, at most three of one name. White space
  alone opens nothing. The end tag of a formatting element with a block between them ends the element when that block ends;
* nothing is moved out of tables, and no ``html``, ``head``, ``body`` or ``tbody`` is made up;
* elements still open at the end of the page end there.

``pos`` counts nodes; it is the token's place where no element was opened again.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..session import small_batches

# Fixed values (HTML standard): formatting elements; elements that bound the reach of an end tag; parts of a table; headings.
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
BOUNDS = frozenset("table td th caption template object applet marquee button html".split())
TABLE_PARTS = frozenset("table caption colgroup thead tbody tfoot tr td th".split())
CELLS = frozenset("td th caption button object applet marquee template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Codes of tokens: text, nothing (blank text, comment, declaration), start tag, leaf element, end tag.
TEXT, NOTHING, OPEN, LEAF, CLOSE = range(5)

_ROW = "src:int,end:int,level:int,parent:int,parent_tag:string,prev:int,hits:bigint"


class Frame:
    """An open element: the bits it matches, those of all elements down to it, and those of its last child."""

    __slots__ = ("tag", "pos", "own", "around", "last", "last_pos", "owners", "entry", "late")

    def __init__(self, tag, pos, own, around, owners, entry):
        self.tag, self.pos, self.own, self.around, self.owners, self.entry = tag, pos, own, around, owners, entry
        self.last, self.last_pos, self.late = 0, -1, False


class Automaton:
    """Steps of all selectors as bits: the bit of a step is one above that of the step before it."""

    def __init__(self, selectors: dict[str, list], scopes: list[str]):
        self.first = self.descendant = self.child = self.adjacent = 0
        self.last: dict[str, int] = {}
        self.steps: list[dict] = []
        for name, steps in selectors.items():
            for i, step in enumerate(steps):
                how, simple = step if isinstance(step, tuple) else (" ", step)
                bit = 1 << len(self.steps)
                kind = "first" if not i else {" ": "descendant", ">": "child", "+": "adjacent"}[how]
                setattr(self, kind, getattr(self, kind) | bit)
                self.steps.append(simple)
            self.last[name] = bit
        if len(self.steps) > 62:
            raise ValueError("selectors of one pass may have 62 steps together")
        self.scopes = [self.last[s] for s in scopes]

    def matched(self, simple: int, above: Frame) -> int:
        return simple & (self.first | (above.around << 1 & self.descendant) | (above.own << 1 & self.child) | (above.last << 1 & self.adjacent))


class Nodes:
    """Nodes as columns of machine numbers: 119 bytes a node of a page at most while it is folded (347 as a list for each node)."""

    def __init__(self):
        # -1: no such node
        self.src, self.end, self.level, self.parent, self.prev = (array("i") for _ in range(5))
        self.hits = array("q")
        self.parent_tag: list[str] = []
        self.owners: list[tuple] = []

    def __len__(self) -> int:
        return len(self.src)

    def extend(self, more: Nodes) -> None:
        for name, column in vars(more).items():
            getattr(self, name).extend(column)

    def arrow(self, scopes: list[str]) -> pa.StructArray:
        """The columns of ``_ROW`` and, for each scope, the positions of its elements."""
        def numbers(column: array) -> pa.Array:
            x = np.array(column, np.int32)
            return pa.array(x, mask=x < 0)

        columns = [*map(numbers, (self.src, self.end, self.level, self.parent)), pa.array(self.parent_tag, pa.string()), numbers(self.prev),
                   pa.array(np.array(self.hits, np.int64)), *(pa.array([o[k] for o in self.owners], pa.list_(pa.int32())) for k in range(len(scopes)))]
        return pa.StructArray.from_arrays(columns, [*(x.split(":")[0] for x in _ROW.split(",")), *(f"in_{s}" for s in scopes)])


class Page:
    """The nodes of one page, built token by token."""

    def __init__(self, auto: Automaton, rules: dict, again: bool):
        self.auto, self.rules, self.again = auto, rules, again
        self.nodes = Nodes()
        self.stack = [Frame("", -1, 0, 0, ((),) * len(auto.scopes), None)]
        self.active: list = []  # formatting elements: [tag, token, bits, is it open], None at a cell's start

    def add(self, src: int, hits: int = 0) -> int:
        top, nodes = self.stack[-1], self.nodes
        pos = len(nodes.src)
        nodes.src.append(src)
        nodes.end.append(pos)
        nodes.level.append(len(self.stack))
        nodes.parent.append(top.pos)
        nodes.parent_tag.append(top.tag)
        nodes.prev.append(top.last_pos)
        nodes.hits.append(hits)
        nodes.owners.append(top.owners)
        return pos

    def element(self, src: int, tag: str, bits: int, leaf: bool, entry=None) -> None:
        top = self.stack[-1]
        own = self.auto.matched(bits, top)
        pos = self.add(src, own)
        top.last, top.last_pos = own, pos
        if not leaf:
            owners = top.owners
            if own:
                owners = tuple(o + (pos,) if own & bit else o for o, bit in zip(owners, self.auto.scopes))
            self.stack.append(Frame(tag, pos, own, top.around | own, owners, entry))
            if tag in CELLS:
                self.active.append(None)

    def pop(self, upto: int) -> None:
        """End the open elements from ``upto`` on, and those below whose end tag was put off."""
        at = len(self.nodes)
        while len(self.stack) > upto or (len(self.stack) > 1 and self.stack[-1].late):
            f = self.stack.pop()
            self.nodes.end[f.pos] = at
            if f.entry is not None:
                f.entry[3] = False
            if f.tag in CELLS:
                while self.active and self.active.pop() is not None:
                    pass

    def find(self, tag: str, bounds: frozenset) -> int | None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                return i
            if self.stack[i].tag in bounds:
                return None
        return None

    def reopen(self) -> None:
        todo = []
        for e in reversed(self.active) if self.again else ():
            if e is None or e[3]:
                break
            todo.append(e)
        for e in reversed(todo):
            e[3] = True
            self.element(e[1], e[0], e[2], False, e)

    def make_way(self, tag: str) -> None:
        """End what a start tag ends."""
        if tag in self.rules["ends_p"] and (i := self.find("p", BOUNDS)) is not None:
            self.pop(i)
        for box, ended in self.rules["families"]:
            if tag in ended:
                least = None
                for i in range(len(self.stack) - 1, 0, -1):
                    t = self.stack[i].tag
                    if t in box:
                        break
                    if t in ended[tag]:
                        least = i
                if least is not None:
                    self.pop(least)
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.pop(len(self.stack) - 1)
        if tag == "a" and (e := self.formatting("a")) is not None:
            self.end_formatting(e)

    def formatting(self, tag: str):
        for e in reversed(self.active):
            if e is None:
                return None
            if e[0] == tag:
                return e
        return None

    def end_formatting(self, e: list) -> None:
        self.active = [x for x in self.active if x is not e]
        if not e[3]:
            return
        i = next(k for k in range(len(self.stack) - 1, 0, -1) if self.stack[k].entry is e)
        if any(f.tag in self.rules["blocks"] for f in self.stack[i + 1:]):
            self.stack[i].late, self.stack[i].entry = True, None
        else:
            self.pop(i)

    def open(self, src: int, tag: str, bits: int, leaf: bool) -> None:
        self.make_way(tag)
        if tag not in self.rules["blocks"]:
            self.reopen()
        entry = None
        if tag in FORMATTING and not leaf:
            mark = max((k for k, e in enumerate(self.active) if e is None), default=-1)
            same = [e for e in self.active[mark + 1:] if e[0] == tag]
            if len(same) > 2:
                self.active = [e for e in self.active if e is not same[0]]
            entry = [tag, src, bits, True]
            self.active.append(entry)
        self.element(src, tag, bits, leaf, entry)

    def close(self, tag: str) -> None:
        if tag in FORMATTING and (e := self.formatting(tag)) is not None:
            self.end_formatting(e)
            return
        i = self.find(tag, frozenset(("table",)) if tag in TABLE_PARTS else BOUNDS)
        if i is not None:
            self.pop(i)

    def read(self, codes: Iterable[int], tags: Iterable[str], bits: Iterable[int]) -> Nodes:
        for src, (code, tag, simple) in enumerate(zip(codes, tags, bits)):
            if code == OPEN or code == LEAF:
                self.open(src, tag, simple, code == LEAF)
                continue
            if code == CLOSE:
                self.close(tag)
            elif code == TEXT and self.active:
                self.reopen()
            self.add(src)
        self.pop(1)
        return self.nodes


#: Nodes that are held before they are handed on, a whole page at least; bytes of an Arrow batch of pages; tokens read at once.
NODES, BATCH_BYTES, TOKENS = 50_000, 16 << 20, 10_000


def fold(selectors: dict[str, list], scopes: list[str], rules: dict, again: bool) -> Callable:
    """The nodes of pages from the arrays of their tokens' codes, tags and matched steps.

    An Arrow batch may hold thousands of pages: they are taken out of it one by one, ``TOKENS`` tokens at a time, and their
    nodes go back to Spark whenever there are ``NODES``.
    """
    auto = Automaton(selectors, scopes)

    def listed(nodes: Nodes, ends: list) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), nodes.arrow(scopes))

    def values(column: pa.Array, at: int, n: int) -> Iterator:
        for k in range(at, at + n, TOKENS):
            yield from column.slice(k, min(TOKENS, at + n - k)).to_pylist()

    def nodes(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for *arrays, size in batches:
            flat = [x.flatten() for x in arrays]
            held, ends, at = Nodes(), [0], 0
            for n in size.to_pylist():
                held.extend(Page(auto, rules, again).read(*(values(x, at, n) for x in flat)))
                at += n
                ends.append(len(held))
                if len(held) >= NODES:
                    yield listed(held, ends)
                    held, ends = Nodes(), [0]
            if len(ends) > 1:
                yield listed(held, ends)

    kind = ",".join([_ROW, *(f"in_{s}:array<int>" for s in scopes)])
    return arrow_udf(nodes, f"array<struct<{kind}>>")


def folded(pages: DataFrame, selectors: dict[str, list], scopes: list[str], rules: dict, matches: Callable[[dict, Column, Column], Column],
           again: bool) -> DataFrame:
    """``pages(page_id, toks, kinds, tags, codes, ...)`` with the array of their ``nodes``.

    ``matches(simple, token, tag)`` says whether a start tag matches one step of a selector.
    """
    small_batches(pages.sparkSession, BATCH_BYTES)
    steps = Automaton(selectors, scopes).steps
    none = F.lit(0).cast("long")

    def bits(tok, i):
        out = none
        for k, simple in enumerate(steps):
            out = out + F.when(matches(simple, tok, F.get("tags", i)), F.lit(1 << k).cast("long")).otherwise(none)
        return F.when(F.get("codes", i).isin(OPEN, LEAF), out).otherwise(none)

    # ``bits`` is used twice, so that Spark keeps it as a column: it would else be worked out inside the call's arguments
    t = pages.withColumn("bits", F.transform("toks", bits) if steps else F.array_repeat(none, F.size("toks")))
    t = t.withColumn("nodes", fold(selectors, scopes, rules, again)("codes", "tags", "bits", F.size("bits")))
    return t.drop("bits", "codes", "html")


def nodes_of(pages: DataFrame, selectors: dict[str, list], scopes: list[str], keep: list[str]) -> DataFrame:
    """The node table of ``folded`` pages: a row for each node, with its token."""
    # outer: from a plain explode Spark infers a filter on the size of ``nodes``, and would fold the pages once more for it
    t = pages.select("page_id", *keep, "toks", "kinds", "tags", F.size("nodes").alias("n_tok"), F.posexplode_outer("nodes").alias("pos", "x")).where("pos is not null")
    kind = F.get("kinds", F.col("x.src"))
    return t.select("page_id", "pos", "n_tok", F.get("toks", F.col("x.src")).alias("tok"), kind.alias("kind"), F.get("tags", F.col("x.src")).alias("tag"),
                    kind.isin("open", "raw").alias("is_elem"), F.col("x.end").alias("end"), F.col("x.level").alias("level"), F.col("x.parent").alias("parent"),
                    F.when(F.col("x.parent").isNotNull(), F.col("x.parent_tag")).alias("parent_tag"), F.col("x.prev").alias("prev"),
                    *(((F.col("x.hits").bitwiseAND(F.lit(b).cast("long"))) != 0).alias(n) for n, b in Automaton(selectors, scopes).last.items()),
                    *(F.col(f"x.in_{s}").alias(f"in_{s}") for s in scopes), *keep)
