"""Benchmark decontamination by CGK embedding and bit-sampling LSH (operator 6).

A text leaks a benchmark item when some stretch of its words is within edit distance
``RATE`` * (words of the item) of the item. Words are runs of letters and digits in lower case, so case,
punctuation and line breaks don't count as edits. An item without a word is in no text.

1. An item is a probe, or several of at most ``LONGEST`` words: of a longer item that is found, at
   least one piece has its share of the edits or fewer.
2. Windows of a probe's size start at every word of a text. By the q-gram lemma a stretch within k
   edits of n words has n - 1 - 2k of their word pairs; windows with fewer pairs of
   the benchmark can't match any item and are passed over.
3. The others are embedded by CGK: a walk reads one word a step and moves on or stays by a
   random bit of (step, word), which makes few edits few mismatches. A repetition samples ``BITS`` places
   of the walk; a window is a candidate for the probes with the same sample. The number of
   repetitions is, for each size of probes, the least that finds ``RECALL`` of them with the full number of
   random edits in them, measured once on the probes themselves (``TRIALS`` draws a size). Sizes of which
   ``MOST`` repetitions find less aren't sampled: a window is a candidate for each probe of which it has as many
   word pairs as a match has at least, so that none is lost.
4. Candidates are verified by the exact edit distance to the best stretch around the window.

The benchmark is dealt into blocks of about ``ITEMS`` items, each sent to the tasks; all texts are
searched for each block. So what a task holds is bounded, and nothing is shuffled.

Null and empty texts leak nothing, nor do null items. Equal items are each reported, as are the rows of a null doc_id.
Repeated rows get equal results; an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calyx.llm.common import batches

RATE, RECALL = 0.2, 0.995
LONGEST, STEP = 256, 4
BITS, MOST = 2, 64
#: Probes with edits that the repetitions of each size are measured on.
TRIALS = 400
#: Texts that are searched at once.
ROWS = 2000
#: Items and characters of a block.
ITEMS, CHARS = 1000, 1 << 22

_WORDS = re.compile(r"[^\W_]+").findall
HITS = "array<struct<item_id:bigint,distance:int>>"


def words(text: str) -> list[str]:
    return _WORDS(text.lower())


def best_distance(item: np.ndarray, text: np.ndarray) -> int:
    """The least edit distance between ``item`` and any stretch of ``text`` (word ids)."""
    row = np.zeros(len(text) + 1, np.int64)
    step = np.arange(len(text) + 1)
    for k, w in enumerate(item):
        new = np.empty_like(row)
        new[0] = k + 1
        new[1:] = np.minimum(row[:-1] + (text != w), row[1:] + 1)
        row = np.minimum.accumulate(new - step) + step
    return int(row.min())


class Block:
    """The probes of some items, grouped by size, with their samples; ``repeats`` has the
    repetitions of each size where they are known from a block of the same items."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, recall: float = RECALL, seed: int = 1,
                 repeats: dict[int, int] | None = None):
        self.rate, self.vocab = rate, {}
        self.items = [(i, np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(t)], np.int64)) for i, t in items]
        self.items = [(i, w) for i, w in self.items if len(w)]
        self.probes = defaultdict(list)  # size -> (item, offset)
        for k, (_, w) in enumerate(self.items):
            for at in range(0, len(w), LONGEST):
                n = min(LONGEST, len(w) - at)
                self.probes[n // STEP * STEP if n >= STEP else n].append((k, at))
        v = len(self.vocab) + 1
        pairs = [w[:-1] * v + w[1:] for _, w in self.items]
        self.own = [np.unique(p) for p in pairs]
        self.pairs = np.unique(np.concatenate([*pairs, np.empty(0, np.int64)]))
        most = max(self.probes, default=1)
        rng = np.random.default_rng(seed)
        # the walk's bits for (repetition, 64 steps, word); the sampled places as parts of the walk
        self.bits = rng.integers(0, 1 << 63, (MOST, self.steps(most) // 64 + 1, v), np.uint64) * np.uint64(2) + rng.integers(
            0, 2, (MOST, self.steps(most) // 64 + 1, v), np.uint64)
        self.places = np.sort(rng.random((MOST, BITS)), 1)
        # of each size: the word pairs that a match has at least, and the words among which
        self.windows = {}
        for n, probes in self.probes.items():
            k = self.edits(max(min(LONGEST, len(self.items[i][1]) - o) for i, o in probes))
            self.windows[n] = n - 1 - 2 * k, n + k
        self.at_pair = {}
        self.need = min((need for need, _ in self.windows.values()), default=0)
        self.span = max((span for _, span in self.windows.values()), default=1)
        self.repeats = self.enough(rng, recall) if repeats is None else repeats
        self.samples = {n: [] for n in self.probes}
        for n, probes in self.probes.items():
            if not self.repeats[n] and self.windows[n][0] > 0:
                self.at_pair[n] = [self.by_pair(probes[k:k + 64]) for k in range(0, len(probes), 64)]
        for n, probes in self.probes.items():
            ids = np.concatenate([np.append(w, np.zeros(2 * LONGEST, np.int64)) for _, w in self.items])
            first = np.cumsum([0] + [len(w) + 2 * LONGEST for _, w in self.items])
            at = np.array([first[k] + o for k, o in probes])
            for r in range(self.repeats[n]):
                found = defaultdict(list)
                for key, probe in zip(self.sample(ids, at, n, r).tolist(), probes):
                    found[key].append(probe)
                self.samples[n].append((np.array(sorted(found), np.int64), [found[key] for key in sorted(found)]))

    @staticmethod
    def steps(n: int) -> int:
        return n + n // 2

    def edits(self, n: int) -> int:
        return int(self.rate * n + 1e-9)

    def sample(self, ids: np.ndarray, at: np.ndarray, n: int, r: int) -> np.ndarray:
        """The sampled words of walk ``r`` from each place ``at``, as one number."""
        places = (self.places[r] * self.steps(n)).astype(int).tolist()
        at, last, out = at.copy(), len(ids) - 1, np.zeros(len(at), np.int64)
        for j in range(places[-1] + 1):
            w = ids[np.minimum(at, last)]
            for _ in range(places.count(j)):
                out = out * (len(self.vocab) + 1) + w
            at += ((self.bits[r, j >> 6][w] >> np.uint64(j & 63)) & np.uint64(1)).astype(np.int64)
        return out

    def by_pair(self, probes: list[tuple[int, int]]):
        """Some probes, and by the number of a word pair: the first place of its probes in a list, how many, and that list."""
        v, own = len(self.vocab) + 1, []
        for k, o in probes:
            w = self.items[k][1][o:o + LONGEST]
            own.append(np.searchsorted(self.pairs, np.unique(w[:-1] * v + w[1:])))
        pair, probe = np.concatenate(own), np.repeat(np.arange(len(own)), list(map(len, own)))
        many = np.bincount(pair, minlength=len(self.pairs))
        return probes, np.cumsum(many) - many, many, probe[np.argsort(pair, kind="stable")]

    def sharing(self, n: int, at: np.ndarray, number: np.ndarray) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
        """The probes of size ``n`` with the places from which on a window has the word pairs that a match has at
        least; ``at`` are the windows that have so many of any probes, ``number`` the word pair of each place or -1."""
        need, span = self.windows[n]
        if need <= 0:
            yield from ((probe, at) for probe in self.probes[n])
            return
        inside = np.zeros(len(number) + 1, np.int64)
        inside[at] += 1
        np.subtract.at(inside, np.minimum(at + span, len(number)), 1)
        where = np.flatnonzero((np.cumsum(inside[:-1]) > 0) & (number >= 0))
        for probes, first, many, listed in self.at_pair[n]:
            times = many[number[where]]
            place = np.repeat(where, times)
            step = np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)
            probe = listed[np.repeat(first[number[where]], times) + step]
            order = np.argsort(probe, kind="stable")
            place, probe = place[order], probe[order]
            a, b = slice(0, max(0, len(place) - need + 1)), slice(need - 1, None)
            good = np.flatnonzero((probe[a] == probe[b]) & (place[b] - place[a] < span))
            for k in np.unique(probe[good]).tolist():
                yield probes[k], place[good[probe[good] == k]]

    def enough(self, rng, recall: float) -> dict[int, int]:
        """Of each size, the least repetitions that find ``recall`` of its probes with all allowed edits in them;
        0 where ``MOST`` don't."""
        out = {}
        for n, probes in sorted(self.probes.items()):
            order = rng.permutation(len(probes))
            own, changed = [], []
            for t in range(TRIALS):
                k, o = probes[order[t % len(order)]]
                w = self.items[k][1][o:o + LONGEST].tolist()
                own.append(np.pad(w, (0, 2 * LONGEST - len(w))))
                for _ in range(self.edits(len(w))):
                    p, kind = int(rng.integers(0, len(w))), int(rng.integers(0, 3))
                    w[p:p + (kind > 0)] = [0] * (kind < 2)  # add, replace, remove
                    w = w or [0]
                changed.append(np.pad(w[:2 * LONGEST], (0, max(0, 2 * LONGEST - len(w)))))
            own, changed, at = np.concatenate(own), np.concatenate(changed), np.arange(TRIALS) * 2 * LONGEST
            found, out[n] = np.zeros(TRIALS, bool), 0
            for r in range(MOST):
                found |= self.sample(own, at, n, r) == self.sample(changed, at, n, r)
                if found.mean() >= recall:
                    out[n] = r + 1
                    break
        return out

    def search(self, texts: list[str | None]) -> list[list[tuple[int, int]]]:
        """(item_id, distance) of the items that each text leaks."""
        get = self.vocab.get
        found = [words(t) if t else [] for t in texts]
        docs = [np.fromiter(map(get, w, repeat(0)), np.int64, len(w)) for w in found]
        del found
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not self.items or not sum(map(len, docs)):
            return out
        gap = np.zeros(1, np.int64)
        ids = np.concatenate([x for d in docs for x in (d, gap)])
        first = np.cumsum([0] + [len(d) + 1 for d in docs])
        v = len(self.vocab) + 1
        both = (ids[:-1] > 0) & (ids[1:] > 0)
        number = np.full(len(ids), -1)  # of the word pair at each place
        if len(self.pairs):
            where = np.flatnonzero(both)
            code = ids[where] * v + ids[where + 1]
            some = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            number[where] = np.where(self.pairs[some] == code, some, -1)
        upto = np.concatenate([[0], np.cumsum(number >= 0)])
        known = np.concatenate([[0], np.cumsum(ids > 0)])

        def within(count, at, span):
            return count[np.minimum(at + span, len(ids))] - count[at]

        # places that could start a window of any size, then those of each size
        some = np.arange(len(ids))
        some = some[within(known, some, self.span) > 0]
        if self.need > 0:
            some = some[within(upto, some, self.span) >= self.need]
        edge = first.tolist()
        near = defaultdict(set)  # item -> (text of the window, where the item would start in it)

        def add(item, offset, starts):
            for start in starts:
                d = bisect_right(edge, start) - 1
                near[item].add((d, max(edge[d], start - offset)))

        for n, (need, span) in self.windows.items():
            at = some[within(upto, some, span) >= need] if need > 0 else some[within(known, some, span) > 0]
            if not len(at):
                continue
            for (item, offset), starts in self.sharing(n, at, number) if not self.repeats[n] else ():
                add(item, offset, starts.tolist())
            for r in range(self.repeats[n]):
                got = self.sample(ids, at, n, r)
                keys, probes_of = self.samples[n][r]
                p = np.minimum(np.searchsorted(keys, got), len(keys) - 1)
                for start, i in zip(*(x[keys[p] == got].tolist() for x in (at, p))):
                    for item, offset in probes_of[i]:
                        add(item, offset, (start,))
        for item, starts in near.items():
            item_id, w = self.items[item]
            k, mine, done = self.edits(len(w)), self.own[item], {}
            runs: list[list[int]] = []  # stretches of a text with candidate starts close to each other
            for d, s in sorted(starts):
                if runs and runs[-1][0] == d and s <= runs[-1][2] + len(w):
                    runs[-1][2] = s
                else:
                    runs.append([d, s, s])
            for d, low, high in runs:
                a, b = max(edge[d], low - 2 * k), min(edge[d + 1] - 1, high + len(w) + 2 * k)
                if d >= len(docs) or b <= a:
                    continue
                # a match has that many of the item's own word pairs
                code = ids[a:b - 1] * v + ids[a + 1:b]
                if len(mine) and (mine[np.minimum(np.searchsorted(mine, code), len(mine) - 1)] == code).sum() < len(w) - 1 - 2 * k:
                    continue
                far = best_distance(w, ids[a:b])
                if far <= k:
                    done[d] = min(far, done.get(d, far))
            for d, far in done.items():
                out[d].append((item_id, far))
        return [sorted(x) for x in out]


def blocks(benchmark: DataFrame, items: int = ITEMS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, one at a time."""
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    n, chars = b.agg(F.count("*"), F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()
    many = max(1, -(-n // items), -(-chars // CHARS))
    for k in range(many):
        some = b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == k)
        yield [tuple(r) for r in some.collect()]


def hits(text: Column, items: list[tuple[int, str]], rate: float = RATE, recall: float = RECALL) -> Column:
    """The items of one block that a text leaks."""
    repeats = Block(items, rate, recall).repeats

    @F.pandas_udf(HITS)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        block = Block(items, rate, recall, repeats=repeats)
        for texts in parts:
            found = []
            for at in range(0, len(texts), ROWS):
                found += block.search(list(texts[at:at + ROWS]))
            yield pd.Series([[{"item_id": i, "distance": d} for i, d in x] for x in found], dtype=object)

    return run(text)


def all_hits(text: Column, benchmark: DataFrame, rate: float = RATE, recall: float = RECALL) -> Column:
    found = [hits(text, b, rate, recall) for b in blocks(benchmark)]
    return F.concat(*found)


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, distance): a row for each text and each item that it leaks."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = []
    for items in blocks(benchmark):
        repeats = Block(items, rate).repeats

        def run(parts: Iterator[pa.RecordBatch], items=items, repeats=repeats) -> Iterator[pa.RecordBatch]:
            block = Block(items, rate, repeats=repeats)
            for b in batches(parts, ROWS):
                found = [(i, *x) for i, hit in zip(b.column(0).to_pylist(), block.search(b.column(1).to_pylist())) for x in hit]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found), (pa.int64(), pa.int64(), pa.int32()))],
                                                     ["doc_id", "item_id", "distance"])

        out.append(d.mapInArrow(run, "doc_id long, item_id long, distance int"))
    return reduce(DataFrame.union, out)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` that leak no item."""
    return docs.where(F.size(all_hits(F.col("text"), benchmark, rate)) == 0)
