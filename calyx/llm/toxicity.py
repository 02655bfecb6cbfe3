"""Toxicity after noisy-channel deobfuscation (operator 10).

Disguised words are restored first. A token with digits or signs between letters, with a letter
three or more times in a row, or spelled out with gaps becomes a lattice: each sign may stand for itself, for the
letters it looks like, or for nothing; a repeated letter may be left out. Viterbi finds the path that is most likely
under the channel and a character trigram model of the plain words of all texts. Plain words are taken as they are. A token of over
``LONG`` characters is several words joined: it is split at signs that stand for no letter, single letters between such
signs are put together again, and what is still longer is restored in overlapping stretches of ``LONG`` characters.

The restored text is scored by a logistic regression over its distinct words and their first four and
five letters. Features and weights are learned from at most ``LABELLED`` labelled training rows, those first in
the order of a hash of the id. Features are those most often in toxic rows by log odds, ``FEATURES`` at most.

Null and empty texts get the score of a text without any feature. Rows without a label are scored like
all others. Without labelled rows of both kinds every score is the share of toxic ones (0 when none). Repeated labels
of one doc_id count as toxic if one is. Other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calyx.llm.common import bucket_of, stage

#: Bounds of the sample that the classifier is fitted on, and of its features.
LABELLED, FEATURES = 40000, 4000
#: Rows of the sample that a feature must be in.
LEAST = 8
#: Signs and the letters they look like (fixed values).
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
         "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i"}
GAPS = " .-_*~'"
#: Log probabilities of the channel: a letter as it is, a look-alike, a sign or gap left out, a repeated letter left out.
SAME, LOOK, NONE, AGAIN = 0.0, math.log(0.3), math.log(0.1), math.log(0.5)
LETTERS = "abcdefghijklmnopqrstuvwxyz"
EDGE, OTHER = "^", "?"

SPELLED = re.compile(r"(?<!\S)[^\W_](?:[ .\-_*~][^\W_@$!|+]|[ .\-_*~][@$!|+]){2,}(?=[\s.,;:!?]|\Z)")
PLAIN = re.compile(r"[^\W\d_]+")
TRIPLE = re.compile(r"(.)\1\1")
#: Characters of a lattice, and of the step from one stretch of a longer token to the next.
LONG, STEP = 64, 32
#: Words joined in a token: letters, digits, signs that look like letters or are put inside words.
JOINED = re.compile(r"(?:[^\W_]|[@$!|+(<€£¡*~'])+")
ENDS = ".,;:?!\"()[]{}<>|"


class CharModel:
    """A trigram model over a-z, word edges and any other letter."""

    def __init__(self, counts: dict[str, int]):
        pair: Counter = Counter()
        for k, n in counts.items():
            pair[k[:2]] += n
        self.size = len(LETTERS) + 2
        self.tri, self.pair = dict(counts), dict(pair)

    def log(self, two: str, c: str) -> float:
        return math.log((self.tri.get(two + c, 0) + 0.1) / (self.pair.get(two, 0) + 0.1 * self.size))


def kind(c: str) -> str:
    return c if c in LETTERS else OTHER


def trigrams(word: str) -> list[str]:
    s = EDGE * 2 + "".join(map(kind, word)) + EDGE
    return [s[k:k + 3] for k in range(len(s) - 2)]


def restore(token: str, model: CharModel) -> str:
    """The most likely plain word behind a token, by Viterbi over its lattice."""
    best = {(EDGE * 2, ""): (0.0, "")}  # (last two letters, last letter written) -> (score, word)
    for c in token:
        new: dict = {}

        def put(key, value, word, new=new):
            old = new.get(key)
            if old is None or value > old[0] or (value == old[0] and word < old[1]):
                new[key] = value, word

        ways = [(x, LOOK) for x in LOOKS.get(c, "")] + ([(c, SAME)] if c.isalpha() else [])
        for (two, last), (value, word) in best.items():
            for x, cost in ways:
                put(((two + kind(x))[-2:], x), value + cost + model.log(two, kind(x)), word + x)
                if x == last:  # the letter again, left out
                    put((two, last), value + cost + AGAIN, word)
            if not c.isalpha():
                put((two, last), value + NONE, word)
        best = new
    return min(((-(value + model.log(two, EDGE)), word) for (two, _), (value, word) in best.items()), default=(0, ""))[1]


def stretches(token: str) -> list[str]:
    """The parts of a long token that are restored each by itself, together all of it."""
    out, single = [], ""
    for part in [*JOINED.findall(token), ""]:
        if len(part) == 1:
            single += part
            continue
        out += [single, part]
        single = ""
    return [x[k:k + LONG] for x in out if x for k in range(0, max(1, len(x) - LONG + STEP), STEP)]


class Restorer:
    """Words of texts, with disguised ones restored; what was restored is remembered."""

    def __init__(self, counts: dict[str, int]):
        self.model, self.seen = CharModel(counts), {}

    def word(self, token: str) -> str:
        bare = token.strip(ENDS)
        if bare.isalpha() and not TRIPLE.search(bare):
            return bare
        if len(self.seen) > 1 << 18:
            self.seen.clear()
        if token not in self.seen:
            # digits and gaps alone hide no word
            hides = any(c.isalpha() for c in token) or sum(c in LOOKS for c in token) >= 3
            whole = restore(token, self.model) if hides else ""
            short = restore(bare, self.model) if hides and bare != token else whole
            self.seen[token] = whole, short
        return self.seen[token]

    def words(self, text: str | None) -> set[str]:
        """The distinct words of a restored text."""
        if not text:
            return set()
        low = text.lower()
        out: set[str] = set()
        for token in set(low.split()):
            bare = token.strip(ENDS)
            if len(token) > LONG and (TRIPLE.search(bare) or not bare.isalpha()):
                out.update(PLAIN.findall(token))
                for part in stretches(token):
                    got = self.word(part)
                    out.update((got,) if isinstance(got, str) else got)
                continue
            got = self.word(token)
            if isinstance(got, str):
                out.add(got)
            else:
                out.update(got)
                out.update(PLAIN.findall(token))
        for found in SPELLED.finditer(low):
            token = "".join(c for c in found[0] if c not in GAPS)
            out.add(restore(token, self.model))
        out.discard("")
        return out


def features(words: set[str]) -> set[str]:
    return words | {w[:5] + "-" for w in words if len(w) > 5} | {w[:4] + "-" for w in words if len(w) > 4}


def sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, text, toxic) of at most about ``most`` labelled training rows, the first by hash of the id."""
    train = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (bucket_of("doc_id", 5) != 0))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    n = train.count()
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    train = train.where(order < max(1, min(1 << 20, (most << 20) // max(n, 1))))
    # the sample's ids are few by its bound, so they go to the texts
    few = train.limit(2 * most + 1).count() <= 2 * most
    return docs.select("doc_id", "text").join(F.broadcast(train) if few else train, "doc_id")


def char_counts(rows: DataFrame) -> dict[str, int]:
    """Trigrams of the plain words of ``rows(text)``: at most 28 ** 3."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in parts:
            words: Counter = Counter()
            for t in b.column(0).to_pylist():
                words.update(w for w in set(t.lower().split()) if w.isalpha()) if t else None
            for w, n in words.items():
                for k in trigrams(w):
                    seen[k] += n
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], ["k", "n"])

    got = rows.select("text").mapInArrow(run, "k string, n long").groupBy("k").agg(F.sum("n").alias("n"))
    return {r.k: r.n for r in got.collect()}


def candidates(rows: DataFrame, chars: dict[str, int], most: int) -> list[str]:
    """The features of ``rows(text, toxic)`` that speak most for toxic texts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, n = Restorer(chars), (Counter(), Counter())
        for b in parts:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n[y > 0].update(features(r.words(t)))
        every = list({**n[0], **n[1]})
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([n[1][k] for k in every], pa.int64()),
                                          pa.array([n[0][k] for k in every], pa.int64())], ["f", "pos", "neg"])

    sums = rows.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") <= 0)).first()
    got = rows.select("text", "toxic").mapInArrow(run, "f string, pos long, neg long").groupBy("f").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (sums[0] + 1)) - F.log((F.col("neg") + 0.5) / (sums[1] + 1))
    got = got.where(F.col("pos") >= LEAST).withColumn("odds", odds).where("odds > 1")
    return [r.f for r in got.orderBy(F.desc(F.col("odds") * F.log("pos")), "f").limit(most).collect()]


def found_in(text: Column, chars: dict[str, int], wanted: list[str]) -> Column:
    """The places in ``wanted`` of the features of a text."""

    @F.pandas_udf("array<int>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        r, place = Restorer(chars), {f: k for k, f in enumerate(wanted)}
        for texts in parts:
            yield pd.Series([sorted(place[f] for f in features(r.words(t)) & place.keys()) for t in texts], dtype=object)

    return run(text)


def fit(rows: list[list[int]], y: np.ndarray, size: int, l2: float = 0.1, rounds: int = 500) -> np.ndarray:
    """Weights of a logistic regression, the constant last, by accelerated gradient steps."""
    n = np.array([len(r) for r in rows])
    doc, col = np.repeat(np.arange(len(rows)), n), np.array([k for r in rows for k in r], np.int64)
    # each feature's step from a bound of its curvature
    per_row = np.bincount(doc, minlength=len(rows)) + 1
    step = 1 / (np.append(np.bincount(col, per_row[doc], size), per_row.sum()) / 4 + l2)
    w = z = np.zeros(size + 1)
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z[-1] + np.bincount(doc, z[col], len(rows)), -30, 30)))
        g = np.append(np.bincount(col, (p - y)[doc], size) + l2 * z[:-1], (p - y).sum())
        new, more = z - step * g, (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / more * (new - w), new, more
    return w


def learn(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> tuple[dict[str, int], list[str], np.ndarray]:
    """(character counts, features, weights). The driver holds the bounded sample's feature numbers, no text."""
    rows = stage(sample(docs, labels, most), "toxic-sample")
    chars = char_counts(docs)
    wanted = candidates(rows, chars, FEATURES)
    got = rows.select("toxic", found_in(F.col("text"), chars, wanted).alias("f")).toPandas()
    y = (got.toxic.to_numpy() > 0).astype(float)
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.0, 1e-9), 1 - 1e-9)
        return chars, [], np.array([math.log(share / (1 - share))])
    return chars, wanted, fit([list(f) for f in got.f], y, len(wanted))


def score(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs(doc_id, text)``."""
    chars, wanted, weights = learn(docs, labels, most)

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        r, of = Restorer(chars), dict(zip(wanted, weights.tolist()))
        for texts in parts:
            total = [math.fsum(sorted(of[f] for f in features(r.words(t)) & of.keys())) + weights[-1] for t in texts]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(total, float), -30, 30))))

    out = docs.select("doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), run(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
