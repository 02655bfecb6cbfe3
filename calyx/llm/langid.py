"""Language identification by rank-order n-gram profiles (operator 3).

A profile is the list of a language's ``size`` most frequent character
n-grams (one to three letters inside words, with word boundaries), counted over
every training text. A text's own most frequent n-grams are compared with each
profile by out-of-place distance: the sum of rank differences, with ``size`` for
an n-gram that the profile lacks. The nearest language wins, the first in
alphabetical order among equals.

score = 1 - distance / (largest possible distance): 1 for the same ranking, 0
when no n-gram is in the profile. A null text, a text without a letter, and any
text when nothing was learned are ``und`` with score 0. Equal counts are ranked
by n-gram code, so the result doesn't depend on how rows are dealt out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calyx.llm.common import bucket_of

#: n-grams of a profile and of a text.
SIZE = 400
#: A profile table larger than this is refused rather than sent to every task.
MAX_LANGS = 2000
UNKNOWN = "und"
#: Distinct n-grams of a language that a task holds before it passes counts on.
HELD = 1 << 20

#: Characters that ``\w`` takes for a word's, and ``\d`` not for digits, though they are numbers: fractions, superscripts, Roman numerals.
_NUMBERS = frozenset(c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_OTHER = re.compile(r"[\W\d_]+")


def lowered(text: str) -> str:
    """A text in lower case, with such numbers as spaces; few texts hold any."""
    low = text.lower()
    if not low.isascii() and not _NUMBERS.isdisjoint(low):
        low = "".join(" " if c in _NUMBERS else c for c in low)
    return low


def ngrams(text: str) -> np.ndarray:
    """Codes of all n-grams of the words of a text, with repeats: up to three
    code points of 21 bits each; a space stands for a word's edge."""
    s = " " + _OTHER.sub(" ", lowered(text)).strip() + " "
    if len(s) < 3:
        return np.empty(0, np.int64)
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    inner = c != 32
    two = c[:-1] | c[1:] << 21
    three = two[:-1] | c[2:] << 42
    return np.concatenate([c[inner], two, three[inner[1:-1]]])


def top(codes: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes, most frequent first."""
    keys, n = np.unique(codes, return_counts=True)
    if len(n) > size:
        least = np.partition(n, len(n) - size)[len(n) - size]
        keep = n >= least
        keys, n = keys[keep], n[keep]
    return keys[np.argsort(-n, kind="stable")[:size]]


def ngram_counts(train: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n) over whole training texts; each task sums its own first."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows(lang):
            keys, n = held.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)],
                                              ["lang", "gram", "n"])

        def add(lang, found):
            keys, n = np.unique(np.concatenate(found), return_counts=True)
            if lang in held:
                keys, at = np.unique(np.concatenate([held[lang][0], keys]), return_inverse=True)
                n = np.bincount(at, np.concatenate([held[lang][1], n])).astype(np.int64)
            held[lang] = keys, n

        for b in parts:
            texts: dict[str, list] = {}
            size: dict[str, int] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                texts.setdefault(lang, []).append(ngrams(text))
                size[lang] = size.get(lang, 0) + len(texts[lang][-1])
                if size[lang] > 4 * HELD:
                    add(lang, texts.pop(lang))
                    size[lang] = 0
                    if len(held[lang][0]) > HELD:
                        yield rows(lang)
            for lang, found in texts.items():
                add(lang, found)
                if len(held[lang][0]) > HELD:
                    yield rows(lang)
        for lang in list(held):
            yield rows(lang)

    found = (train.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
             .where("text is not null and lang is not null").mapInArrow(count, "lang string, gram long, n long"))
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(train: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = SIZE) -> dict[str, list[int]]:
    """The profile of each language: ``size`` n-gram codes, in order of rank.
    At most MAX_LANGS * size codes come to the driver."""
    by = Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("gram"))
    ranked = ngram_counts(train, text_col, lang_col).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= size)
    found = (ranked.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "gram"))).alias("grams"))
             .orderBy("lang").limit(MAX_LANGS + 1).collect())
    if len(found) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages to learn")
    return {r.lang: [g.gram for g in r.grams] for r in found}


class Profiles:
    """All profiles as one matrix of ranks: a row per n-gram, a column per language."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.langs, self.size = sorted(profiles), size
        self.codes = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.rank = np.full((len(self.codes), len(self.langs)), size, np.int64)
        for k, lang in enumerate(self.langs):
            p = np.array(profiles[lang], np.int64)
            self.rank[np.searchsorted(self.codes, p), k] = np.arange(len(p))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = top(ngrams(text), self.size) if text else np.empty(0, np.int64)
        if not len(own) or not self.langs or not len(self.codes):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        known = self.codes[at] == own
        place = np.arange(len(own))[known, None]
        ranks = self.rank[at[known]]
        far = np.where(ranks < self.size, np.abs(ranks - place), self.size).sum(0) + self.size * int((~known).sum())
        best = int(far.argmin())
        return self.langs[best], 1.0 - float(far[best]) / (self.size * len(own))


def predict(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", size: int = SIZE) -> DataFrame:
    """All columns of ``docs`` (but for those of the same name), with lang_pred and score."""
    p = Profiles(profiles, size)

    @F.pandas_udf("lang_pred string, score double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame([p.predict(t) for t in texts], columns=["lang_pred", "score"])

    out = docs.withColumn("_pred", score(F.col(text_col)))
    return out.withColumns({"lang_pred": F.col("_pred.lang_pred"), "score": F.col("_pred.score")}).drop("_pred")


def held_out(doc_id: str = "doc_id") -> Column:
    return bucket_of(doc_id, 3) == 1


def identify(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learn from the rows that aren't held out, predict all."""
    profiles = learn(docs.where(~held_out()), size=size)
    return (predict(docs.select("doc_id", "text"), profiles, size=size)
            .select("doc_id", held_out().alias("held_out"), "lang_pred", "score"))


def keep_identified(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of ``docs`` with a language: those that are ``und`` or share no
    n-gram with any profile go. Columns are those of ``docs``."""
    profiles = learn(docs.where(~held_out()), size=size)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    found = predict(docs.select(*names), profiles, size=size).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") > 0))
    return found.select(*names)
