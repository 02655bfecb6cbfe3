"""Hidden Markov language model over word classes (operator 9).

Tokens are words (lower-cased A-Z, between ASCII white space) and one end a text. A hidden state emits the
class of a token, the class emits the token:

    P(text) = P_HMM(classes of the tokens) * product of (c + 0.1) / (N_k + 0.1 * (V_k + 1))

with c the token's count, N_k all tokens and V_k the distinct ones of its class k in training. A word's class
is a hash of its last two bytes; the end is a class of its own. The base score is the same formula over
one class, without the HMM.

* Baum-Welch: every task runs scaled forward and backward recursions over its whole
  training texts and returns expected counts of starts, transitions and emissions; these sums, of
  fixed size, make the next model. Every round reads all training texts.
* Counts of tokens: each scan task sums its own distinct words; the sums meet by word, and each
  word's count goes back to the tasks' texts that use it. So a frequent word is a row for each task, and a task
  holds the words of its own split only.
* The score is exact: logarithms of the scale factors of the forward recursion add up to the
  log probability of the classes.

Words are counted by a 64-bit hash. Null and empty texts are one end token. A table without
training rows gives every token the same probability. Repeated rows are scored alike; an
empty table gives an empty result; other columns are not looked at. The input must give the same
partitions whenever it is computed, as a table of files does; pass ``stage(df)`` for others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calyx.llm.common import bucket_of, mix64, stage

STATES, CLASSES, ROUNDS = 8, 509, 4
ADD = 0.1
#: The key of the end token, and its class (after the word classes).
END, END_CLASS = 0, CLASSES
#: Bytes of texts, and places of a table of texts, that are worked on at once.
AT_ONCE, CELLS = 2 << 20, 1 << 19
#: Bytes of texts that a task gathers before it works on them.
HELD = 24 << 20
#: Of the words' keys; 5 modulo 8, so that its powers run through a quarter of all numbers.
BASE = 0x9E3779B97F4A7C15


def groups(texts: list[bytes], most: int) -> Iterator[list[int]]:
    """Indexes of texts, the longest first, in groups of about ``most`` bytes."""
    some, size = [], 0
    for i in sorted(range(len(texts)), key=lambda i: (-len(texts[i]), i)):
        if some and size + len(texts[i]) > most:
            yield some
            some, size = [], 0
        some.append(i)
        size += len(texts[i]) + 64
    if some:
        yield some


def encoded(column) -> list[bytes]:
    return [t.lower() if t else b"" for t in column.cast(pa.binary()).to_pylist()]


@cache
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``size`` powers of BASE modulo 2 ** 64, and of its inverse."""
    def series(x):
        out = np.full(size, np.uint64(x))
        out[0] = 1
        return np.multiply.accumulate(out)
    return series(BASE), series(pow(BASE, -1, 1 << 64))


def tokens_of(texts: list[bytes], keys: bool = True) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
    """Of the words of all texts, one after the other: 64-bit keys (a polynomial of the bytes, mixed)
    and classes; and the number of words of each text."""
    buf = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    ends = np.flatnonzero(~space[:-1] & space[1:])
    last, before = buf[ends].astype(np.int64), np.where(space[ends - 1], 0, buf[ends - 1]).astype(np.int64)
    stop = np.cumsum([len(t) + 1 for t in texts])
    n = np.diff(np.searchsorted(ends, stop, "right"), prepend=0)
    key = None
    if keys:
        up, down = powers(1 << max(20, int(len(buf) - 1).bit_length()))
        total = np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:len(buf)])  # before a word stands a space
        starts = np.flatnonzero(space[:-1] & ~space[1:])
        key = mix64((total[ends] - total[starts]) * down[starts + 1]).view(np.int64)
    return key, (last * 263 + before) % CLASSES, n


def keys_of(texts: list[bytes]) -> np.ndarray:
    """Keys of the words of all texts."""
    return tokens_of(texts)[0]


def classes_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the words of all texts, and the number of words of each text."""
    return tokens_of(texts, keys=False)[1:]


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # (S), (S, S), (S, CLASSES + 1)

    @staticmethod
    def from_counts(start, move, emit) -> Model:
        def share(x):
            x = x + ADD
            return x / x.sum(-1, keepdims=True)
        return Model(share(start), share(move), share(emit))

    @staticmethod
    def first(unigram: np.ndarray, seed: int = 7) -> Model:
        """States that differ by seeded noise around the classes' shares, and mostly stay."""
        rng = np.random.default_rng(seed)
        emit = (unigram + ADD) * np.exp(rng.standard_normal((STATES, len(unigram))) * 0.5)
        move = np.full((STATES, STATES), 0.1 / STATES) + np.eye(STATES) * 0.9
        return Model(np.full(STATES, 1 / STATES), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    def forward(self, sym: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 probabilities of ``sym(place, text)`` with texts by falling length ``n``: the
        scale factors of all places, multiplied."""
        emit, one, live = self.emit.T, np.ones(STATES), lives(sym, n)
        scale = np.ones(sym.shape)
        a = None
        for t, k in enumerate(live):
            a = np.broadcast_to(self.start, (k, STATES)) if a is None else a[:k] @ self.move
            a = a * emit[sym[t, :k]]
            c = a @ one
            scale[t, :k] = c
            a /= c[:, None]
        return np.log10(scale).sum(0)

    def expect(self, sym: np.ndarray, n: np.ndarray):
        """Expected counts of starts, transitions and emissions of some texts, and
        their log10 probability. Values of all places are held in single precision."""
        live = lives(sym, n)
        at = np.concatenate([[0], np.cumsum(live)])
        flat = np.concatenate([sym[t, :k] for t, k in enumerate(live)])
        seen = self.emit.T.astype(np.float32)[flat]  # emission of every place
        alpha, scale = np.empty_like(seen), np.empty(len(flat), np.float32)
        step, back, one = self.move.astype(np.float32), np.ascontiguousarray(self.move.T, np.float32), np.ones(STATES, np.float32)
        a = None
        for t, k in enumerate(live):
            own = alpha[at[t]:at[t + 1]]
            if a is None:
                own[:] = self.start
            else:
                np.matmul(a[:k], step, out=own)
            own *= seen[at[t]:at[t + 1]]
            c = scale[at[t]:at[t + 1]]
            np.matmul(own, one, out=c)
            own /= c[:, None]
            a = own
        move, beta = np.zeros((STATES, STATES)), None
        for t in range(len(live) - 1, -1, -1):
            own = alpha[at[t]:at[t + 1]]
            if beta is not None:
                ahead = seen[at[t + 1]:at[t + 2]]
                ahead *= beta
                ahead /= scale[at[t + 1]:at[t + 2], None]
                move += own[:len(ahead)].T @ ahead
                beta = np.ones_like(own)
                np.matmul(ahead, back, out=beta[:len(ahead)])
                own *= beta  # now the share of each state at the place
            else:
                beta = np.ones_like(own)
        counts = np.stack([np.bincount(flat, alpha[:, k], CLASSES + 1) for k in range(STATES)])
        return alpha[:at[1]].sum(0, dtype=np.float64), move * self.move, counts, np.log10(scale, dtype=np.float64).sum()


def lives(sym: np.ndarray, n: np.ndarray) -> list[int]:
    """How many texts are longer than each place."""
    return np.searchsorted(-n, -np.arange(len(sym))).tolist()


def sequences(texts: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(indexes, sym(place, text), lengths) of groups of texts, the longest first, each with its end."""
    for some in groups(texts, 4 * AT_ONCE):
        sym, n = classes_of([texts[i] for i in some])
        order = np.argsort(-n, kind="stable")
        starts = np.cumsum(n) - n
        at = 0
        while at < len(order):  # texts of similar length together, so that little of the table is empty
            longest = int(n[order[at]]) + 1
            many = max(1, min(len(order) - at, CELLS // longest))
            part = order[at:at + many]
            table = np.zeros((longest, len(part)), np.int32)
            table[n[part], np.arange(len(part))] = END_CLASS
            col = np.repeat(np.arange(len(part)), n[part])
            row = np.arange(len(col)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
            table[row, col] = sym[np.repeat(starts[part], n[part]) + row]
            yield [some[k] for k in part], table, n[part] + 1
            at += many


def _sum_up(train: DataFrame, per_batch, size: int) -> np.ndarray:
    """Sums of vectors of ``size`` numbers over all tasks; each task sends one."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some, held = np.zeros(size), False, []
        for b in parts:  # many texts at once, so that texts of similar length meet
            held += encoded(b.column(0))
            some = True
            if sum(map(len, held)) > HELD:
                total += per_batch(held)
                held = []
        if held:
            total += per_batch(held)
        if some:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    out = np.zeros(size)
    for r in train.select("text").mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.at] = r.n
    return out


def train_model(train: DataFrame, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all texts of ``train(text)``. The driver holds sums of fixed size."""

    def unigram(texts):
        sym, _ = classes_of(texts)
        return np.append(np.bincount(sym, minlength=CLASSES), len(texts)).astype(float)

    model = Model.first(_sum_up(train, unigram, CLASSES + 1))
    cut = np.cumsum([STATES, STATES * STATES, STATES * (CLASSES + 1)])
    for _ in range(rounds):
        def counts(texts, m=model):
            out = np.zeros(cut[-1])
            for _, sym, n in sequences(texts):
                start, move, emit, _ = m.expect(sym, n)
                out += np.concatenate([start, move.ravel(), emit.ravel()])
            return out
        start, move, emit, _ = np.split(_sum_up(train, counts, cut[-1]), cut)
        model = Model.from_counts(start, move.reshape(STATES, STATES), emit.reshape(STATES, -1))
    return model


def token_table(docs: DataFrame) -> DataFrame:
    """(chunk, word, class, n, c, first) of ``docs(chunk, text, held_out)``: the distinct tokens of each chunk, n times in its
    training texts and c times in those of all chunks; ``first`` marks one row of each word."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}

        def merge(own, more):
            key = np.concatenate([x[0] for x in (own, more)])
            n, k = (np.concatenate([x[j] for x in (own, more)]) for j in (1, 2))
            key, at, back = np.unique(key, return_index=True, return_inverse=True)
            return key, np.bincount(back, n).astype(np.int64), k[at]

        for b in parts:
            chunks, texts, out = b.column(0).to_pylist(), encoded(b.column(1)), b.column(2).to_pylist()
            for chunk in sorted(set(chunks)):
                own = [i for i, c in enumerate(chunks) if c == chunk]
                for some in groups([texts[i] for i in own], AT_ONCE):
                    t = [texts[own[i]] for i in some]
                    key, k, n = tokens_of(t)
                    use = np.array([not out[own[i]] for i in some])
                    more = (np.append(key, END), np.append(np.repeat(use, n), False).astype(np.int64) , np.append(k, END_CLASS))
                    more[1][-1] = use.sum()
                    empty = (np.empty(0, np.int64),) * 3
                    held[chunk] = merge(held.get(chunk, empty), merge(empty, more))
        for chunk, (key, n, k) in held.items():
            for at in range(0, len(key), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key[part]), chunk, np.int64)), pa.array(key[part]),
                                                  pa.array(k[part].astype(np.int32)), pa.array(n[part])], ["chunk", "word", "class", "n"])

    rows = docs.select("chunk", "text", "held_out").mapInArrow(run, "chunk long, word long, class int, n long")
    by = Window.partitionBy("word")
    return rows.select("*", F.sum("n").over(by).alias("c"), (F.min("chunk").over(by) == F.col("chunk")).alias("first"))


def class_sizes(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """N_k and V_k of all classes."""
    n, v = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for r in table.groupBy("class").agg(F.sum("n").alias("n"), F.count_if(F.col("first") & (F.col("c") > 0)).alias("v")).collect():
        n[r["class"]], v[r["class"]] = r.n, r.v
    return n, v


def score(docs: DataFrame, held_out, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs(doc_id, text)``."""
    # a chunk is what one task scans: bounded by the size of a split
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out.alias("held_out"),
                    F.spark_partition_id().cast("long").alias("chunk"))
    table = stage(token_table(d).select("chunk", "word", "class", "n", "c", "first"), "hmm-tokens")
    size, kinds = class_sizes(table)
    model = train_model(d.where("not held_out"), rounds)
    total, distinct = size.sum(), kinds.sum()
    low = np.log10(size + ADD * (kinds + 1))

    def run(key, texts: pa.Table, words: pa.Table) -> pa.Table:
        word, c = words.column("word").to_numpy(), words.column("c").to_numpy()
        order = np.argsort(word)
        word, c = word[order], c[order].astype(np.float64)
        text = encoded(texts.column("text"))
        out = np.zeros((4, len(text)))  # tokens, known, base, score
        for some in groups(text, AT_ONCE):
            t = [text[i] for i in some]
            keys, k, n = tokens_of(t)
            at = np.minimum(np.searchsorted(word, keys), len(word) - 1)
            if (word[at] != keys).any():
                raise RuntimeError("the input's partitions changed between two readings; pass stage(df)")
            count = c[at]
            doc = np.repeat(np.arange(len(t)), n)
            add = np.log10(count + ADD)
            end = float(c[np.searchsorted(word, END)])
            out[0, some] = n + 1
            out[1, some] = np.bincount(doc, count > 0, len(t)) + (end > 0)
            out[2, some] = np.bincount(doc, add, len(t)) + np.log10(end + ADD) - (n + 1) * np.log10(total + ADD * (distinct + 1))
            out[3, some] = np.bincount(doc, add - low[k], len(t)) + np.log10(end + ADD) - low[END_CLASS]
        for some, sym, n in sequences(text):
            out[3, some] += model.forward(sym, n)
        return pa.table({"doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": out[0].astype(np.int64),
                         "n_known": out[1].astype(np.int64), "train_tokens": np.full(len(text), int(total), np.int64),
                         "base_score": out[2], "score": out[3]})

    return (d.groupBy("chunk").cogroup(table.select("chunk", "word", "c").groupBy("chunk"))
            .applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))


def score_documents(docs: DataFrame) -> DataFrame:
    """``score`` with the rows whose crc32(doc_id as text) mod 10 is 0 held out."""
    return score(docs, bucket_of("doc_id", 10) == 0)
