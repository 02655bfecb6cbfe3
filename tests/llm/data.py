"""Small tables with the awkward rows that every operator must take: nulls, empty and long
texts, repeated rows, ties and extra columns with clashing names."""

from __future__ import annotations

import random

SYL = {"en": "the ing tion er and of st re th wh".split(), "de": "ein ung sch der und ich keit pf äu ß".split(),
       "fr": "eau que oi ment les é è ier aux tre".split()}
EXTRA = "n_tokens long, score double, component_id string, label string, `text hash` string"


def word(rng: random.Random, lang: str) -> str:
    return "".join(rng.choice(SYL[lang]) for _ in range(rng.randint(1, 3)))


def text(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(word(rng, lang) for _ in range(n))


def rows(n: int = 60, seed: int = 3) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars, then the extra columns)."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        out.append((i, text(rng, lang, rng.randint(3, 120)), lang, f"src{i % 4}"))
    for i in range(n, n + 12):  # copies and near copies
        of = out[i % 7]
        w = of[1].split()
        if i % 2:
            w[len(w) // 2] = "changed"
        out.append((i, " ".join(w), of[2], of[3]))
    out += [(n + 20, None, None, None), (n + 21, "", "en", "src0"), (n + 22, " \n\t ", "en", None), (n + 23, "12 34 !!", "en", "src1"),
            (n + 24, "x" * 5000, "en", "src1"), (n + 25, text(rng, "en", 4000), "en", "src2"), (None, "the end of and er", "en", "src0"),
            (None, None, "de", "src0"), (n + 26, "one", None, "src3"), (n + 27, "one", "fr", "src3"), (5, out[5][1], "fr", "src1"), out[6]]
    return [(i, t, lang, s, None if t is None else len(t), 7, 0.5, "clash", "clash", "clash") for i, t, lang, s in out]


def documents(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


def by_key(df, *key) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
