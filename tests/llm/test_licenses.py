"""Operator 12 against brute force: phrases word by word, other templates by comparing every diagonal."""

from __future__ import annotations

import random
import re

from calyx.llm import licenses
from tests.llm.data import documents, rows, text

COLS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NOTICE = licenses.NOTICES[0][1]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(CAPITALS))


def brute(t):
    w = words(t)
    found, base = [], []
    for x in licenses.templates():
        k, gap, least = licenses.KINDS[x.kind]
        votes = {}
        for d in range(-len(x.words), len(w)):
            ats = {i for i in range(len(x.words) - k + 1) if 0 <= d + i and w[d + i:d + i + k] == x.words[i:i + k]}
            if ats:
                votes[d] = ats
        for d, ats in votes.items():
            near = [e for e in votes if abs(e - d) <= gap]
            if max((len(votes[e]), -e) for e in near) != (len(ats), -d):
                continue
            share = len({i + j for e in near for i in votes[e] for j in range(k)}) / len(x.words)
            if share >= least:
                found.append((x.label, share))
                if x.base:
                    base.append((d, x.label))
                    assert w[d:d + len(x.words)] == x.words
    at = [d for d, _ in base]
    labels = lambda some: ",".join(sorted(set(some)))
    return (len(w), len(base), min(at, default=None), max(at, default=None), labels(x for _, x in base), labels(x for x, _ in found),
            max((s for _, s in found), default=0.0))


def table():
    rng = random.Random(4)
    some = rows()[:30] + rows()[60:]
    notice = NOTICE.split()
    edited = notice[:9] + notice[10:20] + ["very", "new"] + notice[20:35] + ["other"] + notice[36:]
    half = notice[:len(notice) // 3]
    texts = ["MIT License", "the mit-license, MIT\nLICENSE; mit licenses", "mit éa license", "mit\x00license\x7fmit  license", "Apache License apache license version 2.0",
             "GNU General Public License, version 3", "general public general public license", "This work is licensed under the GNU General Public License, version 3.",
             "Licensed under CC BY-NC 4.0.", "marK license worK mit lİcense", "K mit license İ", NOTICE, " ".join(edited), " ".join(half),
             text(rng, "en", 300) + " " + NOTICE + " " + text(rng, "de", 50) + "\n" + " ".join(edited), "mit license " * 3000, NOTICE * 3,
             "Redistribution and use in source or binary forms, with or without any modification, are permitted provided that the following conditions are met:",
             "of the software " * 50, "MITLICENSE mit", "license mit"]
    more = [(2000 + i, t, "en", "s", len(t)) + rows()[0][5:] for i, t in enumerate(texts)]
    return some + more + [more[11], more[11], (None, NOTICE, None, None, 1) + rows()[0][5:], (2000, "other text of the same id", "en", "s", 9) + rows()[0][5:]]


def test_scan_against_brute_force(spark):
    t = table()
    got = licenses.report(documents(spark, t))
    assert got.columns == COLS
    want = [(r[0], *brute(r[1])) for r in t]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    by_text = {r[1]: brute(r[1]) for r in t}
    assert by_text[NOTICE][4:] == ("", "mit", 1.0) and sum(x[5] != "" for x in by_text.values()) > 14


def test_places_carry_spans(spark):
    docs = documents(spark, [(1, "x y " + NOTICE, "en", "s", 1, 7, 0.5, "c", "c", "c"), (2, "a MIT License", "en", "s", 1, 7, 0.5, "c", "c", "c")])
    spans = licenses.scan(docs)[1].select("doc_id", "label", "base", "start", "share").collect()
    assert sorted(map(tuple, spans)) == [(1, "mit", False, 2, 1.0), (2, "mit", True, 1, 1.0)]


def test_unsent_and_empty(spark, monkeypatch):
    monkeypatch.setattr(licenses, "SENT", 0)
    t = table()[-12:]
    assert sorted(map(tuple, licenses.report(documents(spark, t)).collect()), key=repr) == sorted(((r[0], *brute(r[1])) for r in t), key=repr)
    assert licenses.report(documents(spark, [])).collect() == []
