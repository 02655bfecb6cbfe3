"""License scans by diagonal voting (operator 12).

Templates are phrases, sentences and notices of licenses, as words. Every k words of a text that follow each other are a
gram (k by the kind of template); the hashes of all grams are joined with the positions at which templates hold the
same hash, and a gram counts only if its words are equal too. A hit at word p of a text and word t of a template votes
for the diagonal p - t. Votes of neighbouring diagonals (within ``gap`` of the strongest one, so that words may be missing or added)
are merged, and the place is kept when the words of the template that its grams cover are at least ``SHARE`` of it, or all for a phrase.

Lower-casing is of A-Z only. Words are runs of letters, digits and characters beyond ASCII. Null texts are empty; texts without a word have no
place. Texts are taken whole; a text's grams are the largest unit, about 100 bytes a word. Rows of one doc_id and text get equal results, and null doc_ids are
kept. Neighbouring diagonals of equal votes give one place, the first. Other columns are not looked at. An empty table gives
an empty result. DataFrame functions only; the templates go to every task (their number is this module's, not the input's).
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calyx.llm.common import sent, stage

#: Between words (fixed by the contract of the scan, with A-Z not yet lower-cased).
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Part of a sentence or notice that must be found.
SHARE = 0.8
#: Documents with places of at most this number are sent to every task.
SENT = 200_000


class Kind(NamedTuple):
    k: int
    gap: int
    share: float


KINDS = {"phrase": Kind(2, 0, 1.0), "sentence": Kind(2, 1, SHARE), "notice": Kind(5, 6, SHARE)}

# Fixed values: (label, text) of the phrases that the scan must find.
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
# Public wordings of licenses, by label.
PHRASES = [("bsd", "bsd license"), ("mpl", "mozilla public license"), ("cc-by-nc", "cc by nc"), ("cc-by-sa", "cc by sa"), ("cc-by", "creative commons attribution")]
SENTENCES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("mit", "Released under the terms of the MIT License"),
    ("cc-by-nc", "Licensed under the Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc0", "To the extent possible under law the author has waived all copyright and related rights to this work"),
]
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
            "the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
]


class Template(NamedTuple):
    id: int
    kind: str
    label: str
    base: bool
    words: list[str]


def templates() -> list[Template]:
    rows = [("phrase", label, True, text) for label, text in BASE] + [
        (kind, label, False, text) for kind, some in (("phrase", PHRASES), ("sentence", SENTENCES), ("notice", NOTICES)) for label, text in some]
    return [Template(i, kind, label, base, re.findall("[a-z0-9]+", text.lower())) for i, (kind, label, base, text) in enumerate(rows)]


def words_of(text: Column) -> Column:
    """Words in lower case; the one other character whose lower case is in A-Z is put out of the way."""
    return F.array_remove(F.split(F.lower(F.replace(text, F.lit("\u212a"), F.lit("é"))), BETWEEN, -1), "")


def grams(words: Column, k: int) -> Column:
    last = F.size(words) - k
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", *(F.get(words, i + j) for j in range(k))))).otherwise(
        F.array().cast("array<string>"))


def posts(spark, some: list[Template]) -> DataFrame:
    """(k, hash, gram, template, at): where templates hold a gram; the row of k 0 keeps one row of each text in the join."""
    rows = [(0, "", -1, 0)] + [(KINDS[t.kind].k, " ".join(t.words[i:i + KINDS[t.kind].k]), t.id, i) for t in some for i in range(len(t.words) - KINDS[t.kind].k + 1)]
    return spark.createDataFrame(rows, "_k int, _gram string, template int, at int").withColumn("_hash", F.xxhash64("_gram"))


def hits(docs: DataFrame, some: list[Template]) -> DataFrame:
    """(doc_id, text_hash, n_words, template, at, diagonal): a row of template -1 for every text, and one for every gram that a template holds."""
    text = F.coalesce("text", F.lit(""))
    ks = sorted({v.k for v in KINDS.values()})
    d = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), words_of(text).alias("w"))
    d = d.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), *(grams(F.col("w"), k).alias(f"g{k}") for k in ks))
    # one array for all k: the position in it tells k and the word
    d = d.select("doc_id", "text_hash", "n_words", F.posexplode(F.concat(F.array(F.lit("")), *(f"g{k}" for k in ks))).alias("i", "gram"))
    k, p, before = F.when(F.col("i") == 0, 0), F.when(F.col("i") == 0, 0), F.lit(1).cast("long")
    for x in ks:
        size = F.greatest(F.col("n_words") - x + 1, F.lit(0))
        k, p, before = k.when(F.col("i") < before + size, x), p.when(F.col("i") < before + size, F.col("i") - before), before + size
    d = d.select("doc_id", "text_hash", "n_words", k.alias("k"), p.cast("long").alias("p"), "gram", F.xxhash64("gram").alias("hash"))
    table = F.broadcast(posts(docs.sparkSession, some))
    found = d.join(table, (F.col("hash") == F.col("_hash")) & (F.col("k") == F.col("_k")) & (F.col("gram") == F.col("_gram")))
    return found.select("doc_id", "text_hash", "n_words", "template", "at", (F.col("p") - F.col("at")).alias("diagonal"))


def places(found: DataFrame, some: list[Template]) -> DataFrame:
    """(doc_id, text_hash, template, label, base, start, share): verified places of templates, one for each."""
    info = found.sparkSession.createDataFrame([(t.id, t.kind, t.label, t.base, len(t.words)) for t in some],
                                              "_id int, kind string, label string, base boolean, length int")
    votes = found.where("template >= 0").groupBy("doc_id", "text_hash", "template", "diagonal").agg(F.collect_set("at").alias("ats"))
    votes = votes.join(F.broadcast(info), F.col("template") == F.col("_id")).withColumn("votes", F.size("ats"))
    out = None
    for name, kind in KINDS.items():
        near = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal").rangeBetween(-kind.gap, kind.gap)
        mine = F.struct("votes", -F.col("diagonal"))
        v = votes.where(F.col("kind") == name)
        if kind.gap:
            v = v.withColumn("strongest", F.max(mine).over(near)).withColumn("ats", F.flatten(F.collect_list("ats").over(near))).where(F.col("strongest") == mine)
        covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + kind.k - 1)))))
        v = v.select("doc_id", "text_hash", "template", "label", "base", F.col("diagonal").alias("start"), (covered / F.col("length")).alias("share"))
        v = v.where(F.col("share") >= kind.share)
        out = v if out is None else out.union(v)
    return out


def scan(docs: DataFrame, some: list[Template] | None = None) -> tuple[DataFrame, DataFrame]:
    """Of ``docs(doc_id, text, ...)``: a row (doc_id, text_hash, n_words) for each row, and the verified places."""
    some = templates() if some is None else some
    found = stage(hits(docs, some), "license-hits")
    return found.where("template = -1").select("doc_id", "text_hash", "n_words"), places(found, some)


def report(docs: DataFrame) -> DataFrame:
    """The digest of the scan, a row for each row of ``docs``."""
    rows, spans = scan(docs)
    labels = lambda some: F.array_join(F.array_sort(F.collect_set(some)), ",")
    base = F.col("base")
    of = stage(spans.groupBy("doc_id", "text_hash").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        labels(F.when(base, F.col("label"))).alias("base_labels"), labels("label").alias("labels"), F.max("share").alias("score")), "license-places")
    of = sent(of.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"}), SENT)
    both = rows.join(of, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return both.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
                       F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
                       F.coalesce("score", F.lit(0.0)).alias("score"))


def _values(some: list[Template]) -> str:
    return ", ".join(f"({t.id}, '{t.label}', {str(t.base).lower()}, {len(t.words)}, {', '.join(map(str, KINDS[t.kind]))}, {t.words!r})" for t in some)


def _run_sql(k: int) -> str:
    return " || ' ' || ".join(["w", *(f"lead(w, {j}) over o" for j in range(1, k))])


_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The same in DuckDB, with the texts' grams joined by their words.
ORACLE = rf"""with template(id, label, base, length, k, gap, share, words) as (values {_values(templates())}),
doc as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_CAPITALS.lower()}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
post as (select id, i - 1 as at, k, array_to_string(words[i:i + k - 1], ' ') as gram from (select *, unnest(range(1, length - k + 2)) as i from template)),
word as (select r, unnest(range(len(w))) as p, unnest(w) as w from doc),
run as (select r, p, {_run_sql(2)} as g2, {_run_sql(5)} as g5 from word window o as (partition by r order by p)),
gram as (select r, p, 2 as k, g2 as gram from run union all select r, p, 5, g5 from run),
vote as (select g.r, o.id, g.p - o.at as diagonal, list(distinct o.at) as ats from gram g join post o using (k, gram) group by all),
near as (select a.r, a.id, a.diagonal, flatten(list(b.ats)) as ats, max((len(b.ats), -b.diagonal)) = (len(any_value(a.ats)), -a.diagonal) as strongest
    from vote a join template t using (id) join vote b on b.r = a.r and b.id = a.id and b.diagonal between a.diagonal - t.gap and a.diagonal + t.gap
    group by a.r, a.id, a.diagonal),
place as (select n.r, n.diagonal as start, t.label, t.base, t.share as least,
    len(list_distinct(flatten(list_transform(n.ats, lambda a: range(a, a + t.k))))) / t.length as share from near n join template t using (id) where n.strongest)
select d.doc_id, len(d.w) as n_words, count(p.r) filter (where p.base) as n_base, min(p.start) filter (where p.base) as first_word,
    max(p.start) filter (where p.base) as last_word, coalesce(string_agg(distinct p.label, ',' order by p.label) filter (where p.base), '') as base_labels,
    coalesce(string_agg(distinct p.label, ',' order by p.label), '') as labels, coalesce(max(p.share), 0.0) as score
from doc d left join place p on p.r = d.r and p.share >= p.least group by d.r, d.doc_id, d.w"""
