"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates; DataFrame functions only.

Paragraphs are sparse sets of word n-grams: every line is one, and so is every block of lines between blank ones, so that
a notice which is wrapped over lines is found too. A softmax regression over the n-grams of known licence texts gives a
score for every family and for "unknown"; its scores are calibrated by a temperature fitted on held-out rows. The best
family stands only if the paragraph also holds enough of one of that family's templates, or a template enough of it.

The words of the templates that are rare in lines without a licence are the classifier's marks: its features are
the n-grams that hold one. So a paragraph without a mark is unknown, and only texts with a mark are cut into n-grams.

The classifier is fitted on every window of the templates and on every line of the corpus, labelled unknown where it is not
near a template. A first pass counts the lines with each template word, a second keeps the texts that may hold a mark. Only
these are cut into n-grams and classified, equal ones once; the driver gets each set of features once, with its number of lines.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.llm.common import durable

#: Notices by which licences are named and granted, one or more for a family.
TEMPLATES: dict[str, list[str]] = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3."],
    "isc": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense."],
    "eupl": ["Licensed under the European Union Public Licence, version 1.2.", "Licensed under the EUPL."],
    "epl": ["Licensed under the Eclipse Public License, version 2.0."],
}
#: Identifiers by which files name their licence after "SPDX-License-Identifier:".
IDENTIFIERS = {
    "apache": ["Apache-2.0"], "mit": ["MIT"], "gpl": ["GPL-3.0-only", "GPL-3.0-or-later", "GPL-2.0-only", "GPL-2.0-or-later"], "bsd": ["BSD-3-Clause", "BSD-2-Clause"], "cc-by-nc": ["CC-BY-NC-4.0"],
    "cc-by": ["CC-BY-4.0"], "cc-by-sa": ["CC-BY-SA-4.0"], "cc0": ["CC0-1.0"], "mpl": ["MPL-2.0"], "lgpl": ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later"],
    "agpl": ["AGPL-3.0-only", "AGPL-3.0-or-later"], "isc": ["ISC"], "unlicense": ["Unlicense"], "eupl": ["EUPL-1.2"], "epl": ["EPL-2.0"],
}
TEMPLATES = {f: [*ts, *(f"SPDX-License-Identifier: {i}" for i in IDENTIFIERS[f])] for f, ts in TEMPLATES.items()}
UNKNOWN = "unknown"
ORDERS = (1, 2, 3)
#: A family stands from this calibrated probability and this share of n-grams in common with a template.
LEAST_PROBABILITY, LEAST_COMMON = 0.5, 0.6
#: A template's word is a mark if it stands in at most this share of the lines that are not near a template, or in so many of them at most.
MARK_SHARE, MARK_LINES = 0.005, 2
#: Lines are told apart by whether they have so many distinct words where those that cannot be near a template are passed over.
LINE_SIZES = (1, 6, 12)
#: Findings by text are sent to all tasks up to so many.
BROADCAST_TEXTS = 100_000
_GAPS = ",;:!?\"'()[]{}<>|/\\*_=+#&%$@~^`\n\t\r\x0b\x0c\xa0"


def words(text: Column) -> Column:
    """Lower-case words between white space and signs; full stops and dashes stay but at the end of one."""
    return F.array_remove(F.transform(F.split(F.translate(F.lower(text), _GAPS, " " * len(_GAPS)), " "), lambda w: F.rtrim(w, F.lit(".-"))), "")


def words_of(text: str) -> list[str]:
    """The same on the driver."""
    spaced = text.lower().translate({ord(c): " " for c in _GAPS})
    return [w for w in (x.rstrip(".-") for x in spaced.split(" ")) if w]


def ngrams_of(of: list[str]) -> list[str]:
    return sorted({" ".join(of[k : k + n]) for n in ORDERS for k in range(len(of) - n + 1)})


def ngrams(of: Column) -> Column:
    """Distinct word n-grams."""

    def order(n: int) -> Column:
        at = F.when(F.size(of) >= n, F.sequence(F.lit(1), F.greatest(F.size(of) - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda k: F.array_join(F.slice(of, k, n), " "))

    return F.array_distinct(F.concat(*[order(n) for n in ORDERS]))


class Classifier:
    """Softmax regression: weights by n-gram and class, one bias a class, a temperature. marks: see the module."""

    def __init__(self, classes: list[str], vocabulary: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float, marks: list[str]):
        self.classes, self.vocabulary, self.weights, self.bias, self.temperature, self.marks = classes, vocabulary, weights, bias, temperature, marks

    @staticmethod
    def probabilities(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    @classmethod
    def fit(cls, texts: list[str], labels: list[str], others: list[tuple[list[str], bool, int]], vocabulary: list[str], marks: list[str], steps: int = 300, rate: float = 1.0, ridge: float = 1e-3) -> Classifier:
        """By gradient steps on the rows whose crc32 mod 5 is not 0 and on all whole notices; the temperature by a search on the
        others. Every class weighs the same in both. others: the n-grams of unknown lines, whether their crc32 mod 5 is 0, number of lines."""
        classes = [*sorted(TEMPLATES), UNKNOWN]
        at = {g: k for k, g in enumerate(vocabulary)}
        rows = [[at[g] for g in ngrams_of(words_of(t)) if g in at] for t in texts] + [[at[g] for g in gs] for gs, _, _ in others]
        truth = np.array([classes.index(c) for c in labels] + [classes.index(UNKNOWN)] * len(others))
        whole = {t for ts in TEMPLATES.values() for t in ts}
        held = np.array([zlib.crc32(t.encode()) % 5 == 0 and t not in whole for t in texts] + [h for _, h, _ in others])
        times = np.array([1.0] * len(texts) + [float(n) for _, _, n in others])

        def balance(chosen: np.ndarray) -> np.ndarray:
            share = np.bincount(truth[chosen], times[chosen], len(classes))
            return times[chosen] / np.maximum(1, share)[truth[chosen]]

        x = Sparse([r for r, h in zip(rows, held, strict=True) if not h], len(vocabulary))
        y, weight = np.eye(len(classes))[truth[~held]], balance(~held)[:, None]
        w, b = np.zeros((len(vocabulary), len(classes))), np.zeros(len(classes))
        for _ in range(steps):
            g = (cls.probabilities(x.times(w) + b) - y) * weight
            w -= rate * (x.transposed_times(g) + ridge * w)
            b -= rate * g.sum(axis=0)
        tried = np.geomspace(0.02, 4, 40)
        chosen = held if held.any() else ~held
        z = Sparse([r for r, c in zip(rows, chosen, strict=True) if c], len(vocabulary)).times(w) + b
        at_truth, weight = (np.arange(len(z)), truth[chosen]), balance(chosen)
        loss = [-(np.log(np.maximum(1e-12, cls.probabilities(z / t)[at_truth])) * weight).sum() for t in tried]
        return cls(classes, vocabulary, w, b, float(tried[int(np.argmin(loss))]), marks)


class Sparse:
    """Rows of features: 1 / sqrt(their number) at those of the row, else 0."""

    def __init__(self, rows: list[list[int]], width: int):
        self.n, self.width = len(rows), width
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        self.columns = np.fromiter((c for r in rows for c in r), np.int64, int(sizes.sum()))
        self.rows = np.repeat(np.arange(self.n), sizes)
        self.values = (1 / np.sqrt(np.maximum(1, sizes)))[self.rows][:, None]
        self.order = np.argsort(self.columns, kind="stable")

    @staticmethod
    def _sums(values: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
        """Sums of the values by key; keys are sorted."""
        out = np.zeros((n, values.shape[1]))
        if len(keys):
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            out[keys[starts]] = np.add.reduceat(values, starts, axis=0)
        return out

    def times(self, w: np.ndarray) -> np.ndarray:
        return self._sums(w[self.columns] * self.values, self.rows, self.n)

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        return self._sums((g[self.rows] * self.values)[self.order], self.columns[self.order], self.width)


def template_ngrams() -> list[frozenset[str]]:
    return [frozenset(ngrams_of(words_of(t))) for ts in TEMPLATES.values() for t in ts]


def idle_words(by_count: list[str], least: int, idle: frozenset[str]) -> frozenset[str]:
    """idle and more of the words, the first ones first, that do not make a line near a template where it holds no others of its words.

    For lines of at least so many distinct words: d of them make 3 d - 3 distinct n-grams or more, as each ends one of every
    order where it first stands, but for the first two words of the line.
    """
    notices = [([frozenset(g.split(" ")) for g in n], LEAST_COMMON * min(len(n), max(6, 3 * least - 3))) for n in template_ngrams()]
    for w in by_count:
        more = idle | {w}
        if all(sum(g <= more for g in gs) < need for gs, need in notices):
            idle = more
    return idle


def held_out(line: Column) -> Column:
    return F.crc32(line.cast("binary")) % 5 == 0


def among(values: Iterable[str]) -> Callable[[Column], Column]:
    values = sorted(values)
    return lambda v: v.isin(values)


def telling(of: Column, known: list[str], idle: list[frozenset[str]]) -> Column:
    """Whether a line's words hold a known one that is not idle in lines of its size; other lines are not near a template."""
    found = F.exists(of, among(set(known) - idle[0]))
    for size, still in zip(LINE_SIZES[1:], idle[1:], strict=True):
        found = F.exists(of, among(set(known) - still)) | ((F.size(F.array_distinct(of)) < size) & found)
    return found


def lines_by_ngrams(lines: DataFrame, known: list[str], idle: list[frozenset[str]]) -> DataFrame:
    """near (a template), held, hits (sorted n-grams of templates), n (lines) of the telling lines. lines: line."""
    notices = template_ngrams()
    hits_of = lambda g: F.struct(F.size(g).alias("size"), F.array_sort(F.filter(g, among(frozenset().union(*notices)))).alias("hits"))
    # words and n-grams are cut once: outside a lambda they would be cut again for each use
    cut = F.transform(F.array(words(F.col("line"))), lambda of: F.when(telling(of, known, idle), F.transform(F.array(ngrams(of)), hits_of)[0]))[0]
    told = lines.select(held_out(F.col("line")).alias("held"), cut.alias("cut")).where("cut IS NOT NULL").select("held", "cut.size", "cut.hits")
    # as text, since thousands of literals take seconds one by one; n-grams hold no quotes or backslashes
    listed = [", ".join(f"'{g}'" for g in sorted(n)) for n in notices]
    near = " OR ".join(f"size(filter(hits, h -> h IN ({gs}))) >= {LEAST_COMMON}D * least({len(n)}, greatest(6, size))" for n, gs in zip(notices, listed, strict=True))
    least = min(LEAST_COMMON * min(len(n), 6) for n in notices)
    return told.select(F.expr(f"size(hits) >= {least}D AND ({near})").alias("near"), "held", "hits").groupBy("near", "held", "hits").agg(F.count(F.lit(1)).alias("n"))


def lines_of(texts: DataFrame) -> DataFrame:
    """line of every line that is not blank. texts: text."""
    return texts.select(F.explode(F.split("text", "\n")).alias("line")).where(F.trim(F.translate("line", "\t\r", "  ")) != "")


def fitted(rows: DataFrame) -> tuple[Classifier, DataFrame]:
    """The classifier fitted on all lines of rows, each as often as it is there; and doc_id, held (key, text) of rows, where
    held is null in texts without a telling line, which have no mark. rows: doc_id, text, not null."""
    texts, labels = [], []
    for family, notices in TEMPLATES.items():
        for notice in notices:
            of = notice.split()
            windows = {" ".join(of[a : a + n]) for n in {6, max(4, len(of) // 2), len(of)} for a in range(len(of) - n + 1)}
            texts += sorted(windows)
            labels += [family] * len(windows)
    known = sorted({w for ts in TEMPLATES.values() for t in ts for w in words_of(t)})
    # the lines that hold each template word; the entries with a blank stand for all lines, held out or not
    one = F.when(held_out(F.col("line")), " held").otherwise(" fitted")
    found = F.array_append(F.array_distinct(F.filter(words(F.col("line")), among(known))), one)
    counts = {r["word"]: r["n"] for r in lines_of(rows).select(F.explode(found).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_lines = {h: counts.get(" held" if h else " fitted", 0) for h in (False, True)}
    frequent = [w for w in sorted(known, key=lambda w: (-counts.get(w, 0), w)) if counts.get(w, 0) > max(MARK_LINES, MARK_SHARE * sum(n_lines.values()))]
    while True:
        idle: list[frozenset[str]] = []
        for least in LINE_SIZES:
            idle.append(idle_words(frequent, least, idle[-1] if idle else frozenset()))
        tells = F.exists(F.transform(F.split("text", "\n"), words), lambda of: telling(of, known, idle))
        told = durable(rows.select("doc_id", F.when(tells, F.struct(F.md5(F.col("text").cast("binary")).alias("key"), "text")).alias("held")))
        lines = durable(lines_by_ngrams(lines_of(told.where("held IS NOT NULL").select("held.text")), known, idle))
        near = {r["held"]: r["n"] for r in lines.where("near").groupBy("held").agg(F.sum("n").alias("n")).collect()}
        near_with = {r["hit"]: r["n"] for r in lines.where("near").select("n", F.explode("hits").alias("hit")).where(among(known)(F.col("hit"))).groupBy("hit").agg(F.sum("n").alias("n")).collect()}
        n_others = {h: n_lines[h] - near.get(h, 0) for h in n_lines}
        most = max(MARK_LINES, MARK_SHARE * sum(n_others.values()))
        marks = [w for w in known if counts.get(w, 0) - near_with.get(w, 0) <= most]
        if idle[-1].isdisjoint(marks):
            break
        # frequent words that hardly stand in other lines than licences: lines with them are needed too; the marks stay as they are
        frequent = [w for w in frequent if w not in marks]
    vocabulary = sorted({g for n in template_ngrams() for g in n if not set(marks).isdisjoint(g.split(" "))})
    features = lines.where(~F.col("near")).select("held", "n", F.filter("hits", among(vocabulary)).alias("hits")).where(F.size("hits") > 0)
    others = sorted((r["hits"], r["held"], r["n"]) for r in features.groupBy("held", "hits").agg(F.sum("n").alias("n")).toLocalIterator())
    without = [([], h, n_others[h] - sum(n for _, held, n in others if held == h)) for h in n_others]
    return Classifier.fit(texts, labels, others + [o for o in without if o[2]], vocabulary, marks), told


def train(docs: DataFrame, text_col: str = "text") -> Classifier:
    """Fitted on all lines of docs."""
    return fitted(docs.select(F.lit(None).cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")))[0]


def scored(units: DataFrame, made: Classifier, least_probability: float, least_common: float) -> DataFrame:
    """The columns of units but for text, then family, probability, common. Units are told apart by their columns but text."""
    own = [c for c in units.columns if c != "text"]
    # words are cut once: outside a lambda they would be cut again for each n-gram
    grams = units.select(*own, F.transform(F.array(words(F.col("text"))), ngrams)[0].alias("g"))
    known = {g: tuple(float(v) for v in np.round(made.weights[k], 6)) for k, g in enumerate(made.vocabulary)}
    notices = [(f, frozenset(ngrams_of(words_of(t)))) for f, ts in TEMPLATES.items() for t in ts]
    none = (0.0,) * len(made.classes)
    rows = [(g, g in known, list(known.get(g, none)), [k for k, (_, gs) in enumerate(notices) if g in gs]) for g in sorted({g for _, gs in notices for g in gs})]
    # the size of the templates, which are part of the program
    table = F.broadcast(units.sparkSession.createDataFrame(rows, "g string, marked boolean, v array<double>, notices array<int>"))
    hits = grams.select(*own, F.size("g").alias("_n"), F.explode("g").alias("g")).join(table, "g")
    sums = hits.groupBy(*own).agg(
        F.max("_n").alias("_n"), F.count_if("marked").alias("_hits"), *[F.sum(F.col("v")[c]).alias(f"_z{c}") for c in range(len(made.classes))],
        *[F.sum(F.array_contains("notices", n).cast("int")).alias(f"_m{n}") for n in range(len(notices))],
    ).where("_hits > 0")
    z = [(F.col(f"_z{c}") / F.sqrt("_hits") + F.lit(float(made.bias[c]))) / F.lit(made.temperature) for c in range(len(made.classes))]
    # the share of a template's n-grams that the paragraph holds, or of the paragraph's that the template holds: the best of each family
    size = lambda gs: F.least(F.lit(len(gs)), F.greatest("_n", F.lit(6)))
    common = [F.greatest(*[F.col(f"_m{n}") / size(gs) for n, (f, gs) in enumerate(notices) if f == c], F.lit(0.0)) if c != UNKNOWN else F.lit(0.0) for c in made.classes]
    near = sums.select(*own, F.array(*z).alias("_z"), F.array(*common).alias("_common"))
    top = F.array_max("_z")
    best = F.array_position("_z", top).cast("int")
    total = F.aggregate(F.transform("_z", lambda v: F.exp(v - top)), F.lit(0.0), lambda a, v: a + v)
    named = near.select(*own, F.element_at(F.array(*[F.lit(c) for c in made.classes]), best).alias("_name"), (F.lit(1.0) / total).alias("_p"), F.least(F.element_at("_common", best), F.lit(1.0)).alias("_common"))
    sure = (F.col("_name") != UNKNOWN) & (F.col("_p") >= least_probability) & (F.col("_common") >= least_common)
    return named.select(*own, F.when(sure, F.col("_name")).otherwise(UNKNOWN).alias("family"), F.round("_p", 4).alias("probability"), F.round("_common", 4).alias("common"))


def paragraphs(texts: DataFrame, made: Classifier) -> DataFrame:
    """key, line (from 1), whole, text of the lines and blocks of several lines that hold a mark. texts: key, text, each key once.

    A block is the lines between two blank ones; its line is its first.
    """
    lines = texts.select("key", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", (F.col("line") + 1).cast("long"))
    blank = F.trim(F.translate("text", "\t\r", "  ")) == ""
    # a window over the lines of one text
    placed = lines.withColumn("_block", F.sum(blank.cast("int")).over(Window.partitionBy("key").orderBy("line"))).where(~blank)
    joined = placed.groupBy("key", "_block").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("_lines")).where(F.size("_lines") > 1)
    blocks = joined.select("key", F.col("_lines")[0]["line"].alias("line"), F.lit(True).alias("whole"), F.array_join(F.col("_lines")["text"], "\n").alias("text"))
    every = placed.select("key", "line", F.lit(False).alias("whole"), "text").unionByName(blocks)
    return every.where(F.arrays_overlap(words(F.col("text")), F.array(*[F.lit(m) for m in made.marks])))


def scan(texts: DataFrame, made: Classifier, least_probability: float = LEAST_PROBABILITY, least_common: float = LEAST_COMMON) -> DataFrame:
    """key, line, whole, family, probability, common of every paragraph with a mark; see paragraphs. texts: key, text, each key once.

    family is the best one, or unknown where its probability or the share of a template in common is too small.
    """
    return scored(paragraphs(texts, made), made, least_probability, least_common)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, families (sorted, distinct), n_paragraphs, first_line, probability (largest) of every row.

    n_paragraphs counts the lines with a family and the blocks whose family none of the text's lines has. Null texts are empty.
    Rows without a licence have no families. Null ids stay null; rows that share an id are told apart, and rows with equal texts
    have equal findings. Other columns are not read.
    """
    made, held = fitted(docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")))
    marks = F.array(*[F.lit(m) for m in made.marks]).cast("array<string>")
    texts = held.where("held IS NOT NULL").select("held.key", "held.text").where(F.arrays_overlap(words(F.col("text")), marks)).dropDuplicates(["key"])
    found = scan(texts, made).where(F.col("family") != UNKNOWN)
    by = found.groupBy("key").agg(
        F.collect_set(F.when(~F.col("whole"), F.col("family"))).alias("l"), F.collect_list(F.when(F.col("whole"), F.struct("family", "line"))).alias("w"), F.count_if(~F.col("whole")).alias("n"),
        F.min(F.when(~F.col("whole"), F.col("line"))).alias("first"), F.max("probability").alias("probability"),
    )
    by = by.withColumn("w", F.filter("w", lambda b: ~F.array_contains("l", b["family"])))
    first = F.least("first", F.array_min(F.transform("w", lambda b: b["line"])))
    by = durable(by.select("key", F.array_join(F.array_sort(F.array_union("l", F.col("w")["family"])), ",").alias("families"), (F.col("n") + F.size("w")).cast("long").alias("n"), first.alias("first_line"), "probability"))
    by = F.broadcast(by) if by.count() <= BROADCAST_TEXTS else by
    out = held.select("doc_id", F.col("held.key").alias("key")).join(by, "key", "left")
    return out.select("doc_id", F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n", F.lit(0)).cast("long").alias("n_paragraphs"), "first_line", "probability")
