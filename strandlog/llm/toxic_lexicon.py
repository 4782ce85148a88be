"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded before they are matched: lower case, look-alike letters of other alphabets and digits or signs that
stand for letters become the letters they stand for. Entries are words or beginnings of words; a match must begin where
a word begins and, for whole words, end where it ends. A match inside an exception phrase does not count. The weights of
the entries found, counted by match and once each, alone and divided by the length, give the score through a logistic curve.

How far an entry must stand out to be in the lexicon is chosen by cross-validation inside the training rows, and the curve
is fitted on what lexicons find that were learned without the row's fold.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlog.llm.common import durable

#: The lexicon and the curve are fitted on about so many labelled rows at most, drawn by a hash of their ids.
TRAIN_DOCS = 20_000
#: An entry stands in so many distinct toxic texts at least.
LEAST_SUPPORT = 3
#: Tried as the least likelihood ratio (G squared) of an entry against chance, and as the least log odds of its share.
RATIOS, ODDS = (8.0, 12.0, 22.0, 40.0), (1.0, 2.0, 3.0)
FOLDS = 5
PREFIXES = (3, 4, 5, 6, 7, 8)
THRESHOLD = 0.7
PREFIX_MARK = "*"

_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: Letters of the Cyrillic and Greek alphabets that look like Latin ones.
_LOOKALIKES = dict(zip("аеорсухіјѕԁһкмтвнαβεικνορτυχ", "aeopcyxijsdhkmtbhabeiknoptux", strict=True))


def _fold_table() -> dict[int, str]:
    table = {ord(a): b for a, b in _LOOKALIKES.items()}
    table |= {c: chr(c - 0xFEE0).lower() for c in range(0xFF01, 0xFF5F)}  # full-width forms
    table |= {c: "" for c in (0x200B, 0x200C, 0x200D, 0xFEFF, 0xAD)}  # no width
    for c in range(0x1D400, 0x1D7FF):  # mathematical letters
        plain = unicodedata.normalize("NFKC", chr(c))
        if plain.isascii():
            table[c] = plain.lower()
    return table


_FOLD = _fold_table()
_SIGNS = str.maketrans(_DIGITS)


def fold(text: str) -> str:
    t = text.lower()
    if not t.isascii():
        t = t.translate(_FOLD)
    return t.translate(_SIGNS)


def letter_runs(folded: str) -> list[str]:
    """Words: runs of letters."""
    if folded.isalpha():
        return [folded]
    return "".join([c if c.isalpha() else " " for c in folded]).split() if not folded.isascii() else folded.translate(_ASCII_GAPS).split()


_ASCII_GAPS = {c: " " for c in range(128) if not chr(c).isalpha()}


def entries_of(words: list[str]) -> set[str]:
    found = set(words)
    for n in PREFIXES:
        found.update(w[:n] + PREFIX_MARK for w in words if len(w) > n)
    return found


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    #: Of 1 and the three features.
    curve: tuple[float, ...] = (-4.0, 0.0, 1.0, 0.0)

    def matcher(self):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for e, w in self.weights.items():
            key = e.removesuffix(PREFIX_MARK)
            whole, start = automaton.get(key, (0.0, 0.0)) if key in automaton else (0.0, 0.0)
            automaton.add_word(key, (whole, w) if e.endswith(PREFIX_MARK) else (w, start))
        values = {}
        for key in list(automaton):
            values[key] = automaton.get(key)
            automaton.add_word(key, (key, *values[key]))
        automaton.make_automaton()
        masks = ahocorasick.Automaton()
        for p in self.exceptions:
            masks.add_word(p, p)
        if len(masks):
            masks.make_automaton()
        return automaton, masks

    def features(self, text: str, made) -> tuple[float, float, float, int]:
        """Sum of the weights of all matches, of the distinct words matched, the latter by length; matches."""
        automaton, masks = made
        t = fold(text)
        covered = _covered(t, masks) if len(masks) else None
        best: dict[int, tuple[int, float]] = {}
        for end, (key, whole, start) in automaton.iter(t) if len(automaton) else ():
            begin = end - len(key) + 1
            if begin and t[begin - 1].isalpha():
                continue
            closed = end + 1 == len(t) or not t[end + 1].isalpha()
            weight = max(whole, start) if closed else start
            if weight > best.get(begin, (0, 0.0))[1] and not (covered and covered(begin, end)):
                best[begin] = (end, weight)
        found: dict[str, list[float]] = {}
        for begin, (end, weight) in best.items():
            while end + 1 < len(t) and t[end + 1].isalpha():
                end += 1
            one = found.setdefault(t[begin : end + 1], [weight, 0])
            one[1] += 1
        return (*_sums(found.values(), n_words(t)), len(best))

    def score(self, *features: float) -> float:
        z = self.curve[0] + sum(c * f for c, f in zip(self.curve[1:], features, strict=True))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def _covered(t: str, masks):
    """Whether an exception phrase that begins and ends with words covers [begin, end]."""
    spans = sorted((end - len(p) + 1, end) for end, p in masks.iter(t))
    spans = [(a, b) for a, b in spans if not (a and t[a].isalpha() and t[a - 1].isalpha()) and not (b + 1 < len(t) and t[b].isalpha() and t[b + 1].isalpha())]
    starts = [a for a, _ in spans]
    furthest = list(accumulate((b for _, b in spans), max))

    def inside(begin: int, end: int) -> bool:
        k = bisect_right(starts, begin) - 1
        return k >= 0 and furthest[k] >= end

    return inside if spans else None


def _sums(found, words: int) -> tuple[float, float, float]:
    """Of (weight, times) of distinct words: the sum by times, the sum, the sum over the square root of the words."""
    rows = sorted(found)
    once = math.fsum(w for w, _ in rows)
    return math.fsum(w * n for w, n in rows), once, once / math.sqrt(words)


def n_words(folded: str) -> int:
    return max(1, folded.count(" ") + folded.count("\n") + 1)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 100) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge; a step that does not lower the loss is halved."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    cost = lambda w: np.logaddexp(0, np.where(y == 1, -(a @ w), a @ w)).sum() + ridge / 2 * (w @ w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (p - y) + ridge * w)
        size, now = 1.0, cost(w)
        while size > 1e-6 and cost(w - size * step) > now:
            size /= 2
        w = w - size * step
        if size <= 1e-6 or np.abs(size * step).max() < 1e-9:
            break
    return w


def chosen(entries: list[str], toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, ratio: float, odds: float) -> dict[str, float]:
    """Entries that stand out so far, and their log odds. Of an entry and beginnings of it, the one that stands out most
    (then the longest) is taken and the others are left out."""
    n = toxic + clean
    share = n_toxic / max(1, n_toxic + n_clean)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(toxic > 0, toxic * np.log(toxic / (n * share)), 0) + np.where(clean > 0, clean * np.log(clean / (n * (1 - share))), 0))
    weight = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    fine = np.flatnonzero((toxic >= LEAST_SUPPORT) & (weight >= odds) & (g >= ratio))
    taken: dict[str, float] = {}
    begun: set[str] = set()
    for k in sorted(fine.tolist(), key=lambda k: (-round(float(g[k]), 9), -len(entries[k]), entries[k])):
        e = entries[k]
        stem = e.removesuffix(PREFIX_MARK)
        if (e != stem and stem in begun) or any(stem[:m] + PREFIX_MARK in taken for m in PREFIXES if m < len(stem) + (e == stem)):
            continue
        taken[e] = round(float(weight[k]), 4)
        begun.update(stem[:m] for m in range(1, len(stem) + 1))
    return taken


def learn(docs: DataFrame, labels: DataFrame, use: Column, train_docs: int = TRAIN_DOCS) -> Lexicon:
    """A lexicon from documents (doc_id, text) whose labels (doc_id, toxic) are known and where use holds of the label's id.

    A document with both labels counts as toxic, and so does a text that stands under both; equal texts count once. Only
    counts of entries of toxic texts and the features of the drawn rows (train_docs of them) reach the driver.
    """
    known = labels.where(use & labels["toxic"].isNotNull()).groupBy(labels["doc_id"].cast("long").alias("_id")).agg(F.max(labels["toxic"].cast("int")).alias("_toxic"))
    n = known.count()
    share = min(1.0, train_docs / max(1, n))
    drawn = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 20)) < int(share * (1 << 20))
    rows = docs.select(docs["doc_id"].cast("long").alias("_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")).where(drawn(F.col("_id")))
    # the drawn labels are about train_docs rows of two numbers, so the texts need no shuffle
    rows = rows.join(F.broadcast(known.where(drawn(F.col("_id")))), "_id").groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.any_value("text").alias("text"), F.max("_toxic").alias("toxic"))
    rows = durable(rows.select("text", "toxic", F.pmod(F.crc32(F.col("h").cast("binary")), F.lit(FOLDS)).cast("int").alias("fold")))
    counted = "entry string, fold int, n bigint"

    def counts(names: frozenset | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: Counter[tuple[str, int]] = Counter()
            for batch in batches:
                for t, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    of = entries_of(letter_runs(fold(t)))
                    found.update((e, k) for e in (of if names is None else of & names))
            yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in found], pa.string()), pa.array([k for _, k in found], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["entry", "fold", "n"])

        return run

    def by_fold(found: DataFrame) -> DataFrame:
        return found.groupBy("entry").agg(*[F.sum(F.when(F.col("fold") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(FOLDS)])

    texts = lambda y: rows.where(F.col("toxic") == y).select("text", "fold")
    total = sum((F.col(f"n{k}") for k in range(FOLDS)), F.lit(0))
    toxic = by_fold(texts(1).mapInArrow(counts(None), counted)).where(total >= LEAST_SUPPORT).orderBy("entry").collect()
    entries = [r["entry"] for r in toxic]
    clean = {r["entry"]: r[1:] for r in by_fold(texts(0).mapInArrow(counts(frozenset(entries)), counted)).collect()}
    t = np.array([r[1:] for r in toxic], dtype=np.int64).reshape(len(entries), FOLDS)
    c = np.array([clean.get(e, (0,) * FOLDS) for e in entries], dtype=np.int64).reshape(len(entries), FOLDS)
    sizes = np.zeros((2, FOLDS), dtype=np.int64)
    for r in rows.groupBy("toxic", "fold").agg(F.count("*").alias("n")).collect():
        sizes[int(r["toxic"] == 1), r["fold"]] = r["n"]

    grid = [(ratio, odds) for ratio in RATIOS for odds in ODDS]

    def lexicon_of(without: int | None, ratio: float, odds: float) -> dict[str, float]:
        use_folds = [k for k in range(FOLDS) if k != without]
        return chosen(entries, t[:, use_folds].sum(axis=1), c[:, use_folds].sum(axis=1), int(sizes[1, use_folds].sum()), int(sizes[0, use_folds].sum()), ratio, odds)

    tried: list[dict[str, dict[int, float]]] = [{} for _ in range(FOLDS)]  # by fold: entry to its weight by place in the grid
    for k in range(FOLDS):
        for at, g in enumerate(grid):
            for e, w in lexicon_of(k, *g).items():
                tried[k].setdefault(e, {})[at] = w

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [features_by_words(t, tried[k], len(grid)) for t, k in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.list_(pa.float64()))], names=["toxic", "f"])

    seen = rows.select("text", "toxic", "fold").mapInArrow(features, "toxic int, f array<double>").toArrow()
    y = np.array(seen.column("toxic").to_pylist(), dtype=float)
    x = np.array(seen.column("f").to_pylist(), dtype=float).reshape(len(y), len(grid), 3)
    order = np.lexsort((*x.reshape(len(y), 3 * len(grid)).T, y))  # the order of rows does not matter then
    x, y = x[order], y[order]
    if len(set(y.tolist())) < 2:
        return Lexicon(lexicon_of(None, *grid[0]))
    curves = [fit_curve(x[:, at], y) for at in range(len(grid))]
    losses = [np.logaddexp(0, np.where(y == 1, -1, 1) * (w[0] + x[:, at] @ w[1:])).mean() for at, w in enumerate(curves)]
    best = int(np.argmin(np.round(losses, 9)))
    lexicon = Lexicon(lexicon_of(None, *grid[best]), curve=tuple(float(w) for w in curves[best]))
    lexicon.exceptions = exceptions(rows, lexicon)
    return lexicon


def features_by_words(text: str, weights: dict[str, dict[int, float]], n: int) -> list[float]:
    """The three features of a text under n lexicons, one after the other, without exceptions. weights: entry to its
    weight by lexicon."""
    folded = fold(text)
    found: list[list[tuple[float, int]]] = [[] for _ in range(n)]
    for w, times in Counter(letter_runs(folded)).items():
        best: dict[int, float] = {}
        for e in (w, *(w[:m] + PREFIX_MARK for m in PREFIXES if len(w) > m)):
            for at, weight in weights.get(e, {}).items():
                best[at] = max(weight, best.get(at, 0.0))
        for at, weight in best.items():
            found[at].append((weight, times))
    words = n_words(folded)
    return [v for f in found for v in _sums(f, words)]


def exceptions(rows: DataFrame, lexicon: Lexicon) -> list[str]:
    """Phrases of a lexicon entry with the word before or after it that stand in clean texts, hardly in toxic ones. rows:
    text, toxic."""

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        weights = lexicon.weights
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = fold(t).split()
                bare = ["".join(letter_runs(w)) for w in words]
                found = set()
                for k, w in enumerate(bare):
                    if w in weights or any(w[:n] + PREFIX_MARK in weights for n in PREFIXES if len(w) > n):
                        found.update(" ".join(words[a:b]) for a, b in ((k - 1, k + 1), (k, k + 2)) if a >= 0 and b <= len(words))
                for p in found:
                    counts.setdefault(p, [0, 0])[1 if y == 1 else 0] += 1
        yield pa.RecordBatch.from_pydict({"phrase": pa.array(list(counts), pa.string()), "clean": pa.array([c[0] for c in counts.values()], pa.int64()), "toxic": pa.array([c[1] for c in counts.values()], pa.int64())})

    found = rows.select("text", "toxic").mapInArrow(phrases, "phrase string, clean bigint, toxic bigint").groupBy("phrase").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    return [r["phrase"] for r in found.where("clean >= 3 AND clean >= 10 * toxic").orderBy("phrase").collect()]


SCORED = "doc_id bigint, held_out boolean, score double, predicted int, n_matches bigint"


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, n_matches of every row. Null texts count as empty, null ids are not held out, rows
    that repeat are scored each; other columns are not read. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lexicon.matcher()
        for batch in batches:
            found = [lexicon.features(t or "", made) for t in batch.column(2).to_pylist()]
            scores = [round(lexicon.score(*f[:3]), 6) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array([f[3] for f in found], pa.int64())],
                names=["doc_id", "held_out", "score", "predicted", "n_matches"],
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(held_out(docs["doc_id"]), F.lit(False)).alias("held_out"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCORED)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on the labels whose crc32(doc_id) mod 3 is not 1 and scores all documents; see score. Labels without an id or a
    value are not used; labels of documents that are not there neither."""
    return score(docs, learn(docs, labels, ~F.coalesce(held_out(labels["doc_id"]), F.lit(True))))
