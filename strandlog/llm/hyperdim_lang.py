"""Language identification by hyperdimensional profiles.

Every letter owns a random vector of +1 and -1. An n-gram's vector binds (multiplies) its letters' vectors, each
permuted (rotated) by its place in the n-gram; a text's profile bundles (adds) the vectors of all its n-grams. A
language's prototype bundles the profiles of its training documents; a text takes the language whose prototype is
nearest by cosine. Texts are lower-cased, and runs of anything but letters count as one gap.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlog.llm.common import free_name, lean_worker

DIMENSIONS = 1024
ORDER = 3
SEED = 7
#: A language's prototype is fitted on about so many distinct texts at most, drawn by a hash of the text.
TRAIN_DOCS = 5_000
#: Vectors of n-grams that a worker keeps.
KEPT_NGRAMS = 32_768
UNDETERMINED = "und"
#: Profiles are scaled to this length and rounded, so that sums over documents do not depend on their order.
UNIT = 1 << 20


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


class Profiler:
    """Profiles of texts. Keeps letter and n-gram vectors that it has made."""

    def __init__(self, dimensions: int = DIMENSIONS, order: int = ORDER, seed: int = SEED):
        if not 1 <= order <= 3:
            raise ValueError("order must be 1, 2 or 3")
        self.dimensions, self.order, self.seed = dimensions, order, seed
        self.letter: dict[int, np.ndarray] = {}
        self.row: dict[int, int] = {}
        self.table = np.empty((KEPT_NGRAMS, dimensions), dtype=np.int8)

    def of_letter(self, code: int) -> np.ndarray:
        if (v := self.letter.get(code)) is None:
            draw = np.random.Generator(np.random.PCG64([self.seed, code]))
            v = self.letter[code] = (draw.integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1).astype(np.int8)
        return v

    def of_ngram(self, key: int) -> np.ndarray:
        bound = np.ones(self.dimensions, dtype=np.int8)
        for place in range(self.order):
            bound = bound * np.roll(self.of_letter(key >> (21 * place) & 0x1FFFFF), place)
        return bound

    def rows(self, keys: list[int]) -> list[int]:
        if len(self.row) + len(keys) > KEPT_NGRAMS:
            self.row.clear()
        known = self.row
        found = []
        for key in keys:
            if (r := known.get(key)) is None:
                r = known[key] = len(known)
                self.table[r] = self.of_ngram(key)
            found.append(r)
        return found

    def ngrams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams, packed by 21 bits a letter, and their counts."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = np.where(letters()[codes], codes, 0)
        if not codes.any():
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        codes = np.concatenate(([0], codes, [0])).astype(np.int64)
        codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
        n = len(codes) - self.order + 1
        keys = sum(codes[self.order - 1 - k : self.order - 1 - k + n] << (21 * k) for k in range(self.order))
        return np.unique(keys, return_counts=True)

    def profile(self, text: str) -> np.ndarray | None:
        """Unit vector of a text; None where it has no letter."""
        keys, counts = self.ngrams(text)
        if not len(keys):
            return None
        total = np.zeros(self.dimensions, dtype=np.float64)
        for at in range(0, len(keys), 4096):
            part = self.rows(keys[at : at + 4096].tolist())
            total += counts[at : at + 4096].astype(np.float32) @ self.table[part].astype(np.float32)
        size = np.linalg.norm(total)
        return total / size if size else total


def learn(docs: DataFrame, text: Column, lang: Column, use: Column, train_docs: int = TRAIN_DOCS, dimensions: int = DIMENSIONS, order: int = ORDER, seed: int = SEED) -> dict[str, np.ndarray]:
    """Prototypes by language, from rows where use holds and the language is known. Equal texts of a language count once.

    Of a language with more distinct texts than train_docs, a share of them is drawn by a hash of the text; every language
    keeps a prototype at every size. What reaches the driver is one number for each language and dimension.
    """
    rows = docs.select(text.cast("string").alias("text"), lang.cast("string").alias("lang"), use.alias("use")).where("use AND lang IS NOT NULL AND text IS NOT NULL").drop("use")
    rows = rows.withColumn("h", F.xxhash64("text", F.lit(seed)))
    counted = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"))
    # one row a language
    shares = F.broadcast(counted.select("lang", F.least(F.lit(1.0), F.lit(float(train_docs)) / F.col("n")).alias("share")))
    drawn = rows.join(shares, "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    rows = drawn.dropDuplicates(["lang", "h"]).select("text", "lang")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        made = Profiler(dimensions, order, seed)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, label in zip(batch.column(0), batch.column(1), strict=True):
                if (v := made.profile(t.as_py())) is not None:
                    name = label.as_py()
                    sums[name] = sums.get(name, 0) + np.rint(v * UNIT).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "v": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))})

    parts = rows.mapInArrow(bundle, "lang string, v array<bigint>")
    sums = parts.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    found: dict[str, np.ndarray] = {}
    for r in sums.collect():
        found.setdefault(r["lang"], np.zeros(dimensions))[r["k"]] = r["x"]
    return {name: v / np.linalg.norm(v) for name, v in sorted(found.items()) if v.any()}


def identify(
    docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", keep: list[str] | None = None, out: tuple[str, str] = ("lang_pred", "score"), dimensions: int = DIMENSIONS, order: int = ORDER, seed: int = SEED,
) -> DataFrame:
    """The columns in keep, then the predicted language and the score under the names in out, of every row of docs.

    score is the cosine with the nearest prototype, 0 if negative; equal cosines go to the language first by name. A
    null text or one without a letter gets "und" and 0. Rows that repeat are predicted each. keep must not hold the names in
    out; other columns may have any name. One pass, no shuffle; the prototypes travel with the task.
    """
    keep = keep if keep is not None else [c for c in docs.columns if c != text_col]
    if clash := {c.lower() for c in keep} & {c.lower() for c in out}:
        raise ValueError(f"{sorted(clash)} are kept and made; give other names in out")
    names = list(prototypes)
    matrix = np.array([prototypes[n] for n in names]).reshape(len(names), dimensions)
    source = docs.select(*[docs[c] for c in keep], docs[text_col].cast("string").alias(free_name([*keep, *out], "text")))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        made = Profiler(dimensions, order, seed)
        for batch in batches:
            best, score = [], []
            for t in batch.column(batch.num_columns - 1):
                v = made.profile(t.as_py() or "")
                if v is None or not names:
                    best.append(UNDETERMINED)
                    score.append(0.0)
                    continue
                near = np.round(matrix @ v, 9)
                k = int(np.argmax(near))
                best.append(names[k])
                score.append(float(min(1.0, max(0.0, near[k]))))
            kept = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(best, pa.string()), pa.array(score, pa.float64())], names=[*keep, *out])

    return source.mapInArrow(predict, schema)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: fits on the documents whose crc32(doc_id) mod 5 is not 0 and predicts all of them.

    A document without an id is not held out and not learned from. Null and empty texts are "und". Other columns are not read."""
    use = ~F.coalesce(held_out(docs["doc_id"]), F.lit(True))
    prototypes = learn(docs, docs["text"], docs["lang"], use)
    rows = docs.select("doc_id", "text", F.coalesce(held_out(docs["doc_id"]), F.lit(False)).alias("held_out"))
    return identify(rows, prototypes, keep=["doc_id", "held_out"])
