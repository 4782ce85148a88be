"""Quality rules by compression: zstandard ratios of whole documents and of fixed chunks that cover them.

A text that repeats itself compresses far better than prose of its length, and noise hardly at all. Because a ratio
falls with length even for clean prose, each length has limits of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandlog.llm.common import arrow_schema

#: (least bytes, lowest ratio, highest ratio) of whole texts. Below 64 bytes a ratio says nothing.
WHOLE_BANDS = [(0, 0.0, 9.0), (64, 0.30, 1.40), (128, 0.35, 1.10), (256, 0.40, 0.95), (512, 0.38, 0.85), (1024, 0.36, 0.76), (4096, 0.33, 0.72), (16384, 0.30, 0.70), (65536, 0.25, 0.70)]
#: The same of one chunk. All chunks of a text have one length (the last ends where the text ends), so one line holds.
CHUNK_BAND = (0.30, 0.76)
CHUNK_BYTES = 2048
#: (bytes, lowest ratio, highest ratio) of the chunks of texts that are no longer than one chunk of the size before.
SMALL_CHUNKS = [(512, 0.38, 0.85), (128, 0.35, 1.03)]
#: A document fails when more than this share of its chunks lies outside CHUNK_BAND.
BAD_CHUNK_SHARE = 0.25
LEVEL = 3

SYMBOLS = "#*$%&|<>"
SPACES = "\x20\t\n\x0b\x0c\r"

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("ratio", T.DoubleType())]
    + [T.StructField("n_chunks", T.LongType()), T.StructField("n_bad_chunks", T.LongType())]
)


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of three words that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    pair = np.unique(seq[:-1] * len(ids) + seq[1:], return_inverse=True)[1].astype(np.int64)
    _, at, counts = np.unique(pair[:-1] * len(ids) + seq[2:], return_inverse=True, return_counts=True)
    twice = counts[at] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. Words end at ASCII white space only."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: set[bytes] = set()
    repeated_lines = 0
    for line in raw.split(b"\n"):
        if line.strip():
            repeated_lines += line in seen
            seen.add(line)
    return (
        len(words),
        len(text) - sum(text.count(c) for c in SPACES),
        sum(text.count(c) for c in SYMBOLS),
        repeated_lines,
        repeated_words(words),
    )


def band_of(n_bytes: int, bands: list[tuple[int, float, float]]) -> tuple[float, float]:
    return next((low, high) for least, low, high in reversed(bands) if n_bytes >= least)


def chunks_of(n_bytes: int, size: int) -> list[int]:
    """Where chunks of a text begin: at every multiple of size; the last one is moved back to end with the text."""
    return [*range(0, n_bytes - size + 1, size), *([n_bytes - size] if n_bytes % size else [])]


def judged(raw: bytes, zip_: zstandard.ZstdCompressor, bands: list, chunk_band: tuple, chunk_bytes: int, bad_share: float) -> tuple[bool, float, int, int]:
    """Whether the ratios lie in their bands, the whole ratio (1 for an empty text), chunks, chunks out of band.

    Every byte lies in a chunk. A text that is no longer than the smallest chunk is one chunk with the limits of a whole.
    """
    if not raw:
        return True, 1.0, 0, 0
    ratio = len(zip_.compress(raw)) / len(raw)
    low, high = band_of(len(raw), bands)
    sizes = [(chunk_bytes, *chunk_band), *(x for x in SMALL_CHUNKS if x[0] < chunk_bytes)]
    size, least, most = next((x for x in sizes if len(raw) > x[0]), (len(raw), low, high))
    starts = chunks_of(len(raw), size)
    bad = sum(not least <= len(zip_.compress(raw[at : at + size])) / size <= most for at in starts)
    return low <= ratio <= high and bad <= bad_share * len(starts), ratio, len(starts), bad


def compression_bands(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    bands: list[tuple[int, float, float]] | None = None,
    chunk_band: tuple[float, float] = CHUNK_BAND,
    chunk_bytes: int = CHUNK_BYTES,
    bad_share: float = BAD_CHUNK_SHARE,
    level: int = LEVEL,
) -> DataFrame:
    """One row per input row with base counts and the verdict of the compression bands.

    A null text counts as empty: no words, so base_failed. Null ids stay null, repeated rows are judged each on their
    own, other columns are not read. One pass, no shuffle.
    """
    limits = bands or WHOLE_BANDS

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=level)
        out = arrow_schema(SCHEMA)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                t = text.as_py() or ""
                counts = base_counts(t)
                fine, ratio, chunks, bad = judged(t.encode("utf-8", "surrogatepass"), zip_, limits, chunk_band, chunk_bytes, bad_share)
                failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
                rows.append((*counts, failed, fine and not failed, ratio, chunks, bad))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 10
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(out)[1:], strict=True))], schema=out)

    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return source.mapInArrow(judge, SCHEMA)
