"""Word shingles of many texts at once, as 64-bit hashes in numpy arrays.

Words are runs of anything but ASCII white space in the lower-cased text. A shingle is a run of words; a text with
fewer words than that has one shingle, all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from strandlog.llm.common import byte_table, mix64

WORDS = 5
#: Texts are hashed together up to about so many bytes.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_BYTES = byte_table(11)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _ODD), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(16, (n - 1).bit_length()))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of its text), in order."""
    raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    space = _SPACE[raw]
    change = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        change = np.concatenate(([0], change))
    starts, ends = change[::2], change[1::2]
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[raw] * up[: len(raw)], out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * down[starts])
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return hashes, np.searchsorted(begins, starts, side="right") - 1


def shingle_hashes(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, number of its text), in order of the texts."""
    h, owner = word_hashes(texts)
    n = len(h)
    if not n:
        return h, owner
    rolled = np.zeros(max(0, n - words + 1), dtype=np.uint64)
    for k in range(words):
        rolled += h[k : k + len(rolled)] * _powers(1 << 16)[0][words - k]
    whole = owner[: len(rolled)] == owner[words - 1 :] if len(rolled) else np.zeros(0, dtype=bool)
    found, of = mix64(rolled[whole]), owner[: len(rolled)][whole]
    counts = np.bincount(owner, minlength=len(texts))
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        first = np.cumsum(counts) - counts
        extra = [mix64(np.array([sum(int(h[first[d] + k]) * int(_powers(1 << 16)[0][words - k]) for k in range(counts[d])) + int(counts[d]) & (1 << 64) - 1], dtype=np.uint64))[0] for d in short]
        found, of = np.concatenate([found, np.array(extra, dtype=np.uint64)]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        found, of = found[order], of[order]
    return found, of


def folded(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def in_chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes together; a longer text stands alone."""
    at = size = 0
    for k, t in enumerate(texts):
        if k > at and size + len(t) > limit:
            yield at, k
            at, size = k, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def multiset(text: bytes, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of one text, sorted, and their counts."""
    return np.unique(shingle_hashes([text], words)[0], return_counts=True)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller counts over the sum of the larger ones; 0 for two texts without shingles."""
    total = int(a[1].sum() + b[1].sum())
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (total - both) if total else 0.0
