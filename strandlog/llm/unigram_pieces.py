"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The segmentation of a text is the sequence of pieces with the highest sum of log scores. Spaces become the marker
U+2581 and one marker is put before a text that is not empty. A character that no piece holds is written as its UTF-8
bytes (byte fallback), and so is a marker that stands in the text itself; decoding therefore gives back every text
exactly.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARKER = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: A character written as bytes scores so much below the worst piece.
FALLBACK_PENALTY = 10.0
#: Words whose segmentation a worker keeps, twice: when there are more, those not met since go.
KEPT_WORDS = 250_000

NORMAL, BYTE, OTHER = 0, 1, 2
_MARKS = ",.;:!?\"'()"
_LETTER = re.compile(r"[^\W\d_]")


class Pieces:
    """A vocabulary: text, log score and kind of each id."""

    def __init__(self, texts: list[str], scores: list[float], kinds: list[int]):
        self.texts, self.scores, self.kinds = texts, scores, kinds

    @classmethod
    def from_file(cls, path: str = MODEL, scores: str = "rank") -> Pieces:
        """Pieces of a SentencePiece model file.

        scores="model" takes the file's own scores as log scores (unigram models). scores="rank" is for models whose
        scores are only minus a merge rank: piece r of n gets the log of its Zipf share, -ln(r + 1) - ln(H_n).
        """
        import sentencepiece

        file = sentencepiece.SentencePieceProcessor(model_file=path)
        n = file.get_piece_size()
        kinds = [BYTE if file.is_byte(i) else OTHER if file.is_control(i) or file.is_unknown(i) or file.is_unused(i) else NORMAL for i in range(n)]
        own = [file.get_score(i) for i in range(n)]
        if scores == "rank":
            normal = [i for i in range(n) if kinds[i] == NORMAL]
            share = math.log(sum(1 / r for r in range(1, len(normal) + 1)))
            own = [-math.log(1 - s) - share if k == NORMAL else 0.0 for s, k in zip(own, kinds, strict=True)]
        return cls([file.id_to_piece(i) for i in range(n)], own, kinds)


class DoubleArray:
    """A trie over UTF-8 bytes in two arrays: the child of node s by byte c is t = base[s] + c + 1 if check[t] == s."""

    def __init__(self, entries: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for key, value in sorted(entries.items()):
            at = 0
            for c in key:
                nxt = children[at].get(c)
                if nxt is None:
                    nxt = children[at][c] = len(children)
                    children.append({})
                    ends.append(-1)
                at = nxt
            ends[at] = value
        size = 2 * len(children) + 2048
        base, check, value = (np.full(size, fill, dtype=np.int32) for fill in (0, -1, -1))
        check[0], value[0] = 0, ends[0]
        empty = np.ones(size, dtype=bool)
        empty[0] = False
        first, waiting = 1, [(0, 0)]
        while waiting:
            node, slot = waiting.pop()
            if not children[node]:
                base[slot] = -1
                continue
            codes = sorted(children[node])
            if not empty[first]:
                first += int(np.argmax(empty[first:]))
            at = max(0, first - codes[0] - 1)
            while True:
                while at + 4096 + 257 > len(empty):
                    base, check, value = (np.concatenate([x, np.full(len(x), fill, dtype=np.int32)]) for x, fill in ((base, 0), (check, -1), (value, -1)))
                    empty = np.concatenate([empty, np.ones(len(empty), dtype=bool)])
                fits = empty[at + codes[0] + 1 : at + codes[0] + 4097].copy()
                for c in codes[1:]:
                    fits &= empty[at + c + 1 : at + c + 4097]
                if fits.any():
                    break
                at += 4096
            at += int(np.argmax(fits))
            base[slot] = at
            for c in codes:
                kid = children[node][c]
                check[at + c + 1], value[at + c + 1], empty[at + c + 1] = slot, ends[kid], False
                waiting.append((kid, at + c + 1))
        self.base, self.check, self.value = base, check, value

    def prefixes(self, data: bytes, at: int) -> list[tuple[int, int]]:
        """(end, value) of every entry that starts in data at the given place, shortest first."""
        found, node = [], 0
        for j in range(at, len(data)):
            b = self.base[node]
            nxt = b + data[j] + 1
            if b < 0 or self.check[nxt] != node:
                break
            node = nxt
            if self.value[node] >= 0:
                found.append((j + 1, self.value[node]))
        return found


class Encoder:
    def __init__(self, pieces: Pieces, trie: DoubleArray | None = None):
        normal = {p.encode(): i for i, (p, k) in enumerate(zip(pieces.texts, pieces.kinds, strict=True)) if k == NORMAL and p}
        for p in normal:
            if MARKER in p.decode().lstrip(MARKER):
                raise ValueError("a marker inside a piece is not supported")
        self.pieces = pieces
        self.trie = trie or DoubleArray(normal)
        # the walk reads whole lists: Python lists are faster to index than arrays
        self.base, self.check, self.value = self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist()
        self.scores = pieces.scores
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces.texts, pieces.kinds, strict=True)) if k == BYTE}
        if len(self.bytes) != 256:
            raise ValueError("byte fallback needs a piece for each of the 256 bytes")
        self.fallback = min((pieces.scores[i] for i in normal.values()), default=0.0) - FALLBACK_PENALTY
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARKER, " ").encode() if k == NORMAL else b"" for p, k in zip(pieces.texts, pieces.kinds, strict=True)]
        # Words stand alone where no piece spans their edge: at a space after other characters, at a line feed if no
        # piece holds one, and between a letter and a punctuation mark where no piece has the two side by side.
        texts = [p.decode() for p in normal]
        alone = "\n" if not any("\n" in t for t in texts) else ""
        odd = {a for t in texts for a, b in zip(t, t[1:], strict=False) if b in _MARKS and _LETTER.fullmatch(a)}
        odd = odd if len(odd) < 64 else set()
        marks = "".join(m for m in _MARKS if not any(_LETTER.fullmatch(a) and a not in odd and b == m for t in texts for a, b in zip(t, t[1:], strict=False)))
        before_mark = rf" *[^\W\d_{re.escape(''.join(sorted(odd)))}]+(?=[{re.escape(marks)}])|" if marks else ""
        self.words = re.compile(f"{MARKER}|" + (f"{alone}|" if alone else "") + before_mark + f" *[^ {MARKER}{alone}]+| +").findall
        self.before: dict[str, tuple[bytes, int, float]] = {}
        self.known: dict[str, tuple[bytes, int, float]] = {}

    def viterbi(self, word: str) -> tuple[list[int], float]:
        """Best ids and their score for a word: spaces, then other characters."""
        if word == MARKER:
            return [self.bytes[c] for c in MARKER.encode()], self.fallback
        data = word.replace(" ", MARKER).encode()
        n = len(data)
        base, check, value, scores = self.base, self.check, self.value, self.scores
        least = -math.inf
        best = [least] * (n + 1)
        come = [0] * (n + 1)
        with_id = [-1] * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            lead = data[i]
            step = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            sofar = best[i]
            covered = False
            node, j = 0, i
            while j < n:
                b = base[node]
                if b < 0:
                    break
                nxt = b + data[j] + 1
                if check[nxt] != node:
                    break
                node = nxt
                j += 1
                v = value[node]
                if v >= 0:
                    covered |= j == i + step
                    s = sofar + scores[v]
                    if s > best[j]:
                        best[j], come[j], with_id[j] = s, i, v
            if not covered:
                j = i + step
                s = sofar + self.fallback
                if s > best[j]:
                    best[j], come[j], with_id[j] = s, i, -1
            i += step
        back: list[int] = []
        at = n
        while at > 0:
            if with_id[at] >= 0:
                back.append(with_id[at])
            else:
                back.extend(self.bytes[c] for c in reversed(data[come[at] : at]))
            at = come[at]
        back.reverse()
        return back, best[n]

    def segments(self, text: str) -> list[tuple[bytes, int, float]]:
        """For each word of text: its ids as little-endian int32, how many of them are bytes, their score."""
        if not text:
            return []
        known, kinds = self.known, self.pieces.kinds
        found = []
        for word in self.words(f" {text}"):
            if (got := known.get(word)) is None:
                if (got := self.before.get(word)) is None:
                    ids, score = self.viterbi(word)
                    got = (array("i", ids).tobytes(), sum([kinds[i] == BYTE for i in ids]), score)
                if len(known) >= KEPT_WORDS:
                    self.before = known
                    known = self.known = {}
                if len(word) <= 64:
                    known[word] = got
            found.append(got)
        return found

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join([s[0] for s in self.segments(text)]), dtype="<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        raw = self.raw
        joined = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return joined[1:] if joined.startswith(" ") else joined


@lru_cache(maxsize=2)
def encoder_parts(path: str, scores: str) -> tuple[Pieces, DoubleArray]:
    """Read and built once on the driver; the arrays travel to the executors, which need no file."""
    pieces = Pieces.from_file(path, scores)
    return pieces, Encoder(pieces).trie


_at_worker: dict[tuple[str, str], Encoder] = {}


def _encoder(key: tuple[str, str], parts: tuple[Pieces, DoubleArray]) -> Encoder:
    if key not in _at_worker:
        _at_worker.clear()
        _at_worker[key] = Encoder(*parts)
    return _at_worker[key]


def encode_documents(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, model: str = MODEL, scores: str = "rank") -> DataFrame:
    """The columns in keep and ids array<int> of every row. A null text gives null ids, an empty one no ids."""
    keep = keep if keep is not None else [c for c in docs.columns if c not in (text_col, "ids")]
    key, parts = (model, scores), encoder_parts(model, scores)
    source = docs.select(*[docs[c] for c in keep], docs[text_col].cast("string").alias("_text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _encoder(key, parts)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                texts = piece.column(piece.num_columns - 1).to_pylist()
                raw = [None if t is None else b"".join([s[0] for s in made.segments(t)]) for t in texts]
                ends = np.cumsum([0] + [len(r or b"") // 4 for r in raw]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join([r or b"" for r in raw]), dtype="<i4"))
                absent = pa.array([r is None for r in raw], pa.bool_())
                ids = pa.ListArray.from_arrays(pa.array(ends), values, mask=absent)
                yield pa.RecordBatch.from_arrays([*[piece.column(k) for k in range(piece.num_columns - 1)], ids], names=[*keep, "ids"])

    return source.mapInArrow(run, schema)


def decode_documents(rows: DataFrame, ids_col: str = "ids", keep: list[str] | None = None, model: str = MODEL, scores: str = "rank") -> DataFrame:
    """The columns in keep and the text of every row's ids. Null ids give a null text."""
    keep = keep if keep is not None else [c for c in rows.columns if c not in (ids_col, "text")]
    key, parts = (model, scores), encoder_parts(model, scores)
    source = rows.select(*[rows[c] for c in keep], rows[ids_col].alias("_ids"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _encoder(key, parts)
        for batch in batches:
            texts = [None if not v.is_valid else made.decode(v.as_py()) for v in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(batch.num_columns - 1)], pa.array(texts, pa.string())], names=[*keep, "text"])

    return source.mapInArrow(run, schema)


DIGEST = "doc_id bigint, n_tokens bigint, n_byte_tokens bigint, log_score double, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def encoding_digest(docs: DataFrame, model: str = MODEL, scores: str = "rank") -> DataFrame:
    """One row per document: counts, the sum of log scores, hashes of the ids (little-endian int32) and of the decoded text.

    Null texts count as empty: no tokens, score 0. Rows that repeat are encoded each on their own. One pass, no
    shuffle.
    """
    key, parts = (model, scores), encoder_parts(model, scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _encoder(key, parts)
        for batch in batches:
            rows = []
            for t in batch.column(1):
                text = t.as_py() or ""
                found = made.segments(text)
                raw = b"".join([s[0] for s in found])
                back = made.decode(np.frombuffer(raw, dtype="<i4").tolist())
                rows.append((len(raw) // 4, sum([s[1] for s in found]), round(math.fsum([s[2] for s in found]), 6), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == text))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_tokens", "n_byte_tokens", "log_score", "ids_sha256", "decoded_sha256", "round_trip"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, DIGEST)
