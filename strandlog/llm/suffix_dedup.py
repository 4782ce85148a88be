"""Removal of byte strings that occur twice, by distributed prefix doubling over thinned positions.

A position's rank at offset h is a name of the h bytes that start there; ranks are made from the bytes, so equal strings
have equal ranks wherever they stand. A global round sorts ranks and drops every position whose rank is unique:

1. At half the threshold (100 bytes), only positions are ranked whose rank is the least within a stretch of 101. Any
   string of 200 bytes holds such a position, chosen by its bytes alone, and a string that occurs twice holds it twice.
   So positions can be thinned to two in a hundred here.
2. At the threshold, all positions are ranked whose string holds a survivor of the first round: by the pair of the ranks
   at half of the position and of the one half further on, and by a second name of the whole string, 96 bits together.

What stays are the positions whose string of 200 bytes starts elsewhere too. Ranks travel packed, dealt by their leading
bits; before the second round texts are put beside their copies, so that a group sends a rank once. The survivors of the
first round come back as a bitmap of bounded size; a false hit in it only sends positions to the second round that this then
drops. Texts are ranked in pieces, so a text may be as long as a row can be.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm.common import byte_table, durable, free_name, lean_worker, mix64
from strandlog.llm.shingles import powers

LENGTH = 200
#: Ranks of one bucket are sorted together in a task; about so many are meant for one, and up to sixteen times as many where
#: there are over MANY_BUCKETS, so that a pack still holds several ranks of a bucket.
BUCKET_RANKS, MANY_BUCKETS = 1 << 18, 1 << 16
#: The bitmap has eight bits or more for each thinned position, up to this many (128 MB).
MOST_BITS = 1 << 30
#: Texts are packed into groups of about so many bytes.
GROUP_BYTES = 1 << 22
#: Positions of a text that are ranked at once, and ranks that are packed at once.
PIECE, PART_RANKS = 1 << 21, 1 << 20

_TABLE, _SECOND = byte_table(3), byte_table(5)
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def sliding(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over every stretch of width values."""
    n = 1
    while n * 2 <= width:
        x = f(x[:-n], x[n:])
        n *= 2
    return f(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def window_hashes(raw: np.ndarray, length: int, table: np.ndarray) -> np.ndarray:
    """A polynomial hash of the string of the given length at every position."""
    n = len(raw)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(table[raw] * up[:n], out=sums[1:])
    return mix64((sums[length:] - sums[:-length]) * down[: n - length + 1])


def half_ranks(raw: np.ndarray, half: int) -> np.ndarray:
    """Rank at half the threshold of every position."""
    return window_hashes(raw, half, _TABLE)


def full_names(raw: np.ndarray, half: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two names of the string of the given length at every position: 64 bits of the half ranks at it and at length - half
    further on, and 32 bits of the whole string by another table."""
    halves, step = half_ranks(raw, half), length - half
    return mix64(halves[:-step] * _PAIR + halves[step:]), (window_hashes(raw, length, _SECOND) >> np.uint64(32)).astype(np.uint32)


def thinned(halves: np.ndarray, half: int, length: int) -> np.ndarray:
    """Positions whose rank is the least of some stretch that lies in one string of the given length."""
    width = length - half + 1
    if len(halves) < width:
        return np.empty(0, dtype=np.int64)
    least = sliding(halves, width, np.minimum)
    edge = np.zeros(width - 1, dtype=np.uint64)
    return np.flatnonzero(sliding(np.concatenate([edge, least, edge]), width, np.maximum) == halves)


def spread(ranks: np.ndarray) -> np.ndarray:
    """Ranks that were chosen for being small, spread evenly again."""
    return mix64(ranks ^ _PAIR)


def places(ranks: np.ndarray, bucket_bits: int, map_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each rank in the bitmap, both in the stretch of its bucket."""
    inner = np.uint64((1 << (map_bits - bucket_bits)) - 1)
    first = ranks >> np.uint64(64 - map_bits)
    return first.astype(np.int64), ((first & ~inner) | (ranks & inner)).astype(np.int64)


def thinned_ranks(raw: np.ndarray, half: int, length: int, piece: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Thinned positions of a text, their half ranks and the least half rank, for one piece of positions after the other."""
    reach = length - half  # a position is chosen by the stretches that hold it
    for begin in range(0, max(0, len(raw) - half + 1), piece):
        low = max(0, begin - reach)
        part = raw[low : begin + piece + reach + half - 1]
        if len(part) < length:  # the text's last positions: no string of this length begins or ends in them alone
            part = raw[max(0, len(raw) - length) :]
            low = len(raw) - len(part)
        h = half_ranks(part, half)
        at = thinned(h, half, length)
        at = at[(at + low >= begin) & (at + low < begin + piece)]
        yield at + low, h[at], int(h.min())


def candidate_runs(raw: np.ndarray, half: int, length: int, bits: np.ndarray, bucket_bits: int, map_bits: int, piece: int) -> tuple[np.ndarray, int]:
    """[(first, last + 1)] of the runs of start positions whose string holds a thinned position with its rank in the bitmap;
    the least half rank."""
    reach, starts = length - half, len(raw) - length + 1
    hits, least = [], 1 << 64
    for at, ranks, low in thinned_ranks(raw, half, length, piece):
        one, two = ((bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1 for p in places(spread(ranks), bucket_bits, map_bits))
        hits.append(at[one & two])
        least = min(least, low)
    found = np.concatenate(hits) if hits else np.empty(0, dtype=np.int64)
    if not len(found):
        return np.empty((0, 2), dtype=np.int64), least
    first, end = np.maximum(found - reach, 0), np.minimum(found + 1, starts)
    fresh = np.concatenate(([True], first[1:] > end[:-1]))
    last = np.concatenate((np.flatnonzero(fresh)[1:] - 1, [len(found) - 1]))
    return np.stack([first[fresh], end[last]], axis=1), least


def named_starts(raw: np.ndarray, runs: np.ndarray, half: int, length: int, piece: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start positions, their two names) of the runs of a text, for one piece after the other."""
    for first, end in runs.tolist():
        for begin in range(first, end, piece):
            stop = min(end, begin + piece)
            yield np.arange(begin, stop), *full_names(raw[begin : stop + length - 1], half, length)


def distinct_names(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order, how often each comes, and the place of every given pair among them."""
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    fresh = np.ones(len(a), dtype=bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    place = np.empty(len(a), dtype=np.int64)
    place[order] = np.cumsum(fresh) - 1
    return a[fresh], b[fresh], np.bincount(place, minlength=int(fresh.sum())), place


def packed(ranks: np.ndarray, bucket_bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """For each bucket (leading bits) with ranks: its number, distinct ranks, and a bit for each if it came twice."""
    if not len(ranks):
        return
    distinct, counts = np.unique(ranks, return_counts=True)
    bucket = (distinct >> np.uint64(64 - bucket_bits)).astype(np.int64) if bucket_bits else np.zeros(len(distinct), dtype=np.int64)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(distinct)]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(bucket[a]), distinct[a:b].tobytes(), np.packbits(counts[a:b] > 1).tobytes()


def unpacked(ranks: list[bytes], twice: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of all packs, whether each came twice in its pack, and the lengths of the packs."""
    parts = [np.frombuffer(r, dtype=np.uint64) for r in ranks]
    flags = [np.unpackbits(np.frombuffer(t, dtype=np.uint8), count=len(p)).astype(bool) for t, p in zip(twice, parts, strict=True)]
    return np.concatenate(parts), np.concatenate(flags), np.array([len(p) for p in parts])


def repeated(ranks: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """The ranks, sorted, that stand in two packs or twice in one."""
    order = np.argsort(ranks, kind="stable")
    r, t = ranks[order], twice[order]
    same = r[1:] == r[:-1]
    return np.unique(np.concatenate([r[t], r[1:][same]]))


def packed_names(one: np.ndarray, two: np.ndarray, counts: np.ndarray, bucket_bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """The same of distinct pairs of names: first those of one, then those of two."""
    bucket = (one >> np.uint64(64 - bucket_bits)).astype(np.int64)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(one)]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(bucket[a]), one[a:b].tobytes() + two[a:b].tobytes(), np.packbits(counts[a:b] > 1).tobytes()


def repeated_names(packs: list[bytes], twice: list[bytes]) -> list[bytes]:
    """For each pack, a bit for each name that stands in another pack too or came twice in its own."""
    sizes = [len(p) // 12 for p in packs]
    one = np.concatenate([np.frombuffer(p, dtype=np.uint64, count=n) for p, n in zip(packs, sizes, strict=True)])
    two = np.concatenate([np.frombuffer(p, dtype=np.uint32, offset=8 * n) for p, n in zip(packs, sizes, strict=True)])
    own = np.concatenate([np.unpackbits(np.frombuffer(t, dtype=np.uint8), count=n).astype(bool) for t, n in zip(twice, sizes, strict=True)])
    _, _, counts, place = distinct_names(one, two)
    again = counts > 1
    again[place[own]] = True
    return [np.packbits(x).tobytes() for x in np.split(again[place], np.cumsum(sizes)[:-1])]


def joined_spans(spans: list[np.ndarray]) -> np.ndarray:
    """Spans in order, those that touch or overlap as one."""
    found = np.concatenate(spans) if spans else np.empty((0, 2), dtype=np.int64)
    if len(found) < 2:
        return found
    fresh = np.concatenate(([True], found[1:, 0] > np.maximum.accumulate(found[:, 1])[:-1]))
    last = np.concatenate((np.flatnonzero(fresh)[1:] - 1, [len(found) - 1]))
    return np.stack([found[fresh, 0], np.maximum.accumulate(found[:, 1])[last]], axis=1)


def removed_spans(starts: np.ndarray, length: int) -> np.ndarray:
    """[(begin, end)] of the maximal runs of bytes that the strings at the sorted starts cover."""
    if not len(starts):
        return np.empty((0, 2), dtype=np.int64)
    fresh = np.concatenate(([True], starts[1:] > starts[:-1] + length))
    last = np.concatenate((np.flatnonzero(fresh)[1:] - 1, [len(starts) - 1]))
    return np.stack([starts[fresh], starts[last] + length], axis=1)


def without(raw: bytes, spans: np.ndarray) -> bytes:
    at, kept = 0, []
    for begin, end in spans.tolist():
        kept.append(raw[at:begin])
        at = end
    kept.append(raw[at:])
    return b"".join(kept)


def bucket_bits_of(ranks: float) -> int:
    fine = pow2_at_least(ranks / BUCKET_RANKS)
    many = pow2_at_least(MANY_BUCKETS)
    return max(4, fine if fine <= many else max(many, fine - 4))


def pow2_at_least(n: float) -> int:
    return max(0, int(np.ceil(np.log2(max(1.0, n)))))


RESULT = ("id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text_sha256", "spans")
_RESULT_SCHEMA = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, text_sha256 string, spans binary"


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, text_sha256, spans (int64 pairs: begin, end) of every row.

    Texts are UTF-8 bytes, null counts as empty. Every byte goes that is covered by a string of `length` bytes which
    also starts at another place, in the same text or another; rows with equal texts are places of their own. Texts
    shorter than that lose nothing. Ids may be null or repeat; they are only carried along.
    """
    half = length // 2
    source = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    sized = source.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    bucket_bits = bucket_bits_of(2 * sized / (length - half + 1))
    map_bits = max(bucket_bits + 3, min(pow2_at_least(16 * sized / (length - half + 1)), pow2_at_least(MOST_BITS)))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        found: list[np.ndarray] = []
        size = 0

        def give() -> Iterator[pa.RecordBatch]:
            rows = list(packed(np.concatenate(found), bucket_bits)) if found else []
            if rows:
                b, r, t = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(r, pa.binary()), pa.array(t, pa.binary())], names=["bucket", "ranks", "twice"])

        for batch in batches:
            for t in batch.column(1):
                raw = np.frombuffer(t.as_py().encode("utf-8", "surrogatepass"), dtype=np.uint8)
                if len(raw) < length:
                    continue
                for _, ranks, _ in thinned_ranks(raw, half, length, PIECE):
                    found.append(spread(ranks))
                    size += len(ranks)
                    if size > PART_RANKS:
                        yield from give()
                        found, size = [], 0
        yield from give()

    def first_round(table: pa.Table) -> pa.Table:
        ranks, twice, _ = unpacked(table.column("ranks").to_pylist(), table.column("twice").to_pylist())
        bucket = table.column("bucket")[0].as_py()
        segment = np.zeros(1 << (map_bits - bucket_bits), dtype=np.uint8)
        for place in places(repeated(ranks, twice), bucket_bits, map_bits):
            segment[place - (bucket << (map_bits - bucket_bits))] = 1
        return pa.table({"bucket": [bucket], "bits": pa.array([np.packbits(segment, bitorder="little").tobytes()], pa.binary())})

    packs = source.select("id", "text").mapInArrow(first, "bucket bigint, ranks binary, twice binary")
    segments = packs.groupBy("bucket").applyInArrow(first_round, "bucket bigint, bits binary")
    bitmap = np.zeros(1 << (map_bits - 3), dtype=np.uint8)
    per = len(bitmap) >> bucket_bits
    collected = segments.toArrow()  # of bounded size: MOST_BITS
    for bucket, bits in zip(collected.column("bucket").to_pylist(), collected.column("bits"), strict=True):
        bitmap[bucket * per : (bucket + 1) * per] = np.frombuffer(bits.as_py(), dtype=np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    told = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.string()), ("route", pa.int64()), ("n_starts", pa.int64()), ("raw", pa.binary())])
    plain = pa.schema([*list(told)[:3], ("grp", pa.string()), ("n_starts", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("raw", pa.binary())])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every row; with its text where it has candidates. route: its least rank, the same for most copies."""
        lean_worker()
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=3)
        bits = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = []
                for i, t in zip(batch.column(0).slice(at, 1000).to_pylist(), batch.column(1).slice(at, 1000), strict=True):
                    raw = t.as_py().encode("utf-8", "surrogatepass")
                    starts, route = 0, 0 if i is None else i
                    if len(raw) >= length:
                        runs, least = candidate_runs(np.frombuffer(raw, dtype=np.uint8), half, length, bits, bucket_bits, map_bits, PIECE)
                        starts, route = int((runs[:, 1] - runs[:, 0]).sum()), least - (1 << 63)
                    rows.append((i, len(raw), hashlib.sha256(raw).hexdigest(), route, starts, zip_.compress(raw) if starts else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), told, strict=True)], schema=told)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of texts that lose nothing as they are; the others in groups, copies beside each other."""
        import zstandard

        task = TaskContext.get().partitionId()
        zip_, unzip, serial = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor(), 0
        held: list[tuple[int | None, bytes, int]] = []
        size = 0

        def give() -> pa.RecordBatch:
            nonlocal serial, held, size
            ids = np.array([0 if i is None else i for i, _, _ in held], dtype=np.int64).tobytes() + bytes(i is None for i, _, _ in held)
            sizes = np.array([len(raw) for _, raw, _ in held], dtype=np.int64).tobytes()
            row = pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((None, None, None, f"{task}-{serial}", sum(n for _, _, n in held), ids, sizes, zip_.compress(b"".join(raw for _, raw, _ in held))), plain, strict=True)], schema=plain)
            serial, held, size = serial + 1, [], 0
            return row

        for batch in batches:
            with_text = batch.column(5).is_valid()
            clean = batch.filter(pa.compute.invert(with_text))
            if clean.num_rows:
                absent = [pa.nulls(clean.num_rows, f.type) for f in list(plain)[3:]]
                yield pa.RecordBatch.from_arrays([*(clean.column(k) for k in range(3)), *absent], schema=plain)
            rest = batch.filter(with_text)
            for i, n, z in zip(rest.column(0).to_pylist(), rest.column(4).to_pylist(), rest.column(5), strict=True):
                held.append((i, unzip.decompress(z.as_py()), n))
                size += len(held[-1][1])
                if size >= GROUP_BYTES:
                    yield give()
        if held:
            yield give()

    routed = source.mapInArrow(second, "id bigint, n_bytes bigint, sha string, route bigint, n_starts bigint, raw binary").hint("rebalance", "route").sortWithinPartitions("route", "sha")
    sorted_out = durable(routed.mapInArrow(pack, "id bigint, n_bytes bigint, sha string, grp string, n_starts bigint, ids binary, sizes binary, raw binary"))
    groups = sorted_out.where("grp IS NOT NULL")
    starts = groups.agg(F.sum("n_starts")).first()[0] or 0
    full_bits = bucket_bits_of(starts)

    def parts_of(raws: bytes, sizes: np.ndarray) -> Iterator[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
        """(text, candidate starts, their names) of a group's texts, as many at a time as are packed together."""
        at, held, size = 0, [], 0
        for k, n in enumerate(sizes.tolist()):
            raw = np.frombuffer(raws, dtype=np.uint8, count=n, offset=at)
            at += n
            runs, _ = candidate_runs(raw, half, length, shared.value, bucket_bits, map_bits, PIECE)
            for starts, one, two in named_starts(raw, runs, half, length, PART_RANKS):
                held.append((k, starts, one, two))
                size += len(starts)
                if size >= PART_RANKS:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def names_of(part: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return distinct_names(np.concatenate([p[2] for p in part]), np.concatenate([p[3] for p in part]))

    def third(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for grp, sizes, raw in zip(*(batch.column(k) for k in range(3)), strict=True):
                for no, part in enumerate(parts_of(unzip.decompress(raw.as_py()), np.frombuffer(sizes.as_py(), dtype=np.int64))):
                    one, two, counts, _ = names_of(part)
                    b, r, t = zip(*packed_names(one, two, counts, full_bits), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([grp.as_py()] * len(b), pa.string()), pa.array([no] * len(b), pa.int64()), pa.array(b, pa.int64()), pa.array(r, pa.binary()), pa.array(t, pa.binary())], names=["grp", "part", "bucket", "names", "twice"])

    def second_round(table: pa.Table) -> pa.Table:
        flags = repeated_names(table.column("names").to_pylist(), table.column("twice").to_pylist())
        return pa.table({"grp": table.column("grp"), "part": table.column("part"), "bucket": table.column("bucket"), "stay": pa.array(flags, pa.binary())})

    named = groups.select("grp", "sizes", "raw")
    judged = named.mapInArrow(third, "grp string, part bigint, bucket bigint, names binary, twice binary").groupBy("bucket").applyInArrow(second_round, "grp string, part bigint, bucket bigint, stay binary")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        lean_worker()
        import zstandard

        columns: list[list] = [[] for _ in RESULT]
        told: dict[int, list[tuple[int, bytes]]] = {}
        for no, b, flags in zip(*(right.column(c).to_pylist() for c in ("part", "bucket", "stay")), strict=True):
            told.setdefault(no, []).append((b, flags))
        for ids_, sizes_, raw_ in zip(*(left.column(c).to_pylist() for c in ("ids", "sizes", "raw")), strict=True):
            sizes = np.frombuffer(sizes_, dtype=np.int64)
            raws = zstandard.ZstdDecompressor().decompress(raw_)
            gone: list[list[np.ndarray]] = [[] for _ in sizes]
            for no, part in enumerate(parts_of(raws, sizes)):
                one, _, _, place = names_of(part)
                bucket = (one >> np.uint64(64 - full_bits)).astype(np.int64)
                stay = np.zeros(len(one), dtype=bool)
                for b, flags in told[no]:
                    lo, hi = np.searchsorted(bucket, b), np.searchsorted(bucket, b, side="right")
                    stay[lo:hi] = np.unpackbits(np.frombuffer(flags, dtype=np.uint8), count=hi - lo).astype(bool)
                cuts = np.cumsum([len(p[1]) for p in part])[:-1]
                for (k, starts, _, _), fine in zip(part, np.split(stay[place], cuts), strict=True):
                    gone[k].append(removed_spans(starts[fine], length))
            ids, absent, at = np.frombuffer(ids_, dtype=np.int64, count=len(sizes)).tolist(), ids_[8 * len(sizes) :], 0
            for k, n in enumerate(sizes.tolist()):
                raw = raws[at : at + n]
                at += n
                spans = joined_spans(gone[k])
                row = (None if absent[k] else ids[k], n, int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(without(raw, spans)).hexdigest(), hashlib.sha256(raw).hexdigest(), spans.astype("<i8").tobytes())
                for column, v in zip(columns, row, strict=True):
                    column.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(RESULT))

    changed = groups.select("grp", "ids", "sizes", "raw").groupBy("grp").cogroup(judged.groupBy("grp")).applyInArrow(finish, _RESULT_SCHEMA)
    same = sorted_out.where("grp IS NULL").select("id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), F.col("sha").alias("text_sha256"), F.lit(b"").alias("spans"))
    return same.unionByName(changed)


def repeats_digest(docs: DataFrame) -> DataFrame:
    return repeats(docs).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def cut_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """docs with the repeated bytes taken out of its texts; a character that is cut in two goes whole.

    Columns stay as they are, n_chars follows the text where there is one. Null texts stay null.
    """
    from pyspark.sql import types as T

    found = repeats(docs, id_col, text_col, length).where("n_removed > 0").select("text_sha256", "spans").dropDuplicates(["text_sha256"])
    sha, spans = free_name(docs.columns, "sha"), free_name(docs.columns, "spans")
    keyed = docs.withColumn(sha, F.sha2(docs[text_col].cast("binary"), 256)).join(found.select(F.col("text_sha256").alias(sha), F.col("spans").alias(spans)), sha, "left")
    names = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for t, s in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), strict=True):
                text = t.as_py()
                if text is not None and s.is_valid:
                    text = without(text.encode("utf-8", "surrogatepass"), np.frombuffer(s.as_py(), dtype="<i8").reshape(-1, 2)).decode("utf-8", "ignore")
                texts.append(text)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns - 2)), pa.array(texts, pa.string())], names=[*names, text_col])

    schema = T.StructType([docs.schema[c] if c != text_col else T.StructField(c, T.StringType()) for c in [*names, text_col]])
    out = keyed.select(*names, F.col(text_col).cast("string").alias(text_col), spans).mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(text_col).isNull(), F.col("n_chars")).otherwise(F.length(text_col)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
