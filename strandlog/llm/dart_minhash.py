"""Near-duplicate classes by DartMinHash.

A document is a weighted set: its five-word shingles, each weighing as often as it occurs. Darts are hashed points; an
element of weight w owns the region [0, w) and gets darts at rate one per unit of weight and rank. Only darts below a
rank of about t / (total weight) are thrown, so that a document of any size throws about t of them. Each dart falls on
one of k coordinates, and the earliest dart of a coordinate is its entry in the signature: two documents agree on a
coordinate with a chance equal to their weighted Jaccard similarity. Where a coordinate got no dart, the rank limit is
doubled for that document, so that entries never depend on the limit.

Signatures are cut into bands. Documents that share a band are compared exactly with the band's leader, and the links
give classes. Rows that this leaves outside their leader's class are then held, by what they changed against the leader,
against all rows of the leader, in blocks; so no link between rows of one leader is lost, and pairs are never rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm.common import durable, lean_worker, mix64
from strandlog.llm.components import connected_components
from strandlog.llm.shingles import WORDS, folded, in_chunks, multiset, shingle_hashes, weighted_jaccard

SIMILARITY = 0.8
#: At a similarity of 0.8, a pair shares no band with a chance of (1 - 0.8^5)^26, about 3e-5.
ROWS, BANDS = 5, 26
#: Rows of one leader that are dealt together.
BLOCK_ROWS = 512
_STEP = np.uint64(0xD1B54A32D192ED03)
_COPY = np.uint64(0x9E3779B97F4A7C15)


def signatures(hashes: np.ndarray, owner: np.ndarray, n: int, k: int) -> np.ndarray:
    """Signatures of n documents: the ranks of their earliest darts by coordinate, as uint64 [n, k].

    hashes, owner: the shingles with repeats, and the document of each. Rows of documents without shingles are all
    ones.
    """
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.ones(len(hashes), dtype=bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    run = np.maximum.accumulate(np.where(first, np.arange(len(hashes)), 0))
    cells = mix64(hashes + (np.arange(len(hashes)) - run + 1).astype(np.uint64) * _COPY)  # unit cells of the regions
    weight = np.bincount(owner, minlength=n)
    darts = k * math.log(k) + 2 * k
    limit = darts / np.maximum(weight, 1)
    found = np.full(n * k, np.iinfo(np.uint64).max, dtype=np.uint64)
    todo = np.arange(len(cells))
    while len(todo):
        key, of = cells[todo], owner[todo]
        rank = np.zeros(len(todo))
        while len(key):
            key = mix64(key + _STEP)
            rank = rank - np.log(((key >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53)
            hit = rank <= limit[of]
            key, of, rank = key[hit], of[hit], rank[hit]
            place = (mix64(key) % np.uint64(k)).astype(np.int64)
            # ranks are not negative, so their bits are in their order
            np.minimum.at(found, of * k + place, rank.view(np.uint64))
        unfilled = (found.reshape(n, k) == np.iinfo(np.uint64).max).any(axis=1)
        limit = np.where(unfilled, limit * 2, limit)
        todo = np.flatnonzero(unfilled[owner])
    return found.reshape(n, k)


def band_keys(signature: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """A 64-bit key for each document and band."""
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), bands)).copy()
    parts = signature.reshape(len(signature), bands, rows)
    for r in range(rows):
        keys = mix64(keys * _COPY + parts[:, :, r])
    return keys


def sketches(docs: DataFrame, rows: int, bands: int, words: int) -> DataFrame:
    """id, t0 and t1 (equal for equal texts), weight (shingles), bands array<bigint> (empty for texts without a word)."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            exact = ["" if not t.is_valid else t.as_py() for t in batch.column(1)]
            raw = [folded(t) for t in exact]
            for a, b in in_chunks(raw):
                part = raw[a:b]
                hashes, owner = shingle_hashes(part, words)
                keys = band_keys(signatures(hashes, owner, len(part), rows * bands), rows, bands)
                some = np.bincount(owner, minlength=len(part)) > 0
                ends = np.concatenate(([0], np.cumsum(np.where(some, bands, 0)))).astype(np.int32)
                digest = np.frombuffer(b"".join(hashlib.md5(t.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() for t in exact[a:b]), dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(np.bincount(owner, minlength=len(part)).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].ravel().view(np.int64)))],
                    names=["id", "t0", "t1", "weight", "bands"],
                )

    return docs.mapInArrow(run, "id bigint, t0 bigint, t1 bigint, weight bigint, bands array<bigint>")


def changes(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """What a has more than b, then what it has less, each sorted: one number for each copy of a shingle. Equal changes
    of two documents against the same b have equal numbers."""
    both = np.union1d(a[0], b[0])
    have, had = (np.zeros(len(both), dtype=np.int64) for _ in range(2))
    have[np.searchsorted(both, a[0])] = a[1]
    had[np.searchsorted(both, b[0])] = b[1]
    parts = []
    for more, sign in ((have - had, 1), (had - have, 2)):
        at = np.flatnonzero(more > 0)
        n = more[at]
        copy = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.minimum(have, had)[at], n)
        numbers = mix64(np.repeat(both[at], n) + copy.astype(np.uint64) * _COPY)
        parts.append(np.sort(mix64(numbers ^ np.uint64(sign))))
    return np.concatenate(parts)


def links_between(x: list[tuple], y: list[tuple], similarity: float) -> list[tuple[int, int]]:
    """Links between rows (id, weight, class, changes) of x and of y in different classes, one for each row of x and class.

    All rows have one leader, so two texts differ in what only one of their changes has. They are linked if that is at
    most t of their weights together, t = (1 - s) / (1 + s).
    """
    t = (1 - similarity) / (1 + similarity)
    shared = np.zeros((len(x), len(y)), dtype=np.int32)
    rows = [np.repeat(np.arange(len(z)), [len(r[3]) for r in z]) for z in (x, y)]
    values = [np.concatenate([r[3] for r in z]) for z in (x, y)]
    order = [np.argsort(v, kind="stable") for v in values]
    rows, values = [r[o] for r, o in zip(rows, order, strict=True)], [v[o] for v, o in zip(values, order, strict=True)]
    for v in np.intersect1d(values[0], values[1]):
        xs, ys = (r[np.searchsorted(w, v) : np.searchsorted(w, v, side="right")] for r, w in zip(rows, values, strict=True))
        shared[xs[:, None], ys[None, :]] += 1
    sizes = [np.array([len(r[3]) for r in z]) for z in (x, y)]
    weights = [np.array([r[1] for r in z]) for z in (x, y)]
    classes = [np.array([r[2] for r in z]) for z in (x, y)]
    found = {}
    for k in range(len(x)):
        apart = sizes[0][k] + sizes[1] - 2 * shared[k]
        near = (apart <= t * (weights[0][k] + weights[1]) + 1e-9) & (classes[0][k] != classes[1])
        found.update({(k, int(classes[1][m])): m for m in np.flatnonzero(near).tolist()})
    return [(x[k][0], y[m][0]) for (k, _), m in found.items()]


def compared(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """a, b, similarity, weight (of a), changes (of a against b) of the pairs (a, b); texts: id, text.

    The pairs of one b are dealt in blocks. A block starts with a row that carries b's text, so the text is sent once a block
    and not with each pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        leader: tuple = ()
        for batch in batches:
            ids, near, weights, made = ([], []), [], [], []
            for b, a, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = multiset(folded(text.as_py()), words)
                if a is None:  # comes before the rows that are held against it
                    leader = own
                    continue
                ids[0].append(a)
                ids[1].append(b)
                near.append(weighted_jaccard(own, leader))
                weights.append(int(own[1].sum()))
                made.append(changes(own, leader).view(np.int64))
            ends = np.cumsum([0] + [len(c) for c in made]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(made) if made else np.empty(0, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[0], pa.int64()), pa.array(ids[1], pa.int64()), pa.array(near, pa.float64()), pa.array(weights, pa.int64()), lists], names=["a", "b", "similarity", "weight", "changes"])

    sizes = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    # ids are dealt by b, texts by a and then by block: no text goes to a task because of its leader
    blocks = pairs.join(sizes, "b").select("b", F.pmod(F.hash("a"), "blocks").alias("block"), "a")
    rows = blocks.join(texts.withColumnRenamed("id", "a"), "a").select("b", "a", "text", "block")
    heads = sizes.join(texts.withColumnRenamed("id", "b"), "b").select("b", F.lit(None).cast("long").alias("a"), "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    dealt = rows.unionByName(heads).repartition("b", "block").sortWithinPartitions("b", "block", F.col("a").asc_nulls_first())
    return dealt.select("b", "a", "text").mapInArrow(run, "a bigint, b bigint, similarity double, weight bigint, changes array<bigint>")


def near_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    rows: int = ROWS,
    bands: int = BANDS,
    words: int = WORDS,
) -> DataFrame:
    """doc_id, text_id, class_id of every row with an id.

    text_id is the least id of the rows with the same text, class_id the least id of the texts joined by chains of
    pairs whose weighted Jaccard similarity is at least `similarity`. A null text counts as empty. Texts without a
    word join no others but equal ones. A row whose id is null gets nulls. An id that repeats keeps its rows; they may
    belong to different texts. Other columns are not read.
    """
    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    made = durable(sketches(source, rows, bands, words))
    named = made.where("id IS NOT NULL")
    reps = durable(named.groupBy("t0", "t1").agg(F.min("id").alias("text_id"), F.min_by(F.struct("weight", "bands"), "id").alias("sketch")).select("t0", "t1", "text_id", "sketch.*"))
    pool = reps.select(F.explode("bands").alias("key"), F.col("text_id").alias("id"), "weight")
    shared = pool.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    pool = durable(pool.join(shared, "key"))
    needed = pool.select("id").distinct()
    keyed = reps.select("text_id", "t0", "t1").join(needed, F.col("text_id") == needed["id"], "left_semi")
    # one row of each needed text: its id is text_id; a repeated id is told apart by the text's hash
    texts = source.where("id IS NOT NULL").join(keyed.select(F.col("text_id").alias("id"), "t0", "t1"), "id")
    own = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    texts = durable(texts.where(own == F.concat(*[little_endian_hex(c) for c in ("t0", "t1")])).select("id", "text").dropDuplicates(["id"]))

    # The leader of a band is the row that shares the most bands with others: the text that the others are copies of.
    sizes = pool.groupBy("key").agg(F.count("*").alias("n"))
    central = pool.join(sizes, "key").groupBy("id").agg(F.sum("n").alias("central"))
    ranked = pool.join(central, "id")
    leaders = ranked.groupBy("key").agg(F.max(F.struct("central", (-F.col("id")).alias("minus"))).alias("top")).select("key", (-F.col("top.minus")).alias("leader"))
    led = pool.join(leaders, "key").where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    tested = durable(compared(led, texts, words))
    links = tested.where(F.col("similarity") >= similarity).select("a", "b")
    labels = connected_components(links)

    # Rows of one leader in different classes, not both linked with it, can still be linked. The rows outside the leader's
    # class ask: in blocks of their own, each of which is held against each block of all the leader's rows. A task gets two
    # blocks at a time; rows that nobody asks for are not sent.
    named = tested.join(labels.select(F.col("id").alias("a"), F.col("label").alias("known")), "a", "left").join(labels.select(F.col("id").alias("b"), F.col("label").alias("head")), "b", "left")
    placed = durable(named.select("a", "b", "weight", "changes", F.coalesce("known", "a").alias("class_of"), (F.coalesce("known", "a") != F.coalesce("head", "b")).alias("out")))
    in_blocks = lambda n: F.ceil(F.col(n) / BLOCK_ROWS).cast("int")
    crowds = placed.groupBy("b").agg(F.count("*").alias("n"), F.count_if("out").alias("n_out")).where("n > 1 AND n_out > 0").select("b", in_blocks("n").alias("blocks"), in_blocks("n_out").alias("asking"))
    dealt = placed.join(crowds, "b")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["b", "i", "j", "a", "weight", "class_of", "changes", "asks"]
    one = dealt.where("out").withColumn("i", F.pmod(F.hash("a"), "asking")).select("*", all_of("blocks").alias("j"), F.lit(True).alias("asks")).select(*columns)
    two = dealt.withColumn("j", F.pmod(F.hash("a"), "blocks")).select("*", all_of("asking").alias("i"), F.lit(False).alias("asks")).select(*columns)

    def hold(table: pa.Table) -> pa.Table:
        sides: tuple[list, list] = ([], [])
        columns = (table.column(c).to_pylist() for c in ("a", "weight", "class_of", "asks"))
        for a, w, c, asks, made in zip(*columns, table.column("changes"), strict=True):
            sides[0 if asks else 1].append((a, w, c, np.asarray(made.values)))
        found = links_between(*sides, similarity) if all(sides) else []
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    # dealt anew: the join's dealing by b would put all blocks of a leader into one task
    more = durable(one.unionByName(two).repartition("b", "i", "j").groupBy("b", "i", "j").applyInArrow(hold, "a bigint, b bigint"))
    if not more.isEmpty():
        labels = connected_components(links.unionByName(more))

    member = made.select("id", "t0", "t1")
    kept = reps.select("t0", "t1", "text_id")
    kept = kept.join(labels.select(F.col("id").alias("text_id"), "label"), "text_id", "left").select("t0", "t1", "text_id", F.coalesce("label", "text_id").alias("class_id"))
    found = member.join(kept, ["t0", "t1"], "left")
    blank = F.col("id").isNull()
    return found.select(F.col("id").alias("doc_id"), F.when(~blank, F.col("text_id")).alias("text_id"), F.when(~blank, F.col("class_id")).alias("class_id"))


def little_endian_hex(name: str):
    """Lower-case hex of a long's eight bytes, least significant first."""
    full = F.lower(F.lpad(F.hex(F.col(name)), 16, "0"))
    return F.concat(*[F.substring(full, at, 2) for at in range(15, 0, -2)])
