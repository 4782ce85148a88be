"""I-Match fingerprints with randomised lexicons, by DataFrame functions only.

The lexicon holds the terms whose share of distinct texts lies in a band: terms that are neither common nor rare (a band of
inverse document frequency). A text keeps its distinct terms of the lexicon, sorted. Each of several random subsets of
the lexicon, thinned at several rates, gives one hash of the kept terms that it holds; the fingerprint is the row of
these hashes, the first over the whole lexicon. Two fingerprints are alike by the share of equal hashes among those
where either text has a term. A text without a lexicon term is compared by subsets of all terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.llm.common import durable

#: Least and largest share of distinct texts of a lexicon term. The lexicon has at most the mean number of distinct terms
#: of a text divided by the least share.
LOW, HIGH = 0.001, 0.02
#: Subsets hold one in so many of the lexicon's terms; so many subsets of each rate.
RATES, EACH = (8, 32, 128, 512), 12
#: So many subsets of a rate must have a term for that rate to tell the likeness.
LEAST_FILLED = 6
SEED = 17
WIDTH = 8
EMPTY = "0" * WIDTH
#: Hashes of texts with copies are sent to all tasks up to so many.
BROADCAST_COPIES = 500_000
#: Hashes of the lexicon lie in so many lists, by their last bits.
BUCKETS = 1 << 16
#: So many stretches of the order for each shuffle partition, when the next document is looked up.
STRETCHES = 8

_GAPS = ".,;:!?\"'()[]{}<>|/\\*_=+#&%$@~^`\n\t\r\x0b\x0c"


def terms(text: Column) -> Column:
    """Distinct lower-case terms, in the order they come."""
    return F.array_remove(F.array_distinct(F.split(F.translate(F.lower(text), _GAPS, " " * len(_GAPS)), " ")), "")


def term_hashes(text: Column) -> Column:
    return F.transform(terms(text), lambda t: F.xxhash64(t))


def lexicon(docs: DataFrame, text: Column, low: float = LOW, high: float = HIGH) -> list[int]:
    """Hashes of the terms whose share of the distinct texts lies in the band and that two of them have at least.

    Copies count once, told by a hash of the text. Only texts with copies meet at one task, by the hashes of their terms.
    """
    hashed = docs.select(text.alias("text"), F.xxhash64(text).alias("t"))
    copies = durable(hashed.groupBy("t").agg(F.count("*").alias("n")).where("n > 1"))
    found = copies.agg(F.count("*").alias("texts"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("more")).first()
    n = docs.count() - found["more"]
    held = F.broadcast(copies.select("t")) if found["texts"] <= BROADCAST_COPIES else copies.select("t")
    alone = hashed.join(held, "t", "left_anti").select("t", term_hashes(F.col("text")).alias("h"))
    first = hashed.join(held, "t", "left_semi").select("t", term_hashes(F.col("text")).alias("h")).dropDuplicates(["t"])
    distinct = alone.unionByName(first)
    counts = distinct.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    return sorted(r["h"] for r in counts.where((F.col("n") >= max(2.0, low * n)) & (F.col("n") <= max(2.0, high * n))).collect())


def graded(hashes: Column) -> Column:
    """1 + len(RATES) * EACH hashes side by side of the sorted hashes of terms, zeros where no term fell in."""
    # a term is in a subset if some bits of its hash are zero: the first subset needs none, a rate of 2^n needs n
    subsets = F.array(*[F.struct(F.lit(5 * k).alias("at"), F.lit(rate - 1).cast("long").alias("mask")) for rate in (1, *RATES) for k in range(EACH if rate > 1 else 1)])
    marked = F.transform(hashes, lambda t: F.struct(t.alias("t"), F.xxhash64(t, F.lit(SEED)).alias("h")))
    inside = lambda s: lambda z: F.call_function("shiftrightunsigned", z["h"], s["at"]).bitwiseAND(s["mask"]) == 0
    hashed = lambda chosen: F.when(F.size(chosen) == 0, EMPTY).otherwise(F.substring(F.lpad(F.hex(F.xxhash64(chosen["t"])), 16, "0"), 1, WIDTH))
    one = lambda words: lambda s: F.transform(F.array(F.filter(words, inside(s))), hashed)[0]
    return F.transform(F.array(marked), lambda words: F.array_join(F.transform(subsets, one(words)), ""))[0]  # the terms are hashed once


def fingerprinted(docs: DataFrame, text: str, name: str, lexicon_terms: Column) -> DataFrame:
    """docs with name, the fingerprint of the named text. A text without a term of the lexicon gets an x and the same hashes over all its terms.

    lexicon_terms is a scalar subquery of bucketed(), so neither the plan nor its text holds the hashes.
    """
    every = docs.withColumn("_every", term_hashes(F.col(text))).withColumn("_buckets", lexicon_terms)
    known = lambda buckets: lambda h: F.array_contains(F.get(buckets, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), h)
    kept = lambda buckets: F.array_sort(F.filter("_every", known(buckets)))
    bare = lambda k: F.size(k) == 0
    made = lambda k: F.concat(F.when(bare(k), "x").otherwise(""), graded(F.when(bare(k), F.array_sort("_every")).otherwise(k)))
    # the buckets are used in one place only, so Spark puts the subquery there and no row holds them
    return every.withColumn(name, F.transform(F.transform(F.array("_buckets"), kept), made)[0]).drop("_every", "_buckets")


def bucketed(docs: DataFrame, hashes: list[int]) -> Column:
    buckets: list[list[int]] = [[] for _ in range(BUCKETS)]
    for h in hashes:
        buckets[h & (BUCKETS - 1)].append(h)
    return docs.sparkSession.createDataFrame([(buckets,)], "terms array<array<bigint>>").scalar()


def likeness(a: Column, b: Column, text_a: Column, text_b: Column) -> Column:
    """Share of equal hashes among the subsets of one rate in which either text has a term: of the thinnest rate with
    LEAST_FILLED such subsets, where a subset has few terms; without one, of all. Where a text has no lexicon term, the
    subsets are of all terms of both."""
    n = 1 + len(RATES) * EACH
    at = F.sequence(F.lit(0), F.lit(n - 1))
    filled = lambda z: (z["p"] != EMPTY) | (z["q"] != EMPTY)
    same = lambda z: filled(z) & (z["p"] == z["q"])
    bare = lambda c: c.startswith("x")
    whole = lambda c, text: F.when(bare(c), F.substring(c, 2, n * WIDTH)).otherwise(graded(F.array_sort(term_hashes(text))))

    def share(zipped: Column) -> Column:
        found = F.size(F.filter(zipped, filled))
        for level in range(len(RATES)):  # the last one tested is the thinnest
            part = F.slice(zipped, 2 + level * EACH, EACH)
            some = F.size(F.filter(part, filled))
            value = F.size(F.filter(part, same)) / some
            best = F.when(some >= LEAST_FILLED, value).otherwise(best if level else F.size(F.filter(zipped, same)) / found)
        return best

    piece = lambda c, k: F.substring(c, k * WIDTH + 1, F.lit(WIDTH))
    zipped = lambda z: F.transform(at, lambda k: F.struct(piece(z["a"], k).alias("p"), piece(z["b"], k).alias("q")))
    alike = lambda p, q: F.transform(F.transform(F.array(F.struct(p.alias("a"), q.alias("b"))), zipped), share)[0]
    return F.when(a == b, 1.0).when(bare(a) | bare(b), alike(whole(a, text_a), whole(b, text_b))).otherwise(alike(a, b)).cast("double")


def stretches(rows: DataFrame, order: str) -> tuple[list[int], int]:
    """Values of the order column (an integer) that cut it into stretches of about equally many rows, ascending; one that
    repeats holds so many stretches alone. And how many stretches the rows with a null fill.

    Their number follows the shuffle partitions, not the rows.
    """
    n = STRETCHES * max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = rows.agg(
        F.percentile_approx(order, [k / n for k in range(1, n)] or [0.5], max(10_000, 4 * n)).alias("cuts"), F.count_if(F.col(order).isNull()).alias("absent"), F.count("*").alias("n"),
    ).first()
    return found["cuts"] or [], -(-n * found["absent"] // max(1, found["n"]))


def stretch_of(value: Column, text_hash: Column, cuts: list[int], n_absent: int) -> Column:
    """Number of the stretch of a row; numbers ascend with (value, text_hash), nulls first.

    The cuts are looked through in two steps, so a row is compared with about twice the root of their number.
    """
    times = Counter(cuts)
    distinct = sorted(times)
    # a value that fills several stretches is cut by the hash
    first, at = [], n_absent + 1
    for c in distinct:
        first.append(at)
        at += times[c]
    size = max(1, int(len(distinct) ** 0.5))
    groups = [list(zip(distinct, first, strict=True))[k : k + size] for k in range(0, len(distinct), size)]
    part = lambda n: F.least(F.floor((text_hash.cast("double") / F.lit(2.0**64) + F.lit(0.5)) * n), n - 1).cast("long")
    null = part(F.lit(max(1, n_absent)).cast("double")) if n_absent else F.lit(0).cast("long")
    if not distinct:
        return F.when(value.isNull(), null).otherwise(F.lit(n_absent).cast("long"))
    table = F.array(*[F.array(*[F.struct(F.lit(c).cast("long").alias("c"), F.lit(f).cast("long").alias("f"), F.lit(times[c]).cast("double").alias("n")) for c, f in g]) for g in groups])
    row = F.struct(value.alias("v"), text_hash.alias("h"))
    # each cut begins its own stretches; below the first there is one more
    of_group = lambda z: F.element_at(F.filter(table, lambda g: g[0]["c"] <= z["v"]), -1)
    last = lambda z: F.element_at(F.filter(of_group(z), lambda e: e["c"] <= z["v"]), -1)
    inside = lambda z, e: e["f"] + F.when(z["v"] == e["c"], F.least(F.floor((z["h"].cast("double") / F.lit(2.0**64) + F.lit(0.5)) * e["n"]), e["n"] - 1)).otherwise(e["n"] - 1).cast("long")
    known = F.transform(F.array(row), lambda z: F.transform(F.array(last(z)), lambda e: inside(z, e))[0])[0]
    return F.when(value.isNull(), null).when(value < F.lit(distinct[0]), F.lit(n_absent).cast("long")).otherwise(known)


def with_next(rows: DataFrame, order: str, text: str, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """order, and as here and next the columns value of made(rows) of a row and of the row that follows in ascending
    order (nulls first), then by hash of the text; after the last, the first. value is a struct that has text.

    Rows are dealt by stretches of the order, so neighbours meet in one task, and the first row of each stretch is
    handed to the stretch before it. A value that a large part of the rows share is cut into stretches by the text's hash.
    """
    dealt = rows.withColumn("_hash", F.xxhash64(text)).withColumn("_part", stretch_of(F.col(order), F.col("_hash"), *stretches(rows, order)))
    here = made(dealt).select(order, "_part", "_hash", F.col("value").alias("here"))
    w = Window.partitionBy("_part").orderBy(order, "_hash", f"here.{text}")
    here = here.withColumn("_next", F.lead("here").over(w))
    # the heads: numbers tell nearly all rows apart, so few texts are sorted; one row a stretch, so all of them are few
    least = dealt.groupBy("_part").agg(F.min(order).alias("_least"))
    firsts = dealt.join(F.broadcast(least.withColumnRenamed("_part", "_p")), (F.col("_part") == F.col("_p")) & F.col(order).eqNullSafe(F.col("_least")), "left_semi")
    hashes = firsts.groupBy("_part").agg(F.min("_hash").alias("_least"))
    firsts = firsts.join(F.broadcast(hashes.withColumnRenamed("_part", "_p")), (F.col("_part") == F.col("_p")) & (F.col("_hash") == F.col("_least")), "left_semi")
    first = firsts.groupBy("_part", order).agg(F.min(text).alias(text))
    heads = made(first).select("_part", F.col("value").alias("_head"))
    parts = heads.select("_part")
    around = Window.orderBy("_part")  # one row a stretch
    lowest = F.first("_part").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    follows = parts.select("_part", F.coalesce(F.lead("_part").over(around), lowest).alias("_after"))
    given = durable(follows.join(heads.withColumnRenamed("_part", "_after"), "_after").select("_part", "_head"))
    return here.join(given, "_part", "left").select(order, "here", F.coalesce("_next", "_head").alias("next"))


def imatch(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many of the next document. Null
    texts count as empty, null ids come first, rows with the same id are ordered by a hash of the text.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    found = bucketed(docs, lexicon(rows, F.col("text"), low, high))
    beside = with_next(rows, "doc_id", "text", lambda d: fingerprinted(d, "text", "fingerprint", found).withColumn("value", F.struct("text", "fingerprint")))
    n = F.length("here.text")
    m = F.floor(n / 4).cast("int")
    edited = beside.withColumn("edited", F.concat(F.substring("here.text", F.lit(1), n - m), F.substring(F.col("next.text"), F.lit(1), m)))
    made = fingerprinted(edited, "edited", "edited_fingerprint", found)
    of = lambda c: (F.col(f"{c}.fingerprint"), F.col(f"{c}.text"))
    (a, text), (b, following) = of("here"), of("next")
    return made.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), a.alias("fingerprint"), "edited_fingerprint",
        likeness(a, F.col("edited_fingerprint"), text, F.col("edited")).alias("near_edited"), likeness(a, b, text, following).alias("near_next"),
    )
