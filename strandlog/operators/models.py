"""Read models as DataFrames: states by key, lists, changes, lag and failed keys."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.functions.errors import UsageError
from strandlog.functions.filters import contains, kind
from strandlog.operators.windows import numbered

#: Kinds of list values in their order; anything else counts as missing.
RANKS = ("number", "string", "boolean", "date")


def keyed(states: DataFrame, delta: DataFrame, key: list[str], sums: list[str], last: dict[str, str | tuple[str, ...]], order: str | tuple[str, ...] = "sequence") -> DataFrame:
    """Stored states and those of newer events, merged: sums add up, last values follow their order columns.

    Both sides have one row a key, with the columns of sums, last and order; a delta is made by the same fold. Where late
    transactions can commit, the order is (transaction_id, sequence).
    """
    at = lambda by: by if isinstance(by, str) else F.struct(*by)
    both = states.unionByName(delta.select(*states.columns))
    merged = both.groupBy(*key).agg(*[F.sum(c).alias(c) for c in sums], *[F.max_by(c, at(by)).alias(c) for c, by in last.items()], F.max(at(order)).alias("_at"))
    return merged.withColumnRenamed("_at", order) if isinstance(order, str) else merged.select(*key, *sums, *last, "_at.*")


def key_batch(states: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """The states of the keys that a page touches: keys are as many as a page has records at most, so they are sent to the states."""
    return states.join(F.broadcast(keys.select(*key).distinct()), key, "left_semi")


def with_previous(revisions: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """Every revision of a state with the values of the one before it, as previous_<value> and previous_<order>."""
    w = Window.partitionBy(key).orderBy(order)
    return revisions.select("*", *[F.lag(v).over(w).alias(f"previous_{v}") for v in [*values, order]])


def without_retired(states: DataFrame, retired: DataFrame, key: list[str]) -> DataFrame:
    """States but for those of retired (name, version or key) rows: what a retirement leaves."""
    return states.join(retired.select(*key).distinct(), key, "left_anti")


def split_failed(rows: DataFrame, key: str, poison: Column) -> tuple[DataFrame, DataFrame]:
    """(rows of the keys without a poisoned event, key and failed_sequence of the others). Other keys go on."""
    failed = rows.where(poison).groupBy(key).agg(F.min("sequence").alias("failed_sequence"))
    return rows.join(failed, key, "left_anti"), failed


def where_equal(states: DataFrame, where: dict[str, Any]) -> DataFrame:
    """Rows whose columns equal the given values; None matches only NULL; 1 does not match "1"."""
    if len(where) > 64:
        raise UsageError("where takes at most 64 fields")
    for name, value in where.items():
        if states.schema[name].dataType.simpleString() == "variant":
            states = states.where(contains(F.col(name), value))
        elif value is None:
            states = states.where(F.col(name).isNull())
        elif isinstance(value, str) != (states.schema[name].dataType.simpleString() == "string"):
            states = states.where(F.lit(False))
        else:
            states = states.where(F.col(name) == F.lit(value))
    return states


def rank_of(v: Column) -> Column:
    """0 to 3 for a number, string, boolean or date in a variant, NULL for what has no place in a list's order."""
    return mixed_value(v)["rank"]


def mixed_value(v: Column) -> Column:
    """rank, num, str, flag of a variant: the kind's place in a list's order and the value as that kind; a date is a number.

    The kind is computed once: it is an element of an array that a lambda looks at.
    """
    number = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"

    def of(z: Column) -> Column:
        k, date = z["kind"], z["date"]
        rank = F.when(k.rlike(number), 0).when(k == "STRING", 1).when(k == "BOOLEAN", 2).when(date.isNotNull(), 3)
        return F.struct(
            rank.alias("rank"), F.when(rank == 0, F.try_variant_get(z["v"], "$", "double")).when(rank == 3, date).alias("num"),
            F.when(rank == 1, F.try_variant_get(z["v"], "$", "string")).alias("str"), F.when(rank == 2, F.try_variant_get(z["v"], "$", "boolean")).alias("flag"),
        )

    inner = F.try_variant_get(v, '$["$date"]', "variant")
    date = F.when(kind(inner).rlike(number), F.try_variant_get(inner, "$", "double"))
    return F.transform(F.array(F.struct(v.alias("v"), kind(v).alias("kind"), date.alias("date"))), of)[0]


def mixed_order(v: Column, key: Column, descending: bool = False) -> list[Column]:
    """Sort columns over a mixed_value: missing last both ways, then kind, value and key (ascending)."""
    way = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    return [v["rank"].isNull().asc(), way(v["rank"]), way(v["num"]), way(v["str"]), way(v["flag"]), key.asc()]


def listed(states: DataFrame, key: str, order: list[Column], offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of a list, with its place from 1. Spark keeps offset + limit rows of each task, not all."""
    page = states.orderBy(*order, F.col(key).asc()).limit(offset + limit)
    place = F.row_number().over(Window.orderBy(*order, F.col(key).asc()))  # over offset + limit rows at most
    return page.withColumn("place", place.cast("long")).where(F.col("place") > offset)


def placed(states: DataFrame, order: list[Column]) -> DataFrame:
    """Every row with its place in the whole list, from 1, without sorting all rows in one task. The order must be total."""
    return numbered(states, order, "place")


def changes_since(states: DataFrame, revision: int, key_after: str, limit: int, key: str = "key") -> DataFrame:
    """Rows changed after (revision, key), in that order."""
    beyond = (F.col("revision") > revision) | ((F.col("revision") == revision) & (F.col(key) > key_after))
    return states.where(beyond).orderBy("revision", key).limit(limit)


def enter_leave(before: DataFrame, after: DataFrame, key: str, match: Column) -> DataFrame:
    """key and change (entered, changed, left) of the rows that a filter matches before or after."""
    b = before.where(match).select(key, F.struct(*[c for c in before.columns if c != key]).alias("_b"))
    a = after.where(match).select(key, F.struct(*[c for c in before.columns if c != key]).alias("_a"))
    both = b.join(a, key, "full")
    change = F.when(F.col("_b").isNull(), "entered").when(F.col("_a").isNull(), "left").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


def lag_of(log_rows: DataFrame, checkpoint: int) -> DataFrame:
    """events: how many lie beyond the checkpoint; oldest: when the first of them was recorded."""
    return log_rows.where(F.col("sequence") > checkpoint).agg(F.count("*").alias("events"), F.min("recorded_at").alias("oldest"))


def counts(states: DataFrame, match: Column, failed: Column) -> DataFrame:
    """total (rows that match and did not fail), failed, keys."""
    return states.agg(F.count_if(match & ~failed).alias("total"), F.count_if(failed).alias("failed"), F.count("*").alias("keys"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
