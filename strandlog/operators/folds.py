"""Folds: event sequences become state.

Three forms with one contract, equal to folding the events one by one in order:

* algebraic: a table of aggregate columns, for folds that are sums, counts, extremes or last values;
* ordered: a Catalyst lambda over the sorted events of a key, for folds that depend on order;
* python: any function (state, event) -> state, run over sorted batches of a key's events.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("transaction_id", "sequence")


def fold_algebraic(rows: DataFrame, key: list[Column], **aggregates: Column) -> DataFrame:
    """One row for each key; partial sums are made before the shuffle, so a hot key costs no more than others."""
    return rows.groupBy(*key).agg(*[c.alias(name) for name, c in aggregates.items()])


def last_by(value: str) -> Column:
    """The value of the last event in log order."""
    return F.max_by(value, F.struct(*ORDER))


def fold_since(rows: DataFrame, key: list[str], cut: Column, **aggregates: Column) -> DataFrame:
    """An algebraic fold that begins anew after each event where cut holds; a key whose last event is one has no row.

    The last cut of each key is a max before the shuffle; so a hot key costs no more than others.
    """
    last = rows.where(cut).groupBy(*key).agg(F.max(F.struct(*ORDER)).alias("_cut"))
    beyond = rows.join(last, key, "left").where(F.col("_cut").isNull() | (F.struct(*ORDER) > F.col("_cut")))
    return beyond.groupBy(*key).agg(*[c.alias(name) for name, c in aggregates.items()])


def fold_ordered(rows: DataFrame, key: list[str], event: Column, initial: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """key and state: a lambda over the sorted events of each key. A key's events must fit in one row; fold_python has no
    such bound."""
    listed = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*ORDER, event.alias("e")))).alias("es"))
    return listed.select(*key, F.aggregate("es", initial, lambda s, x: step(s, x["e"])).alias("state"))


def fold_running(rows: DataFrame, key: list[str], **aggregates: Column) -> DataFrame:
    """Every event with the state after it: algebraic aggregates over the events up to it."""
    w = Window.partitionBy(*key).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("*", *[c.over(w).alias(name) for name, c in aggregates.items()])


def fold_python(rows: DataFrame, key: str, initial: Callable[[], Any], step: Callable[[Any, dict], Any], finish: Callable[[Any], dict], schema: str, on_error: str = "raise") -> DataFrame:
    """key and finish(state) of each key, by a Python step over its events in order.

    Rows are sorted by key inside their partitions and streamed, so that a key may have any number of events; a key's events
    are folded one after the other by one task, so a fold that can be written as sums belongs into fold_algebraic. whose last state is None is deleted: it has no row. With on_error="keep" a key whose step raises gets nulls and the first failing sequence with its error, in the columns
    failed_sequence and failed_error that schema must then name.
    """
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Any = None
        state: Any = None
        failed: tuple[int, str] | None = None
        out: list[dict] = []

        def close() -> None:
            if state is None and not failed:
                return
            row = {} if failed else finish(state)
            more = {"failed_sequence": failed[0], "failed_error": failed[1]} if failed else {}
            out.append({key: held} | row | more)

        for batch in batches:
            for event in batch.to_dict("records"):
                if event[key] != held:
                    if held is not None:
                        close()
                    held, state, failed = event[key], initial(), None
                if failed:
                    continue
                try:
                    state = step(state, event)
                except Exception as e:
                    if on_error == "raise":
                        raise
                    failed = int(event["sequence"]), str(e)[:1000]
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=names)
                out.clear()
        if held is not None:
            close()
        if out:
            yield pd.DataFrame(out, columns=names)

    dealt = rows.where(F.col(key).isNotNull()).repartition(F.col(key)).sortWithinPartitions(key, *ORDER)
    return dealt.mapInPandas(run, schema)
