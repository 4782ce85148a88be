"""Reads over a log: rows, groups by filter, summary numbers, projections and paging.

The order of operations is fixed: `until` narrows everything; matching and the context version see whole records; then
`after`, `cursor` and `settled_only` narrow the rows, the rows are projected, ordered and limited.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlog.functions.errors import UsageError
from strandlog.functions.filters import Query, checked_options, compiled, normalised
from strandlog.sources.canonical import Log


@dataclass
class Read:
    """rows: the page with hits (one boolean for each filter). summary: one row of six numbers."""

    rows: DataFrame
    filters: list[dict]
    matched: DataFrame = field(repr=False)
    visible: Column = field(repr=False)
    log: Log = field(repr=False)
    options: dict[str, Any] = field(repr=False)

    def by_filter(self) -> DataFrame:
        """The page once for each filter that a row matches: filter_index and the row's columns."""
        hit = self.rows.select("*", F.posexplode("hits").alias("filter_index", "hit")).where("hit")
        return hit.drop("hits", "hit").withColumn("filter_index", F.col("filter_index").cast("int"))

    def summary(self) -> DataFrame:
        """context_version, last_returned, cursor_transaction, cursor_sequence, watermark, n_rows."""
        version = F.lit(-1).cast("long") if self.options.get("version") is False else F.coalesce(F.max("sequence"), F.lit(0)).cast("long")
        numbers = lambda seen: [
            F.coalesce(F.max(F.when(seen, F.col("sequence"))), F.lit(0)).alias("last_returned"), F.count_if(seen).alias("n_rows"),
            F.max(F.when(seen & self.log.settled, F.struct("transaction_id", "sequence"))).alias("c"),
        ]
        if self.options.get("limit") is None:
            found = self.matched.agg(version.alias("context_version"), *numbers(self.visible))  # one scan for all numbers
        else:
            # both sides are one row
            found = self.matched.agg(version.alias("context_version")).crossJoin(self.rows.agg(*numbers(F.lit(True))))
        return found.select("context_version", "last_returned", F.col("c.transaction_id").alias("cursor_transaction"), F.col("c.sequence").alias("cursor_sequence"), F.lit(self.log.watermark).cast("long").alias("watermark"), "n_rows")


def matching(log: Log, query: Query, until: int | None = None) -> tuple[DataFrame, list[dict]]:
    """The records that any filter matches, each once, with hits."""
    filters = normalised(query)
    df = log.df if until is None else log.df.where(F.col("sequence") <= until)
    columns = df.columns
    if any(needs_payload(f, log) for f in filters):
        df = df.withColumn("_v", F.parse_json("payload"))  # parsed once, however many predicates look at it
    payload = F.col("_v")
    tests: list[Column] = [compiled(f, lambda k: log.scope_of(k, payload), payload, F.col("event_type")) for f in filters]
    some = tests[0]
    for t in tests[1:]:
        some = some | t
    return df.where(some).select(*columns, F.array(*[F.coalesce(t, F.lit(False)) for t in tests]).alias("hits")), filters


def needs_payload(f: dict, log: Log) -> bool:
    """Whether a filter looks at more than types and physical scope columns."""
    return "where" in f or any(k not in log.scope_keys for k in f.get("scopes", {})) or any(needs_payload(n, log) for n in f.get("not", []))


def read(log: Log, query: Query, **options: Any) -> Read:
    """A page of a query. See checked_options for the options; cursor=None counts as given, without a bound.

    Rows are sorted where an order or a limit is given; else they come as they lie, and nothing is shuffled.
    """
    checked_options(**options)
    matched, filters = matching(log, query, options.get("until"))
    visible = F.lit(True)
    if options.get("after") is not None:
        visible = visible & (F.col("sequence") > options["after"])
    if options.get("settled_only"):
        visible = visible & log.settled
    if options.get("cursor") is not None:
        txn, seq = options["cursor"]
        beyond = (F.col("transaction_id") > txn) | ((F.col("transaction_id") == txn) & (F.col("sequence") > seq))
        visible = visible & (beyond if log.watermark is None else beyond | (F.col("transaction_id") >= log.watermark))
    rows = matched.where(visible)
    rows = projected(rows, log, options)
    keys = ["transaction_id", "sequence"] if "cursor" in options or options.get("settled_only") else ["sequence"]
    if options.get("order") is not None or options.get("limit") is not None:
        rows = rows.orderBy(*[F.col(k).desc() if options.get("order") == "desc" else F.col(k).asc() for k in keys])
    if options.get("limit") is not None:
        rows = rows.limit(options["limit"])
    return Read(rows, filters, matched, visible, log, options)


def projected(rows: DataFrame, log: Log, options: dict[str, Any]) -> DataFrame:
    """What a read asked for of each record: all of it, without some keys, without data, or without the payload."""
    if options.get("payload") is False:
        rows = rows.drop("payload", *[f"scope_{k}" for k in log.scope_keys])
        return rows.withColumn("event_id", F.concat(F.lit("~"), "sequence"))
    if options.get("data") is False:
        return rows.drop("payload")
    if omit := options.get("omit"):
        for type_, key in log.id_keys.items():
            if key in omit:
                raise UsageError(f"omit cannot drop {key}, the own id key of {type_}")
        entries = F.from_json("payload", "map<string,variant>")
        kept = F.map_filter(entries, lambda k, v: ~k.isin(list(omit)))
        return rows.withColumn("payload", F.to_json(kept))
    return rows


def renamed_field(old: str, new: str) -> Callable[[Column], Column]:
    """An upcast of a payload (JSON text): a top-level field under its new name, where it is there."""
    return lambda payload: F.to_json(F.transform_keys(F.from_json(payload, "map<string,variant>"), lambda k, v: F.when(k == old, new).otherwise(k)))


def upcasted(log: Log, columns: dict[str, Callable[[Column], Column]] | None = None, python: dict[str, Callable[[dict], dict]] | None = None) -> Log:
    """The log with payloads as the current versions of their types say; what is stored stays.

    columns: by type, from the payload column to the new one, inside the same stage. python: by type, from a record's data to
    the new data, in Arrow batches; only rows of those types go there.
    """
    from strandlog.functions.ids import default_id_key
    from strandlog.functions.registry import upcast_payload

    df = log.df
    for type_, change in (columns or {}).items():
        df = df.withColumn("payload", F.when(F.col("event_type") == type_, change(F.col("payload"))).otherwise(F.col("payload")))
    if not python:
        return log.with_df(lambda _: df)
    own = {t: log.id_keys.get(t, default_id_key(t)) for t in python}
    at, kind = df.columns.index("payload"), df.columns.index("event_type")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [upcast_payload(p, python[t], own[t]) for t, p in zip(batch.column(kind).to_pylist(), batch.column(at).to_pylist(), strict=True)]
            yield batch.set_column(at, "payload", pa.array(new, pa.string()))

    old = F.col("event_type").isin(sorted(python))
    return log.with_df(lambda _: df.where(~old).unionByName(df.where(old).mapInArrow(run, df.schema)))


def statistics(log: Log, query: Query | None = None) -> DataFrame:
    """event_type, count, bytes (of the payload as written), last_sequence of the records that a query matches."""
    matched, _ = matching(log, query if query is not None else {})
    return matched.groupBy("event_type").agg(F.count("*").alias("count"), F.sum(F.octet_length("payload")).cast("long").alias("bytes"), F.max("sequence").alias("last_sequence"))


def tenant_view(log: Log, tenant: str) -> Log:
    """The records of one tenant; fails where the log has no tenant key."""
    if log.tenant_key is None:
        raise UsageError("the log has no tenant key")
    return log.with_df(lambda df: df.where(log.scope_of(log.tenant_key) == tenant))


def as_of(log: Log, sequence: int) -> Log:
    """The log as it was when the given sequence was its last; of nested views the earlier counts."""
    return log.with_df(lambda df: df.where(F.col("sequence") <= sequence))


def back_links(log: Log, key: str, parent_type: str) -> DataFrame:
    """parent_id, child_type, n_children, last_child: events that name one of parent_type's events by a scope key."""
    parents = log.df.where(F.col("event_type") == parent_type).select(F.col("event_id").alias("parent_id"))
    children = log.df.where(F.col("event_type") != parent_type).groupBy(log.scope_of(key).alias("parent_id"), F.col("event_type").alias("child_type"))
    counted = children.agg(F.count("*").alias("n_children"), F.max("sequence").alias("last_child"))
    return parents.join(counted, "parent_id")
