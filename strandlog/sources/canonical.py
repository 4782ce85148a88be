"""The log as a DataFrame, and logs made from relational tables.

Columns of a log: sequence, transaction_id (bigint), event_type, event_id, payload (JSON text as it was written),
recorded_at, and one physical column scope_<key> for every declared scope key, extracted when the log is written. Keys
without a column are found by the same rule over the payload.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions.filters import scope_value, string_at
from strandlog.functions.ids import default_id_key, default_id_key_column

TRANSACTION_EVENTS = 100


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass
class Log:
    df: DataFrame
    scope_keys: tuple[str, ...] = ()
    #: Transactions below it have ended; None if all have.
    watermark: int | None = None
    id_keys: dict[str, str] = field(default_factory=dict)
    tenant_key: str | None = None

    def scope_of(self, key: str, payload: Column | None = None) -> Column:
        """The physical column of a key, else the rule over the (parsed) payload."""
        return F.col(f"scope_{key}") if key in self.scope_keys else scope_value(F.parse_json("payload") if payload is None else payload, key)

    def with_df(self, change: Callable[[DataFrame], DataFrame]) -> Log:
        return Log(change(self.df), self.scope_keys, self.watermark, self.id_keys, self.tenant_key)

    @property
    def settled(self) -> Column:
        return F.lit(True) if self.watermark is None else F.col("transaction_id") < self.watermark


def extracted(df: DataFrame, scope_keys: tuple[str, ...], fields: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """A log's physical columns from sequence, transaction_id, event_type, payload, recorded_at: what a writer adds. fields:
    further columns by name, from the parsed payload."""
    wanted = {f"scope_{k}": (lambda v, k=k: scope_value(v, k)) for k in scope_keys} | (fields or {})
    own = F.call_function("get_json_object", F.col("payload"), F.concat(F.lit("$."), default_id_key_column(F.col("event_type"))))
    if not wanted:
        return df.select("*", own.alias("event_id"))
    # inside the lambda the payload is parsed once for all columns, also where a filter repeats the expression
    found = F.transform(F.array(F.parse_json("payload")), lambda v: F.struct(*[f(v).alias(n) for n, f in wanted.items()]))[0]
    return df.withColumn("_s", found).select(*df.columns, own.alias("event_id"), *[F.col("_s").getField(n).alias(n) for n in wanted])


EVENT_KEYS = ("userId", "tenantId")
ORDER_KEYS = ("customerRegisteredId", "orderPlacedId")


def events_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as records. Every tenth event has its user in another place: flat, as a number, nowhere, or both
    under scopes and flat."""
    e = read_table(spark, sf_dir, "events")
    way = F.col("event_id") % 10
    user, tenant = F.concat(F.lit("u"), F.col("user_id")), F.concat(F.lit("t"), F.col("user_id") % 5)
    head = F.concat(
        F.lit('{"'), default_id_key_column(F.col("event_type")), F.lit('":"e'), F.col("event_id"), F.lit('","cents":'), F.round(F.col("value") * 100).cast("long"),
        F.lit(',"k":'), F.get_json_object("props", "$.k"), F.lit(',"flag":'), F.when(F.col("event_id") % 3 == 0, "true").when(F.col("event_id") % 3 == 1, "false").otherwise("null"),
        F.lit(',"tags":["'), F.concat(F.lit("g"), F.col("event_id") % 4), F.lit('","'), F.concat(F.lit("h"), F.col("event_id") % 6), F.lit('"]'),
        F.lit(',"at":{"slot":'), F.col("event_id") % 7, F.lit("}"),
    )
    flat = F.when(way == 6, F.concat(F.lit(',"userId":"'), user, F.lit('"'))).when(way == 7, F.concat(F.lit(',"userId":'), F.col("user_id"))).when(way == 9, F.lit(',"userId":"x"')).otherwise("")
    inside = F.when(way.isin(6, 7, 8), "").otherwise(F.concat(F.lit('"userId":"'), user, F.lit('",')))
    payload = F.concat(head, flat, F.lit(',"scopes":{'), inside, F.lit('"tenantId":"'), tenant, F.lit('"}}'))
    return e.select(
        (F.col("event_id") + 1).alias("sequence"), (F.floor(F.col("event_id") / TRANSACTION_EVENTS) + 1).cast("long").alias("transaction_id"), "event_type", payload.alias("payload"), F.col("ts").alias("recorded_at"),
    )


def events_log(spark: SparkSession, sf_dir: str) -> Log:
    """The events table as a log that a FileStore keeps in the shared folder; written once a session."""
    return stored_log(spark, sf_dir, "events", events_frame, EVENT_KEYS, "tenantId")


def orders_log(spark: SparkSession, sf_dir: str) -> Log:
    """Customers, orders and lines as such a log."""
    return stored_log(spark, sf_dir, "orders", orders_frame, ORDER_KEYS, None)


_stored: dict[tuple, str] = {}


def store_of(spark: SparkSession, folder: str, keys: tuple[str, ...], tenant_key: str | None):
    """A store over a folder, through the session's file systems, with the amount of payloads as a column."""
    from strandlog.functions.registry import Schema
    from strandlog.sources.files import HadoopFiles
    from strandlog.sources.store import FileStore

    return FileStore(folder, Schema(tuple(keys), tenant_key=tenant_key, strict=False), files=HadoopFiles(spark), fields={"cents": "bigint"})


def new_store(spark: SparkSession, frame: DataFrame, keys: tuple[str, ...], tenant_key: str | None, in_order: bool = False):
    """A store in a folder of its own that is filled from a frame."""
    import uuid

    from strandlog.sources.files import shared_folder

    store = store_of(spark, f"{shared_folder(spark).rstrip('/')}/log-{uuid.uuid4().hex}", keys, tenant_key)
    store.import_frame(spark, frame, in_order)
    return store


def stored_folder(spark: SparkSession, sf_dir: str, name: str, frame: Callable[[SparkSession, str], DataFrame], keys: tuple[str, ...], tenant_key: str | None) -> str:
    made = spark.sparkContext.applicationId, sf_dir, name
    if made not in _stored:
        _stored[made] = new_store(spark, frame(spark, sf_dir), keys, tenant_key, frame is orders_frame).directory
    return _stored[made]


def stored_log(spark: SparkSession, sf_dir: str, name: str, frame: Callable[[SparkSession, str], DataFrame], keys: tuple[str, ...], tenant_key: str | None) -> Log:
    return shown(store_of(spark, stored_folder(spark, sf_dir, name, frame, keys, tenant_key), keys, tenant_key).snapshot(spark), keys)


def shown(log: Log, keys: tuple[str, ...]) -> Log:
    """A snapshot with the amount as cents, times as such, and a name for records without an id."""
    own = F.coalesce("event_id", F.concat(F.lit("~"), "sequence"))
    columns = ["sequence", "transaction_id", "event_type", own.alias("event_id"), "payload", F.col("recorded_at").cast("timestamp_ntz").alias("recorded_at"), *[f"scope_{k}" for k in keys], F.col("field_cents").alias("cents")]
    return log.with_df(lambda df: df.select(*columns))


#: The same log in DuckDB's SQL, as a common table expression named log.
EVENTS_LOG_SQL = """log0 AS (SELECT event_id + 1 AS sequence, (event_id // 100 + 1)::BIGINT AS transaction_id, event_type, ts AS recorded_at, round(value * 100)::BIGINT AS cents,
  lower(event_type[1]) || event_type[2:] || 'Id' AS id_key,
  '{"' || lower(event_type[1]) || event_type[2:] || 'Id":"e' || event_id || '","cents":' || round(value * 100)::BIGINT || ',"k":' || (props->>'$.k') || ',"flag":'
  || CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'null' END || ',"tags":["g' || event_id % 4 || '","h' || event_id % 6 || '"],"at":{"slot":' || event_id % 7 || '}'
  || CASE event_id % 10 WHEN 6 THEN ',"userId":"u' || user_id || '"' WHEN 7 THEN ',"userId":' || user_id WHEN 9 THEN ',"userId":"x"' ELSE '' END
  || ',"scopes":{' || CASE WHEN event_id % 10 IN (6, 7, 8) THEN '' ELSE '"userId":"u' || user_id || '",' END || '"tenantId":"t' || user_id % 5 || '"}}' AS payload FROM events),
log AS (SELECT *, json_extract_string(payload, '$.' || id_key) AS event_id,
  CASE WHEN json_type(payload, '$.scopes.userId') = 'VARCHAR' THEN json_extract_string(payload, '$.scopes.userId') WHEN json_type(payload, '$.userId') = 'VARCHAR' THEN json_extract_string(payload, '$.userId') END AS user_scope,
  CASE WHEN json_type(payload, '$.scopes.tenantId') = 'VARCHAR' THEN json_extract_string(payload, '$.scopes.tenantId') END AS tenant_scope FROM log0)"""


def sequenced(df: DataFrame, order: list[str]) -> DataFrame:
    """df with sequence: 1 to n in the given order, without bringing all rows to one task.

    Rows are dealt by range and numbered inside their range; a range starts after the rows of those before it, and is one
    file that is read in order. What reaches the driver is one count for each range.
    """
    from strandlog.operators.windows import numbered

    return numbered(df, [F.col(c) for c in order], "sequence")


def orders_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, orders and lines as records: adoption of three tables with their back-links, numbered in one order. Only
    numbers are sorted; the texts are made of them after that."""
    c, o, i = (read_table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    none = F.lit(0).cast("long")

    def part(df: DataFrame, rank: int, link: Column, a: str, b: Column, rest: list[Column]) -> DataFrame:
        more = [x.alias(f"o{n}") for n, x in enumerate(rest)]
        return df.select(F.lit(rank).alias("rank"), link.cast("long").alias("link"), F.col(a).cast("long").alias("a"), b.cast("long").alias("b"), *more)

    money = lambda x: F.round(F.col(x) * 100).cast("long")
    empty = [none, none, none, none]
    all_ = part(c, 1, F.lit(None), "c_custkey", none, empty).unionByName(part(o, 2, F.col("o_custkey"), "o_orderkey", none, empty))
    day = F.datediff("l_shipdate", F.lit("1970-01-01")).cast("long")
    lines = [F.col("l_partkey").cast("long"), F.col("l_suppkey").cast("long"), day, money("l_extendedprice")]
    all_ = all_.unionByName(part(i, 3, F.lit(None), "l_orderkey", F.col("l_linenumber"), lines))
    made = sequenced(all_, ["rank", "a", "b", "o0", "o1", "o2", "o3"])
    is_order, is_line = F.col("rank") == 2, F.col("rank") == 3
    quoted = lambda key, letter, value: F.concat(F.lit(f'"{key}":"{letter}'), value, F.lit('"'))
    customer, order = (lambda v: quoted("customerRegisteredId", "c", v)), (lambda v: quoted("orderPlacedId", "o", v))
    link = lambda value: F.concat(F.lit('"scopes":{'), value, F.lit("}"))
    body = F.when(is_line, F.concat(F.lit('"cents":'), "o3", F.lit(","), link(order("a")))).when(is_order, F.concat(order("a"), F.lit(","), link(customer("link")))).otherwise(customer("a"))
    type_ = F.when(is_line, "LineShipped").when(is_order, "OrderPlaced").otherwise("CustomerRegistered")
    payload = F.concat(F.lit("{"), body, F.lit("}"))
    return made.select("sequence", (F.floor((F.col("sequence") - 1) / TRANSACTION_EVENTS) + 1).cast("long").alias("transaction_id"), type_.alias("event_type"), payload.alias("payload"))


ORDERS_LOG_SQL = """parts AS (SELECT 1 AS rank, 'CustomerRegistered' AS event_type, 'c' || c_custkey AS event_id, NULL AS link, c_custkey AS a, 0 AS b, 0 AS o0, 0 AS o1, 0 AS o2, 0 AS o3 FROM customer
  UNION ALL SELECT 2, 'OrderPlaced', 'o' || o_orderkey, 'c' || o_custkey, o_orderkey, 0, 0, 0, 0, 0 FROM orders
  UNION ALL SELECT 3, 'LineShipped', NULL, 'o' || l_orderkey, l_orderkey, l_linenumber, l_partkey, l_suppkey, date_diff('day', DATE '1970-01-01', l_shipdate::DATE), round(l_extendedprice * 100)::BIGINT FROM lineitem),
numbered AS (SELECT *, row_number() OVER (ORDER BY rank, a, b, o0, o1, o2, o3) AS sequence FROM parts),
log AS (SELECT sequence, event_type, coalesce(event_id, '~' || sequence) AS event_id,
  CASE event_type WHEN 'OrderPlaced' THEN link WHEN 'CustomerRegistered' THEN event_id END AS customer_scope,
  CASE event_type WHEN 'LineShipped' THEN link WHEN 'OrderPlaced' THEN event_id END AS order_scope, o3::BIGINT AS cents FROM numbered)"""

__all__ = ["EVENTS_LOG_SQL", "ORDERS_LOG_SQL", "Log", "default_id_key", "events_frame", "events_log", "extracted", "orders_frame", "orders_log", "read_table", "sequenced", "stored_log", "string_at"]
