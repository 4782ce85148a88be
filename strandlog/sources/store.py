"""The log store: appends, guards and reads over a directory of Parquet files with numbered commits.

A batch is one Parquet file and becomes visible by one commit file, made only where there is none: of two writers that try
the same number one wins, and the other reads the new commits and checks its guard again. Readers see committed files only,
so a crash leaves nothing but a file that no commit names. Erasing and compacting are commits too, which name new files for
old ones; the old ones stay until a sweep, so no reader loses what it reads.

Every so many commits a manifest sums up those before it: the files with their ranges, and sorted runs of the hashes of the
unique keys, which are looked up and never held whole. A process reads the last manifest and the commits after it. A guard
reads only what is newer than the version that it holds.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace
from datetime import UTC, datetime
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions.errors import ConflictError, TransientError, UnindexableContextError, UniqueViolationError, UsageError
from strandlog.functions.filters import MOST_GUARD_VALUES, Query, checked_options, matches, normalised, scope_value_of, wire
from strandlog.functions.ids import lock_key, uuid7
from strandlog.functions.registry import EMPTY_SCHEMA, NewEvent, Recorded, Schema, check_envelope, from_payload, to_payload, value_at
from strandlog.sources.canonical import Log, extracted
from strandlog.sources.files import LocalFiles, Part, one_file_a_task

MOST_BATCH = 10_000
#: Of the rule by which scope values are extracted; to be raised when it changes.
RULE = 1
MOST_LOCKS = 512
#: A manifest is written by the commit whose number is a multiple of this.
MANIFEST_EVERY = 256
#: Rows of files that the driver keeps.
KEPT_ROWS = 400_000
#: Files of more rows are read by the columns that a filter looks at first.
MOST_WHOLE = 2_000
#: Files of fewer rows are put together by compact(), up to about MOST_ROWS.
SMALL_ROWS, MOST_ROWS = 50_000, 1_000_000
_BASE = [("sequence", pa.int64()), ("transaction_id", pa.int64()), ("event_type", pa.string()), ("event_id", pa.string()), ("payload", pa.string()), ("metadata", pa.string()), ("recorded_at", pa.string())]
_FIELDS = {"bigint": (pa.int64(), int), "double": (pa.float64(), (int, float)), "string": (pa.string(), str), "boolean": (pa.bool_(), bool)}


@dataclass(frozen=True)
class Appended:
    first: int
    last: int
    count: int
    transaction_id: int


@dataclass(frozen=True)
class Segment:
    """A file, the sequences and transactions that it may hold, its rows, and the commit that brought them."""

    file: str
    first: int
    last: int
    low: int
    high: int
    rows: int
    commit: int


@dataclass(frozen=True)
class Result:
    events: list[Recorded]
    by_filter: list[list[Recorded]]
    last_returned: int
    context_version: int
    settled_cursor: tuple[int, int] | None
    watermark: int | None
    query: Query

    @property
    def ctx(self) -> tuple[Query, int]:
        return self.query, self.context_version


class FileStore:
    """directory on a file system that files can write; executors must reach it for snapshots. fields: top-level fields of
    payloads that files also keep as typed columns (field_<name>), null where a payload has another kind of value.

    allocate_id and is_settled stand in for open transactions in tests; without them every commit is settled.
    """

    def __init__(
        self, directory: str, schema: Schema = EMPTY_SCHEMA, clock: Callable[[], datetime] | None = None, allocate_id: Callable[[int], int] | None = None, is_settled: Callable[[int], bool] | None = None,
        files: Any = None, fields: dict[str, str] | None = None,
    ):
        self.directory, self.schema, self.files = directory, schema, files or LocalFiles()
        self.clock = clock or (lambda: datetime.now(UTC))
        self.allocate_id, self.is_settled = allocate_id, is_settled
        self._lock = threading.RLock()
        self._listeners: list[Callable[[list[Recorded]], None]] = []
        self.doorbell = threading.Condition()
        #: By file and, where only rows that may match were read, by what they were to match.
        self._rows: OrderedDict[tuple[str, bytes], list[dict]] = OrderedDict()
        self.physical, self.fields = self._properties(fields or {})
        self._forget()

    def _properties(self, fields: dict[str, str]) -> tuple[tuple[str, ...], dict[str, str]]:
        """Scope keys and fields that every file has as columns: those declared when the directory was made. Keys that are
        declared later are found by the rule over the payload. A directory written under another rule is refused."""
        name = f"{self.directory}/properties.json"
        if unknown := set(fields.values()) - set(_FIELDS):
            raise UsageError(f"no such kinds of fields: {sorted(unknown)}")
        if not self.files.exists(name):
            self.files.put_new(name, json.dumps({"rule": RULE, "scope_keys": list(self.schema.scope_keys), "fields": fields}).encode())
        found = json.loads(self.files.read(name))
        if found["rule"] != RULE:
            raise UsageError(f"the log was written under rule {found['rule']} of scope values, this is rule {RULE}")
        return tuple(k for k in found["scope_keys"] if k in self.schema.scope_keys), found.get("fields", {})

    # ---- commits -----------------------------------------------------------------------------------------------------

    def _forget(self) -> None:
        self._n = self._last = self._high = self.erasures = 0
        self._segments: list[Segment] = []
        self._index()
        self._tail: set[str] = set()
        self._runs: list[str] = []
        self._dropped: dict[str, float] = {}

    def _index(self) -> None:
        self._segments.sort(key=lambda s: s.first)
        self._lasts = [s.last for s in self._segments]
        self._ends = [(s.high, s.last) for s in self._segments]
        #: Whether the order by transaction is the order by sequence.
        self._in_order = all(a[0] <= s.low for a, s in zip(self._ends, self._segments[1:], strict=False))

    def refresh(self) -> int:
        """Reads the commits that are new, after the last manifest; the number of the last one."""
        with self._lock:
            if not self._n:
                names = [n for n in self.files.names(f"{self.directory}/manifests") if n.endswith(".json")]
                if names:
                    m = json.loads(self.files.read(f"{self.directory}/manifests/{names[-1]}"))
                    self._n, self._last, self._high, self.erasures, self._runs, self._dropped = m["n"], m["last"], m["high"], m["erasures"], m["runs"], m["dropped"]
                    self._segments = [Segment(**s) for s in m["segments"]]
                    self._index()
            while True:
                try:
                    commit = json.loads(self.files.read(self._commit_name(self._n + 1)))
                except FileNotFoundError:
                    return self._n
                self._apply(commit)

    def _apply(self, commit: dict) -> None:
        self._n += 1
        gone = set(commit.get("gone", ()))
        fresh = [Segment(**s) for s in commit["segments"]]
        if gone:
            self._segments = [s for s in self._segments if s.file not in gone]
            self._dropped |= dict.fromkeys(gone, commit["at"])
            for k in [k for k in self._rows if k[0] in gone]:
                del self._rows[k]
        self._segments += fresh
        if gone or len(fresh) != 1 or not self._lasts or fresh[0].first <= self._lasts[-1]:
            self._index()
        else:
            self._in_order = self._in_order and self._ends[-1][0] <= fresh[0].low
            self._lasts.append(fresh[0].last)
            self._ends.append((fresh[0].high, fresh[0].last))
        self.erasures += commit.get("erased", 0) > 0
        self._last, self._high = max(self._last, commit["last"]), max(self._high, commit["transaction_id"])
        self._tail.update(commit.get("keys", ()))
        self._runs = [*self._runs, *commit.get("runs", ())]

    def _commit_name(self, n: int) -> str:
        return f"{self.directory}/commits/{n:020d}.json"

    def _publish(self, n: int, commit: dict) -> bool:
        if not self.files.put_new(self._commit_name(n), json.dumps(commit).encode()):
            return False
        self.refresh()
        if n % MANIFEST_EVERY == 0:
            self.write_manifest()
        return True

    def segments(self) -> list[Segment]:
        with self._lock:
            self.refresh()
            return list(self._segments)

    def write_manifest(self) -> None:
        """Sums up all commits so far. The keys since the last manifest become a sorted run; runs that are not longer than
        what they are put together with are merged, so there are few, and a key is written again a few times at most."""
        with self._lock:
            n = self.refresh()
            runs, keys = list(self._runs), sorted(self._tail)
            while runs and keys and self.files.size(f"{self.directory}/keys/{runs[-1]}") <= 64 * len(keys):
                raw = self.files.read(f"{self.directory}/keys/{runs.pop()}")
                keys = sorted({*keys, *(raw[k : k + 32].hex() for k in range(0, len(raw), 32))})
            if keys:
                runs.append(self._write_run(keys))
            body = {"n": n, "last": self._last, "high": self._high, "erasures": self.erasures, "runs": runs, "dropped": self._dropped, "segments": [asdict(s) for s in self._segments]}
            if self.files.put_new(f"{self.directory}/manifests/{n:020d}.json", json.dumps(body).encode()):
                self._runs, self._tail = runs, set()

    def _write_run(self, keys: list[str]) -> str:
        name = f"{uuid.uuid4().hex}.run"
        self.files.put(f"{self.directory}/keys/{name}", bytes.fromhex("".join(keys)))
        return name

    def is_taken(self, key: str) -> bool:
        """Whether a unique key's hash is in the log. Hashes are spread evenly, so a run is read near where one should be."""
        if key in self._tail:
            return True
        raw = bytes.fromhex(key)
        for run in self._runs:
            path = f"{self.directory}/keys/{run}"
            n, reach = self.files.size(path) // 32, 512
            guess = int(int(key[:16], 16) / 2**64 * n)
            while True:
                low, high = max(0, guess - reach), min(n, guess + reach)
                part = self.files.read_part(path, 32 * low, 32 * (high - low))
                found = [part[k : k + 32] for k in range(0, len(part), 32)]
                if (low == 0 or found[0] <= raw) and (high == n or found[-1] >= raw):
                    at = bisect_left(found, raw)
                    if at < len(found) and found[at] == raw:
                        return True
                    break
                reach *= 8
        return False

    def _rows_of(self, s: Segment, filters: list[dict] | None = None) -> list[dict]:
        """A file's rows; with filters, of a large file perhaps only those that may match them."""
        tests = self._column_tests(filters) if filters and s.rows > MOST_WHOLE else []
        key = s.file, hashlib.sha256(repr(tests).encode()).digest() if tests else b""
        with self._lock:
            key = (s.file, b"") if (s.file, b"") in self._rows else key
            if key in self._rows:
                self._rows.move_to_end(key)
                return self._rows[key]
        try:
            path = f"{self.directory}/data/{s.file}"
            found = self._some_rows(path, tests) if tests else pq.read_table(pa.BufferReader(self.files.read(path))).to_pylist()
        except FileNotFoundError:  # replaced and swept meanwhile
            self.refresh()
            now = [x for x in self._segments if x.first <= s.last and x.last >= s.first]
            if any(x.file == s.file for x in now):
                raise
            return [r for x in now for r in self._rows_of(x, filters) if s.first <= r["sequence"] <= s.last]
        with self._lock:
            self._rows[key] = found
            # an entry without rows takes room too
            while len(self._rows) > 1 and sum(map(len, self._rows.values())) + 16 * len(self._rows) > KEPT_ROWS:
                self._rows.popitem(last=False)
        return found

    def _column_tests(self, filters: list[dict]) -> list[list[tuple[str, list[str]]]]:
        """For every filter the columns that it looks at and the values that they must have; none where a filter has no such."""
        tests = []
        for f in filters:
            own = [("event_type", sorted(f["types"]))] if "types" in f else []
            own += [(f"scope_{k}", sorted(vs)) for k, vs in f.get("scopes", {}).items() if k in self.physical]
            if not own:
                return []
            tests.append(own)
        return tests

    def _some_rows(self, path: str, tests: list[list[tuple[str, list[str]]]]) -> list[dict]:
        """The rows that pass all column tests of a filter. The other columns are read only of row groups that hold such rows."""
        found: list[dict] = []
        file = pq.ParquetFile(pa.PythonFile(Part(self.files, path), mode="r"))
        names = sorted({name for own in tests for name, _ in own})
        for g in range(file.num_row_groups):
            tested = file.read_row_group(g, columns=names)
            some = None
            for own in tests:
                hit = None
                for name, values in own:
                    one = pc.is_in(tested.column(name), pa.array(values, pa.string()))
                    hit = one if hit is None else pc.and_(hit, one)
                some = hit if some is None else pc.or_(some, hit)
            if pc.any(some).as_py():
                found += file.read_row_group(g).filter(some).to_pylist()
        return found

    # ---- writes ------------------------------------------------------------------------------------------------------

    def append(self, events: list[NewEvent]) -> Appended:
        return self._append(events, None)

    def append_if(self, events: list[NewEvent], ctx: tuple[Query, int]) -> Appended:
        """Appends if no record that ctx's query matches is newer than ctx's version; else ConflictError."""
        query, version = ctx
        if version < 0:
            raise UsageError("a read without a version cannot guard an append")
        condition_lock_keys(query, self.schema)
        return self._append(events, (query, version))

    def _append(self, events: list[NewEvent], guard: tuple[Query, int] | None) -> Appended:
        if not 1 <= len(events) <= MOST_BATCH:
            raise UsageError(f"a batch has 1 to {MOST_BATCH} events")
        prepared = []
        for e in events:
            check_envelope(e, self.schema)
            e = replace(e, id=e.id or uuid7(), data=wire(e.data), metadata=wire(e.metadata) if e.metadata is not None else None)
            prepared.append((e, to_payload(e, self.schema.id_key(e.type))))
        keys = self._unique_keys(prepared)
        file = f"{uuid.uuid4().hex}.parquet"
        while True:
            with self._lock:
                n, first, high = self.refresh(), self._last + 1, self._high
            if guard is not None:
                actual = max(guard[1], self.version(guard[0], after=guard[1]))
                if actual > guard[1]:
                    raise ConflictError(guard[1], actual)
            for k, error in keys.items():
                if self.is_taken(k):
                    raise error
            txn = self.allocate_id(first) if self.allocate_id else high + 1
            self._write(file, prepared, first, txn)
            segment = Segment(file, first, first + len(prepared) - 1, txn, txn, len(prepared), n + 1)
            if self._publish(n + 1, {"transaction_id": txn, "last": segment.last, "segments": [asdict(segment)], "keys": sorted(keys)}):
                break
        self._announce(segment)
        return Appended(segment.first, segment.last, len(prepared), txn)

    def _unique_keys(self, prepared: list[tuple[NewEvent, dict]]) -> dict[str, UniqueViolationError]:
        found: dict[str, UniqueViolationError] = {}
        for e, payload in prepared:
            for parts, error in unique_parts(e.type, payload, e.metadata, self.schema):
                k = hashlib.sha256("\0".join(parts).encode()).hexdigest()
                if k in found:
                    raise error
                found[k] = error
        return found

    def _write(self, file: str, prepared: list[tuple[NewEvent, dict]], first: int, txn: int) -> None:
        now = self.clock().isoformat()
        keys = self.schema.scope_keys
        columns: list[list] = [[] for _ in range(len(_BASE) + len(keys) + len(self.fields))]
        for k, (e, payload) in enumerate(prepared):
            row = [first + k, txn, e.type, e.id, json.dumps(payload, separators=(",", ":"), ensure_ascii=False), None if e.metadata is None else json.dumps(e.metadata), now]
            typed = [v if isinstance(v := payload.get(f), _FIELDS[kind][1]) and (kind == "boolean" or not isinstance(v, bool)) else None for f, kind in self.fields.items()]
            for c, v in zip(columns, [*row, *[scope_value_of(payload, key) for key in keys], *typed], strict=True):
                c.append(v)
        schema = pa.schema([*_BASE, *[(f"scope_{k}", pa.string()) for k in keys], *[(f"field_{f}", _FIELDS[kind][0]) for f, kind in self.fields.items()]])
        self._put_table(file, pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))

    def _put_table(self, file: str, table: pa.Table) -> None:
        sink = pa.BufferOutputStream()
        pq.write_table(table, sink)
        self.files.put(f"{self.directory}/data/{file}", sink.getvalue().to_pybytes())

    def _announce(self, segment: Segment) -> None:
        with self.doorbell:
            self.doorbell.notify_all()
        if self._listeners:
            records = [self._recorded(r) for r in self._rows_of(segment)]
            for f in list(self._listeners):
                try:
                    f(records)
                except Exception:  # a listener's trouble is its own
                    continue

    def on_appended(self, f: Callable[[list[Recorded]], None]) -> Callable[[], None]:
        self._listeners.append(f)
        return lambda: self._listeners.remove(f) if f in self._listeners else None

    # ---- frames ------------------------------------------------------------------------------------------------------

    def kinds(self) -> str:
        base = "sequence bigint, transaction_id bigint, event_type string, event_id string, payload string, metadata string, recorded_at string"
        return ", ".join([base, *[f"scope_{k} string" for k in self.physical], *[f"field_{f} {kind}" for f, kind in self.fields.items()]])

    def frame(self, spark: SparkSession, segments: list[Segment]) -> DataFrame:
        names = [f"{self.directory}/data/{s.file}" for s in segments]
        return spark.read.schema(self.kinds()).parquet(*names) if names else spark.createDataFrame([], self.kinds())

    def snapshot(self, spark: SparkSession) -> Log:
        """The committed records as a DataFrame; later commits do not change it. Records count as settled below the oldest
        transaction that is open."""
        segments = self.segments()
        return Log(self.frame(spark, segments), self.physical, self._watermark(segments) if self.is_settled else None, dict(self.schema.id_keys), self.schema.tenant_key)

    def _watermark(self, segments: list[Segment]) -> int:
        """Transactions below it have ended: the oldest open one, else the next one."""
        if self.is_settled is None:
            return self._high + 1
        return min((t for s in segments for t in {s.low, s.high} if not self.is_settled(t)), default=self._high + 1)

    def import_frame(self, spark: SparkSession, df: DataFrame, in_order: bool = False) -> Appended:
        """Fills an empty log from a frame: sequence, transaction_id, event_type, payload, perhaps metadata and recorded_at
        (text), in one commit. Executors write the files, in ranges of the sequence, with the scope and field columns.
        in_order: each file that df reads is such a range already, as windows.numbered leaves them; nothing is shuffled."""
        if self.refresh():
            raise UsageError("only an empty log can be filled from a frame")
        for name in ("metadata", "recorded_at"):
            if name not in df.columns:
                df = df.withColumn(name, F.lit(None).cast("string"))
        base = df.select(F.col("sequence").cast("long").alias("sequence"), F.col("transaction_id").cast("long").alias("transaction_id"), "event_type", F.col("payload").cast("string").alias("payload"), F.col("metadata").cast("string").alias("metadata"), F.col("recorded_at").cast("string").alias("recorded_at"))
        typed = {f"field_{f}": (lambda v, f=f, kind=kind: field_value(v, f, kind)) for f, kind in self.fields.items()}
        names = ["sequence", "transaction_id", "event_type", "event_id", "payload", "metadata", "recorded_at", *[f"scope_{k}" for k in self.physical], *typed]
        segments = self._write_frame(spark, base, 1, change=lambda df: extracted(df, self.physical, typed).select(*names), in_order=in_order)
        runs = self._key_runs(self.frame(spark, segments))
        last, high = max((s.last for s in segments), default=0), max((s.high for s in segments), default=0)
        if not self._publish(1, {"transaction_id": high, "last": last, "segments": [asdict(s) for s in segments], "keys": [], "runs": runs}):
            raise UsageError("another writer began the log meanwhile")
        with self.doorbell:
            self.doorbell.notify_all()
        return Appended(min((s.first for s in segments), default=0), last, sum(s.rows for s in segments), high)

    def _write_frame(self, spark: SparkSession, df: DataFrame, commit: int, rows: int | None = None, change: Callable[[DataFrame], DataFrame] = lambda df: df, in_order: bool = False) -> list[Segment]:
        """Files of a frame with all columns, once change has added what it lacks, cut into ranges of the sequence and sorted by
        it. What reaches the driver is five numbers a file."""
        folder = uuid.uuid4().hex
        place = f"{self.directory}/data/{folder}"
        if in_order:
            with one_file_a_task(spark):
                change(df).write.option("maxRecordsPerFile", MOST_ROWS).parquet(place)
        else:
            rows = df.count() if rows is None else rows
            parts = max(1, -(-rows // MOST_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // 10_000)))
            change(df.repartitionByRange(parts, "sequence").sortWithinPartitions("sequence")).write.parquet(place)
        written = spark.read.schema(self.kinds()).parquet(place).select("*", F.col("_metadata.file_name").alias("_file"))
        found = written.groupBy("_file").agg(F.min("sequence").alias("a"), F.max("sequence").alias("b"), F.min("transaction_id").alias("c"), F.max("transaction_id").alias("d"), F.count("*").alias("n"))
        segments = sorted((Segment(f"{folder}/{r['_file']}", r["a"], r["b"], r["c"], r["d"], r["n"], commit) for r in found.collect()), key=lambda s: s.first)
        if in_order and any(s.last - s.first + 1 != s.rows for s in segments):  # not the ranges that were promised
            return self._write_frame(spark, written.drop("_file"), commit)
        return segments

    def _key_runs(self, df: DataFrame) -> list[str]:
        """The unique keys of a frame as one sorted run; an error if one comes twice."""
        types = [t for t, paths in self.schema.uniques.items() if paths]
        rows = df.where(F.col("metadata").isNotNull() | F.col("event_type").isin(types) if types else F.col("metadata").isNotNull()).select("event_type", "payload", "metadata")
        schema = self.schema

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for t, p, m in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    out += [hashlib.sha256("\0".join(parts).encode()).hexdigest() for parts, _ in unique_parts(t, json.loads(p), json.loads(m) if m else None, schema)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["k"])

        counted = rows.mapInArrow(keys, "k string").groupBy("k").agg(F.count("*").alias("n"))
        found, twice = [], False
        for r in counted.orderBy("k").toLocalIterator():
            found.append(r["k"])
            twice |= r["n"] > 1
        if twice:
            raise UniqueViolationError()
        return [self._write_run(found)] if found else []

    def compact(self, spark: SparkSession | None = None) -> int:
        """Puts neighbouring small files together; with a session on the executors. How many files went. Reads that began
        before go on with the old files until they are swept."""
        while True:
            n = self.refresh()
            groups: list[list[Segment]] = [[]]
            for s in self.segments():
                if s.rows >= SMALL_ROWS or sum(x.rows for x in groups[-1]) + s.rows > MOST_ROWS:
                    groups.append([])
                if s.rows < SMALL_ROWS:
                    groups[-1].append(s)
            groups = [g for g in groups if len(g) > 1]
            if not groups:
                return 0
            fresh: list[Segment] = []
            for g in groups:
                if spark is not None:
                    fresh += [replace(s, commit=g[-1].commit) for s in self._write_frame(spark, self.frame(spark, g), 0, 1)]
                    continue
                file = f"{uuid.uuid4().hex}.parquet"
                tables = [pq.read_table(pa.BufferReader(self.files.read(f"{self.directory}/data/{s.file}"))) for s in g]
                self._put_table(file, pa.concat_tables(tables, promote_options="default").sort_by("sequence"))
                fresh.append(Segment(file, g[0].first, g[-1].last, min(s.low for s in g), max(s.high for s in g), sum(s.rows for s in g), g[-1].commit))
            gone = [s.file for g in groups for s in g]
            if self._publish(n + 1, {"transaction_id": 0, "last": 0, "gone": gone, "at": time.time(), "segments": [asdict(s) for s in fresh]}):
                return len(gone)

    # ---- reads -------------------------------------------------------------------------------------------------------

    def _recorded(self, row: dict) -> Recorded:
        return recorded(row, self.schema, True if self.is_settled is None else self.is_settled(row["transaction_id"]))

    def _hits(self, filters: list[dict], row: dict) -> list[bool] | None:
        """Which filters a row matches, None for none. Scopes with a column are compared there; payloads are parsed only where
        a filter looks into them."""
        if filters == [{}]:
            return [True]
        payload = None
        out, some = [], False
        for f in filters:
            hit = "types" not in f or row["event_type"] in f["types"]
            for k, vs in f.get("scopes", {}).items() if hit else ():
                if k in self.physical and row.get(f"scope_{k}") not in vs:
                    hit = False
                    break
            if hit and ("where" in f or "not" in f or any(k not in self.physical for k in f.get("scopes", ()))):
                payload = json.loads(row["payload"]) if payload is None else payload
                hit = matches(f, row["event_type"], payload)
            out.append(hit)
            some = some or hit
        return out if some else None

    def version(self, query: Query, after: int = 0) -> int:
        """The highest matching sequence beyond `after`, 0 if none; reads backwards until one file has a match."""
        return self._last_match(normalised(query), self.segments(), None, after)

    def _last_match(self, filters: list[dict], segments: list[Segment], until: int | None, after: int = 0) -> int:
        for s in reversed(segments):
            if s.last <= after:
                break
            if until is not None and s.first > until:
                continue
            best = max((r["sequence"] for r in self._rows_of(s, filters) if r["sequence"] > after and (until is None or r["sequence"] <= until) and self._hits(filters, r)), default=0)
            if best:
                return best
        return 0

    def query(self, query: Query, **options: Any) -> Result:
        """A page for the driver. Large reads go through snapshot() and operators.read.

        Files that lie before the bounds are not read, and a page that is full ends the read: what a run of pages reads is in
        proportion to the log, not to its square. The version is looked for from the end; version=False saves that.
        """
        checked_options(**options)
        filters, segments = normalised(query), self.segments()
        until, after, cursor, limit = (options.get(k) for k in ("until", "after", "cursor", "limit"))
        descending = options.get("order") == "desc"
        by_tuple = "cursor" in options or options.get("settled_only")
        in_order = self.is_settled is None and self._in_order
        if until is not None:
            segments = [s for s in segments if s.first <= until]
        start = 0
        if after is not None:
            start = bisect_right(self._lasts, after)
        if cursor is not None and in_order:
            start = max(start, bisect_right(self._ends, cursor))
        early = limit is not None and (in_order or not by_tuple)
        forward = in_order and not descending
        seen, hits, full = 0, [], False
        for s in segments[start:] if not descending else reversed(segments[start:]):
            rows = self._rows_of(s, filters)
            if forward and (cursor is not None or after is not None):
                # rows before the bounds; the version is looked for from the end
                low = bisect_right(rows, cursor, key=lambda r: (r["transaction_id"], r["sequence"])) if cursor is not None else 0
                rows = rows[max(low, bisect_right(rows, after, key=lambda r: r["sequence"]) if after is not None else 0) :]
            for row in reversed(rows) if descending else rows:
                if until is not None and row["sequence"] > until:
                    continue
                if early and len(hits) >= limit:
                    full = True
                    break
                hit = self._hits(filters, row)
                if hit is None:
                    continue
                seen = max(seen, row["sequence"])
                if after is not None and row["sequence"] <= after:
                    continue
                settled = self.is_settled is None or self.is_settled(row["transaction_id"])
                if options.get("settled_only") and not settled or cursor is not None and settled and (row["transaction_id"], row["sequence"]) <= cursor:
                    continue
                hits.append((self._projected(self._recorded(row), options), hit))
            if full:
                break
        version = -1
        if options.get("version") is not False:
            beyond = self._last_match(filters, segments, until, seen) if full and not (descending and seen) else 0
            version = beyond or seen or self._last_match(filters, segments, until)
        if not early:
            hits.sort(key=lambda h: (h[0].transaction_id, h[0].sequence) if by_tuple else h[0].sequence, reverse=descending)
        hits = hits[:limit] if limit is not None else hits
        ended = [(h.transaction_id, h.sequence) for h, _ in hits if h.settled]
        return Result(
            [h for h, _ in hits], [[h for h, hit in hits if hit[k]] for k in range(len(filters))], max((h.sequence for h, _ in hits), default=0),
            version, max(ended, default=None), self._watermark(segments), query,
        )

    def _projected(self, r: Recorded, options: dict) -> Recorded:
        own = self.schema.id_key(r.type)
        if options.get("payload") is False:
            return replace(r, data={}, scopes={}, id=f"~{r.sequence}")
        if options.get("data") is False:
            return replace(r, data={k: r.data[k] for k in self.schema.scope_keys if isinstance(r.data.get(k), str)})
        if omit := options.get("omit"):
            if own in omit:
                raise UsageError(f"omit cannot drop {own}, the own id key of {r.type}")
            return replace(r, data={k: v for k, v in r.data.items() if k not in omit})
        return r

    def statistics(self, query: Query | None = None) -> list[dict]:
        """For the driver; operators.read.statistics does the same over a snapshot of any size."""
        filters, found = normalised(query if query is not None else {}), {}
        for segment in self.segments():
            for row in self._rows_of(segment, filters):
                if self._hits(filters, row):
                    s = found.setdefault(row["event_type"], {"type": row["event_type"], "count": 0, "bytes": 0, "last_sequence": 0})
                    s["count"] += 1
                    s["bytes"] += len(row["payload"].encode())
                    s["last_sequence"] = max(s["last_sequence"], row["sequence"])
        return [found[t] for t in sorted(found)]

    def wait(self, beyond: int, timeout: float) -> bool:
        """Waits until there are more than so many commits; True if there are. Other processes' commits are polled."""
        deadline = time.time() + timeout
        while self.refresh() <= beyond:
            left = deadline - time.time()
            if left <= 0:
                return False
            with self.doorbell:
                self.doorbell.wait(min(left, 0.2))
        return True

    def erase(self, query: Query) -> int:
        """Takes matching records out of the log; sequences and the keys of uniques stay taken. No read that begins after the
        commit sees them; their bytes go with the next sweep. Models that fold a page while it is erased read it again;
        states and models that were folded before must be invalidated by the caller. Returns how many records went."""
        filters = normalised(query)
        while True:
            n, gone, fresh, erased = self.refresh(), [], [], 0
            for s in self.segments():
                stay = [not self._hits(filters, r) for r in self._rows_of(s)]
                if all(stay):
                    continue
                table = pq.read_table(pa.BufferReader(self.files.read(f"{self.directory}/data/{s.file}")))
                file = f"{uuid.uuid4().hex}.parquet"
                self._put_table(file, table.filter(pa.array(stay)))
                gone.append(s.file)
                fresh.append(replace(s, file=file, rows=sum(stay)))
                erased += len(stay) - sum(stay)
            if not gone or self._publish(n + 1, {"transaction_id": 0, "last": 0, "gone": gone, "at": time.time(), "erased": erased, "segments": [asdict(s) for s in fresh]}):
                with self.doorbell:
                    self.doorbell.notify_all()
                return erased

    def erase_frame(self, spark: SparkSession, query: Query) -> int:
        """The same on the executors, for logs and tenants of any size: only files that hold a match are written anew."""
        from strandlog.operators.read import matching

        while True:
            n, segments = self.refresh(), self.segments()
            log = Log(self.frame(spark, segments).withColumn("_file", F.col("_metadata.file_path")), self.physical, None, dict(self.schema.id_keys), self.schema.tenant_key)
            hit = {r["_file"]: r["n"] for r in matching(log, query)[0].groupBy("_file").agg(F.count("*").alias("n")).collect()}
            touched = [s for s in segments if any(f.endswith(f"/data/{s.file}") for f in hit)]
            if not touched:
                return 0
            old = Log(self.frame(spark, touched), self.physical, None, dict(self.schema.id_keys), self.schema.tenant_key)
            gone = matching(old, query)[0].select("sequence")
            stay = old.df.join(gone, "sequence", "left_anti").select(*old.df.columns)
            fresh = [replace(s, commit=max(x.commit for x in touched if x.first <= s.last and x.last >= s.first)) for s in self._write_frame(spark, stay, 0)]
            body = {"transaction_id": 0, "last": 0, "gone": [s.file for s in touched], "at": time.time(), "erased": sum(hit.values()), "segments": [asdict(s) for s in fresh]}
            if self._publish(n + 1, body):
                return body["erased"]

    def sweep(self, older_than: float = 3600.0) -> int:
        """Deletes data files that no commit names any more since so many seconds, and those of that age that none ever
        named: younger ones may belong to a writer that is about to commit. Returns how many were deleted."""
        self.refresh()
        named, limit, count = {s.file for s in self._segments}, time.time() - older_than, 0
        for top in self.files.names(f"{self.directory}/data"):
            inner = [f"{top}/{f}" for f in self.files.names(f"{self.directory}/data/{top}") if f.endswith(".parquet")]
            for f in inner or [top]:
                path = f"{self.directory}/data/{f}"
                if f not in named and self._dropped.get(f, self.files.modified(path)) < limit:
                    self.files.delete(path)
                    count += 1
        return count


def recorded(row: dict, schema: Schema, settled: bool = True) -> Recorded:
    """A stored row as a record of the current versions of its type."""
    own, data, scopes = from_payload(json.loads(row["payload"]), schema.id_key(row["event_type"]))
    up = schema.upcasts.get(row["event_type"])
    return Recorded(row["sequence"], row["transaction_id"], row["event_type"], own or f"~{row['sequence']}", up(data) if up else data, scopes, json.loads(row["metadata"]) if row["metadata"] else None, row["recorded_at"], settled)


def field_value(payload: Column, name: str, kind: str) -> Column:
    """A top-level field of a parsed payload as a typed column; null for another kind of value."""
    from strandlog.functions.filters import kind as kind_of
    from strandlog.functions.filters import path

    at = F.try_variant_get(payload, path(name), "variant")
    wanted = {"bigint": "^BIGINT", "double": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "string": "^STRING", "boolean": "^BOOLEAN"}[kind]
    return F.when(kind_of(at).rlike(wanted), F.try_variant_get(at, "$", kind))


def unique_parts(type_: str, payload: dict, metadata: dict | None, schema: Schema) -> Iterator[tuple[list[str], UniqueViolationError]]:
    """What a record claims for itself alone: values at unique paths, and its idempotency key within its tenant."""
    for path in schema.uniques.get(type_, ()):
        if (v := value_at(payload, path)) is not None:
            yield ["unique", type_, path, json.dumps(v, sort_keys=True)], UniqueViolationError(type_, path)
    if (v := (metadata or {}).get("idempotencyKey")) is not None:
        tenant = scope_value_of(payload, schema.tenant_key) if schema.tenant_key else None
        yield ["key", tenant or "", str(v)], UniqueViolationError(idempotency_key=True)


def condition_lock_keys(query: Query, schema: Schema) -> tuple[list[int], bool, list[int]]:
    """(keys, whether the whole log must be held, tenants held whole) that a guard names; errors for guards that cannot
    be held. One commit point makes the locks themselves unnecessary; the rules stay."""
    keys, tenants, whole = set(), set(), False
    for f in normalised(query):
        for k, values in f.get("scopes", {}).items():
            if len(values) > MOST_GUARD_VALUES:
                raise UsageError(f"a guard names at most {MOST_GUARD_VALUES} values of scope {k}")
        declared = {k: v for k, v in f.get("scopes", {}).items() if k in schema.scope_keys}
        others = {k: v for k, v in declared.items() if k != schema.tenant_key}
        if others:
            keys.update(lock_key(f"scope:{k}={v}", schema.lock_salt) for k, vs in others.items() for v in vs)
        elif declared:
            tenants.update(lock_key(f"scope:{k}={v}", schema.lock_salt) for k, vs in declared.items() for v in vs)
        elif schema.strict:
            raise UnindexableContextError(f"the filter names no declared scope key: {f}")
        else:
            whole = True
    return sorted(keys), whole or len(keys) > MOST_LOCKS, sorted(tenants)


def event_lock_keys(events: list[NewEvent], schema: Schema) -> list[int]:
    """Keys that an append touches: own ids, scopes and flat strings at declared keys, without the tenant's."""
    found = set()
    for e in events:
        payload = to_payload(e, schema.id_key(e.type))
        for k in schema.scope_keys:
            if k != schema.tenant_key:
                found.update(lock_key(f"scope:{k}={v}", schema.lock_salt) for v in {e.scopes.get(k), payload.get(k)} if isinstance(v, str))
    return sorted(found)


__all__ = ["Appended", "FileStore", "Result", "Segment", "TransientError", "condition_lock_keys", "event_lock_keys"]
