"""The log as a Structured Streaming source, and keyed states that a streaming query keeps.

spark.dataSource.register(LogSource); spark.readStream.format("strandlog").option("path", directory).load()
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from strandlog.operators.models import keyed
from strandlog.sources.files import LocalFiles
from strandlog.sources.store import FileStore, Segment

SCHEMA = "sequence bigint, transaction_id bigint, event_type string, event_id string, payload string, recorded_at string"
ORDER = ("transaction_id", "sequence")


class FileGroup(InputPartition):
    def __init__(self, segments: list[Segment]):
        self.segments = segments


class LogReader(DataSourceStreamReader):
    """Offsets are numbers of commits, and the last commit is always offered, whatever a process saw before. So a micro-batch
    holds whole commits, each record once in a query's life, and a query that is started again goes on from its checkpoint.

    A backlog is one batch of many tasks. The files are read by the executors; records that were erased are not delivered,
    and compacted files count as the last commit that is in them.
    """

    def __init__(self, directory: str, rows_each: int):
        self.directory, self.rows_each = directory, rows_each
        self._store: FileStore | None = None

    @property
    def store(self) -> FileStore:
        if self._store is None:
            self._store = FileStore(self.directory)
        return self._store

    def initialOffset(self) -> dict:
        return {"commit": 0}

    def latestOffset(self) -> dict:
        return {"commit": self.store.refresh()}

    def partitions(self, start: dict, end: dict) -> list[FileGroup]:
        groups: list[list[Segment]] = [[]]
        for s in self.store.segments():
            if start["commit"] < s.commit <= end["commit"]:
                if groups[-1] and sum(x.rows for x in groups[-1]) + s.rows > self.rows_each:
                    groups.append([])
                groups[-1].append(s)
        return [FileGroup(g) for g in groups if g] or [FileGroup([])]

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        names = ["sequence", "transaction_id", "event_type", "event_id", "payload", "recorded_at"]
        for s in partition.segments:
            yield from pq.read_table(pa.BufferReader(LocalFiles().read(f"{self.directory}/data/{s.file}")), columns=names).to_batches()

    def commit(self, end: dict) -> None:
        pass

    def __getstate__(self) -> dict:
        return {"directory": self.directory, "rows_each": self.rows_each, "_store": None}


class LogSource(DataSource):
    """path: the log's directory, on a file system that the executors mount. rowsEach: about so many rows for a task."""

    @classmethod
    def name(cls) -> str:
        return "strandlog"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: object) -> LogReader:
        return LogReader(self.options["path"], int(self.options.get("rowsEach", "250000")))


def read_stream(spark: SparkSession, directory: str, **options: str) -> DataFrame:
    spark.dataSource.register(LogSource)
    return spark.readStream.format("strandlog").options(path=directory, **options).load()


class StreamedStates:
    """States by key, kept by a streaming query: every micro-batch adds the partial states of its own keys as one Parquet
    folder, named by the batch, so a batch that is run again replaces itself. Reading merges them; compact() folds those so
    far into one. sums add up; last values are those of the last record by (transaction, sequence), as in the folds."""

    def __init__(self, directory: str, key: list[str], sums: dict[str, Column], last: dict[str, Column]):
        self.directory, self.key, self.sums, self.last = directory, key, sums, last

    def _folders(self, spark: SparkSession) -> tuple[int, list[tuple[int, str]]]:
        """The batch up to which states are folded into one, and the folders to read: (batch, name), complete ones only."""
        from strandlog.sources.files import HadoopFiles

        files = HadoopFiles(spark)
        names = [n for n in files.names(self.directory) if "=" in n and files.exists(f"{self.directory}/{n}/_SUCCESS")]
        bases = sorted((int(n.partition("=")[2]), n) for n in names if n.startswith("base="))
        upto = bases[-1][0] if bases else -1
        batches = sorted((int(n.partition("=")[2]), n) for n in names if n.startswith("batch="))
        return upto, bases[-1:] + [b for b in batches if b[0] > upto]

    def write(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self._folders(batch.sparkSession)[0]:
            return  # folded already; the query runs it again because it ended before it noted that
        at = F.struct(*ORDER)
        made = batch.groupBy(*self.key).agg(*[F.sum(c).alias(n) for n, c in self.sums.items()], *[F.max_by(c, at).alias(n) for n, c in self.last.items()], F.max(at).alias("at"))
        made.select(*self.key, *self.sums, *self.last, "at.*").write.mode("overwrite").parquet(f"{self.directory}/batch={batch_id}")

    def read(self, spark: SparkSession) -> DataFrame:
        return self._merged(spark, self._folders(spark)[1])

    def _merged(self, spark: SparkSession, folders: list[tuple[int, str]]) -> DataFrame:
        stored = spark.read.parquet(*[f"{self.directory}/{n}" for _, n in folders])
        return keyed(stored, stored.limit(0), self.key, list(self.sums), dict.fromkeys(self.last, ORDER), ORDER)

    def compact(self, spark: SparkSession) -> int:
        """Folds the batches so far into one folder and deletes theirs; how many. A read that began before may have to begin anew."""
        from strandlog.sources.files import HadoopFiles

        upto, folders = self._folders(spark)
        batches = [f for f in folders if f[0] > upto]
        if not batches:
            return 0
        self._merged(spark, folders).write.mode("overwrite").parquet(f"{self.directory}/base={batches[-1][0]}")
        for _, name in folders:
            HadoopFiles(spark).delete(f"{self.directory}/{name}")
        return len(batches)

    def start(self, stream: DataFrame, checkpoint: str, **trigger: object):
        return stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
