"""Small files of a log: on a local file system, or on any that Hadoop reads.

A log needs one thing of its file system: a file that is made whole or not at all, and only where there is none yet. Local
file systems have it by hard links; on others it is a rename that does not overwrite.
"""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class Part(io.RawIOBase):
    """A file that is read in parts, where they are asked for."""

    def __init__(self, files: Any, path: str):
        self.files, self.path, self.length, self.at = files, path, files.size(path), 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.length)[whence]
        return self.at

    def read(self, size: int = -1) -> bytes:
        found = self.files.read_part(self.path, self.at, self.length - self.at if size is None or size < 0 else min(size, self.length - self.at))
        self.at += len(found)
        return found


class LocalFiles:
    def read(self, path: str) -> bytes:
        with open(path, "rb") as f:
            return f.read()

    def read_part(self, path: str, offset: int, size: int) -> bytes:
        with open(path, "rb") as f:
            f.seek(offset)
            return f.read(size)

    def size(self, path: str) -> int:
        return os.stat(path).st_size

    def put_new(self, path: str, body: bytes) -> bool:
        """Makes the file; False if there is one already."""
        part = self._part(path, body)
        try:
            os.link(part, path)
        except FileExistsError:
            return False
        finally:
            os.unlink(part)
        return True

    def put(self, path: str, body: bytes) -> None:
        """Makes or replaces the file."""
        os.replace(self._part(path, body), path)

    def _part(self, path: str, body: bytes) -> str:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            f.write(body)
            f.flush()
            os.fsync(f.fileno())
        return part

    def delete(self, path: str) -> None:
        import shutil

        shutil.rmtree(path) if os.path.isdir(path) else os.unlink(path)

    def names(self, folder: str) -> list[str]:
        return sorted(os.listdir(folder)) if os.path.isdir(folder) else []

    def modified(self, path: str) -> float:
        return os.stat(path).st_mtime

    def exists(self, path: str) -> bool:
        return os.path.exists(path)


class HadoopFiles:
    """The same on a path that Hadoop knows, through the session's JVM."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str) -> tuple[Any, Any]:
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self._conf), at

    def read(self, path: str) -> bytes:
        return self.read_part(path, 0, -1)

    def read_part(self, path: str, offset: int, size: int) -> bytes:
        fs, at = self._at(path)
        if not fs.exists(at):
            raise FileNotFoundError(path)
        stream = fs.open(at)
        try:
            stream.seek(offset)
            return bytes(stream.readAllBytes() if size < 0 else stream.readNBytes(size))
        finally:
            stream.close()

    def size(self, path: str) -> int:
        fs, at = self._at(path)
        if not fs.exists(at):
            raise FileNotFoundError(path)
        return fs.getFileStatus(at).getLen()

    def put_new(self, path: str, body: bytes) -> bool:
        from py4j.protocol import Py4JJavaError

        part = self._part(path, body)
        fs, at = self._at(part)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._jvm.java.lang.reflect.Array.newInstance(rename.NONE.getDeclaringClass(), 1)
        options[0] = rename.NONE
        try:
            context.rename(at, self._jvm.org.apache.hadoop.fs.Path(path), options)
        except Py4JJavaError as e:
            if fs.exists(at):
                fs.delete(at, False)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def put(self, path: str, body: bytes) -> None:
        fs, at = self._at(path)
        stream = fs.create(at, True)
        try:
            stream.write(body)
        finally:
            stream.close()

    def _part(self, path: str, body: bytes) -> str:
        part = f"{path}.{uuid.uuid4().hex}.part"
        self.put(part, body)
        return part

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)

    def names(self, folder: str) -> list[str]:
        fs, at = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def modified(self, path: str) -> float:
        fs, at = self._at(path)
        return fs.getFileStatus(at).getModificationTime() / 1000

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables: spark.checkpoint.dir, else the context's checkpoint folder.

    Where neither is set, a session whose tasks all run in the driver's process gets a folder of its own; on a cluster this
    is an error.
    """
    context = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if place is None:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = tempfile.mkdtemp(prefix="strandlog-checkpoints-")
        context.setCheckpointDir(place)
    return place


@contextmanager
def one_file_a_task(spark: SparkSession) -> Iterator[None]:
    """What is planned inside reads each file whole in a task of its own, so sorted files stay ranges of their order."""
    names = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, str(1 << 40))
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the shared folder; Spark's cleaner deletes the files when the frame goes, where it is set to."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
