"""Numbering of rows in one total order, spread over tasks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlog.sources.files import shared_folder


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with name: 1 to n in the given order; ties get any order among themselves.

    Rows are shuffled once, to ranges of the order, and each range is written sorted to the shared folder as a file, because a
    second sampling could cut other ranges. A row's number is its place in its file, moved by the sizes of the files before;
    the sizes are all that the driver sees.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = f"{shared_folder(spark).rstrip('/')}/numbered-{uuid.uuid4().hex}"
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).write.parquet(place)
    ranged = spark.read.schema(df.schema).parquet(place).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_own"))
    before, rows = [], 0
    # names begin with the number of the range
    for r in sorted(ranged.groupBy("_file").agg(F.count("*").alias("n")).collect(), key=lambda r: r["_file"]):
        before.append((r["_file"], rows))
        rows += r["n"]
    starts = spark.createDataFrame(before, "_file string, _before bigint")
    return ranged.join(F.broadcast(starts), "_file").select(*df.columns, (F.col("_own") + F.col("_before") + 1).cast("long").alias(name))
