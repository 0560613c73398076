"""Numbers for rows that hold over every later reading, whatever the cluster looks like then."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one file that numbers leave room for, in bits; the file's own number, of FILE_BITS, stands above them.
ROW_BITS, FILE_BITS = 36, 27
#: Hashes of file names that are tried for one that tells all files apart; with many files none does, and their numbers are a table.
SEEDS = 8
#: Up to so many files are broadcast with their numbers, and so many ranges with theirs.
BROADCAST_FILES = 1_000_000


#: Rows per Arrow batch handed to workers: their strings and lists take several times a batch's bytes, and every core has a worker.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of Arrow batches, so that a worker's memory hangs on neither the table nor the rows of a partition."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared checkpoint folder, so that passes share one result. Only a local session may do without a folder's name."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and not context.master.startswith(("local[", "local")) or context.master.startswith("local-cluster") and not root:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="twinframe-"))
    return df.checkpoint()


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, in any case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def addressable(df: DataFrame) -> bool:
    """Whether each row is one of a Parquet file, as it stands there: a scan with nothing but projections and deterministic filters above."""
    run = df._jdf.queryExecution()
    nodes = set(re.findall(r"^[^A-Za-z\n]*([A-Za-z]+)", run.executedPlan().toString(), re.M))
    parquet = "FileScan parquet" in run.executedPlan().toString()
    return parquet and nodes <= {"FileScan", "ColumnarToRow", "Project", "Filter"} and run.analyzed().deterministic()


def numbered(df: DataFrame, column: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows with a number of their own in ``column``, the same in every later reading, by any number of cores.

    A row of a Parquet file is known by the file and its place there; how a reading splits the files doesn't matter. A file's number is a
    hash of its name, if one of a few hashes tells all files apart, else its place among the names. Any other rows go through
    ``keep`` first, which must make a table of them.
    """
    if not addressable(df):
        return keep(df.withColumn(column, F.monotonically_increasing_id()))
    name, number = column + "_file", column + "_number"
    files = df.select(F.col("_metadata.file_path").alias(name)).distinct()  # reads no column
    hashed = lambda path, seed: F.pmod(F.xxhash64(path, F.lit(seed)), F.lit(1 << FILE_BITS))
    n, *apart = files.agg(F.count("*"), *(F.count_distinct(hashed(name, k)) for k in range(SEEDS))).first()
    address = lambda file, place: (F.shiftleft(file, ROW_BITS) + place).alias(column)
    if n in apart:
        return df.select(*df.columns, address(hashed(F.col("_metadata.file_path"), apart.index(n)), F.col("_metadata.row_index")))
    at = df.withColumn(name, F.col("_metadata.file_path")).withColumn(column, F.col("_metadata.row_index"))
    files = keep(files.select(name, F.row_number().over(Window.orderBy(name)).cast("long").alias(number)))
    rows = at.join(F.broadcast(files) if n <= BROADCAST_FILES else files, name)
    return rows.select(*df.columns, address(F.col(number), F.col(column)))


def ranked(df: DataFrame, group: str, order: Column, column: str) -> DataFrame:
    """Adds each row's rank in its group, from 1, in the given total order; a group is as many tasks as it needs.

    Rows are sorted by range of group and order; a prefix scan over the counts of each range, one row for each range and group in it, says
    where its ranks begin.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at, place, run, first, before, same = (fresh(f"_{n}", df) for n in ("order", "place", "run", "first", "before", "group"))
    d = df.withColumn(at, order).repartitionByRange(width, group, at).sortWithinPartitions(group, at).drop(at)
    d = cut(d.withColumn(place, F.monotonically_increasing_id())).withColumn(run, F.shiftright(place, 33))
    counts = d.groupBy(F.col(group).alias(same), F.col(run).alias(run)).agg(F.min(place).alias(first), F.count("*").alias("n"))
    earlier = Window.partitionBy(same).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(same, F.col(run).alias(run + "_"), first, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    counts = cut(counts)
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_FILES else counts  # as many rows as there are ranges and groups
    placed = d.join(counts, F.col(group).eqNullSafe(F.col(same)) & (F.col(run) == F.col(run + "_")))
    return placed.select(*df.columns, (F.col(place) - F.col(first) + F.col(before) + 1).alias(column))
