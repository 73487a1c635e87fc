"""Writing samples and reports."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumipair.schema import PAIR

# Directories that a task writes to at the same time. With more of them its rows are sorted by directory.
OPEN_DIRECTORIES = 64


# Rows of a compressed file, which one task reads: some 100 MB.
FILE_ROWS = 2_000_000


def write_samples(samples: DataFrame, folder: str) -> None:
    """Write draws as compressed CSV, one directory per kind and channel pair. A folder that is already in use is refused.

    Draws that hold for every pair, as those of the prior do, need be given once only, with null for the pair (``read_samples``).
    A task keeps a file of each directory open, so that draws are not sorted, and spilled, to be written.
    """
    conf, name = samples.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, OPEN_DIRECTORIES)
    try:
        rows = samples.write.mode("errorifexists").partitionBy("kind", *PAIR).option("maxRecordsPerFile", FILE_ROWS)
        rows.option("header", True).option("compression", "gzip").csv(folder)
    finally:
        conf.set(name, before)


def read_samples(spark: SparkSession, folder: str, columns: str, pairs: DataFrame) -> DataFrame:
    """Draws that ``write_samples`` wrote; those without a pair are given to each of ``pairs`` (ch_x, ch_y, distinct).

    ``columns`` are the names and types of a file's columns, in their order.
    """
    rows = spark.read.schema(f"{columns}, kind string, ch_x int, ch_y int").csv(folder, header=True, enforceSchema=False)
    of_all = rows.filter(F.col("ch_x").isNull()).drop(*PAIR).crossJoin(F.broadcast(pairs.select(*PAIR)))
    return rows.filter(F.col("ch_x").isNotNull()).unionByName(of_all)


def append_report(report: DataFrame, folder: str, digits: int = 6, run_id: str | None = None) -> None:
    """Append report lines, separated by ``|`` and rounded half to even. Read back with ``header=True, sep='|'``.

    The lines of a run are a partition, ``run=<run_id>``. A job that is run again with its ``run_id`` replaces what it wrote
    before, finished or not, and leaves the lines of other runs alone. Without one every call is a run of its own.
    """
    run_id = uuid.uuid4().hex if run_id is None else run_id
    if not re.fullmatch(r"[A-Za-z0-9_-][A-Za-z0-9_.-]*", run_id):
        raise ValueError("a run id consists of letters, digits, dots, hyphens and underscores")
    rounded = [
        F.when(F.isnan(f.name) | F.col(f.name).isin(float("inf"), float("-inf")), F.col(f.name))
        .otherwise(F.bround(f.name, digits)).alias(f.name)
        if f.dataType.typeName() == "double" else F.col(f.name)
        for f in report.schema.fields
    ]
    lines = report.select(*rounded).write.mode("overwrite").option("header", True).option("sep", "|")
    lines.csv(f"{folder.rstrip('/')}/run={run_id}")


def write_new(df: DataFrame, folder: str) -> None:
    """Write a table as Parquet; a folder that is already in use is refused."""
    df.write.mode("errorifexists").parquet(folder)
