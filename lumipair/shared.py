"""Tables written between the passes of a job, and joins against them.

Several operators need two passes over the pixels (a threshold first, the mask second). The result of the first pass
is written to the folder all executors share, so a lost executor costs a re-read and not a recomputation, and its
real size is known before the second pass is planned.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest lookup table sent to every executor. Anything larger is shuffled, where adaptive execution splits skewed
# partitions.
BROADCAST_BYTES = 128 * 1024 * 1024

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode, where it is shared by nature."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="/tmp/spark-")
    return _own_folders[app]


def new_table_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/lumipair/{app}/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files; otherwise they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    spark = df.sparkSession
    path = new_table_path(spark, label)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_tables(*tables: DataFrame) -> None:
    """Delete tables that ``written`` returned and that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        root = f"/lumipair/{spark.sparkContext.applicationId}/"
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            if root in folder:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remove_written(spark: SparkSession) -> None:
    """Delete all tables this application has written in between. DataFrames that read them stop working."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(
        f"{shared_folder(spark)}/lumipair/{spark.sparkContext.applicationId}"
    )
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def table_bytes(lookup: DataFrame) -> int:
    """The measured size of a lookup in memory: its strings as long as they are, 32 bytes for an array's element, 8 for any
    other value and 32 for a row."""
    texts = [F.sum(F.octet_length(c)) for c, kind in lookup.dtypes if kind == "string"]
    arrays = [F.sum(32 * F.size(c)) for c, kind in lookup.dtypes if kind.startswith("array")]
    n, *lengths = lookup.agg(F.count(F.lit(1)), *texts, *arrays).first()
    return n * (32 + 8 * len(lookup.columns)) + sum(x or 0 for x in lengths)


def lookup_join(
    big: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner", at_most: int | None = None
) -> DataFrame:
    """Join a per-key lookup table to a large table, with equal rows whichever way it goes.

    ``at_most`` is a row count the caller can prove for lookups of numbers and names of bounded length. Otherwise the
    lookup is written first and its bytes are measured. They decide between a broadcast and an ordinary shuffled join.
    """
    if at_most is None:
        lookup = written(lookup, "lookup")
        small = table_bytes(lookup) <= BROADCAST_BYTES
    else:
        small = at_most * (32 + 80 * len(lookup.columns)) <= BROADCAST_BYTES
    return big.join(F.broadcast(lookup) if small else lookup, keys, how)
