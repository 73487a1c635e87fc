"""What the operators of this subpackage share: reading text, folds, Arrow batches, grouping of sorted rows."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# XXH64 seed of Spark's own xxhash64, used for every hash that Python has to share with Spark.
SEED = 42


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors a copy of this package, once per application; Spark's own file server distributes it."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as packed:
            for source in sorted(package.rglob("*.py")):
                packed.write(source, source.relative_to(package.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(name: str = "text") -> Column:
    """The text as it is; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def fold(modulus: int) -> Column:
    """The fold of a document, from its id alone. A null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def give_back() -> None:
    """Return memory that is free to the system, so that a worker's stages do not add up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


# Rows of an Arrow batch are worked on in slices of about so many bytes, so that Python holds little at a time.
SLICE_BYTES = 4_000_000


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch as slices of at most about SLICE_BYTES, or of one row."""
    rows = max(1, int(batch.num_rows * SLICE_BYTES / max(1, batch.nbytes)))
    for begin in range(0, batch.num_rows, rows):
        part = batch.slice(begin, rows)
        if part.nbytes > 4 * SLICE_BYTES and rows > 1:  # long rows close together
            yield from (part.slice(i, 1) for i in range(part.num_rows))
        else:
            yield part


def each_slice(texts: pa.Array, make: Callable[[list[bytes]], pa.Array]) -> pa.Array:
    """``make`` of the texts (null: empty) of an array, a slice of some megabytes at a time."""
    parts = [make(texts_of(part.column(0))) for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]))] if len(texts) else [make([])]
    give_back()
    return pa.concat_arrays(parts)


def batches(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``make`` to slices of every Arrow batch, inside the tasks that read the rows; no shuffle."""

    ship(df.sparkSession)

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for item in items:
            yield from map(make, slices(item))
        give_back()

    return df.mapInArrow(run, schema)
