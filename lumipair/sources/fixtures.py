"""Image tables derived from the TPC-H-like test tables (see FIXTURES.md)."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumipair.functions.ranking import ordinals
from lumipair.schema import IMAGE, scanlines_schema
from lumipair.shared import new_table_path
from lumipair.sources.bands import align_channels, with_row_ranges

# Send this module's functions to the executors with the tasks, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LINEITEM_WIDTH = 100
EMBEDDING_SIDE = 8

_ingested: dict[tuple[str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _runs_of_rows(placed: DataFrame, channels: list[int]) -> DataFrame:
    """One row for each stretch of pixels of one image row that follow each other: ``col`` of the first, arrays of values."""
    planes = [f"c{c}" for c in channels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = np.zeros(batch.num_rows, bool)
            fresh[0] = True
            for name in (*IMAGE, "row"):
                values = batch.column(name)
                fresh[1:] |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
            col = batch.column("col").to_numpy()
            fresh[1:] |= col[1:] != col[:-1] + 1
            first = np.flatnonzero(fresh)
            ends = pa.array(np.append(first, batch.num_rows), pa.int32())
            heads = [batch.column(n).take(pa.array(first)) for n in (*IMAGE, "row", "height", "col")]
            lists = [pa.ListArray.from_arrays(ends, batch.column(p)) for p in planes]
            yield pa.RecordBatch.from_arrays([*heads, *lists], names=[*IMAGE, "row", "height", "col", *planes])

    schema = "condition string, image_id string, row int, height int, col long, " + ", ".join(f"{p} array<double>" for p in planes)
    return placed.select(*IMAGE, "row", "height", F.col("col").cast("long").alias("col"), *planes).mapInArrow(run, schema)


def ingest_lineitem(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Lay the line items of each (return flag, status) out as one image of four channels and write its scanlines."""
    values = {1: "l_quantity", 2: "l_extendedprice", 3: "l_discount", 4: "l_tax"}
    items = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linestatus") == "F", "sample").otherwise("control").alias("condition"),
        F.col("l_returnflag").alias("image_id"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *values.values(),
    )
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    placed = ordinals(items, IMAGE, order, list(values.values())).select(
        *IMAGE,
        F.expr(f"cast(ordinal div {LINEITEM_WIDTH} as int)").alias("row"),
        (F.col("ordinal") % LINEITEM_WIDTH).alias("col"),
        F.ceil(F.col("group_rows") / LINEITEM_WIDTH).cast("int").alias("height"),
        *[F.col(v).alias(f"c{c}") for c, v in values.items()],
    )
    # Items lie in order, so those of a row become one run, or two where a task or batch ends. Whole rows stay where they are; only
    # the runs of cut and short rows are shuffled, from the written table, and their rows added to it.
    width, names = F.lit(LINEITEM_WIDTH), [f"c{c}" for c in values]
    runs = _runs_of_rows(placed, list(values)).select(*IMAGE, "row", "height", width.alias("width"), *names, "col")
    with_row_ranges(runs.withColumn("whole", F.size("c1") == width)).write.parquet(path)
    parts = spark.read.parquet(path).filter(~F.col("whole"))
    gathered = parts.groupBy(*IMAGE, "row", "height").agg(F.sort_array(F.collect_list(F.struct("col", *names))).alias("_runs"))
    lines = gathered.select(*IMAGE, "row", "height", *[F.flatten(f"_runs.{c}").alias(c) for c in names])

    def padded(c):
        return F.concat(c, F.array_repeat(F.lit(None).cast("double"), width - F.size(c)))

    scanlines = lines.select(*IMAGE, "row", "height", width.alias("width"), *[padded(c).alias(c) for c in names], F.lit(0).cast("long").alias("col"))
    with_row_ranges(scanlines.withColumn("whole", F.lit(True))).write.mode("append").parquet(path)


def _whole_rows(spark: SparkSession, path: str) -> DataFrame:
    schema = scanlines_schema([1, 2, 3, 4], ranges=True)
    return spark.read.schema(schema.add("whole", "boolean")).parquet(path).filter("whole").drop("whole")


def lineitem_scanlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line-item images. Loading writes the scanlines once per application; later calls read that table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _ingested:
        try:
            return _whole_rows(spark, _ingested[key])
        except AnalysisException:
            del _ingested[key]
    path = new_table_path(spark, "lineitem")
    ingest_lineitem(spark, sf_dir, path)
    _ingested[key] = path
    return _whole_rows(spark, path)


def embedding_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of embedding vectors as two-channel images of 8 x 8 pixels; even image numbers are samples.

    Vectors are dealt by image before they are cut into rows, so that an image's rows are never dealt again by its keys.
    """
    side = EMBEDDING_SIDE
    vectors = table(spark, sf_dir, "embeddings").select(
        F.when(F.expr("(vec_id div 2) % 2") == 0, "sample").otherwise("control").alias("condition"),
        F.expr("cast(vec_id div 2 as string)").alias("image_id"),
        F.expr("cast(vec_id % 2 + 1 as int)").alias("channel"), "embedding",
    )
    return vectors.repartition(*IMAGE).select(
        *IMAGE, "channel", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("row"),
        F.lit(side).alias("height"), F.lit(side).alias("width"),
        F.col("embedding").cast("array<double>").alias("_vector"),
    ).withColumn("values", F.slice("_vector", F.col("row") * side + 1, F.lit(side))).drop("_vector")


def embedding_scanlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_channels(embedding_bands(spark, sf_dir), [1, 2])


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.expr("concat('img_', vec_id div 2, '_c', vec_id % 2 + 1, '.tif')").alias("name")
    )
