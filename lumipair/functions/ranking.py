"""Ranks, positions and quantiles of groups of any size.

A window over a whole group sorts that group in one task. Here the rows are range-partitioned by (group, value)
instead, so a group that holds a large share of all rows spreads over many tasks; the number of rows in the preceding
slices of the same group is then added to the position inside the slice. The slices are fixed by writing them out once,
which also keeps the result the same if executors are lost afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumipair.shared import lookup_join, written

# Up to this many rows per group the built-in exact percentile, which gathers a group's distinct values, is used.
SMALL_GROUP_ROWS = 100_000

# Rows of a slice that is sorted at once, some 40 MB, so that no sort spills. A shuffle to more than 200 partitions sorts its input,
# too, and spills where it is large (spark.shuffle.sort.bypassMergeThreshold), so that slices grow eightfold before there are more.
SLICE_ROWS = 250_000
LARGE_SLICE_ROWS = 2_000_000
UNSORTED_SLICES = 200
MOST_SLICES = 20_000

# Bins of equal width that a group's values are counted in, to find those that hold a quantile.
QUANTILE_BINS = 4096


def _rows_before(slices: DataFrame, keys: list[str]) -> DataFrame:
    """Add the rows of a group in earlier slices, and of the whole group, to per-slice counts."""
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return slices.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).withColumn(
        "_group_rows", F.sum("_rows").over(group)
    )


def sorting_slices(df: DataFrame) -> int:
    """Range partitions to sort ``df`` in. By the bytes of a shuffle, which are compressed, they would be too few and spill."""
    rows = df.count()
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, ceil(rows / SLICE_ROWS))
    return min(wanted, max(UNSORTED_SLICES, ceil(rows / LARGE_SLICE_ROWS)), MOST_SLICES)


def ordinals(df: DataFrame, keys: list[str], order: list[str], carry: list[str] | None = None) -> DataFrame:
    """Add ``ordinal``, the 0-based position within the group, and ``group_rows``. ``order`` must identify a row.

    ``carry`` names the columns that are kept beside the keys; all are by default.
    """
    kept = df.columns if carry is None else list(dict.fromkeys([*keys, *carry]))
    placed = written(
        df.repartitionByRange(sorting_slices(df), *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .select(*kept, F.monotonically_increasing_id().alias("_place")),
        "ordinals",
    ).withColumn("_slice", F.shiftright("_place", 33))
    slices = placed.groupBy(*keys, "_slice").agg(
        F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    return (
        lookup_join(placed, _rows_before(slices, keys).drop("_rows"), [*keys, "_slice"])
        .withColumn("ordinal", F.col("_place") - F.col("_first") + F.col("_before"))
        .withColumn("group_rows", F.col("_group_rows"))
        .drop("_place", "_slice", "_first", "_before", "_group_rows")
    )


def _inside(sorted_counts: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``_inside``, the sum of ``ties`` of the earlier rows of the same keys in a partition that is sorted by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = np.zeros(batch.num_rows, bool)
            for name in keys:
                column = batch.column(name)
                # Null keys are equal to each other.
                changed = pc.fill_null(pc.not_equal(column[1:], column[:-1]), False)
                fresh[1:] |= pc.or_(changed, pc.xor(pc.is_null(column[1:]), pc.is_null(column[:-1]))).to_numpy(zero_copy_only=False)
            ties = batch.column("ties").to_numpy()
            upto = np.cumsum(ties)
            first = np.flatnonzero(fresh)
            base = np.zeros(len(first) + 1, np.int64)
            base[1:] = upto[first] - ties[first]
            head = [batch.column(name)[0].as_py() for name in keys]
            if head == last:
                base[0] = -held
            before = upto - ties - np.repeat(base, np.diff(np.concatenate([[0], first, [batch.num_rows]])))
            last, held = [batch.column(name)[-1].as_py() for name in keys], int(before[-1] + ties[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before)], names=[*batch.schema.names, "_inside"])

    kinds = ", ".join(f"`{name}` {kind}" for name, kind in sorted_counts.dtypes)
    return sorted_counts.mapInArrow(run, f"{kinds}, _inside bigint")


def value_ranks(
    df: DataFrame, keys: list[str], value: str, weight: str | None = None, also: tuple[Column, ...] = ()
) -> DataFrame:
    """Per distinct value of each group: ``ties`` (its rows), ``before`` (rows with a smaller value), ``group_rows``.

    ``weight`` names the column with the number of rows that a row stands for; without it each is one. ``also`` are further
    aggregates of the rows of a value. Values are sorted in the slices that they are dealt to, and counted on as they come.
    """
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.groupBy(*keys, value).agg(rows.alias("ties"), *also)
    kept = [c for c in counts.columns if c not in (*keys, value, "ties")]
    dealt = counts.repartitionByRange(*keys, value).sortWithinPartitions(*keys, value)
    inside = written(_inside(dealt.withColumn("_slice", F.spark_partition_id()), keys), "ranks")
    slices = inside.groupBy(*keys, "_slice").agg(F.sum("ties").alias("_rows"))
    return (
        lookup_join(inside, _rows_before(slices, keys).drop("_rows"), [*keys, "_slice"])
        .withColumn("before", F.col("_inside") + F.col("_before"))
        .select(*keys, value, "ties", "before", F.col("_group_rows").alias("group_rows"), *kept)
    )


def unpivot(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Turn numeric columns into rows (keys, name, value)."""
    return df.unpivot(keys, [F.col(c).cast("double").alias(c) for c in columns], "name", "value")


def quantiles(
    long: DataFrame, keys: list[str], probabilities: list[float], rows_per_group: int | None = None,
    also: tuple[Column, ...] = (),
) -> DataFrame:
    """Exact quantiles of ``value`` per group with linear interpolation, as an array column ``quantiles``.

    ``also`` are further aggregates of the groups, taken in the same pass where there is one.

    ``rows_per_group`` is an upper bound the caller can prove. Without one, or above ``SMALL_GROUP_ROWS``, values are
    counted in bins between the group's ends first, and only the values of bins that hold a quantile are ranked.
    """
    if rows_per_group is not None and rows_per_group <= SMALL_GROUP_ROWS:
        wanted = F.array(*[F.lit(p) for p in probabilities])
        return long.groupBy(*keys).agg(F.percentile("value", wanted).alias("quantiles"), *also)
    present = long.filter(F.col("value").isNotNull())
    ends = [F.min("value").alias("_low"), F.max("value").alias("_high"), F.count("value").alias("_n")]
    groups = written(long.groupBy(*keys).agg(*ends, *also), "groups")
    ends = groups.select(*keys, "_low", "_high", "_n")
    # Without a finite width there is one bin only. The bin number never falls as the value grows.
    span = F.col("_high") - F.col("_low")
    share = F.when((span > 0) & (span < float("inf")), (F.col("value") - F.col("_low")) / span).otherwise(F.lit(0.0))
    bin_ = F.least(F.floor(share * F.lit(float(QUANTILE_BINS))), F.lit(QUANTILE_BINS - 1).cast("long"))
    binned = lookup_join(present.select(*keys, "value"), ends, keys).withColumn("_bin", bin_)
    earlier = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = binned.groupBy(*keys, "_bin", "_n").agg(F.count(F.lit(1)).alias("_rows")).withColumn(
        "_earlier", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    )
    positions = [(F.col("_n") - 1) * F.lit(p) for p in probabilities]
    places = [place for position in positions for place in (F.floor(position), F.ceil(position))]
    holds = [(F.col("_earlier") <= place) & (F.col("_earlier") + F.col("_rows") > place) for place in places]
    bins = counts.filter(reduce(or_, holds)).select(*keys, "_bin", "_earlier")
    ranked = value_ranks(lookup_join(binned.select(*keys, "_bin", "value"), bins, [*keys, "_bin"]), [*keys, "_bin", "_earlier"], "value")
    first = F.col("_earlier") + F.col("before")
    ranked = lookup_join(ranked, ends.select(*keys, "_n"), keys)
    at = [F.max(F.when((first <= place) & (first + F.col("ties") > place), F.col("value"))) for place in places]
    found = ranked.groupBy(*keys, "_n").agg(*[value.alias(f"_at{k}") for k, value in enumerate(at)])
    between = []
    for k, position in enumerate(positions):
        low, high = F.col(f"_at{2 * k}"), F.col(f"_at{2 * k + 1}")
        between.append(low + (high - low) * (position - F.floor(position)))
    middle = found.select(*keys, F.array(*between).alias("quantiles"))
    return lookup_join(groups.drop("_low", "_high", "_n"), middle, keys) if also else middle
