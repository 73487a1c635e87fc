"""Rank correlations of patches too large for one task.

The values of such a patch are ranked by ``value_ranks``, which spreads a patch over many tasks. Equal values always
stay together, so the results are exact and equal to the ones of the small-patch path.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumipair.functions.ranking import value_ranks
from lumipair.operators.rank_methods import concordance
from lumipair.shared import lookup_join, written

# Send this module's functions to the executors with the tasks, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows that are computed at once, unless one slice has more.
BATCH_CELLS = 100_000

PATCH_NUMBER = ["_patch"]


def _collapsed(pixels: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct (x, y) of each patch with their number, counted before any shuffle, and the keys of each patch.

    Patches go by a number, ``_patch``, from here on, which is shorter to move and to sort than their keys.
    """
    cells = written(pixels.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("weight")), "collapsed")
    patches = written(cells.select(*keys).distinct().withColumn("_patch", F.monotonically_increasing_id()), "patches")
    return lookup_join(cells, patches, keys).select("_patch", "x", "y", "weight"), patches


def _centred() -> Column:
    """Average rank minus the mean rank (group_rows + 1) / 2, which both sides share."""
    return F.col("before") + (F.col("ties") - F.col("group_rows")) / F.lit(2.0)


def spearman(pixels: DataFrame, keys: list[str], slice_rows: int) -> DataFrame:
    """Ranks of y are joined to the cells; what they sum up to at each x is carried along when x is ranked, without a join."""
    cells, patches = _collapsed(pixels, keys)
    of_y = written(value_ranks(cells, PATCH_NUMBER, "y", "weight").withColumn("rank_y", _centred()), "ranks")
    placed = cells.join(of_y.select("_patch", "y", "rank_y"), ["y", "_patch"])
    of_x = value_ranks(placed, PATCH_NUMBER, "x", "weight", (F.sum(F.col("weight") * F.col("rank_y")).alias("moment"),))
    square_x = F.sum(F.col("ties") * F.col("rank_x") * F.col("rank_x")).alias("square_x")
    square_y = F.sum(F.col("ties") * F.col("rank_y") * F.col("rank_y")).alias("square_y")
    sums = of_x.withColumn("rank_x", _centred()).groupBy("_patch").agg(
        F.max("group_rows").alias("n"), F.sum(F.col("rank_x") * F.col("moment")).alias("both"), square_x
    ).join(of_y.groupBy("_patch").agg(square_y), "_patch")
    rho = F.try_divide("both", F.sqrt("square_x") * F.sqrt("square_y"))
    bounded = F.when(rho.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho)))
    return patches.join(sums, "_patch").select(*keys, "n", bounded.alias("rho"))


def _slice_of(slice_rows: int) -> Column:
    """A slice number that grows with the value; a value with more than ``slice_rows`` ties has an odd one alone."""
    heavy = F.when(F.col("ties") > slice_rows, 1).otherwise(0)
    return 2 * F.floor(F.col("before") / F.lit(slice_rows)) + heavy


def _scores(items: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Concordance of each slice of rows sorted by slice, ``BATCH_CELLS`` rows at a time or one slice; the last slice of a batch
    may go on in the next. ``columns``: slice number, x, y and weight."""

    def scored(cells: pa.Table) -> pa.RecordBatch:
        cells = cells.combine_chunks()
        fresh = np.zeros(cells.num_rows, bool)
        fresh[0] = True
        for name in (*keys, columns[0]):
            # Null keys are equal to each other.
            changed = pc.fill_null(pc.not_equal(cells[name][1:], cells[name][:-1]), False)
            fresh[1:] |= pc.or_(changed, pc.xor(pc.is_null(cells[name][1:]), pc.is_null(cells[name][:-1]))).to_numpy()
        x, y, weight = (cells[c].to_numpy() for c in columns[1:])
        first = np.flatnonzero(fresh)
        total = concordance(np.cumsum(fresh) - 1, x, y, weight.astype(np.float64), len(first))
        heads = cells.select(keys).take(pa.array(first)).combine_chunks()
        return pa.RecordBatch.from_arrays([*[heads[k].combine_chunks() for k in keys], pa.array(total)], names=[*keys, "score"])

    def last_slice(cells: pa.Table) -> int:
        """Where the last slice of the rows begins."""
        same = np.ones(cells.num_rows, bool)
        for name in (*keys, columns[0]):
            value = cells[name][-1]
            equal = pc.fill_null(pc.equal(cells[name], value), False) if value.is_valid else pc.is_null(cells[name])
            same &= equal.to_numpy()
        return int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0

    held: list[pa.Table] = []
    n = 0
    for item in items:
        if not item.num_rows:
            continue
        held.append(pa.Table.from_batches([item]))
        n += item.num_rows
        if n >= BATCH_CELLS:
            cells = pa.concat_tables(held)
            end = last_slice(cells)
            if end:
                yield scored(cells.slice(0, end))
            held, n = [cells.slice(end)], cells.num_rows - end
    if n:
        yield scored(pa.concat_tables(held))


def _inside_slices(cells: DataFrame, keys: list[str], by: str, x: str, y: str) -> DataFrame:
    """Concordance of the pairs within each slice. Slices of a single value (odd numbers) have none.

    Slices are sorted by number and computed many at once, as a patch has as many as its pixels need.
    """
    types = dict(cells.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", score double"
    light = cells.filter(F.col(by) % 2 == 0).select(
        *keys, F.col(by).alias("_slice"), F.col(x).alias("_x"), F.col(y).alias("_y"), "weight"
    )
    dealt = light.repartition(*keys, "_slice").sortWithinPartitions(*keys, "_slice")
    return dealt.mapInArrow(lambda items: _scores(items, keys, ["_slice", "_x", "_y", "weight"]), schema)


def _between_slices(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Concordance of the pairs that differ in both slice numbers, from the slices' totals.

    As two slice numbers share all bits above one highest differing bit, every pair meets in exactly one block per
    bit. A block holds at most two totals per y slice.
    """
    totals = cells.groupBy(*keys, "sx", "sy").agg(F.sum("weight").alias("weight"))
    top_bit = F.floor(F.log2(F.max("sx") + 1)).cast("int")
    levels = totals.groupBy(*keys).agg(top_bit.alias("_top")).select(
        *keys, F.explode(F.sequence(F.lit(0), F.col("_top"))).alias("bit")
    )
    placed = totals.join(levels, keys).select(
        *keys, "bit", "sy",
        F.expr("shiftright(sx, bit + 1)").alias("block"),
        F.expr("shiftright(sx, bit) & 1").alias("upper"),
        "weight",
    )
    halves = placed.groupBy(*keys, "bit", "block", "sy").agg(
        F.sum(F.when(F.col("upper") == 0, F.col("weight")).otherwise(0)).alias("low"),
        F.sum(F.when(F.col("upper") == 1, F.col("weight")).otherwise(0)).alias("high"),
    )
    # By number, as Spark would join the partitions to few by their bytes, which are little beside the work on a row.
    halves = halves.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "bit", "block")
    block = Window.partitionBy(*keys, "bit", "block")
    ordered = block.orderBy("sy")
    below = F.coalesce(F.sum("low").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = F.sum("low").over(block) - below - F.col("low")
    return (
        halves.withColumn("_gain", (below - above).cast("double") * F.col("high"))
        .groupBy(*keys).agg(F.sum("_gain").alias("score"))
    )


def kendall(pixels: DataFrame, keys: list[str], slice_rows: int) -> DataFrame:
    """tau-b by slicing both values.

    Pairs that differ in both slices are counted from slice totals, pairs in the same x slice inside it, and pairs in
    the same y slice but different x slices inside the y slice. Slices hold fewer than ``2 * slice_rows`` pixels.
    """
    cells, patches = _collapsed(pixels, keys)
    placed, ties = cells, []
    for value in ("x", "y"):
        ranks = written(value_ranks(cells, PATCH_NUMBER, value, "weight"), "ranks")
        placed = placed.join(ranks.select("_patch", value, _slice_of(slice_rows).alias(f"s{value}")), [value, "_patch"])
        tied = F.sum(F.col("ties").cast("double") * (F.col("ties") - 1) / 2)
        ties.append(ranks.groupBy("_patch").agg(tied.alias(f"tied_{value}"), F.max("group_rows").alias(f"n_{value}")))
    placed = written(placed.select("_patch", "x", "y", "weight", "sx", "sy"), "sliced")
    score = (
        _between_slices(placed, PATCH_NUMBER)
        .unionByName(_inside_slices(placed, PATCH_NUMBER, "sx", "x", "y"))
        .unionByName(_inside_slices(placed, PATCH_NUMBER, "sy", "sx", "y"))
        .groupBy("_patch").agg(F.sum("score").alias("score"))
    )
    pairs = F.col("n_x").cast("double") * (F.col("n_x") - 1) / 2
    scale = F.sqrt(pairs - F.col("tied_x")) * F.sqrt(pairs - F.col("tied_y"))
    found = ties[0].join(ties[1], "_patch").join(score, "_patch", "left")
    return patches.join(found, "_patch").select(
        *keys, F.col("n_x").alias("n"), F.try_divide(F.coalesce("score", F.lit(0.0)), scale).alias("rho")
    )


METHODS = {"spearman": spearman, "kendall": kendall}
