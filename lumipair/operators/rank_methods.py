"""Spearman's rho and Kendall's tau-b of many patches at once.

Patches arrive as array columns, one row per patch, and a whole Arrow batch of them is computed with a few vector
operations. ``group`` always holds ascending group numbers.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# Send this module's functions to the executors with the tasks, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Pixels of a channel that are computed at once, unless one patch has more: some twenty arrays of this length are held.
BATCH_PIXELS = 250_000


def _runs(group: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorting order by (group, value), and the first and end position of each run of equal values in that order."""
    order = np.lexsort((values, group))
    g, v = group[order], values[order]
    fresh = np.ones(len(v), dtype=bool)
    fresh[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    first = np.flatnonzero(fresh)
    return order, first, np.append(first[1:], len(v))


def _per_element(first: np.ndarray, end: np.ndarray, of_run: np.ndarray) -> np.ndarray:
    return np.repeat(of_run, end - first)


def _group_starts(group: np.ndarray, n_groups: int) -> np.ndarray:
    return np.searchsorted(group, np.arange(n_groups))


def dense_ranks(group: np.ndarray, values: np.ndarray, n_groups: int) -> np.ndarray:
    """0-based ranks of the distinct values within each group."""
    order, first, end = _runs(group, values)
    run_group = group[order[first]]
    before = np.searchsorted(run_group, np.arange(n_groups))
    ranks = np.empty(len(values), dtype=np.int64)
    ranks[order] = _per_element(first, end, np.arange(len(first)) - before[run_group])
    return ranks


def average_ranks(group: np.ndarray, values: np.ndarray, n_groups: int) -> np.ndarray:
    """Ranks within each group from 1 on; equal values share their mean rank."""
    order, first, end = _runs(group, values)
    starts = _group_starts(group, n_groups)[group[order[first]]]
    ranks = np.empty(len(values))
    ranks[order] = _per_element(first, end, (first + end + 1) / 2.0 - starts)
    return ranks


def tied_pairs(group: np.ndarray, values: np.ndarray, n_groups: int) -> np.ndarray:
    """Number of pairs with equal values per group."""
    order, first, end = _runs(group, values)
    ties = (end - first).astype(float)
    return np.bincount(group[order[first]], weights=ties * (ties - 1.0) / 2.0, minlength=n_groups)


def concordance(group: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, n_groups: int) -> np.ndarray:
    """Weighted count of concordant minus discordant pairs per group; pairs tied in x or y count nothing.

    Two different x ranks share all bits above one highest differing bit. From the top bit down, each block of ranks
    that agree so far is split into a lower and an upper half, and the halves' y values are compared. Elements stay in y
    order inside their block throughout.
    """
    score = np.zeros(n_groups)
    if len(x) < 2:
        return score
    x_rank = dense_ranks(group, x, n_groups)
    order = np.lexsort((y, group))
    group, x_rank, y, weight = group[order], x_rank[order], y[order], weight[order]
    new_block = np.ones(len(x), dtype=bool)
    new_block[1:] = group[1:] != group[:-1]
    for bit in range(int(x_rank.max()).bit_length() - 1, -1, -1):
        new_run = new_block.copy()
        new_run[1:] |= y[1:] != y[:-1]
        block = np.flatnonzero(new_block)
        block_end = np.append(block[1:], len(x))
        run = np.flatnonzero(new_run)
        run_end = np.append(run[1:], len(x))
        upper = ((x_rank >> bit) & 1).astype(bool)
        lower_sum = np.zeros(len(x) + 1)
        np.cumsum(np.where(upper, 0.0, weight), out=lower_sum[1:])
        # Lower elements below a run of equal y, minus those above it, both within the run's block.
        of_run = lower_sum[run] + lower_sum[run_end]
        of_block = lower_sum[block] + lower_sum[block_end]
        gain = _per_element(run, run_end, of_run) - _per_element(block, block_end, of_block)
        score += np.bincount(group, weights=np.where(upper, weight * gain, 0.0), minlength=n_groups)
        # Split every block, lower half first, and keep the order inside the halves.
        lower_count = np.zeros(len(x) + 1, dtype=np.int64)
        np.cumsum(~upper, out=lower_count[1:])
        in_block = lower_count[block_end] - lower_count[block]
        lower_before = lower_count[:-1] - _per_element(block, block_end, lower_count[block])
        start = _per_element(block, block_end, block)
        place = np.where(
            upper, np.arange(len(x)) - lower_before + _per_element(block, block_end, in_block), start + lower_before
        )
        target = np.empty(len(x), dtype=np.int64)
        target[place] = np.arange(len(x))
        group, x_rank, y, weight = group[target], x_rank[target], y[target], weight[target]
        new_block = np.zeros(len(x) + 1, dtype=bool)
        new_block[block] = True
        new_block[block + in_block] = True
        new_block = new_block[:-1]
    return score


def kendall(group: np.ndarray, x: np.ndarray, y: np.ndarray, n_groups: int) -> np.ndarray:
    """tau-b per group; NaN where a side is constant."""
    sizes = np.bincount(group, minlength=n_groups).astype(float)
    pairs = sizes * (sizes - 1.0) / 2.0
    scale = (pairs - tied_pairs(group, x, n_groups)) * (pairs - tied_pairs(group, y, n_groups))
    score = concordance(group, x, y, np.ones(len(x)), n_groups)
    varies = scale > 0
    return np.where(varies, score / np.sqrt(np.where(varies, scale, 1.0)), np.nan)


def spearman(group: np.ndarray, x: np.ndarray, y: np.ndarray, n_groups: int) -> np.ndarray:
    """Correlation of the average ranks per group; NaN where a side is constant."""
    middle = (np.bincount(group, minlength=n_groups)[group] + 1) / 2.0
    a, b = (average_ranks(group, v, n_groups) - middle for v in (x, y))
    sxx, syy, sxy = (np.bincount(group, weights=p, minlength=n_groups) for p in (a * a, b * b, a * b))
    varies = (sxx > 0) & (syy > 0)
    return np.where(varies, sxy / np.sqrt(np.where(varies, sxx, 1.0)) / np.sqrt(np.where(varies, syy, 1.0)), np.nan)


METHODS = {"spearman": spearman, "kendall": kendall}


def of_few_pixels(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold ``BATCH_PIXELS`` pixels of a channel at most, or one patch."""
    ends, begin = np.cumsum(sizes), 0
    while begin < batch.num_rows:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + BATCH_PIXELS, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def rho_of_arrays(patches: DataFrame, keys: list[str], pairs: list[tuple[int, int]], method: str) -> DataFrame:
    """Correlation of every channel pair of patches whose channels are array columns ``c1 .. cN`` of equal length."""
    types = dict(patches.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", ch_x int, ch_y int, n bigint, rho double"
    correlation = METHODS[method]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in of_few_pixels(whole, whole.column(f"c{pairs[0][0]}").value_lengths().to_numpy(zero_copy_only=False)):
                yield from of_batch(batch)

    def of_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n_groups = batch.num_rows
        planes = {
            c: batch.column(f"c{c}").flatten().to_numpy(zero_copy_only=False) for pair in pairs for c in pair
        }
        sizes = batch.column(f"c{pairs[0][0]}").value_lengths().to_numpy(zero_copy_only=False)
        group = np.repeat(np.arange(n_groups, dtype=np.int64), sizes)
        signal = {c: (v != 0) & ~np.isnan(v) for c, v in planes.items()}
        for x, y in pairs:
            both = signal[x] & signal[y]
            of_pair = group[both]
            rho = correlation(of_pair, planes[x][both], planes[y][both], n_groups)
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keys] + [
                    pa.array(np.full(n_groups, x), pa.int32()), pa.array(np.full(n_groups, y), pa.int32()),
                    pa.array(np.bincount(of_pair, minlength=n_groups), pa.int64()),
                    pa.array(rho, pa.float64(), mask=np.isnan(rho)),
                ],
                names=[*keys, "ch_x", "ch_y", "n", "rho"],
            )

    return patches.mapInArrow(compute, schema)
