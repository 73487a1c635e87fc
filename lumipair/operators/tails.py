"""Sums of normal distribution functions around values, for many thresholds at once.

Every value meets every threshold. Values and thresholds are taken in blocks, with one exponential for both tails of a pair
of them, and a batch leaves one row of sums for each of its groups and thresholds.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumipair.functions.columns import ERF_A, ERF_P

# Send this module's functions to the executors with the tasks, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Pairs of a value and a threshold that are computed at once: arrays of some 500 kB, which stay in a core's cache.
BLOCK = 65_536


def upper_tail(z: np.ndarray) -> np.ndarray:
    """1 - Phi(|z|), as ``columns.normal_cdf`` has it."""
    x = np.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + ERF_P * x)
    poly = np.zeros_like(x)
    for a in reversed(ERF_A):
        poly += a
        poly *= t
    return 0.5 * poly * np.exp(-x * x)


def tail_sums(values: np.ndarray, counts: np.ndarray, width: float | None, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of ``counts`` times the mass above and below each threshold of a kernel at each value, and of values above it.

    Without a width a value counts as a step. A value of NaN is above all; at a width of 0 one at the threshold gives NaN.
    """
    above, below, steps = (np.zeros(len(thresholds)) for _ in range(3))
    rows = max(1, BLOCK // max(1, len(thresholds)))
    for begin in range(0, len(values), rows):
        value, m = values[begin:begin + rows, None], counts[begin:begin + rows]
        over = ~(value <= thresholds)
        steps += m @ over
        if width is None:
            above += m @ over
            below += m @ ~over
            continue
        with np.errstate(all="ignore"):
            z = (value - thresholds) / width
            upper = upper_tail(z)
            lower = 1.0 - upper
        right = ~(z < 0)
        above += m @ np.where(right, lower, upper)
        below += m @ np.where(z > 0, upper, lower)
    return above, below, steps


def kernel_tails(values: DataFrame, keys: list[str], thresholds: list[float], flat_is_step: bool) -> DataFrame:
    """``p_above``, ``p_below`` and ``p_empirical`` of each group and threshold.

    ``values`` has the keys, ``value``, ``m`` (how often it occurs) and ``h``, the width of its group. With ``flat_is_step`` a width of 0
    counts as none.
    """
    types = dict(values.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", rho_threshold double, above double, below double, step double, m bigint"
    at = np.array(thresholds, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.select(keys).to_pandas().groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(group, kind="stable")
            begins = np.flatnonzero(np.diff(group[order], prepend=-1))
            value, m = (batch.column(c).to_numpy(zero_copy_only=False)[order] for c in ("value", "m"))
            first = order[begins]
            sums: list[list[np.ndarray]] = []
            for begin, end, head in zip(begins, np.append(begins[1:], len(order)), first, strict=True):
                width = batch.column("h")[int(head)].as_py()
                none = width is None or (flat_is_step and width == 0)
                sums.append([*tail_sums(value[begin:end], m[begin:end].astype(np.float64), None if none else width, at), np.full(len(at), m[begin:end].sum())])
            heads = batch.select(keys).take(pa.array(np.repeat(first, len(at))))
            columns = [np.concatenate(c) for c in zip(*sums, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*heads.columns, pa.array(np.tile(at, len(first))), *map(pa.array, columns)],
                names=[*keys, "rho_threshold", "above", "below", "step", "m"],
            )

    sums = values.select(*keys, F.col("value").cast("double").alias("value"), F.col("m").cast("long").alias("m"), "h").mapInArrow(run, schema)
    return sums.groupBy(*keys, "rho_threshold").agg(
        (F.sum("above") / F.sum("m")).alias("p_above"), (F.sum("below") / F.sum("m")).alias("p_below"),
        (F.sum("step") / F.sum("m")).alias("p_empirical"),
    )
