"""Pearson correlations of all channel pairs at once, from masked Gram products.

With X the centred values of the channels in a run of image rows (0 where there is no signal) and M their signal (1 or 0),
the products M M', X M', X² M' and X X' hold the counts, sums, squares and cross products of every pair over the pixels
with a signal in both channels. Each pixel is read once however many pairs there are; a patch leaves its task as one row of
moments, and rows of the same patch are merged around their common means.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumipair.operators.patches import patch_rows
from lumipair.schema import IMAGE, PATCH

# Send this module's functions to the executors with the tasks, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A task keeps the moments of so many bytes of patches before it hands them on.
KEPT_BYTES = 64 * 1024 * 1024

# Below this share of the squares around the channel's own mean, a pair's variance is taken from its pixels again.
DOUBTFUL = 1e-6

# Moments of a pair, in this order: count, means, sums of squares and products around them, smallest and largest values.
# The limits are only exact where they decide whether a channel varies; elsewhere they are infinite.
N, MX, MY, SXX, SYY, SXY, LOX, HIX, LOY, HIY = range(10)


def plane_matrix(column: pa.ListArray, rows: np.ndarray, width: int) -> np.ndarray:
    """The first ``width`` values of the given rows; what is missing is NaN."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)[rows, None]
    if not len(values):
        return np.full((len(rows), width), np.nan)
    places = offsets[:-1].astype(np.int64)[rows, None] + np.arange(width)
    return np.where(np.arange(width) < lengths, values[np.minimum(places, len(values) - 1)], np.nan)


def of_pixels(x: np.ndarray, y: np.ndarray, both: np.ndarray) -> list[float]:
    x, y = x[both], y[both]
    dx, dy = x - x.mean(), y - y.mean()
    return [len(x), x.mean(), y.mean(), dx @ dx, dy @ dy, dx @ dy, x.min(), x.max(), y.min(), y.max()]


def run_moments(planes: np.ndarray, ny: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Moments (patch column, moment, pair) of a run of image rows; ``planes`` is (channel, row, column)."""
    channels, rows, width = planes.shape
    values = planes.reshape(channels, rows, ny, width // ny).transpose(2, 0, 1, 3).reshape(ny, channels, -1)
    signal = (values == values) & (values != 0)
    mask = signal.astype(float)
    shift = np.where(signal, values, 0).sum(2) / np.maximum(signal.sum(2), 1)
    centred = np.where(signal, values - shift[:, :, None], 0)
    mask_t = mask.transpose(0, 2, 1)
    sums, squares = centred @ mask_t, (centred * centred) @ mask_t
    n, sx, sy, qx, qy = (mask @ mask_t)[:, x, y], sums[:, x, y], sums[:, y, x], squares[:, x, y], squares[:, y, x]
    some = np.maximum(n, 1)
    found = np.empty((ny, 10, len(x)))
    found[:, N], found[:, MX], found[:, MY] = n, shift[:, x] + sx / some, shift[:, y] + sy / some
    found[:, SXX], found[:, SYY] = qx - sx * sx / some, qy - sy * sy / some
    found[:, SXY] = (centred @ centred.transpose(0, 2, 1))[:, x, y] - sx * sy / some
    found[:, [LOX, LOY]], found[:, [HIX, HIY]] = -np.inf, np.inf
    none = np.array([0, 0, 0, 0, 0, 0, np.inf, -np.inf, np.inf, -np.inf])
    # Constant or nearly constant channels, and infinite values, whose products reach pairs without them.
    sure = (found[:, SXX] > DOUBTFUL * qx) & (found[:, SYY] > DOUBTFUL * qy) & np.isfinite(found[:, :LOX]).all(1)
    for j, k in np.argwhere(~sure):
        both = signal[j, x[k]] & signal[j, y[k]]
        found[j, :, k] = of_pixels(values[j, x[k]], values[j, y[k]], both) if both.any() else none
    return found


def merged(moments: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Merge rows (row, moment, pair) that follow each other; a new group begins at each of ``starts``."""
    sizes = np.diff([*starts, len(moments)])
    n = moments[:, N]
    found = np.empty((len(starts), *moments.shape[1:]))
    found[:, N] = np.add.reduceat(n, starts)
    off = []
    for mean in (MX, MY):
        found[:, mean] = np.add.reduceat(n * moments[:, mean], starts) / np.maximum(found[:, N], 1)
        off.append(np.where(n > 0, moments[:, mean] - np.repeat(found[:, mean], sizes, axis=0), 0))
    for total, a, b in ((SXX, off[0], off[0]), (SYY, off[1], off[1]), (SXY, off[0], off[1])):
        found[:, total] = np.add.reduceat(moments[:, total] + n * a * b, starts)
    for low, high in ((LOX, HIX), (LOY, HIY)):
        found[:, low] = np.minimum.reduceat(moments[:, low], starts)
        found[:, high] = np.maximum.reduceat(moments[:, high], starts)
    return found


def correlations(moments: np.ndarray) -> np.ndarray:
    """Correlation of every (row, pair); NaN where a channel does not vary or is not finite."""
    varies = (moments[:, LOX] < moments[:, HIX]) & (moments[:, LOY] < moments[:, HIY])
    rho = moments[:, SXY] / (np.sqrt(moments[:, SXX]) * np.sqrt(moments[:, SYY]))
    return np.where(varies & np.isfinite(rho), np.clip(rho, -1, 1), np.nan)


def _batch_of(keys: list[tuple], columns: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    condition, image_id, patch_i, patch_j = zip(*keys, strict=True)
    places = [pa.array(condition, pa.string()), pa.array(image_id, pa.string()), pa.array(patch_i, pa.int32()), pa.array(patch_j, pa.int32())]
    return pa.RecordBatch.from_arrays([*places, *columns], names=[*IMAGE, *PATCH, *names])


def lists(rows: np.ndarray, mask: np.ndarray | None = None, kind: pa.DataType | None = None) -> pa.ListArray:
    flat = pa.array(rows.ravel(), kind, mask=None if mask is None else mask.ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), flat)


def gram_rho(scanlines: DataFrame, pairs: list[tuple[int, int]], nx: int, ny: int) -> DataFrame:
    """(image, pair, patch, n, rho) of every pair; patches of which a row is there have a row, if only with n = 0."""
    channels = sorted({c for pair in pairs for c in pair})
    planes = [f"c{c}" for c in channels]
    x, y = (np.array([channels.index(pair[k]) for pair in pairs]) for k in (0, 1))

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            keys = [(*key, j + 1) for key in kept for j in range(ny)]
            moments = np.concatenate(list(kept.values()))
            kept.clear()
            return _batch_of(keys, [lists(moments.reshape(len(moments), -1))], ["moments"])

        for batch in batches:
            runs: dict[tuple, list[int]] = {}
            for k, place in enumerate(zip(*(batch.column(c).to_pylist() for c in (*IMAGE, "patch_i", "patch_w")), strict=True)):
                runs.setdefault(place, []).append(k)
            for (*key, patch_w), rows in runs.items():
                at = np.array(rows)
                values = np.stack([plane_matrix(batch.column(p), at, ny * patch_w) for p in planes])
                with np.errstate(all="ignore"):
                    found = run_moments(values, ny, x, y)
                    before = kept.get(tuple(key))
                    if before is not None:
                        both = np.stack([before, found], 1).reshape(2 * ny, *found.shape[1:])
                        found = merged(both, np.arange(ny) * 2)
                kept[tuple(key)] = found
                if len(kept) * found.nbytes > KEPT_BYTES:
                    yield flush()
        if kept:
            yield flush()

    def of_patches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_moments = None, None

        def closed(keys: list[tuple], moments: np.ndarray) -> pa.RecordBatch:
            with np.errstate(all="ignore"):
                rho = correlations(moments)
            return _batch_of(keys, [lists(moments[:, N].astype(np.int64)), lists(rho, np.isnan(rho))], ["n", "rho"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(c).to_pylist() for c in (*IMAGE, *PATCH)), strict=True))
            moments = batch.column("moments").flatten().to_numpy().reshape(len(keys), 10, len(pairs))
            if open_key is not None:
                keys, moments = [open_key, *keys], np.concatenate([open_moments, moments])
            starts = np.array([k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]])
            with np.errstate(all="ignore"):
                found = merged(moments, starts)
            keys = [keys[k] for k in starts]
            open_key, open_moments = keys[-1], found[-1:]
            if len(keys) > 1:
                yield closed(keys[:-1], found[:-1])
        if open_key is not None:
            yield closed([open_key], open_moments)

    place = "condition string, image_id string, patch_i int, patch_j int"
    rows = patch_rows(scanlines, nx, ny).select(*IMAGE, "patch_i", "patch_w", *planes)
    parts = rows.mapInArrow(of_rows, f"{place}, moments array<double>")
    patches = parts.repartition(*IMAGE, *PATCH).sortWithinPartitions(*IMAGE, *PATCH)
    found = patches.mapInArrow(of_patches, f"{place}, n array<bigint>, rho array<double>")
    ch_x, ch_y = (F.array(*[F.lit(pair[k]) for pair in pairs]) for k in (0, 1))
    zipped = F.arrays_zip(ch_x.alias("ch_x"), ch_y.alias("ch_y"), F.col("n"), F.col("rho"))
    return found.select(*IMAGE, *PATCH, F.inline(zipped)).select(*IMAGE, "ch_x", "ch_y", *PATCH, "n", "rho")
