"""Counts and Pearson correlations of many grids from one look at the pixels.

The rows of an image that a task reads together are a tile. Summed-area tables of a pair's signal counts and centred moments
are made once for a tile; the part of a patch of any grid that lies in the tile is four look-ups. Small tiles, as of images of
a few rows, are summed from their pixels instead, many in one step. Parts of a patch from
different tiles meet as moments (``gram.merged``), so that tiles carry nothing over to each other.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumipair.operators import gram  # noqa: F401
from lumipair.operators.gram import HIX, HIY, LOX, LOY, MX, MY, SXX, SXY, SYY, N, correlations, lists, merged, of_pixels, plane_matrix
from lumipair.schema import IMAGE, PAIR

# Send this module's functions to the executors with the tasks, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A patch with a smaller share of a tile's squares is summed from its pixels: differences of large sums are not exact enough.
DOUBTFUL = 1e-5

# Tiles up to so many pixels are summed from their pixels, many tiles at once.
SMALL_TILE = 4096

_NONE = np.array([0, 0, 0, 0, 0, 0, np.inf, -np.inf, np.inf, -np.inf])


def summed_area(values: np.ndarray) -> np.ndarray:
    """Sums of all values above and to the left of every corner."""
    table = np.zeros((values.shape[0] + 1, values.shape[1] + 1))
    np.cumsum(np.cumsum(values, 0), 1, out=table[1:, 1:])
    return table


class Tile:
    """The summed-area tables of one pair over the given image rows, in ascending order."""

    def __init__(self, rows: np.ndarray, x: np.ndarray, y: np.ndarray):
        self.rows, self.x, self.y = rows, x, y
        self.both = (x == x) & (y == y) & (x != 0) & (y != 0)
        n = max(int(self.both.sum()), 1)
        x, y = np.where(self.both, x, 0), np.where(self.both, y, 0)
        self.shift = x.sum() / n, y.sum() / n
        dx, dy = (np.where(self.both, v - s, 0) for v, s in zip((x, y), self.shift, strict=True))
        self.tables = [summed_area(v) for v in (self.both, dx, dy, dx * dx, dy * dy, dx * dy)]

    def moments(self, grid: int, patch_h: int, patch_w: int) -> tuple[np.ndarray, np.ndarray]:
        """Patch rows (0-based) with a row in this tile, and their moments (patch row, patch column, moment)."""
        across = np.searchsorted(self.rows, np.arange(grid + 1) * patch_h)
        along = np.arange(grid + 1) * patch_w
        there = np.flatnonzero(np.diff(across))
        n, sx, sy, qx, qy, p = (np.diff(np.diff(t[np.ix_(across, along)], axis=0), axis=1)[there] for t in self.tables)
        some = np.maximum(n, 1)
        found = np.empty((len(there), grid, 10))
        found[..., N] = n
        found[..., MX], found[..., MY] = self.shift[0] + sx / some, self.shift[1] + sy / some
        found[..., SXX], found[..., SYY] = qx - sx * sx / some, qy - sy * sy / some
        found[..., SXY] = p - sx * sy / some
        found[..., [LOX, LOY]], found[..., [HIX, HIY]] = -np.inf, np.inf
        total_x, total_y = self.tables[3][-1, -1], self.tables[4][-1, -1]
        sure = (found[..., SXX] > DOUBTFUL * total_x) & (found[..., SYY] > DOUBTFUL * total_y)
        found[n == 0] = _NONE
        if not np.isfinite(total_x + total_y):
            # Counts are exact, whatever the values.
            sure[:] = False
        for k, j in np.argwhere(~sure & (n > 0)):
            part = np.s_[across[there[k]]:across[there[k] + 1], along[j]:along[j + 1]]
            found[k, j] = of_pixels(self.x[part], self.y[part], self.both[part])
        return there, found


def moments_of_small(
    x: np.ndarray, y: np.ndarray, rows: np.ndarray, tile: np.ndarray, grid: int, patch_h: int, patch_w: int
) -> tuple[np.ndarray, np.ndarray]:
    """Like ``Tile.moments``, from the pixels of many tiles of images of one size.

    ``tile`` is the number of each image row's tile and ``rows`` its number in the image, both ascending. The first result is the position
    of the first image row of each (tile, patch row).
    """
    used = np.flatnonzero(rows < grid * patch_h)
    if not len(used):
        return used, np.empty((0, grid, 10))
    patch_i, tile = rows[used] // patch_h, tile[used]
    starts = np.flatnonzero(np.r_[True, (tile[1:] != tile[:-1]) | (patch_i[1:] != patch_i[:-1])])
    of_row = np.repeat(np.arange(len(starts)), np.diff([*starts, len(used)]))
    x, y = (v[used, :grid * patch_w].reshape(len(used), grid, patch_w) for v in (x, y))
    both = (x == x) & (y == y) & (x != 0) & (y != 0)

    def total(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values.sum(2), starts)

    found = np.empty((len(starts), grid, 10))
    found[..., N] = n = total(both)
    off = []
    for values, mean, low, high in ((x, MX, LOX, HIX), (y, MY, LOY, HIY)):
        found[..., mean] = total(np.where(both, values, 0)) / np.maximum(n, 1)
        found[..., low] = np.minimum.reduceat(np.where(both, values, np.inf).min(2), starts)
        found[..., high] = np.maximum.reduceat(np.where(both, values, -np.inf).max(2), starts)
        off.append(np.where(both, values - found[of_row, :, mean][:, :, None], 0))
    found[..., SXX], found[..., SYY], found[..., SXY] = total(off[0] * off[0]), total(off[1] * off[1]), total(off[0] * off[1])
    found[n == 0] = _NONE
    return used[starts], found


def _codes(column: pa.Array) -> np.ndarray:
    """Equal numbers for equal values, null included."""
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy()


def grid_rho(scanlines: DataFrame, pairs: list[tuple[int, int]], grids: list[int], min_support: int) -> DataFrame:
    """(image, pair, resolution, patch, n, rho) on every square grid whose patches could hold more than ``min_support`` pixels.

    All grids and pairs come from one pass over the scanlines. What is shuffled is one row for each row of patches in a tile.
    Tiles up to ``SMALL_TILE`` pixels of equal image size are computed together.
    """
    channels = sorted({c for pair in pairs for c in pair})
    planes = [f"c{c}" for c in channels]

    def parts_of(batch: pa.RecordBatch, at: np.ndarray, x: int, y: int, grid: int, patch_i: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
        """Moments (patch row, patch column, moment) as rows, ``at`` a row of the image each."""
        rows = pa.array(at)
        numbers = [pa.array(np.broadcast_to(v, len(at)), pa.int32()) for v in (x, y, grid, patch_i + 1)]
        places = [batch.column(c).take(rows) for c in IMAGE]
        return pa.RecordBatch.from_arrays([*places, *numbers, lists(found.reshape(len(at), -1))], names=[*IMAGE, *PAIR, "resolution", "patch_i", "moments"])

    def of_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, height, width = (batch.column(c).to_numpy().astype(np.int64) for c in ("row", "height", "width"))
            places = [*map(_codes, map(batch.column, IMAGE)), height, width]
            order = np.lexsort((row, *places))
            fresh = np.zeros(batch.num_rows, bool)
            for v in places:
                fresh[1:] |= v[order[1:]] != v[order[:-1]]
            tile = np.cumsum(fresh)
            small = np.bincount(tile)[tile] * width[order] <= SMALL_TILE
            sizes = sorted(set(zip(height[order[small]].tolist(), width[order[small]].tolist(), strict=True)))
            for h, w in sizes:
                own = small & (height[order] == h) & (width[order] == w)
                at = order[own]
                usable = [g for g in grids if (h // g) * (w // g) > min_support]
                if not usable:
                    continue
                values = {c: plane_matrix(batch.column(f"c{c}"), at, w) for c in channels}
                for x, y in pairs:
                    for g in usable:
                        with np.errstate(all="ignore"):
                            first, found = moments_of_small(values[x], values[y], row[at], tile[own], g, h // g, w // g)
                        if len(first):
                            yield parts_of(batch, at[first], x, y, g, row[at[first]] // (h // g), found)
            begins = np.flatnonzero(np.r_[True, fresh[1:]])
            for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), batch.num_rows], strict=True):
                at = order[begin:end]
                h, w = int(height[at[0]]), int(width[at[0]])
                usable = [g for g in grids if (h // g) * (w // g) > min_support]
                if small[begin] or not usable:
                    continue
                values = {c: plane_matrix(batch.column(f"c{c}"), at, w) for c in channels}
                for x, y in pairs:
                    with np.errstate(all="ignore"):
                        whole = Tile(row[at], values[x], values[y])
                        for g in usable:
                            there, found = whole.moments(g, h // g, w // g)
                            if len(there):
                                yield parts_of(batch, np.full(len(there), at[0]), x, y, g, there, found)

    def of_patches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last patch row so far, as one part

        def closed(rows: pa.RecordBatch, moments: np.ndarray) -> pa.RecordBatch:
            with np.errstate(all="ignore"):
                rho = correlations(moments)
            n = moments[:, N].astype(np.int64)
            return pa.RecordBatch.from_arrays([*rows.columns[:-1], lists(n), lists(rho, np.isnan(rho))], names=[*rows.schema.names[:-1], "n", "rho"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.concat_batches([held, batch])
            fresh = np.zeros(batch.num_rows, bool)
            fresh[0] = True
            for name in batch.schema.names[:-1]:
                codes = _codes(batch.column(name))
                fresh[1:] |= codes[1:] != codes[:-1]
            last = int(np.flatnonzero(fresh)[-1])
            grid = batch.column("resolution").to_numpy()
            flat, offsets = batch.column("moments").values.to_numpy(), batch.column("moments").offsets.to_numpy()
            for g in np.unique(grid).tolist():
                at = np.flatnonzero(grid == g)
                # Parts are (patch column, moment); the patch columns take the place of pairs.
                moments = flat[offsets[at].astype(np.int64)[:, None] + np.arange(10 * g)].reshape(len(at), g, 10).transpose(0, 2, 1)
                starts = np.flatnonzero(fresh[at])
                with np.errstate(all="ignore"):
                    found = merged(moments, starts)
                rows = batch.take(pa.array(at[starts]))
                if at[starts[-1]] == last:
                    part = lists(found[-1:].transpose(0, 2, 1).reshape(1, -1))
                    held = pa.RecordBatch.from_arrays([*rows.slice(len(starts) - 1).columns[:-1], part], schema=batch.schema)
                    rows, found = rows.slice(0, len(starts) - 1), found[:-1]
                if rows.num_rows:
                    yield closed(rows, found)
        if held is not None:
            moments = held.column("moments").flatten().to_numpy().reshape(1, -1, 10).transpose(0, 2, 1)
            yield closed(held, moments)

    place = "condition string, image_id string, ch_x int, ch_y int, resolution int, patch_i int"
    rows = scanlines.select(*IMAGE, "row", "height", "width", *planes)
    keys = [*IMAGE, *PAIR, "resolution", "patch_i"]
    parts = rows.mapInArrow(of_tiles, f"{place}, moments array<double>").repartition(*keys).sortWithinPartitions(*keys)
    found = parts.mapInArrow(of_patches, f"{place}, n array<bigint>, rho array<double>")
    return found.select(*keys, F.posexplode(F.arrays_zip("n", "rho")).alias("_j", "_found")).select(
        *keys, (F.col("_j") + 1).alias("patch_j"), "_found.n", "_found.rho"
    )
