"""Local correlation maps with a fallback to coarser grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumipair.operators.correlate import (
    MIN_SUPPORT,
    WHOLE_PATCH_PIXELS,
    check_pairs,
    dropped_images,
    patch_rho,
    rank_rho,
)
from lumipair.operators.images import dimensions
from lumipair.operators.summed_areas import grid_rho
from lumipair.schema import IMAGE, PAIR, PATCH
from lumipair.shared import lookup_join, written

# Stands for "no correlation" in a map; below every real value.
MISSING = -2.0
FALLBACK_STEP = 10

_RESULT = [*IMAGE, *PAIR, "resolution", *PATCH, "n", "rho"]


def map_rho(
    scanlines: DataFrame,
    n: int,
    pairs: list[tuple[int, int]] | None = None,
    method: str = "pearson",
    step: int = FALLBACK_STEP,
    min_support: int = MIN_SUPPORT,
    whole_patch: int = WHOLE_PATCH_PIXELS,
) -> DataFrame:
    """Patch correlations on an n x n grid per image and pair.

    Where not one patch has enough usable pixels, the finest of the grids ``..., 3 step, 2 step, step`` (not above n)
    that has such a patch replaces it. An image without any is left out, unless n is below ``step`` and there was no
    coarser grid to try: then the map of missing values stays.
    """
    pairs = check_pairs(scanlines, pairs)
    candidates = list(range(step, n + 1, step))
    # Images whose patches cannot hold enough pixels go to the coarser grids at once.
    holds = F.expr(f"cast(height div {n} as bigint) * (width div {n})") > min_support
    usable = scanlines.filter(holds) if candidates else scanlines
    fine = patch_rho(usable, n, pairs=pairs, method=method, min_support=min_support, whole_patch=whole_patch)
    fine = written(fine.withColumn("resolution", F.lit(n)).select(*_RESULT), "map")
    if not candidates:
        return fine
    has_value = fine.groupBy(*IMAGE, *PAIR).agg((F.max("n") > min_support).alias("_ok")).filter("_ok")
    wanted = F.array(*[F.struct(F.lit(x).alias("ch_x"), F.lit(y).alias("ch_y")) for x, y in pairs])
    images = dimensions(scanlines).select(*IMAGE, F.inline(wanted))
    failed = written(images.join(has_value, [*IMAGE, *PAIR], "left_anti"), "failed")
    if failed.isEmpty():
        return fine

    # Counts and moments of every grid from one pass over the images that failed.
    retried = lookup_join(scanlines, failed.select(*IMAGE).distinct(), IMAGE)
    tried = written(grid_rho(retried, pairs, candidates, min_support), "tried")
    best = tried.filter(F.col("n") > min_support).groupBy(*IMAGE, *PAIR).agg(F.max("resolution").alias("resolution"))
    chosen = written(best.join(failed, [*IMAGE, *PAIR], "left_semi"), "chosen")
    if method == "pearson":
        again = tried
    else:
        lines = lookup_join(scanlines, chosen.select(*IMAGE, "resolution").distinct(), IMAGE)
        grid = F.col("resolution")
        again = rank_rho(lines, pairs, grid, grid, method, whole_patch)
    again = again.withColumn("rho", F.when(F.col("n") > min_support, F.col("rho")))
    again = again.join(chosen, [*IMAGE, *PAIR, "resolution"], "left_semi")
    kept = fine.join(has_value, [*IMAGE, *PAIR], "left_semi")
    return kept.select(*_RESULT).unionByName(again.select(*_RESULT))


def dropped_from_map(scanlines: DataFrame, n: int, pairs: list[tuple[int, int]] | None = None, **options) -> DataFrame:
    """Images without a place in the map or without any correlation in it, with the reason (``correlate.dropped_images``)."""
    return dropped_images(scanlines, map_rho(scanlines, n, pairs, **options), pairs)


def local_map(scanlines: DataFrame, n: int, **options) -> DataFrame:
    """The table behind a local correlation map: plot position in pixels and the correlation or ``MISSING``."""
    rho = lookup_join(map_rho(scanlines, n, **options), dimensions(scanlines), IMAGE)
    patch_h, patch_w = F.expr("height div resolution"), F.expr("width div resolution")
    return rho.select(
        *IMAGE, *PAIR, "resolution", *PATCH,
        (F.col("patch_j") * patch_w).cast("int").alias("x"),
        ((F.col("resolution") - F.col("patch_i") + 1) * patch_h).cast("int").alias("y"),
        F.coalesce("rho", F.lit(MISSING)).alias("rho"),
    )
