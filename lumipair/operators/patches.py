"""Cutting images into grids of patches.

Patch numbers are 1-based. Remainder rows and columns at the bottom and right edge are dropped, and an image smaller
than the grid has no patches. All of it is arithmetic on columns the rows already carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumipair.schema import IMAGE
from lumipair.sources.bands import to_pixels


def check_grid(nx: int, ny: int) -> None:
    if nx < 1 or ny < 1:
        raise ValueError("the number of patches must be at least 1")


def patch_height(nx: int | Column) -> Column:
    return F.call_function("div", F.col("height"), nx if isinstance(nx, Column) else F.lit(nx)).cast("int")


def patch_width(ny: int | Column) -> Column:
    return F.call_function("div", F.col("width"), ny if isinstance(ny, Column) else F.lit(ny)).cast("int")


def patch_rows(scanlines: DataFrame, nx: int | Column, ny: int | Column | None = None) -> DataFrame:
    """Add the patch size and the patch row to scanlines and drop the rows outside the grid."""
    ny = nx if ny is None else ny
    if not isinstance(nx, Column):
        check_grid(nx, ny)
    count = nx if isinstance(nx, Column) else F.lit(nx)
    return (
        scanlines.withColumn("patch_h", patch_height(nx))
        .withColumn("patch_w", patch_width(ny))
        .filter((F.col("patch_h") > 0) & (F.col("patch_w") > 0) & (F.col("row") < count * F.col("patch_h")))
        .withColumn("patch_i", (F.call_function("div", F.col("row"), F.col("patch_h")) + 1).cast("int"))
    )


def patch_column(position: Column) -> Column:
    return (F.call_function("div", position, F.col("patch_w")) + 1).cast("int")


def patch_pixels(scanlines: DataFrame, nx: int, ny: int | None = None, channels: list[int] | None = None) -> DataFrame:
    """Pixels with their patch and their 1-based position (px, py) inside it."""
    ny = nx if ny is None else ny
    check_grid(nx, ny)
    height, width = patch_height(nx), patch_width(ny)
    return (
        to_pixels(scanlines, channels)
        .withColumn("patch_h", height).withColumn("patch_w", width)
        .filter((F.col("patch_h") > 0) & (F.col("patch_w") > 0))
        .filter((F.col("row") < nx * F.col("patch_h")) & (F.col("col") < ny * F.col("patch_w")))
        .select(
            *IMAGE, "channel", "height", "width", "patch_h", "patch_w",
            (F.call_function("div", F.col("row"), F.col("patch_h")) + 1).cast("int").alias("patch_i"),
            patch_column(F.col("col")).alias("patch_j"),
            (F.col("row") % F.col("patch_h") + 1).alias("px"),
            (F.col("col") % F.col("patch_w") + 1).alias("py"),
            "value",
        )
    )


def patch_sizes(scanlines: DataFrame, nx: int, ny: int | None = None) -> DataFrame:
    """Per channel and patch: its pixels and how many of them have a value."""
    return patch_pixels(scanlines, nx, ny).groupBy(*IMAGE, "channel", "patch_i", "patch_j").agg(
        F.count(F.lit(1)).alias("n_pixels"), F.count("value").alias("n_values")
    )


def unpatch(patched: DataFrame) -> DataFrame:
    """Patch-local positions back to 0-based image coordinates."""
    return patched.select(
        *IMAGE, "channel", "height", "width",
        ((F.col("patch_i") - 1) * F.col("patch_h") + F.col("px") - 1).cast("int").alias("row"),
        ((F.col("patch_j") - 1) * F.col("patch_w") + F.col("py") - 1).cast("int").alias("col"),
        "value",
    )


def patch_grid(scanlines: DataFrame, nx: int | Column, ny: int | Column | None = None) -> DataFrame:
    """All patches of every image, found from the size columns, whichever rows an image has."""
    ny = nx if ny is None else ny
    rows = nx if isinstance(nx, Column) else F.lit(nx)
    columns = ny if isinstance(ny, Column) else F.lit(ny)
    keep = [c for c in ("resolution",) if c in scanlines.columns]
    return (
        scanlines.select(*IMAGE, *keep, "height", "width").distinct()
        .withColumn("patch_h", patch_height(nx)).withColumn("patch_w", patch_width(ny))
        .filter((F.col("patch_h") > 0) & (F.col("patch_w") > 0))
        .select(*IMAGE, *keep, "patch_h", "patch_w", columns.alias("_ny"),
                F.explode(F.sequence(F.lit(1), rows)).alias("patch_i"))
        .select(*IMAGE, *keep, "patch_h", "patch_w", "patch_i",
                F.explode(F.sequence(F.lit(1), F.col("_ny"))).alias("patch_j"))
    )
