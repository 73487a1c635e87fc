"""Image dimensions, metadata, stacks, normalisation and composites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumipair.functions.ranking import value_ranks
from lumipair.schema import IMAGE, channels_of
from lumipair.shared import lookup_join
from lumipair.sources.bands import with_row_ranges
from lumipair.sources.manifest import channel_name


def dimensions(scanlines: DataFrame) -> DataFrame:
    return scanlines.groupBy(*IMAGE).agg(F.max("height").alias("height"), F.max("width").alias("width"))


def pair_combinations(channels: DataFrame) -> DataFrame:
    """All channel pairs x < y of every image, from a table with one row per (image, channel)."""
    low = channels.select(*IMAGE, F.col("channel").alias("ch_x"))
    high = channels.select(*IMAGE, F.col("channel").alias("ch_y"))
    return low.join(high, IMAGE).filter(F.col("ch_x") < F.col("ch_y"))


def value_range(scanlines: DataFrame, channels: list[int] | None = None) -> DataFrame:
    """Per image the smallest and largest value of every channel (``lo<c>``, ``hi<c>``), NaN and NULL left out."""
    channels = channels or channels_of(scanlines)
    if not {f"lo_c{c}" for c in channels} <= set(scanlines.columns):
        scanlines = with_row_ranges(scanlines)
    found = []
    for c in channels:
        found += [F.min(f"lo_c{c}").alias(f"lo{c}"), F.max(f"hi_c{c}").alias(f"hi{c}")]
    return scanlines.groupBy(*IMAGE).agg(*found)


def minmax_normalise(scanlines: DataFrame, channels: list[int] | None = None) -> DataFrame:
    """Scale every channel of every image to [0, 1]; a constant channel becomes NULL."""
    channels = channels or channels_of(scanlines)
    ranged = lookup_join(scanlines, value_range(scanlines, channels), IMAGE)

    def scaled(c: int) -> Column:
        low, span = F.col(f"lo{c}"), F.col(f"hi{c}") - F.col(f"lo{c}")
        return F.transform(f"c{c}", lambda v: F.try_divide(v - low, span)).alias(f"c{c}")

    return ranged.select(*IMAGE, "row", "height", "width", *[scaled(c) for c in channels])


def stack_positions(images: DataFrame) -> DataFrame:
    """Add ``image_idx``, the 1-based position of an image in its condition's stack in name order."""
    ranks = value_ranks(images.select(*IMAGE).distinct(), ["condition"], "image_id")
    positions = ranks.select(*IMAGE, (F.col("before") + 1).cast("int").alias("image_idx"))
    return lookup_join(images, positions, IMAGE)


def stack_lengths(images: DataFrame) -> DataFrame:
    return images.select(*IMAGE).distinct().groupBy("condition").agg(F.count(F.lit(1)).alias("n_images"))


def image_at(positioned: DataFrame, condition: str, index: int) -> DataFrame:
    """The rows of the image at a 1-based position; ``IndexError`` if the stack has none there."""
    found = positioned.filter((F.col("condition") == condition) & (F.col("image_idx") == index))
    if found.isEmpty():
        raise IndexError(f"the {condition} stack has no image {index}")
    return found


def image_table(
    scanlines: DataFrame, thresholds: DataFrame | None = None, files: DataFrame | None = None,
    names: list[str] | None = None,
) -> DataFrame:
    """One row per (image, channel): position, channel name, path, dimensions and threshold.

    Channel names come from ``names``, else from the manifest ``files``, else they are made up.
    """
    channels = channels_of(scanlines)
    if names is not None and len(names) != len(channels):
        raise ValueError(f"{len(names)} names for {len(channels)} channels")
    images = stack_positions(dimensions(scanlines)).withColumn(
        "channel", F.explode(F.array(*[F.lit(c) for c in channels]))
    )
    if files is not None:
        images = images.join(files.select("image_id", "channel", "channel_name", "path"), ["image_id", "channel"], "left")
    else:
        absent = F.lit(None).cast("string")
        images = images.withColumn("channel_name", absent).withColumn("path", absent)
    if names is not None:
        images = images.withColumn(
            "channel_name", F.element_at(F.create_map(*[F.lit(v) for cn in zip(channels, names) for v in cn]), F.col("channel"))
        )
    if thresholds is not None:
        images = images.join(
            thresholds.select(*IMAGE, "channel", "otsu_threshold"), [*IMAGE, "channel"], "left"
        )
    else:
        images = images.withColumn("otsu_threshold", F.lit(None).cast("double"))
    return images.select(
        *IMAGE, "image_idx", "channel", channel_name(F.col("channel_name"), F.col("channel")).alias("channel_name"),
        "path", "height", "width", "otsu_threshold",
    )


def composite(scanlines: DataFrame, shown: list[int], scale: bool = True) -> DataFrame:
    """Pixels with red, green and blue values from one to three channels.

    Three channels fill blue, green and red in that order, two fill green and red, one becomes a shade of grey. Missing
    values are shown as 0.
    """
    if not 1 <= len(shown) <= 3:
        raise ValueError("one to three channels can be shown")
    if not set(shown) <= set(channels_of(scanlines)):
        raise ValueError(f"channels {shown} are not all in the image")
    lines = minmax_normalise(scanlines, shown) if scale else scanlines
    names = [f"c{c}" for c in shown]
    zipped = F.arrays_zip(*[F.col(c).alias(f"v{k}") for k, c in enumerate(names)])
    pixels = lines.select(*IMAGE, "row", F.posexplode(zipped).alias("col", "v"))
    values = [F.coalesce(F.nanvl(F.col(f"v.v{k}"), F.lit(None)), F.lit(0.0)) for k in range(len(shown))]
    if len(shown) == 3:
        blue, green, red = values
    elif len(shown) == 2:
        (green, red), blue = values, F.lit(0.0)
    else:
        blue = green = red = values[0]
    return pixels.select(*IMAGE, "row", "col", red.alias("red"), green.alias("green"), blue.alias("blue"))


def patch_lines(images: DataFrame, n: int) -> DataFrame:
    """Positions of the grid lines drawn over an image of n x n patches."""
    return images.select(*IMAGE, "height", "width", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("line")).select(
        *IMAGE, "line",
        (F.col("line") * F.expr(f"height div {n}")).alias("y"), (F.col("line") * F.expr(f"width div {n}")).alias("x"),
    )


def patch_labels(rho: DataFrame, sized: DataFrame, n: int, digits: int = 2) -> DataFrame:
    """Text positions (patch centres) and rounded correlations for patches that have one."""
    placed = lookup_join(rho, dimensions(sized), IMAGE)
    patch_h, patch_w = F.expr(f"height div {n}"), F.expr(f"width div {n}")
    return placed.filter(F.col("rho").isNotNull()).select(
        *IMAGE, "ch_x", "ch_y", "patch_i", "patch_j",
        ((F.col("patch_j") - 1) * patch_w + patch_w / F.lit(2.0)).alias("x"),
        ((F.col("patch_i") - 1) * patch_h + patch_h / F.lit(2.0)).alias("y"),
        F.round("rho", digits).alias("rho"),
    )
