"""Otsu thresholds and background masks.

Threshold definition (Otsu 1979): values between the smallest and largest one fall into 256 equal bins; the threshold
is the upper edge of the first bin that maximises the between-class variance. A constant channel's threshold is its
value, so all of it is background.

Two passes over the pixels: the value range needs no exploded pixels, and the histogram shrinks to at most 256 rows per
(image, channel) before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumipair.operators.images import value_range
from lumipair.schema import IMAGE, channels_of
from lumipair.shared import lookup_join

BINS = 256


def histogram(scanlines: DataFrame, channels: list[int] | None = None, bins: int = BINS) -> DataFrame:
    channels = channels or channels_of(scanlines)
    ranged = lookup_join(scanlines, value_range(scanlines, channels), IMAGE)
    planes = F.array(*[
        F.struct(F.lit(c).alias("channel"), F.col(f"lo{c}").alias("lo"), F.col(f"hi{c}").alias("hi"),
                 F.col(f"c{c}").alias("values"))
        for c in channels
    ])
    pixels = ranged.select(*IMAGE, F.inline(planes)).select(*IMAGE, "channel", "lo", "hi", F.explode("values").alias("v"))
    share = F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo"))
    bin_ = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * F.lit(float(bins))), F.lit(bins - 1)).cast("int")
    return (
        pixels.filter(F.col("v").isNotNull() & ~F.isnan("v"))
        .groupBy(*IMAGE, "channel", "lo", "hi", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    )


def otsu_thresholds(scanlines: DataFrame, channels: list[int] | None = None, bins: int = BINS) -> DataFrame:
    plane = Window.partitionBy(*IMAGE, "channel")
    upto = plane.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n, moment = F.col("n").cast("double"), F.col("n").cast("double") * F.col("bin")
    sums = histogram(scanlines, channels, bins).select(
        *IMAGE, "channel", "lo", "hi", "bin",
        F.sum(n).over(upto).alias("w"), F.sum(moment).over(upto).alias("m"),
        F.sum(n).over(plane).alias("total_w"), F.sum(moment).over(plane).alias("total_m"),
    )
    gap = F.col("total_m") * F.col("w") - F.col("total_w") * F.col("m")
    between = F.try_divide(gap * gap, F.col("w") * (F.col("total_w") - F.col("w")))
    best = F.max(F.when(between.isNotNull(), F.struct(between.alias("variance"), (-F.col("bin")).alias("first"))))
    span = F.col("hi") - F.col("lo")
    return (
        sums.groupBy(*IMAGE, "channel", "lo", "hi").agg(best.alias("best"))
        .select(
            *IMAGE, "channel",
            F.coalesce(F.col("lo") + (F.lit(1) - F.col("best.first")) * span / F.lit(float(bins)), F.col("lo"))
            .alias("otsu_threshold"),
        )
    )


def with_thresholds(scanlines: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Scanlines with a threshold column ``t<c>`` per channel, NULL for a channel without a single value."""
    channels = channels_of(scanlines)
    wide = thresholds.groupBy(*IMAGE).agg(
        *[F.max(F.when(F.col("channel") == c, F.col("otsu_threshold"))).alias(f"t{c}") for c in channels]
    )
    return lookup_join(scanlines, wide, IMAGE, "left")


def apply_mask(scanlines: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Set background (values not above the threshold) to 0; missing and NaN values, and channels without a threshold,
    stay as they are."""

    def masked(c: int) -> Column:
        threshold = F.col(f"t{c}")
        return F.transform(f"c{c}", lambda v: F.when(v <= threshold, F.lit(0.0)).otherwise(v)).alias(f"c{c}")

    return with_thresholds(scanlines, thresholds).select(
        *IMAGE, "row", "height", "width", *[masked(c) for c in channels_of(scanlines)]
    )


def mask_otsu(scanlines: DataFrame) -> DataFrame:
    return apply_mask(scanlines, otsu_thresholds(scanlines))


def mask_pixels(scanlines: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The binary mask: one row per pixel and channel, true strictly above the threshold."""
    planes = F.array(*[
        F.struct(F.lit(c).alias("channel"), F.col(f"t{c}").alias("threshold"), F.col(f"c{c}").alias("values"))
        for c in channels_of(scanlines)
    ])
    above = (F.col("value") > F.col("threshold")) & ~F.isnan("value")
    return (
        with_thresholds(scanlines, thresholds)
        .select(*IMAGE, "row", "width", F.inline(planes))
        .select(*IMAGE, "channel", "row", "width", "threshold", F.posexplode("values").alias("col", "value"))
        .select(*IMAGE, "channel", "row", "col", "width", F.coalesce(above, F.lit(False)).alias("mask"))
    )


def mask_mosaic(scanlines: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The masks of an image's channels side by side."""
    place = F.lit(0)
    for k, c in enumerate(channels_of(scanlines)):
        place = F.when(F.col("channel") == c, F.lit(k)).otherwise(place)
    return mask_pixels(scanlines, thresholds).select(
        *IMAGE, "row", (F.col("col") + place * F.col("width")).alias("mosaic_col"), "mask"
    )
