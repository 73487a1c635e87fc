"""Patch-wise correlation of channel pairs.

Only pixels with a signal in both channels count, and a patch needs more than ``MIN_SUPPORT`` of them. All images, all
pairs and all patches are computed in one plan. Pixels never leave the task that read them for Pearson: patches shrink
to a few partial moments before the only shuffle, in aggregates where no channel is in two pairs, and otherwise in products
of all channels at once (``gram``), so that pixels are not copied for each pair. The rank methods have to bring a patch together: patches up to a size
limit are gathered as arrays (``rank_methods``), larger ones are split by value (``large_patches``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumipair.functions.columns import has_signal
from lumipair.operators import large_patches
from lumipair.operators.gram import gram_rho
from lumipair.operators.patches import check_grid, patch_column, patch_grid, patch_height, patch_rows, patch_width
from lumipair.operators.rank_methods import rho_of_arrays
from lumipair.schema import IMAGE, PAIR, PATCH, channel_pairs, channels_of

# A patch whose count of usable pixels is not above this has no correlation.
MIN_SUPPORT = 15

# Largest patch (in pixels) that is gathered into one row: 8 MB per channel.
WHOLE_PATCH_PIXELS = 1_000_000

METHODS = ("pearson", "spearman", "kendall")


def check_pairs(scanlines: DataFrame, pairs: list[tuple[int, int]] | None) -> list[tuple[int, int]]:
    channels = channels_of(scanlines)
    if pairs is None:
        pairs = channel_pairs(channels)
    if not pairs:
        raise ValueError("at least two channels are needed")
    for pair in pairs:
        if len(pair) != 2:
            raise ValueError(f"a channel pair has exactly two channels, not {len(pair)}")
        if not set(pair) <= set(channels):
            raise ValueError(f"channels {pair} are not all among {channels}")
    return [tuple(p) for p in pairs]


def pair_lines(scanlines: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """Scanlines with one row per channel pair and the two channels as arrays ``xs`` and ``ys``."""
    planes = F.array(*[
        F.struct(F.lit(x).alias("ch_x"), F.lit(y).alias("ch_y"), F.col(f"c{x}").alias("xs"), F.col(f"c{y}").alias("ys"))
        for x, y in pairs
    ])
    channels = {f"c{c}" for c in channels_of(scanlines)}
    return scanlines.select(*[c for c in scanlines.columns if c not in channels], F.inline(planes))


def pair_pixels(
    scanlines: DataFrame, pairs: list[tuple[int, int]], nx: int | Column, ny: int | Column | None = None
) -> DataFrame:
    """Pixels (x, y) of every channel pair with their patch, before any test for signal."""
    keep = [c for c in ("resolution",) if c in scanlines.columns]
    ny = nx if ny is None else ny
    columns = ny if isinstance(ny, Column) else F.lit(ny)
    lines = pair_lines(patch_rows(scanlines, nx, ny), pairs)
    zipped = F.arrays_zip(F.col("xs").alias("x"), F.col("ys").alias("y"))
    return (
        lines.select(*IMAGE, *keep, *PAIR, "patch_i", "patch_h", "patch_w", (columns * F.col("patch_w")).alias("_end"),
                     F.posexplode(zipped).alias("_col", "_px"))
        .filter(F.col("_col") < F.col("_end"))
        .select(*IMAGE, *keep, *PAIR, "patch_i", patch_column(F.col("_col")).alias("patch_j"), "patch_h", "patch_w",
                F.col("_px.x").alias("x"), F.col("_px.y").alias("y"))
    )


def gathered_patches(scanlines: DataFrame, channels: list[int], nx: int | Column, ny: int | Column) -> DataFrame:
    """One row per patch with each channel's pixels as one array. What is shuffled are runs of an image row."""
    keys = [*IMAGE, *[c for c in ("resolution",) if c in scanlines.columns], *PATCH]
    columns = ny if isinstance(ny, Column) else F.lit(ny)
    start = ((F.col("patch_j") - 1) * F.col("patch_w") + 1).cast("int")
    none = F.lit(None).cast("double")

    def run(c: int) -> Column:
        """The patch's part of an image row; pixels behind the end of a short or absent plane are missing."""
        part = F.coalesce(F.slice(f"c{c}", start, F.col("patch_w")), F.array().cast("array<double>"))
        return F.concat(part, F.array_repeat(none, F.col("patch_w") - F.size(part))).alias(f"c{c}")

    runs = (
        patch_rows(scanlines, nx, ny)
        .withColumn("patch_j", F.explode(F.sequence(F.lit(1), columns)))
        .select(*keys, F.struct(*map(run, channels)).alias("_run"))
    )
    gathered = runs.groupBy(*keys).agg(F.collect_list("_run").alias("_runs"))
    return gathered.select(*keys, *[F.flatten(F.col(f"_runs.c{c}")).alias(f"c{c}") for c in channels])


def both_have_signal() -> Column:
    return has_signal(F.col("x")) & has_signal(F.col("y"))


def signal_pixels(scanlines: DataFrame, pairs: list[tuple[int, int]] | None, nx: int, ny: int | None = None) -> DataFrame:
    """Pixels that have a signal in both channels of a pair."""
    check_grid(nx, nx if ny is None else ny)
    return pair_pixels(scanlines, check_pairs(scanlines, pairs), nx, ny).filter(both_have_signal())


def moments_rho(x: Column, y: Column) -> Column:
    """Pearson correlation from one pass of mergeable moments; NULL when either side is constant."""
    spread = F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    rho = F.try_divide(F.covar_pop(x, y), spread)
    # Infinite values leave no number, and NaN would count as the larger one.
    return F.when(varies & ~F.isnan(rho), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho)))


def _supported(df: DataFrame, min_support: int) -> DataFrame:
    return df.withColumn("rho", F.when(F.col("n") > min_support, F.col("rho")))


def pearson(pixels: DataFrame, keys: list[str]) -> DataFrame:
    usable = both_have_signal()
    x, y = F.when(usable, F.col("x")), F.when(usable, F.col("y"))
    masked = pixels.select(*keys, x.alias("x"), y.alias("y"))
    return masked.groupBy(*keys).agg(F.count("x").alias("n"), moments_rho(F.col("x"), F.col("y")).alias("rho"))


def _patch_size(nx: int | Column, ny: int | Column) -> Column:
    return patch_height(nx).cast("long") * patch_width(ny)


def largest_patch(scanlines: DataFrame, nx: int | Column, ny: int | Column | None = None) -> int:
    """Pixels of the largest patch; reads the size columns only."""
    size = F.max(_patch_size(nx, nx if ny is None else ny))
    return scanlines.agg(size.alias("size")).first()["size"] or 0


def patch_rho(
    scanlines: DataFrame,
    nx: int,
    ny: int | None = None,
    pairs: list[tuple[int, int]] | None = None,
    method: str = "pearson",
    min_support: int = MIN_SUPPORT,
    whole_patch: int = WHOLE_PATCH_PIXELS,
    largest: int | None = None,
) -> DataFrame:
    """Correlation of every (image, channel pair, patch).

    ``largest`` is the pixel count of the largest patch if the caller knows it; the rank methods look it up otherwise.
    """
    if method not in METHODS:
        raise ValueError(f"the method must be one of {METHODS}")
    ny = nx if ny is None else ny
    check_grid(nx, ny)
    pairs = check_pairs(scanlines, pairs)
    keys = IMAGE + PAIR + PATCH
    if method == "pearson":
        if 2 * len(pairs) > len({c for pair in pairs for c in pair}):
            return _supported(gram_rho(scanlines, pairs, nx, ny).select(*keys, "n", "rho"), min_support)
        return _supported(pearson(pair_pixels(scanlines, pairs, nx, ny), keys), min_support)

    return _supported(rank_rho(scanlines, pairs, nx, ny, method, whole_patch, largest), min_support)


def rank_rho(
    scanlines: DataFrame, pairs: list[tuple[int, int]], nx: int | Column, ny: int | Column, method: str,
    whole_patch: int = WHOLE_PATCH_PIXELS, largest: int | None = None,
) -> DataFrame:
    """Rank correlation of every (image, channel pair, patch), of any support; of scanlines with a ``resolution``, for each."""
    place = [*IMAGE, *[c for c in ("resolution",) if c in scanlines.columns]]
    keys = place + PAIR + PATCH
    if largest is None:
        largest = largest_patch(scanlines, nx, ny)
    size = _patch_size(nx, ny)
    small = scanlines if largest <= whole_patch else scanlines.filter(size <= whole_patch)
    gathered = gathered_patches(small, sorted({c for pair in pairs for c in pair}), nx, ny)
    rho = rho_of_arrays(gathered, place + PATCH, pairs, method).select(*keys, "n", "rho")
    if largest > whole_patch:
        large = scanlines.filter(size > whole_patch)
        pixels = pair_pixels(large, pairs, nx, ny).filter(both_have_signal())
        each = F.array(*[F.struct(F.lit(x).alias("ch_x"), F.lit(y).alias("ch_y")) for x, y in pairs])
        grid = patch_grid(large, nx, ny).select(*place, F.inline(each), *PATCH)
        ranked = large_patches.METHODS[method](pixels, keys, whole_patch)
        rho = rho.unionByName(
            grid.join(ranked, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), "rho")
        )
    return rho


def usable_rho(rho: DataFrame) -> DataFrame:
    """Patches whose correlation is neither missing nor NaN."""
    return rho.filter(F.col("rho").isNotNull() & ~F.isnan("rho"))


def empty_images(rho: DataFrame) -> DataFrame:
    """Images without a single usable patch for a pair: they drop out of the analysis and should be reported."""
    usable = F.count_if(F.col("rho").isNotNull() & ~F.isnan("rho"))
    return (
        rho.groupBy(*IMAGE, *PAIR).agg(usable.alias("n_usable"))
        .filter(F.col("n_usable") == 0).select(*IMAGE, *PAIR)
    )


def dropped_images(scanlines: DataFrame, rho: DataFrame, pairs: list[tuple[int, int]] | None = None) -> DataFrame:
    """Images that give no correlation for a pair, with the reason: every image of ``scanlines`` is either here or has a
    usable patch in ``rho`` (patch correlations or a local map's).

    ``no_patch``: no patch was formed at all, as in an image smaller than the grid; ``no_usable_patch``: none has enough
    pixels with a signal in both channels.
    """
    wanted = F.array(*[F.struct(F.lit(x).alias("ch_x"), F.lit(y).alias("ch_y")) for x, y in check_pairs(scanlines, pairs)])
    images = scanlines.select(*IMAGE).distinct().select(*IMAGE, F.inline(wanted))
    usable = F.count_if(F.col("rho").isNotNull() & ~F.isnan("rho"))
    found = rho.groupBy(*IMAGE, *PAIR).agg(usable.alias("_usable"))
    reason = F.when(F.col("_usable").isNull(), F.lit("no_patch")).otherwise(F.lit("no_usable_patch"))
    joined = images.join(found, [*IMAGE, *PAIR], "left").filter(F.coalesce("_usable", F.lit(0)) == 0)
    return joined.select(*IMAGE, *PAIR, reason.alias("reason"))


def rho_vectors(rho: DataFrame) -> DataFrame:
    """Per image and pair the usable correlations as one array in patch order (at most nx * ny of them)."""
    at = F.array_sort(F.collect_list(F.struct(*PATCH, "rho")))
    return usable_rho(rho).groupBy(*IMAGE, *PAIR).agg(at.alias("_at")).select(
        *IMAGE, *PAIR, F.col("_at.rho").alias("rho")
    )
