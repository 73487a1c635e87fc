"""Reading image rows and moving between the band, scanline and pixel layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumipair.functions.columns import finite_values
from lumipair.schema import BANDS, IMAGE, channels_of, require_columns
from lumipair.shared import lookup_join
from lumipair.sources.manifest import check_manifest

# So many files are named in an error.
MOST_NAMED = 10


def read_bands(spark: SparkSession, path: str) -> DataFrame:
    """Read a Parquet band table; values of any numeric type become doubles."""
    raw = spark.read.parquet(path)
    require_columns(raw, BANDS.fieldNames(), "the band table")
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in BANDS.fields])


def with_row_ranges(scanlines: DataFrame) -> DataFrame:
    """Add the value range of each row and channel, to be stored with the scanlines."""
    found = []
    for c in channels_of(scanlines):
        values = finite_values(F.col(f"c{c}"))
        found += [F.array_min(values).alias(f"lo_c{c}"), F.array_max(values).alias(f"hi_c{c}")]
    return scanlines.select("*", *found)


def write_scanlines(scanlines: DataFrame, path: str) -> None:
    """Store scanlines for later runs; one directory per condition, so one side of a comparison can be read alone."""
    with_row_ranges(scanlines).write.mode("errorifexists").partitionBy("condition").parquet(path)


def read_scanlines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def align_channels(bands: DataFrame, channels: list[int], complete: bool = False) -> DataFrame:
    """Put the channels of an image row next to each other.

    This is the join of the channels at equal (image, row), done once for all channels in one shuffle of whole image
    rows. A group holds one image row per channel, so its size is fixed by the image format.

    Refused when the rows are read, whichever columns are asked for: channels of different size, a band row that is
    there twice, and, with ``complete``, an image row that lacks a channel (its plane is NULL otherwise).
    """
    sizes = [f(c).alias(f"_{name}_{c}") for c in ("height", "width") for name, f in (("low", F.min), ("high", F.max))]
    equal = (F.col("_low_height") == F.col("_high_height")) & (F.col("_low_width") == F.col("_high_width"))
    row = F.concat(F.lit("row "), F.col("row"), F.lit(" of image "), F.col("image_id"))
    absent = F.array_except(F.array(*map(F.lit, channels)), F.col("_channels"))
    faults = [(~F.coalesce(equal, F.lit(False)), F.concat(F.lit("the channels of image "), F.col("image_id"), F.lit(" differ in size"))),
              (F.size(F.array_distinct("_channels")) < F.size("_channels"), F.concat(row, F.lit(" has a channel twice")))]
    if complete:
        faults.append((F.size(absent) > 0, F.concat(row, F.lit(" lacks the channels "), absent.cast("string"))))
    fault = F.lit(None).cast("string")
    for found, message in reversed(faults):
        fault = F.when(found, message).otherwise(fault)
    return (
        bands.filter(F.col("channel").isin(channels))
        .groupBy(*IMAGE, "row")
        .agg(F.collect_list(F.struct("channel", "values")).alias("_list"), F.collect_list("channel").alias("_channels"), *sizes)
        # A filter, as the optimizer prunes columns that nobody reads, and any check with them.
        .filter(F.when(fault.isNull(), True).otherwise(F.raise_error(fault).cast("boolean")))
        .withColumn("_planes", F.map_from_entries("_list"))
        .select(
            *IMAGE, "row", F.col("_high_height").alias("height"), F.col("_high_width").alias("width"),
            *[F.try_element_at("_planes", F.lit(c)).alias(f"c{c}") for c in channels],
        )
    )


def to_bands(scanlines: DataFrame, channels: list[int] | None = None) -> DataFrame:
    channels = channels or channels_of(scanlines)
    planes = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"c{c}").alias("values")) for c in channels])
    return scanlines.select(*IMAGE, "row", "height", "width", F.inline(planes)).select(*BANDS.fieldNames())


def to_pixels(scanlines: DataFrame, channels: list[int] | None = None) -> DataFrame:
    """One row per pixel and channel."""
    return to_bands(scanlines, channels).select(
        *IMAGE, "channel", "row", "height", "width", F.posexplode("values").alias("col", "value")
    )


def bands_from_pixels(pixels: DataFrame) -> DataFrame:
    """Collect pixel rows (condition, image_id, channel, row, col, value) into bands; absent pixels become NULL."""
    sizes = pixels.groupBy(*IMAGE).agg(
        (F.max("row") + 1).cast("int").alias("height"), (F.max("col") + 1).cast("int").alias("width")
    )
    lines = lookup_join(
        pixels.groupBy(*IMAGE, "channel", "row").agg(
            F.array_sort(F.collect_list(F.struct("col", "value"))).alias("_line")
        ),
        sizes, IMAGE,
    )
    # The map is made once for a row, in a projection of its own.
    lines = lines.withColumn("_at", F.when(F.size("_line") < F.col("width"), F.map_from_entries("_line")))
    sparse = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda k: F.try_element_at(F.col("_at"), k))
    values = F.when(F.size("_line") == F.col("width"), F.col("_line.value")).otherwise(sparse)
    return lines.select(
        *IMAGE, F.col("channel").cast("int").alias("channel"), F.col("row").cast("int").alias("row"),
        "height", "width", values.cast("array<double>").alias("values"),
    )


def stack_from_manifest(bands: DataFrame, files: DataFrame, n_channels: int, condition: str) -> DataFrame:
    """Scanlines of a folder: band rows keyed by ``path`` (path, row, height, width, values) joined to its manifest.

    An incomplete folder is refused, and so are files without any band row (only ``path`` is read to find them) and image
    rows that lack a channel; band rows of paths outside the manifest are not part of the stack.
    """
    of_path = check_manifest(files, n_channels).select("image_id", "channel", "path")
    unread = of_path.select("path").join(bands.select("path"), "path", "left_anti").orderBy("path").head(MOST_NAMED)
    if unread:
        raise ValueError(f"no band rows for {', '.join(r.path for r in unread)}")
    rows = bands.join(of_path, "path").withColumn("condition", F.lit(condition)).select(*BANDS.fieldNames())
    return align_channels(rows, list(range(1, n_channels + 1)), complete=True)


def shape_summary(scanlines: DataFrame) -> DataFrame:
    """Per image its number of rows and the smallest and largest stated or actual height and width."""
    sizes = [F.col("width")] + [F.coalesce(F.size(f"c{c}"), F.lit(-1)) for c in channels_of(scanlines)]
    return scanlines.groupBy(*IMAGE).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("height").alias("min_height"), F.max("height").alias("max_height"),
        F.min(F.least(*sizes)).alias("min_width"), F.max(F.greatest(*sizes)).alias("max_width"),
    )


def shape_violations(scanlines: DataFrame) -> DataFrame:
    """Images whose rows or channel planes do not all have the stated size; an empty result means all is well."""
    return shape_summary(scanlines).filter(
        (F.col("min_height") != F.col("max_height"))
        | (F.col("n_rows") != F.col("max_height"))
        | (F.col("min_width") != F.col("max_width"))
    )
