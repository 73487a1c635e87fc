"""Grouping image files into images and channels by their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """File names and paths of a folder. Only the listing is read, never the files' content."""
    return (
        spark.read.format("binaryFile").load(folder).select("path")
        .select(F.element_at(F.split("path", "/"), -1).alias("name"), "path")
    )


def channel_name(name: Column, channel: Column) -> Column:
    """The given channel name, or ``channel_<number>`` where there is none."""
    return F.coalesce(name, F.concat(F.lit("channel_"), channel.cast("string")))


def _parsed(files: DataFrame) -> DataFrame:
    """image_id, channel (NULL where the name has none), name and path of every file whose name has a dot."""
    if "path" not in files.columns:
        files = files.withColumn("path", F.col("name"))
    tokens = F.split("name", "_")
    image = F.when(
        F.size(tokens) > 2, F.array_join(F.slice(tokens, F.lit(1), F.size(tokens) - 1), "_")
    ).otherwise(F.element_at(tokens, 1))
    return files.filter(F.contains("name", F.lit("."))).select(
        image.alias("image_id"),
        F.regexp_extract("name", r"_c(\d+)[^_]*$", 1).try_cast("int").alias("channel"),
        "name", "path",
    )


def manifest(files: DataFrame, n_channels: int) -> DataFrame:
    """One row per (image, channel): the first matching file in name order.

    Names without a dot are skipped. An image's name is everything before the last underscore, or the first token of
    a two-token name; the channel is the number behind ``_c``.
    """
    if n_channels < 1:
        raise ValueError("an image needs at least one channel")
    first = F.min(F.struct("name", "path"))
    return (
        _parsed(files).filter(F.col("channel").between(1, n_channels))
        .groupBy("image_id", "channel").agg(first.alias("_first"))
        .select(
            "image_id", "channel",
            channel_name(F.lit(None).cast("string"), F.col("channel")).alias("channel_name"),
            F.col("_first.name").alias("name"), F.col("_first.path").alias("path"),
        )
    )


def missing_channels(files: DataFrame, n_channels: int) -> DataFrame:
    """(image, channel) combinations that have no file, for every image a file name mentions."""
    wanted = F.sequence(F.lit(1), F.lit(n_channels))
    return (
        _parsed(files).groupBy("image_id").agg(F.collect_set("channel").alias("_have"))
        .select("image_id", F.explode(F.array_except(wanted, F.col("_have"))).alias("channel"))
    )


def manifest_problems(files: DataFrame, n_channels: int) -> DataFrame:
    """What keeps a folder from being complete: image_id, channel, name, problem.

    ``unknown_channel``: a file without a channel from 1 to n; ``missing_channel``: an image without a file for one;
    ``surplus_file``: a file behind the first one of its image and channel.
    """
    parsed = _parsed(files)
    known = F.coalesce(F.col("channel").between(1, n_channels), F.lit(False))
    unknown = parsed.filter(~known).select("image_id", "channel", "name", F.lit("unknown_channel").alias("problem"))
    missing = missing_channels(files, n_channels).select(
        "image_id", "channel", F.lit(None).cast("string").alias("name"), F.lit("missing_channel").alias("problem")
    )
    surplus = parsed.join(manifest(files, n_channels).select("image_id", "channel", F.col("name").alias("_first")), ["image_id", "channel"])
    surplus = surplus.filter(F.col("name") != F.col("_first")).select(
        "image_id", "channel", "name", F.lit("surplus_file").alias("problem")
    )
    return unknown.unionByName(missing).unionByName(surplus)


def check_manifest(files: DataFrame, n_channels: int) -> DataFrame:
    """The manifest, or ``ValueError`` for an empty, uneven or incomplete folder or one with other files in it."""
    n = files.filter(F.contains("name", F.lit("."))).count()
    if n % n_channels:
        raise ValueError(f"{n} files cannot be divided into images of {n_channels} channels")
    if n == 0:
        raise ValueError("there is no image in the folder")
    found = manifest_problems(files, n_channels).filter("problem <> 'surplus_file'").orderBy("problem", "image_id", "channel").head()
    if found is not None and found.problem == "unknown_channel":
        raise ValueError(f"file {found.name} belongs to no channel from 1 to {n_channels}")
    if found is not None:
        raise ValueError(f"image {found.image_id} has no file for channel {found.channel}")
    return manifest(files, n_channels)
