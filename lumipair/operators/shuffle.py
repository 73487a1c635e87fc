"""Randomised controls: pixels or blocks of pixels put in random order.

The order is that of a pseudo-random key of the position, so it does not depend on partitioning and can be repeated. The
key is a permutation of the numbers below a prime; two hashed offsets per image and channel choose the permutation.

The pixels of an image up to a size limit are gathered and put in order at once. In larger images, ranks come from slices
of the key range, which fill evenly however large the image is.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumipair.functions.columns import key_number, random_key
from lumipair.schema import IMAGE, channels_of, plain_columns, scanlines_schema
from lumipair.shared import lookup_join

# Send this module's functions to the executors with the tasks, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A prime for which raising to the fifth power is one-to-one, as 5 does not divide PRIME - 1.
PRIME = 2**31 - 1

# Rows of one group that are put in order inside one task.
SLICE_ROWS = 65_536

# Largest image whose pixels are gathered into one row, over all channels: 48 MB.
WHOLE_IMAGE_PIXELS = 6_000_000

# Pixels of a channel whose keys are computed at once.
BATCH_PIXELS = 500_000

DEFAULT_BLOCK = 9
METHODS = ("block", "pixel")


def _offsets(seed: int, *names: Column) -> tuple[Column, Column]:
    key = random_key(seed, *names)
    return key_number(key, 1, 13) % PRIME, key_number(key, 14, 13) % PRIME


def _fifth_power(x):
    """x ** 5 modulo the prime, for columns as well as for arrays of 64-bit integers."""
    square = x * x % PRIME
    return square * square % PRIME * x % PRIME


def _with_key(df: DataFrame, position: Column, first: Column, second: Column) -> DataFrame:
    df = df.withColumn("_key", (position.cast("long") % PRIME + first) % PRIME)
    df = df.withColumn("_key", (_fifth_power(F.col("_key")) + second) % PRIME)
    return df.withColumn("_key", _fifth_power(F.col("_key")))


def _key_rank(df: DataFrame, keys: list[str], place: list[str], group_rows: Column, slice_rows: int) -> DataFrame:
    """Add ``rank``, the 0-based position of a row in its group in the order of (``_key``, place)."""
    slices = F.ceil(group_rows / F.lit(slice_rows)).cast("double")
    sliced = df.withColumn("_slice", F.floor(F.col("_key") / F.lit(float(PRIME)) * slices))
    counts = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "_slice", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_slice").orderBy("_key", *place)
    ranked = sliced.withColumn("_inside", F.row_number().over(inside) - 1)
    return (
        ranked.join(counts, [*keys, "_slice"])
        .withColumn("rank", F.col("_inside") + F.col("_before"))
        .drop("_key", "_slice", "_inside", "_before")
    )


def _plane_of(plane: str):
    return lambda line: F.coalesce(line[plane], F.array().cast("array<double>"))


def _size_of(plane: str):
    return lambda line: F.coalesce(F.size(line[plane]), F.lit(0))


def _shuffle_whole_images(scanlines: DataFrame, seed: int) -> DataFrame:
    channels = channels_of(scanlines)
    planes = [f"c{c}" for c in channels]
    lines = F.array_sort(F.collect_list(F.struct("row", *planes)))
    offsets = [
        o.alias(f"{name}{c}")
        for c in channels for name, o in zip("ab", _offsets(seed, F.col("image_id"), F.lit(c)))
    ]
    # Rows and planes may be absent or short: the values that are there take part, each with its own position.
    sizes = [F.transform("_lines", _size_of(p)) for p in planes]
    gathered = scanlines.groupBy(*IMAGE, "height", "width").agg(lines.alias("_lines")).select(
        *IMAGE, "height", "width", *offsets, F.col("_lines.row").alias("_rows"),
        *[F.flatten(F.transform("_lines", _plane_of(p))).alias(p) for p in planes],
        *[s.alias(f"_n_{p}") for s, p in zip(sizes, planes, strict=True)],
    )

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                condition, image_id, height, width = (batch.column(n)[k].as_py() for n in (*IMAGE, "height", "width"))
                rows = batch.column("_rows")[k].values.to_numpy().astype(np.int64)
                moved = []
                for c in channels:
                    first, second = batch.column(f"a{c}")[k].as_py(), batch.column(f"b{c}")[k].as_py()
                    sizes = batch.column(f"_n_c{c}")[k].values.to_numpy().astype(np.int64)
                    column = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    key = (np.repeat(rows, sizes) * width + column) % PRIME + first
                    key = _fifth_power((_fifth_power(key % PRIME) + second) % PRIME)
                    moved.append(batch.column(f"c{c}")[k].values.take(pa.array(np.argsort(key, kind="stable"))))
                n_rows = max(-(-len(values) // width) for values in moved)
                starts = np.arange(n_rows + 1) * width
                lines = [pa.ListArray.from_arrays(pa.array(np.minimum(starts, len(v)), pa.int32()), v) for v in moved]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([condition] * n_rows), pa.array([image_id] * n_rows),
                        pa.array(np.arange(n_rows), pa.int32()), pa.array(np.full(n_rows, height), pa.int32()),
                        pa.array(np.full(n_rows, width), pa.int32()), *lines,
                    ],
                    names=[*IMAGE, "row", "height", "width", *planes],
                )

    return gathered.mapInArrow(permute, scanlines_schema(channels))


def _slices(scanlines: DataFrame, seed: int, slice_rows: int, counted: bool) -> DataFrame:
    """The pixels with their slice of the key's range and ``_key``, or, ``counted``, rows of a slice with their number."""
    channels = channels_of(scanlines)
    offsets = [
        o.alias(f"{name}{c}")
        for c in channels for name, o in zip("ab", _offsets(seed, F.col("image_id"), F.lit(c)))
    ]
    place = [*IMAGE, "height", "width"]

    def keyed(part: pa.RecordBatch, c: int) -> Iterator[pa.RecordBatch]:
        sizes = part.column(f"c{c}").value_lengths().fill_null(0).to_numpy().astype(np.int64)
        line = np.repeat(np.arange(part.num_rows), sizes)
        row, height, width, first, second = (
            part.column(n).to_numpy().astype(np.int64) for n in ("row", "height", "width", f"a{c}", f"b{c}")
        )
        position = (row * width)[line] + np.arange(len(line)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        key = _fifth_power((_fifth_power((position % PRIME + first[line]) % PRIME) + second[line]) % PRIME)
        slices = np.ceil(height.astype(np.float64) * width / slice_rows)
        slice_ = np.floor(key / float(PRIME) * slices[line]).astype(np.int64)
        if counted:
            most = int(slices.max(initial=0)) + 1
            found, rows = np.unique(line * most + slice_, return_counts=True)
            line, last = found // most, {"_slice": found % most, "_rows": rows}
        else:
            last = {"_slice": slice_, "_key": key, "_position": position, "value": part.column(f"c{c}").flatten()}
        of_line = [part.column(n).take(pa.array(line)) for n in place]
        arrays = [*of_line, pa.array(np.full(len(line), c), pa.int32()), *[pa.array(v) if isinstance(v, np.ndarray) else v for v in last.values()]]
        yield pa.RecordBatch.from_arrays(arrays, names=[*place, "channel", *last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, sizes = 0, np.cumsum(batch.column("width").to_numpy().astype(np.int64))
            while begin < batch.num_rows:
                before = sizes[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(sizes, before + BATCH_PIXELS, "right")))
                for c in channels:
                    yield from keyed(batch.slice(begin, end - begin), c)
                begin = end

    last = "_rows long" if counted else "_key long, _position long, value double"
    schema = f"condition string, image_id string, height int, width int, channel int, _slice long, {last}"
    planes = [f"c{c}" for c in channels]
    return scanlines.select(*place, "row", *offsets, *planes).mapInArrow(run, schema)


def _shuffle_sliced_images(scanlines: DataFrame, seed: int, slice_rows: int) -> DataFrame:
    """Pixels move once, to their slice of the key's range; from there runs of the new rows move, not pixels."""
    channels = channels_of(scanlines)
    place = [*IMAGE, "height", "width", "channel"]
    keys = [*place, "_slice"]
    earlier = Window.partitionBy(*place).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = _slices(scanlines, seed, slice_rows, True).groupBy(*keys).agg(F.sum("_rows").alias("_rows"))
    counts = counts.select(*keys, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    # Dealt before they are gathered: lists of one or two pixels each would be larger than the pixels.
    dealt = _slices(scanlines, seed, slice_rows, False).repartition(*keys).groupBy(*keys).agg(
        F.collect_list(F.struct("_key", "_position", "value")).alias("_px")
    )
    ordered = lookup_join(dealt.select(*keys, F.sort_array("_px")["value"].alias("_px")), counts, keys)
    begin = F.greatest(F.col("row") * F.col("width") - F.col("_before"), F.lit(0))
    end = F.least((F.col("row") + 1) * F.col("width") - F.col("_before"), F.size("_px"))
    rows = F.sequence(F.expr("_before div width"), F.expr("(_before + size(_px) - 1) div width"))
    runs = ordered.withColumn("row", F.explode(rows)).select(
        *place, "_before", F.col("row").cast("int").alias("row"),
        F.slice("_px", (begin + 1).cast("int"), (end - begin).cast("int")).alias("_run"),
    )
    lines = runs.groupBy(*IMAGE, "row", "height", "width").agg(
        F.sort_array(F.collect_list(F.struct("channel", "_before", "_run"))).alias("_runs")
    )

    def plane(c: int) -> Column:
        return F.flatten(F.filter("_runs", lambda e: e["channel"] == c)["_run"]).alias(f"c{c}")

    return lines.select(*IMAGE, "row", "height", "width", *[plane(c) for c in channels])


def shuffle_pixels(
    scanlines: DataFrame, seed: int = 0, slice_rows: int = SLICE_ROWS, whole_image: int = WHOLE_IMAGE_PIXELS
) -> DataFrame:
    """Permute the pixels of every channel on its own.

    Pixels that are there keep to the front of the image: of absent rows or planes nothing is moved. Both ways, for images
    that fit one task and for larger ones, give the same rows. ``whole_image`` counts the pixels of all channels.
    """
    scanlines = scanlines.select(*plain_columns(scanlines))
    size = F.expr(f"cast(height as bigint) * width * {len(channels_of(scanlines))}")
    largest = scanlines.agg(F.max(size).alias("size")).first()["size"] or 0
    if largest <= whole_image:
        return _shuffle_whole_images(scanlines, seed)
    small = _shuffle_whole_images(scanlines.filter(size <= whole_image), seed)
    return small.unionByName(_shuffle_sliced_images(scanlines.filter(size > whole_image), seed, slice_rows))


def block_moves(scanlines: DataFrame, block: int, seed: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Where each block of an image goes: (from_i, from_j) to (to_i, to_j), 0-based.

    Blocks at the bottom and right edge can be smaller, so blocks are only exchanged within the same shape.
    """
    b = F.lit(block)
    full_i, full_j = F.expr(f"height div {block}"), F.expr(f"width div {block}")
    blocks = (
        scanlines.select(*IMAGE, "height", "width").distinct()
        .withColumn("full_i", full_i).withColumn("full_j", full_j)
        .withColumn("from_i", F.explode(F.sequence(F.lit(0), F.expr(f"(height - 1) div {block}"))))
        .withColumn("from_j", F.explode(F.sequence(F.lit(0), F.expr(f"(width - 1) div {block}"))))
        .withColumn("low_h", (F.col("from_i") == F.col("full_i")).cast("int"))
        .withColumn("low_w", (F.col("from_j") == F.col("full_j")).cast("int"))
    )
    size = F.col("height").cast("double") * F.col("width") / (b * b)
    position = F.col("from_i").cast("long") * (F.col("full_j") + 1) + F.col("from_j")
    keyed = _with_key(blocks, position, *_offsets(seed, F.col("image_id")))
    ranked = _key_rank(keyed, [*IMAGE, "low_h", "low_w"], ["from_i", "from_j"], size, slice_rows)
    across = F.when(F.col("low_w") == 1, F.lit(1)).otherwise(F.greatest(F.col("full_j"), F.lit(1)))
    to_i = F.when(F.col("low_h") == 1, F.col("full_i")).otherwise(F.call_function("div", F.col("rank"), across))
    to_j = F.when(F.col("low_w") == 1, F.col("full_j")).otherwise(F.col("rank") % across)
    return ranked.select(*IMAGE, "from_i", "from_j", to_i.alias("to_i"), to_j.alias("to_j"))


def shuffle_blocks(
    scanlines: DataFrame, block: int = DEFAULT_BLOCK, seed: int = 0, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Permute square blocks of pixels; all channels of an image move together.

    Whole image rows are joined to the moves of their row of blocks, a table smaller than the pixels by the block's size
    that is broadcast up to the limit of ``lookup_join``; only then are rows cut, and what is shuffled to build the new rows
    are runs of ``block`` pixels of all channels.
    """
    if block < 1:
        raise ValueError("a block is at least one pixel wide")
    channels = channels_of(scanlines)
    moves = block_moves(scanlines, block, seed, slice_rows).groupBy(*IMAGE, "from_i").agg(
        F.collect_list(F.struct("from_j", "to_i", "to_j")).alias("_moves")
    )
    lines = lookup_join(scanlines.withColumn("from_i", F.expr(f"row div {block}")), moves, [*IMAGE, "from_i"])
    planes = [f"c{c}" for c in channels]
    start = (F.col("from_j") * block + 1).cast("int")
    runs = lines.select(*IMAGE, "row", "height", "width", *planes, F.inline("_moves")).select(
        *IMAGE, "height", "width", "to_j", (F.col("to_i") * block + F.col("row") % block).cast("int").alias("row"),
        *[F.slice(c, start, F.lit(block)).alias(c) for c in planes],
    )
    line = F.array_sort(F.collect_list(F.struct("to_j", *planes)))
    return (
        runs.groupBy(*IMAGE, "row", "height", "width").agg(line.alias("_line"))
        .select(*IMAGE, "row", "height", "width", *[F.flatten(F.col(f"_line.{c}")).alias(c) for c in planes])
    )


def shuffled_control(
    sample: DataFrame, method: str = "block", block: int = DEFAULT_BLOCK, seed: int = 0
) -> DataFrame:
    """A control made from the sample itself."""
    if method not in METHODS:
        raise ValueError(f"the shuffle method must be one of {METHODS}")
    return as_control(shuffle_pixels(sample, seed) if method == "pixel" else shuffle_blocks(sample, block, seed))


def as_control(df: DataFrame) -> DataFrame:
    """Rows of sample images relabelled as those of their shuffled control."""
    return df.withColumn("condition", F.lit("control")).withColumn(
        "image_id", F.concat(F.lit("shuffled_control_"), F.col("image_id"))
    )
