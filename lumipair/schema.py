"""Table layouts shared by all operators.

Pixels have three layouts:

* **bands**: one row per (image, channel, image row). This is how images arrive, one file per channel.
* **scanlines**: one row per (image, image row) with every channel next to the others in columns ``c1 .. cN``. All
  analysis reads this layout: channels of a pixel are already together, unused channels are pruned by the Parquet
  reader, and no operator has to join pixels again.
  A stored scanline may also carry the smallest and largest value of each channel in this row (``lo_c1``, ``hi_c1``);
  then the value range of an image is found without reading any pixel.
* **pixels**: one row per pixel, only ever produced inside a plan or for small outputs.

Every row carries its image's ``height`` and ``width``, so patch coordinates never need a lookup.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

IMAGE = ["condition", "image_id"]
PAIR = ["ch_x", "ch_y"]
PATCH = ["patch_i", "patch_j"]
CONDITIONS = ("control", "sample")

BANDS = T.StructType([
    T.StructField("condition", T.StringType()),
    T.StructField("image_id", T.StringType()),
    T.StructField("channel", T.IntegerType()),
    T.StructField("row", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("values", T.ArrayType(T.DoubleType())),
])

GLOBAL_PARAMETERS = [
    "mu_control", "nu_control", "sigma_control", "tau_control",
    "mu_sample", "nu_sample", "sigma_sample", "tau_sample",
]

_CHANNEL_COLUMN = re.compile(r"c([1-9]\d*)$")


def scanlines_schema(channels: list[int], ranges: bool = False) -> T.StructType:
    fields = [f for f in BANDS.fields if f.name not in ("channel", "values")]
    fields += [T.StructField(f"c{c}", T.ArrayType(T.DoubleType())) for c in channels]
    if ranges:
        fields += [T.StructField(f"{side}_c{c}", T.DoubleType()) for c in channels for side in ("lo", "hi")]
    return T.StructType(fields)


def channels_of(scanlines: DataFrame) -> list[int]:
    """Channel numbers of a scanline table, in ascending order."""
    found = [_CHANNEL_COLUMN.match(name) for name in scanlines.columns]
    return sorted(int(m.group(1)) for m in found if m)


def plain_columns(scanlines: DataFrame) -> list[str]:
    """The columns of a scanline table without the optional row ranges."""
    return [*IMAGE, "row", "height", "width", *[f"c{c}" for c in channels_of(scanlines)]]


def channel_pairs(channels: list[int]) -> list[tuple[int, int]]:
    """All pairs x < y of the given channels."""
    ordered = sorted(channels)
    return [(x, y) for i, x in enumerate(ordered) for y in ordered[i + 1:]]


def require_columns(df: DataFrame, columns: list[str], what: str) -> None:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"{what} lacks the columns {absent}")
