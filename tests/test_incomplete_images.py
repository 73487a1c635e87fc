"""Images with absent rows, absent planes and unequal sizes: the same answer or the same error on every path."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lumipair.operators import correlate, localmap, mask, shuffle
from lumipair.plans.analysis import Options, analyse
from lumipair.schema import BANDS, scanlines_schema
from lumipair.shared import new_table_path, remove_written, written
from lumipair.sources.bands import align_channels, shape_violations, stack_from_manifest, to_pixels
from lumipair.sources.manifest import check_manifest, manifest_problems


@pytest.fixture(scope="module")
def incomplete(spark):
    """Image "gap" has no row 0, "short" an absent plane and a short one; "whole" is complete."""
    rows = []
    for name in ("gap", "short", "whole"):
        for r in range(12):
            a = [float((r * 7 + c * 5) % 11) for c in range(12)]
            b = [float((r * 3 + c * c) % 13) for c in range(12)]
            if name == "short" and r == 3:
                a = None
            if name == "short" and r == 4:
                b = b[:8]
            if not (name == "gap" and r == 0):
                rows.append(("sample", name, r, 12, 12, a, b))
    return spark.createDataFrame(rows, scanlines_schema([1, 2]))


def answers(rho):
    return {(r.image_id, r.patch_i, r.patch_j): (r.n, None if r.rho is None else round(r.rho, 9)) for r in rho.collect()}


@pytest.mark.parametrize("method", ["spearman", "kendall"])
def test_rank_methods_agree_on_incomplete_images(incomplete, method):
    small = answers(correlate.patch_rho(incomplete, 2, method=method))
    large = answers(correlate.patch_rho(incomplete, 2, method=method, whole_patch=5))
    assert small == large and len(small) == 12
    pearson = answers(correlate.patch_rho(incomplete, 2))
    assert {k: n for k, (n, _) in small.items()} == {k: n for k, (n, _) in pearson.items()}


def test_pixel_shuffles_agree_on_incomplete_images(incomplete):
    whole = to_pixels(shuffle.shuffle_pixels(incomplete, 3)).collect()
    sliced = to_pixels(shuffle.shuffle_pixels(incomplete, 3, slice_rows=20, whole_image=0)).collect()
    assert sorted(whole) == sorted(sliced)
    before, after = (df.groupBy("image_id", "channel").agg(F.sort_array(F.collect_list("value")).alias("v")).collect() for df in (to_pixels(incomplete), to_pixels(shuffle.shuffle_pixels(incomplete, 3))))
    assert sorted(before) == sorted(after)


def test_block_shuffle_keeps_images_without_first_row(incomplete):
    moved = shuffle.shuffle_blocks(incomplete.filter("image_id <> 'short'"), 4, 3)
    assert {r.image_id for r in moved.select("image_id").distinct().collect()} == {"gap", "whole"}
    assert to_pixels(moved).count() == to_pixels(incomplete.filter("image_id <> 'short'")).count()


def test_image_without_values_is_kept_and_reported(spark):
    rows = [("sample", name, r, 8, 8, [v] * 8, [v] * 8) for name in ("blank", "ok") for r in range(8) for v in [None if name == "blank" else float(r)]]
    scanlines = spark.createDataFrame(rows, scanlines_schema([1, 2]))
    masked = mask.mask_otsu(scanlines)
    assert masked.select("image_id").distinct().count() == 2
    dropped = correlate.dropped_images(masked, correlate.patch_rho(masked, 1)).collect()
    assert [(r.image_id, r.reason) for r in dropped] == [("blank", "no_usable_patch")]
    mapped = localmap.map_rho(masked, 4, step=2)
    assert {r.image_id for r in correlate.dropped_images(masked, mapped).collect()} == {"blank"}
    assert mask.mask_pixels(scanlines, mask.otsu_thresholds(scanlines)).filter("image_id = 'blank' and mask").count() == 0


def test_unequal_channels_and_incomplete_images_are_refused(spark, incomplete):
    bands = spark.createDataFrame([("sample", "a", c, r, 2 + c, 2, [1.0, 2.0]) for c in (1, 2) for r in range(2)], BANDS)
    with pytest.raises(PySparkException, match="differ in size"):
        align_channels(bands, [1, 2]).collect()
    assert {r.image_id for r in shape_violations(incomplete).collect()} == {"gap", "short"}
    with pytest.raises(ValueError, match="not a full matrix"):
        analyse(incomplete, options=Options(patches=2, shuffle=True))


def test_surplus_and_unknown_files(spark):
    def files(*names):
        return spark.createDataFrame([(n,) for n in names], "name string")

    found = {(r.image_id, r.channel, r.name, r.problem) for r in manifest_problems(files("a_c1", "a_x_c1.tif", "a_c2.tif", "b_c9.tif", "a_c2.b.tif", "foo.tif"), 2).collect()}
    assert ("b", 9, "b_c9.tif", "unknown_channel") in found and ("foo.tif", None, "foo.tif", "unknown_channel") in found
    assert ("b", 1, None, "missing_channel") in found and ("a_x", 2, None, "missing_channel") in found
    assert [f for f in found if f[3] == "surplus_file"] == [("a", 2, "a_c2.tif", "surplus_file")]
    for names in (["a_c1.t", "a_c2.t", "foo.tif", "bar_x.tif"], ["a_c1.t", "a_c2.t", "b_c3.t", "b_c4.t"]):
        with pytest.raises(ValueError, match="belongs to no channel|has no file"):
            check_manifest(files(*names), 2)


def test_stack_from_manifest(spark):
    files = spark.createDataFrame([("x_c1.t", "/d/x_c1.t"), ("x_c2.t", "/d/x_c2.t")], "name string, path string")
    bands = spark.createDataFrame([(f"/d/x_c{c}.t", r, 2, 2, [float(c), float(r)]) for c in (1, 2) for r in (0, 1)], "path string, row int, height int, width int, values array<double>")
    got = stack_from_manifest(bands, files, 2, "sample").orderBy("row").collect()
    assert [(r.image_id, r.row, r.c1, r.c2) for r in got] == [("x", 0, [1.0, 0.0], [2.0, 0.0]), ("x", 1, [1.0, 1.0], [2.0, 1.0])]


def test_mosaic_comes_from_raw_pixels(spark):
    rows = [("control" if i % 2 else "sample", f"i{i}", r, 12, 12, *[[float((r * 5 + c * k + i) % 9 - 8) for c in range(12)] for k in (1, 2)]) for i in range(4) for r in range(12)]
    scanlines = spark.createDataFrame(rows, scanlines_schema([1, 2]))
    sample, control = (scanlines.filter(F.col("condition") == c) for c in ("sample", "control"))
    result = analyse(sample, control, Options(patches=2, draws=50))
    want = mask.mask_mosaic(scanlines, mask.otsu_thresholds(scanlines)).filter("mask").count()
    assert result.mask_mosaic().filter("mask").count() == want


def test_written_tables_are_removed(spark, tmp_path):
    own = spark.newSession()
    path = written(own.range(3), "test").inputFiles()[0]
    assert path.startswith("file:")
    assert new_table_path(own, "x").startswith(own.conf.get("spark.checkpoint.dir"))
    assert callable(remove_written)
