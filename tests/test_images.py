import math

import numpy as np
import pytest

from lumipair.operators import images, mask, patches
from lumipair.sources.bands import to_pixels


def test_minmax_with_constant_and_nan(make_scanlines, planes_of):
    scanlines = make_scanlines({("sample", "a"): [[[2, 4], [6, None]], [[3, 3], [3, 3]], [[math.nan, 1], [2, 3]]]})
    plane = planes_of(images.minmax_normalise(scanlines))[("sample", "a")]
    np.testing.assert_allclose(plane[0], [[0, 0.5], [1, np.nan]])
    assert np.isnan(plane[1]).all()
    np.testing.assert_allclose(plane[2], [[np.nan, 0], [0.5, 1]])


def test_composites(make_scanlines):
    scanlines = make_scanlines({("sample", "a"): [[[0, 1]], [[2, 4]], [[9, None]]]})
    three = images.composite(scanlines, [1, 2, 3], scale=False).orderBy("col").collect()
    assert [(r.red, r.green, r.blue) for r in three] == [(9.0, 2.0, 0.0), (0.0, 4.0, 1.0)]
    two = images.composite(scanlines, [1, 2], scale=False).orderBy("col").collect()
    assert [(r.red, r.green, r.blue) for r in two] == [(2.0, 0.0, 0.0), (4.0, 1.0, 0.0)]
    one = images.composite(scanlines, [2]).orderBy("col").collect()
    assert [(r.red, r.green, r.blue) for r in one] == [(0.0, 0.0, 0.0), (1.0, 1.0, 1.0)]
    with pytest.raises(ValueError):
        images.composite(scanlines, [1, 2, 3, 1])
    with pytest.raises(ValueError):
        images.composite(scanlines, [7])


def thresholds(spark, value):
    return spark.createDataFrame(
        [("sample", "a", c, value) for c in (1, 2, 3)], "condition string, image_id string, channel int, otsu_threshold double"
    )


@pytest.mark.parametrize("threshold, expected", [(2.5, 0.0), (0.5, 1.0)])
def test_mask_all_or_nothing(spark, make_scanlines, planes_of, threshold, expected):
    scanlines = make_scanlines({("sample", "a"): [[[1.0] * 128] * 128] * 3})
    found = thresholds(spark, threshold)
    plane = planes_of(mask.apply_mask(scanlines, found))[("sample", "a")]
    assert plane.shape == (3, 128, 128) and (plane == expected).all()
    shown = mask.mask_pixels(scanlines, found)
    assert shown.count() == 3 * 128 * 128 and shown.filter("mask").count() == 3 * 128 * 128 * expected


def test_mask_keeps_missing_values(spark, make_scanlines, planes_of):
    scanlines = make_scanlines({("sample", "a"): [[[1, None, math.nan, 3]]] * 3})
    found = thresholds(spark, 1.0)
    rows = mask.apply_mask(scanlines, found).collect()
    assert rows[0].c1[0] == 0.0 and rows[0].c1[1] is None and math.isnan(rows[0].c1[2]) and rows[0].c1[3] == 3.0
    shown = mask.mask_pixels(scanlines, found).filter("channel = 1").orderBy("col").collect()
    assert [r.mask for r in shown] == [False, False, False, True]
    mosaic = mask.mask_mosaic(scanlines, found).filter("mask").orderBy("mosaic_col").collect()
    assert [r.mosaic_col for r in mosaic] == [3, 7, 11]


def brute_otsu(values):
    lo, hi = values.min(), values.max()
    if lo == hi:
        return lo
    bins = np.minimum(np.floor((values - lo) / (hi - lo) * 256), 255).astype(int)
    best, chosen = -1.0, 0
    for k in range(255):
        low, high = bins[bins <= k], bins[bins > k]
        if len(low) and len(high):
            between = len(low) * len(high) * (low.mean() - high.mean()) ** 2
            if between > best * (1 + 1e-12):
                best, chosen = between, k
    return lo + (chosen + 1) * (hi - lo) / 256


def test_otsu_against_brute_force(make_scanlines, rng):
    bimodal = np.where(rng.random((24, 20)) < 0.6, rng.normal(10, 2, (24, 20)), rng.normal(50, 6, (24, 20)))
    flat = np.full((24, 20), 7.0)
    ints = rng.integers(0, 255, (24, 20)).astype(float)
    scanlines = make_scanlines({("sample", "a"): [bimodal.tolist(), flat.tolist(), ints.tolist()]})
    found = {r.channel: r.otsu_threshold for r in mask.otsu_thresholds(scanlines).collect()}
    for channel, plane in ((1, bimodal), (2, flat), (3, ints)):
        assert found[channel] == pytest.approx(brute_otsu(plane.ravel()), rel=1e-12)
    assert 15 < found[1] < 45
    masked = to_pixels(mask.mask_otsu(scanlines)).filter("channel = 2 and value <> 0")
    assert masked.isEmpty()


def test_patch_matches_slices_and_unpatch(make_scanlines, rng):
    plane = rng.random((100, 100))
    scanlines = make_scanlines({("sample", "a"): [plane.tolist()]})
    cut = patches.patch_pixels(scanlines, 10)
    pdf = cut.toPandas()
    for (i, j), part in pdf.groupby(["patch_i", "patch_j"]):
        part = part.sort_values(["px", "py"])["value"].to_numpy().reshape(10, 10)
        assert (part == plane[(i - 1) * 10:i * 10, (j - 1) * 10:j * 10]).all()
    back = patches.unpatch(cut).toPandas()
    rebuilt = np.zeros((100, 100))
    rebuilt[back["row"], back["col"]] = back["value"]
    assert (rebuilt == plane).all()


def test_patch_trims_and_small_images(make_scanlines):
    scanlines = make_scanlines({("sample", "a"): [[[1, 2, 3, 4, 5, 6, 7]] * 5]})
    counts = patches.patch_sizes(scanlines, 2, 3).collect()
    assert len(counts) == 6 and all(r.n_pixels == 4 for r in counts)
    assert patches.patch_sizes(scanlines, 6).isEmpty()
    with pytest.raises(ValueError):
        patches.patch_sizes(scanlines, 0)


def test_patch_lines(make_scanlines):
    scanlines = make_scanlines({("sample", "a"): [[[1] * 9] * 8]})
    lines = images.patch_lines(images.dimensions(scanlines), 4).orderBy("line").collect()
    assert [(r.y, r.x) for r in lines] == [(0, 0), (2, 2), (4, 4), (6, 6), (8, 8)]
