import numpy as np
import pytest

from lumipair.operators import localmap, shuffle


@pytest.mark.parametrize("whole_image", [10**6, 10])
def test_pixel_shuffle_keeps_values_per_channel(make_scanlines, planes_of, rng, whole_image):
    planes = rng.permutation(2 * 9 * 7).reshape(2, 9, 7).astype(float)
    scanlines = make_scanlines({("sample", "a"): planes.tolist()})
    moved = planes_of(shuffle.shuffle_pixels(scanlines, 3, 7, whole_image))[("sample", "a")]
    assert moved.shape == planes.shape and (moved != planes).any()
    for c in range(2):
        assert sorted(moved[c].ravel()) == sorted(planes[c].ravel())
    where = [np.argsort(moved[c].ravel()) for c in range(2)], [np.argsort(planes[c].ravel()) for c in range(2)]
    assert (where[0][0][np.argsort(where[1][0])] != where[0][1][np.argsort(where[1][1])]).any()


def test_slices_do_not_change_the_order(make_scanlines, planes_of, rng):
    scanlines = make_scanlines({("sample", "a"): rng.random((2, 12, 11)).tolist()})
    whole, one_slice, sliced = (
        planes_of(shuffle.shuffle_pixels(scanlines, 1, n, limit))[("sample", "a")]
        for n, limit in ((5, 10**6), (10**6, 10), (5, 10))
    )
    assert (whole == sliced).all() and (whole == one_slice).all()
    whole, sliced = (planes_of(shuffle.shuffle_blocks(scanlines, 3, 1, n))[("sample", "a")] for n in (10**6, 2))
    assert (whole == sliced).all()


@pytest.mark.parametrize("block", [1, 3, 4, 9, 20])
def test_block_shuffle_moves_whole_blocks_of_all_channels(make_scanlines, planes_of, rng, block):
    first = rng.permutation(10 * 13).reshape(10, 13).astype(float)
    scanlines = make_scanlines({("sample", "a"): [first.tolist(), (first + 1000).tolist()]})
    moved = planes_of(shuffle.shuffle_blocks(scanlines, block, 5))[("sample", "a")]
    assert sorted(moved[0].ravel()) == sorted(first.ravel())
    assert (moved[1] == moved[0] + 1000).all()
    blocks = {
        tuple(first[i:i + block, j:j + block].ravel()): first[i:i + block, j:j + block].shape
        for i in range(0, 10, block) for j in range(0, 13, block)
    }
    for i in range(0, 10, block):
        for j in range(0, 13, block):
            part = moved[0][i:i + block, j:j + block]
            assert blocks[tuple(part.ravel())] == part.shape


def test_missing_values_move_too_and_sizes_mix(make_scanlines, planes_of, rng):
    small, big = rng.random((4, 5)).tolist(), rng.random((9, 8)).tolist()
    small[1][2] = None
    scanlines = make_scanlines({("sample", "small"): [small], ("sample", "big"): [big]})
    mixed = planes_of(shuffle.shuffle_pixels(scanlines, 1, 5, 30))
    whole = planes_of(shuffle.shuffle_pixels(scanlines, 1))
    assert np.isnan(whole[("sample", "small")]).sum() == 1
    for k in whole:
        np.testing.assert_array_equal(mixed[k], whole[k])


def test_keys_are_a_permutation():
    x = np.arange(200_000, dtype=np.int64)
    keys = shuffle._fifth_power((shuffle._fifth_power((x + 12345) % shuffle.PRIME) + 678) % shuffle.PRIME)
    assert len(np.unique(keys)) == len(x) and abs(np.corrcoef(x, keys)[0, 1]) < 0.01
    assert abs(np.corrcoef(keys[1:], keys[:-1])[0, 1]) < 0.01


def test_shuffled_control_labels(make_scanlines):
    scanlines = make_scanlines({("sample", "a"): [[[1, 2], [3, 4]]] * 2})
    for method in shuffle.METHODS:
        control = shuffle.shuffled_control(scanlines, method)
        assert {(r.condition, r.image_id) for r in control.collect()} == {("control", "shuffled_control_a")}
    with pytest.raises(ValueError):
        shuffle.shuffled_control(scanlines, "rows")
    with pytest.raises(ValueError):
        shuffle.shuffle_blocks(scanlines, 0)


@pytest.fixture
def mixed(make_scanlines, rng):
    fine = rng.random((2, 60, 60)) + 1
    sparse = np.zeros((2, 60, 60))
    sparse[:, ::3, ::3] = fine[:, ::3, ::3]
    return make_scanlines({
        ("sample", "fine"): fine.tolist(), ("sample", "sparse"): sparse.tolist(),
        ("sample", "dark"): np.zeros((2, 60, 60)).tolist(), ("sample", "tiny"): (fine[:, :9, :9]).tolist(),
    })


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_map_falls_back_to_the_finest_usable_grid(mixed, method):
    rho = localmap.map_rho(mixed, 12, step=2, method=method).toPandas()
    chosen = {k: set(v) for k, v in rho.groupby("image_id")["resolution"]}
    # Every third row and column has a signal: a patch of 10 x 10 pixels that starts on one has 16 usable pixels.
    assert chosen == {"fine": {12}, "sparse": {6}, "tiny": {2}}
    assert rho.groupby("image_id").size().to_dict() == {"fine": 144, "sparse": 36, "tiny": 4}
    usable = rho[rho["rho"].notna()].groupby("image_id").size().to_dict()
    assert usable == {"fine": 144, "sparse": 4, "tiny": 4}


def test_images_that_a_map_drops_are_listed(mixed):
    dropped = localmap.dropped_from_map(mixed, 12, step=2).collect()
    assert [(r.image_id, r.ch_x, r.ch_y, r.reason) for r in dropped] == [("dark", 1, 2, "no_patch")]
    dropped = localmap.dropped_from_map(mixed, 6, step=10).collect()
    assert {(r.image_id, r.reason) for r in dropped} >= {("dark", "no_usable_patch")}


def test_map_without_coarser_grids_keeps_missing_values(mixed):
    shown = localmap.local_map(mixed, 6, step=10).toPandas()
    assert set(shown["image_id"]) == {"fine", "sparse", "dark", "tiny"}
    dark = shown[shown["image_id"] == "dark"]
    assert len(dark) == 36 and (dark["rho"] == localmap.MISSING).all()
    corner = shown[(shown["image_id"] == "fine") & (shown["patch_i"] == 1) & (shown["patch_j"] == 6)].iloc[0]
    assert (corner["x"], corner["y"]) == (60, 60)


def test_sliced_shuffle_moves_runs_of_rows_and_bounds_its_batches(make_scanlines, planes_of, rng, monkeypatch):
    planes = rng.integers(0, 99, (2, 9, 13)).astype(float).tolist()
    planes[1][4][7] = None
    scanlines = make_scanlines({("sample", "a"): planes, ("control", "b"): planes})
    whole = planes_of(shuffle.shuffle_pixels(scanlines, 3))
    monkeypatch.setattr(shuffle, "BATCH_PIXELS", 20)
    sliced = shuffle.shuffle_pixels(scanlines, 3, 10, 0)
    assert "_run" in sliced._jdf.queryExecution().optimizedPlan().toString()
    found = planes_of(sliced)
    assert found.keys() == whole.keys() and all(np.array_equal(found[k], whole[k], equal_nan=True) for k in whole)
