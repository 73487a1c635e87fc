"""Counts and correlations of many grids from one pass."""

import numpy as np
import pytest

from lumipair.operators import correlate, localmap, summed_areas
from lumipair.schema import IMAGE, PAIR, PATCH, channel_pairs


def answers(rho):
    return {(r.image_id, r.ch_x, r.ch_y, r.resolution, r.patch_i, r.patch_j): (r.n, r.rho) for r in rho.collect()}


def same(got, want):
    return got.keys() == want.keys() and all(
        n == want[k][0] and (want[k][1] is None if rho is None else rho == pytest.approx(want[k][1], abs=1e-12)) for k, (n, rho) in got.items()
    )


@pytest.fixture(scope="module")
def scanlines(make_scanlines):
    rng = np.random.default_rng(11)
    values = rng.normal(500, 1, (3, 26, 31))
    values[1] += values[0]
    values[rng.random(values.shape) < 0.5] = 0
    values[2, 13:] = 7.1
    infinite = rng.random((3, 20, 20))
    infinite[0, 4, 4] = np.inf
    return make_scanlines({
        ("sample", "a"): values.tolist(), ("control", "i"): infinite.tolist(), ("control", "s"): rng.random((3, 3, 3)).tolist(),
    }).repartition(4)


def test_every_grid_agrees_with_a_pass_of_its_own(scanlines):
    pairs, grids = channel_pairs([1, 2, 3]), [1, 2, 3, 5]
    got = answers(summed_areas.grid_rho(scanlines, pairs, grids, 4))
    want = {}
    for g in grids:
        one = correlate.pearson(correlate.pair_pixels(scanlines, pairs, g), [*IMAGE, *PAIR, *PATCH])
        want |= {k[:3] + (g,) + k[4:]: v for k, v in answers(one.selectExpr("*", f"{g} as resolution")).items()}
    want = {k: v for k, v in want.items() if k[0] != "s" or k[3] == 1}  # patches too small for the support
    assert got.keys() == want.keys()
    for key, (n, rho) in want.items():
        assert got[key][0] == n, key
        assert got[key][1] == (None if rho is None else pytest.approx(rho, abs=1e-8)), key


def test_tiles_meet_as_the_whole():
    rng = np.random.default_rng(12)
    x, y = rng.random((2, 30, 12)) * (rng.random((2, 30, 12)) < 0.7)
    whole = summed_areas.Tile(np.arange(30), x, y).moments(4, 7, 3)[1]
    parts = np.zeros((4, 4, 2, 10))
    parts[...] = summed_areas._NONE
    for k, rows in enumerate((np.arange(0, 30, 2), np.arange(1, 30, 2))):
        there, found = summed_areas.Tile(rows, x[rows], y[rows]).moments(4, 7, 3)
        parts[there, :, k] = found
    merged = summed_areas.gram.merged(parts.transpose(0, 2, 3, 1).reshape(8, 10, 4), np.arange(4) * 2)
    assert np.allclose(merged[:, :6], whole.transpose(0, 2, 1)[:, :6], atol=1e-9)


def test_one_pass_whatever_the_number_of_grids(scanlines):
    plans = [
        summed_areas.grid_rho(scanlines, [(1, 2)], grids, 15)._jdf.queryExecution().executedPlan().toString()
        for grids in ([2], list(range(1, 40)))
    ]
    for plan in plans:
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("MapInArrow") == 2
    assert summed_areas.grid_rho(scanlines.limit(0), [(1, 2)], [2], 15).isEmpty()


@pytest.mark.parametrize("method", ["spearman", "kendall"])
def test_rank_maps_gather_grids_together(scanlines, method):
    sparse = scanlines.filter("image_id <> 'i'").selectExpr(*IMAGE, "row", "height", "width", "c1", "c2")
    got = answers(localmap.map_rho(sparse, 8, step=2, method=method, min_support=15))
    large = answers(localmap.map_rho(sparse, 8, step=2, method=method, min_support=15, whole_patch=20))
    chosen = {k[0]: k[3] for k in got}
    assert chosen and same(got, large)
    for image, grid in chosen.items():
        one = correlate.patch_rho(sparse.filter(f"image_id = '{image}'"), grid, method=method, min_support=15)
        assert same({k: v for k, v in got.items() if k[0] == image}, answers(one.selectExpr("*", f"{grid} as resolution")))


def test_small_tiles_are_summed_together(make_scanlines, monkeypatch):
    """Many small images: no table of sums for each of them, the same answers as with one for each."""
    rng = np.random.default_rng(13)
    images = {("sample", str(k)): (rng.random((2, 8, 8 + k % 2)) * (rng.random((2, 8, 8 + k % 2)) < 0.9)).tolist() for k in range(60)}
    images[("control", "c")] = [[[5.5] * 8] * 8, rng.random((8, 8)).tolist()]
    images[("control", "d")] = np.zeros((2, 8, 8)).tolist()
    images[("control", "e")] = [[[float("inf"), *[1.0] * 7]] * 8, rng.random((8, 8)).tolist()]
    images[("control", "f")] = [[[None, 3.0, float("nan"), 1.0, 2.0, 7.0, 9.0, 4.0]] * 8, rng.random((8, 8)).tolist()]
    lines = make_scanlines(images).repartition(3)
    want = answers(summed_areas.grid_rho(lines, [(1, 2)], [1, 2, 3], 3).localCheckpoint())
    for limit in (0, 10 ** 6):
        monkeypatch.setattr(summed_areas, "SMALL_TILE", limit)
        assert same(answers(summed_areas.grid_rho(lines, [(1, 2)], [1, 2, 3], 3)), want)
    calls = []
    monkeypatch.setattr(summed_areas, "Tile", lambda *a: calls.append(a))
    pixels = rng.random((2, 160, 8))
    rows, tile = np.tile(np.arange(8), 20), np.repeat(np.arange(20), 8)
    first, found = summed_areas.moments_of_small(*pixels, rows, tile, 2, 4, 4)
    assert first.tolist() == list(range(0, 160, 4)) and found.shape == (40, 2, 10) and not calls
    np.testing.assert_allclose(found[3, 1, 1], pixels[0, 12:16, 4:8].mean())


def test_images_too_small_for_a_grid_are_not_cut_for_it(mixed_sizes, monkeypatch):
    read = []
    plain = localmap.patch_rho
    monkeypatch.setattr(localmap, "patch_rho", lambda lines, *a, **k: read.append({r.image_id for r in lines.collect()}) or plain(lines, *a, **k))
    got = answers(localmap.map_rho(mixed_sizes, 4, step=1))
    assert read == [{"large"}] and {k[0]: k[3] for k in got} == {"large": 4, "small": 2}


@pytest.fixture
def mixed_sizes(make_scanlines):
    rng = np.random.default_rng(14)
    return make_scanlines({("sample", "large"): rng.random((2, 20, 20)).tolist(), ("sample", "small"): rng.random((2, 8, 8)).tolist()})


def test_rows_of_vector_images_are_dealt_once(spark):
    from lumipair.sources import fixtures

    rho = correlate.patch_rho(fixtures.embedding_scanlines(spark, "/root/testdata/sf0.001"), 2)
    rho.collect()
    assert rho._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange") == 1
