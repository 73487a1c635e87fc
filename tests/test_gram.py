"""Pearson correlations of all pairs from masked Gram products."""

import numpy as np
import pytest

from lumipair.operators import correlate, gram
from lumipair.schema import IMAGE, PAIR, PATCH, channel_pairs


def answers(rho):
    return {(r.image_id, r.ch_x, r.ch_y, r.patch_i, r.patch_j): (r.n, r.rho) for r in rho.collect()}


@pytest.fixture(scope="module")
def planes():
    rng = np.random.default_rng(5)
    values = rng.normal(1e6, 1, (5, 24, 30))
    values[1] = values[0] + rng.normal(0, 0.1, (24, 30))
    values[rng.random(values.shape) < 0.3] = 0
    values[2, rng.random((24, 30)) < 0.2] = np.nan
    values[3, :12] = 7.1  # constant in the upper half
    values[4, 3, 5] = np.inf
    return values


@pytest.fixture(scope="module")
def scanlines(make_scanlines, planes):
    other = np.random.default_rng(6).random((5, 9, 8))
    listed = [[[None if np.isnan(v) else v for v in line] for line in p] for p in planes.tolist()]
    return make_scanlines({("sample", "a"): listed, ("control", "b"): other.tolist()}).repartition(5)


def test_agrees_with_pixels_and_aggregates(scanlines, planes):
    pairs = channel_pairs([1, 2, 3, 4, 5])
    got = answers(correlate.patch_rho(scanlines, 2, 3, min_support=3))
    pixels = correlate.pearson(correlate.pair_pixels(scanlines, pairs, 2, 3), [*IMAGE, *PAIR, *PATCH])
    plain = answers(pixels)
    assert got.keys() == plain.keys() and len(got) == 2 * 10 * 6
    for key, (n, rho) in got.items():
        assert n == plain[key][0]
        assert rho == pytest.approx(plain[key][1], abs=1e-6) if rho is not None else plain[key][1] is None, key
    for x, y in pairs:
        for i in range(2):
            for j in range(3):
                a, b = (planes[c - 1, 12 * i:12 * i + 12, 10 * j:10 * j + 10].ravel() for c in (x, y))
                both = ~np.isnan(a) & ~np.isnan(b) & (a != 0) & (b != 0)
                n, rho = got["a", x, y, i + 1, j + 1]
                assert n == both.sum()
                a, b = a[both], b[both]
                if np.isfinite(a.sum() + b.sum()) and np.ptp(a) > 0 and np.ptp(b) > 0:
                    assert rho == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-9)
                else:
                    assert rho is None


def test_merging_parts_equals_the_whole():
    rng = np.random.default_rng(7)
    values = rng.normal(100, 1, (3, 12, 10)) * (rng.random((3, 12, 10)) < 0.8)
    values[2] = 4.3
    x, y = np.array([0, 0, 1]), np.array([1, 2, 2])
    whole = gram.run_moments(values, 2, x, y)
    parts = [gram.run_moments(values[:, a:b], 2, x, y) for a, b in ((0, 1), (1, 5), (5, 12))]
    together = gram.merged(np.stack(parts, 1).reshape(6, 10, 3), np.array([0, 3]))
    assert np.allclose(together[:, :gram.LOX], whole[:, :gram.LOX], atol=1e-9)
    assert np.allclose(gram.correlations(together), gram.correlations(whole), atol=1e-12, equal_nan=True)
    assert np.isnan(gram.correlations(together)[:, 1:]).all()


def test_short_and_absent_planes(scanlines):
    short = scanlines.selectExpr(*IMAGE, "row", "height", "width", "slice(c1, 1, 12) as c1", "if(row < 3, null, c2) as c2", "cast(null as array<double>) as c3")
    got = answers(correlate.patch_rho(short, 2, 3, min_support=3))
    want = answers(correlate.patch_rho(short, 2, 3, method="spearman", min_support=3))
    assert {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in want.items()}
    assert correlate.patch_rho(scanlines.limit(0), 2).isEmpty()
    assert answers(correlate.patch_rho(scanlines.filter("image_id = 'b'"), 10)) == {}


def test_pixels_are_read_once_and_patches_shuffled(scanlines):
    plan = correlate.patch_rho(scanlines, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate posexplode" not in plan
    one = correlate.patch_rho(scanlines, 2, pairs=[(1, 2)])._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in one
