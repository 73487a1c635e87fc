"""The full hierarchical posterior against brute-force integrals."""

import math

import numpy as np
import pytest

from lumipair.operators import hierarchy as h
from lumipair.operators.posterior import draw_ids

RHO = "condition string, image_id string, ch_x int, ch_y int, patch_i int, patch_j int, n long, rho double"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(12)
    levels = {"sample": (0.55, 0.45, 0.6), "control": (0.05, -0.05, 0.1)}
    return {
        (condition, f"i{k}"): np.clip(level + 0.15 * rng.standard_t(4, 40), -1, 1)
        for condition, own in levels.items() for k, level in enumerate(own)
    }


@pytest.fixture(scope="module")
def rho(spark, data):
    rows = [(c, i, 1, 2, k // 7 + 1, k % 7 + 1, 99, float(v)) for (c, i), values in data.items() for k, v in enumerate(values)]
    rows += [("sample", "none", 1, 2, 1, 1, 3, None), ("sample", "alone", 1, 3, 1, 1, 99, 0.4)]
    return spark.createDataFrame(rows, RHO)


def phi(x):
    return 0.5 * np.vectorize(math.erfc)(-np.asarray(x, float) / math.sqrt(2))


def brute_means(condition, images):
    """Means of mu, nu, sigma, tau by sums over a dense grid, with dense grids of each image's own parameters inside."""
    m, s, v = np.linspace(-0.995, 0.995, 200), np.geomspace(0.02, 0.98, 60), np.geomspace(0.12, 90, 30)
    t_const = np.array([math.lgamma((x + 1) / 2) - math.lgamma(x / 2) - 0.5 * math.log(x * math.pi) for x in v])
    mu, sigma, tau, nu = np.linspace(-0.97, 0.97, 65), np.geomspace(2e-3, 0.97, 26), np.geomspace(2e-3, 0.97, 16), np.geomspace(0.02, 12, 16)
    edge = lambda x, lo, hi: np.concatenate([[lo], (x[1:] + x[:-1]) / 2, [hi]])
    em, es, ev = edge(m, -1, 1), edge(s, 0, 1), edge(v, 0, 1e9)
    total = 0
    for values in images:
        z = ((values[:, None, None] - m[:, None]) / s) ** 2
        table = np.stack([(t_const[c] - (x + 1) / 2 * np.log1p(z / x) - np.log(s)).sum(axis=0) for c, x in enumerate(v)], axis=2)
        like = np.exp(table - table.max())
        w_nu = np.exp(-ev[:-1, None] / nu) - np.exp(-ev[1:, None] / nu)
        by_nu = like @ w_nu  # (m, s, nu)
        found = np.zeros((len(mu), len(sigma), len(tau), len(nu)))
        for b, sd in enumerate(sigma):
            w_mu = np.diff(phi((em[:, None] - mu) / sd), axis=0) / (phi((1 - mu) / sd) - phi((-1 - mu) / sd))
            w_s = np.diff(phi((es[:, None] - sd) / tau), axis=0) / (phi((1 - sd) / tau) - phi(-sd / tau))
            found[:, b] = np.einsum("mg,msn,st->gtn", w_mu, by_nu, w_s)
        total = total + np.log(np.maximum(found, 1e-300))
    centre = 0.1 if condition == "sample" else 0.0
    prior = (
        -np.log1p((mu / 0.3) ** 2)[:, None, None, None] - np.log1p(((sigma - centre) / 0.3) ** 2)[:, None, None]
        - np.log1p(((tau - 0.1) / 0.3) ** 2)[:, None] - nu
    )
    size = sigma[:, None, None] * tau[:, None] * nu  # of cells even in the logarithm
    w = np.exp(total + prior - (total + prior).max()) * size
    w /= w.sum()
    mean = lambda x, axis: float((w.sum(axis=tuple(i for i in range(4) if i != axis)) * x).sum())
    return mean(mu, 0), mean(nu, 3), mean(sigma, 1), mean(tau, 2)


def test_eight_columns_match_a_brute_force_integral(spark, data, rho):
    draws = h.posterior_draws(rho, draw_ids(spark, 20_000), [(1, 2), (1, 3)], 5).toPandas()
    assert len(draws) == 20_000 and not draws.isna().any().any() and (draws.ch_y == 2).all()
    for condition in ("control", "sample"):
        want = brute_means(condition, [v for (c, _), v in data.items() if c == condition])
        got = [draws[f"{p}_{condition}"].mean() for p in h.PARAMETERS]
        np.testing.assert_allclose(got, want, rtol=0.12, atol=0.02)
        assert abs(got[0] - want[0]) < 0.02


def test_identical_stacks_have_equal_posteriors(spark):
    rng = np.random.default_rng(3)
    values = np.clip(0.3 + 0.05 * rng.standard_normal(256), -1, 1)
    rows = [(c, f"i{k}", 1, 2, j // 16 + 1, j % 16 + 1, 99, float(v)) for c in ("sample", "control") for k in range(5) for j, v in enumerate(values)]
    draws = h.posterior_draws(spark.createDataFrame(rows, RHO), draw_ids(spark, 20_000), [(1, 2)], 1).toPandas()
    delta = draws.mu_sample - draws.mu_control
    assert abs(delta.mean()) < 0.01 and abs(draws.mu_sample.mean() - 0.3) < 0.02
    assert (delta > 0.1).mean() < 0.06


def test_nested_cells_hold_the_same_mass(data):
    values = data["sample", "i0"]
    sums = []
    for nested in (0, 1, 2, 3):
        *edges, table = h.image_table(values, nested)
        size = np.diff(edges[0])[:, None, None] * np.diff(edges[1])[:, None] * np.diff(edges[2])
        sums.append(math.log((np.exp(table - table.max()) * size).sum()) + table.max())
    assert abs(sums[2] - sums[3]) < 0.02 and abs(sums[1] - sums[3]) < 0.1


def test_normal_mass():
    low = np.array([-9.0, -3, -1, 0, 0.5, 2, 6, 8])
    np.testing.assert_allclose(h._normal_mass(low, low + 0.3), [0.5 * (math.erfc(a / 2 ** 0.5) - math.erfc((a + 0.3) / 2 ** 0.5)) for a in low], rtol=2e-5, atol=1e-17)


def test_no_correlations(spark, rho):
    assert h.posterior_draws(rho.limit(0), draw_ids(spark, 10), [(1, 2)]).count() == 0
    assert h.image_levels(rho).count() == 7


def test_picking_draws_gathers_none_of_them(spark):
    """Weights whose sums do not come back when one is taken off: a draw still lies in one interval, and rows are not compared."""
    weights = np.random.default_rng(8).random(3000) ** 6
    weights /= weights.sum()
    rows = [(c, 1, 2, k, float(w), float(k), 1.0, 1.0, 1.0) for c in ("control", "sample") for k, w in enumerate(weights)]
    schema = f"condition string, ch_x int, ch_y int, cell int, w double, {', '.join(f'{p} double' for p in h.PARAMETERS)}"
    found = h.picked(spark.createDataFrame(rows, schema), draw_ids(spark, 20_000), [(1, 2)], 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Deduplicate" not in plan
    draws = found.toPandas()
    assert sorted(draws.draw) == list(range(20_000))
    for side in ("control", "sample"):
        assert abs(draws[f"mu_{side}"].mean() - (weights * np.arange(3000)).sum()) < 30
