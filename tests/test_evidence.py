import math

import numpy as np
import pytest

from lumipair import shared
from lumipair.functions import columns, ranking
from lumipair.functions.ranking import ordinals, quantiles, unpivot, value_ranks
from lumipair.operators import evidence, posterior, tails
from pyspark.sql import functions as F

SUMMARY = "condition string, image_id string, ch_x int, ch_y int, n_patches long, mean_rho double, sd_rho double"


def summaries(spark, control, sample, n=256, sd=0.3):
    rows = [("control", f"c{i}", 1, 2, n, m, sd) for i, m in enumerate(control)]
    rows += [("sample", f"s{i}", 1, 2, n, m, sd) for i, m in enumerate(sample)]
    return spark.createDataFrame(rows, SUMMARY)


def test_ordinals_and_ranks_split_a_hot_group(spark, rng):
    values = rng.integers(0, 50, 2000).tolist()
    rows = [("hot" if i % 10 else "cold", v, i) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(5)
    placed = ordinals(df, ["k"], ["v", "i"]).toPandas()
    assert placed["ordinal"].is_unique is False and len(placed) == 2000
    for key, part in placed.groupby("k"):
        part = part.sort_values(["v", "i"])
        assert part["ordinal"].tolist() == list(range(len(part))) and set(part["group_rows"]) == {len(part)}
    ranks = value_ranks(df, ["k"], "v").toPandas()
    for key, part in ranks.groupby("k"):
        own = np.array([v for k, v, _ in rows if k == key])
        for r in part.itertuples():
            assert (r.before, r.ties, r.group_rows) == ((own < r.v).sum(), (own == r.v).sum(), len(own))


def test_slices_that_are_sorted_at_once_do_not_grow_with_the_rows(spark, monkeypatch):
    found, plain = [], ranking.written
    monkeypatch.setattr(ranking, "written", lambda df, label: found.append(plain(df, label)) or found[-1])
    df = spark.range(1_200_000).select((F.col("id") % 2).alias("k"), F.xxhash64("id").alias("v"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        ranking.ordinals(df, ["k"], ["v"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    slices = found[0].groupBy(F.shiftright("_place", 33).alias("slice")).count().toPandas()
    assert slices["count"].sum() == 1_200_000 and slices["count"].max() < 400_000


def test_a_shuffle_to_slices_holds_no_rows_while_slices_are_of_moderate_size(spark):
    assert [ranking.sorting_slices(spark.range(n)) for n in (10_000_000, 60_000_000, 1_000_000_000)] == [40, 200, 500]


def test_both_quantile_paths_agree(spark, rng):
    rows = [("a" if i % 3 else "b", float(v), float(w)) for i, (v, w) in enumerate(rng.normal(size=(500, 2)).round(1))]
    df = unpivot(spark.createDataFrame(rows, "k string, v double, w double"), ["k"], ["v", "w"])
    wanted = [0.025, 0.25, 0.5, 0.975]
    built_in, distributed = (
        {(r.k, r.name): list(r["quantiles"]) for r in quantiles(df, ["k", "name"], wanted, n).collect()}
        for n in (500, None)
    )
    assert built_in.keys() == distributed.keys() and len(built_in) == 4
    for k in built_in:
        assert distributed[k] == pytest.approx(built_in[k], abs=1e-12)


def test_lookup_join_without_broadcast_gives_the_same(spark, monkeypatch):
    big = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    small = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    want = sorted(shared.lookup_join(big, small, ["k"]).collect())
    assert "BroadcastHashJoin" in shared.lookup_join(big, small, ["k"])._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 200)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = shared.lookup_join(big, small, ["k"])
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
        assert sorted(joined.collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shared_folder_is_the_configured_one(spark):
    assert shared.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_normal_cdf_and_division(spark):
    zs = [-6.0, -2.0, -0.5, 0.0, 0.7, 3.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double").select("z", columns.normal_cdf(F.col("z")).alias("p"))
    for r in df.collect():
        assert r.p == pytest.approx(0.5 * math.erfc(-r.z / math.sqrt(2)), abs=2e-7)
    cases = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 4.0), (None, 0.0), (math.inf, 2.0)]
    found = [
        r.q for r in spark.createDataFrame(cases, "a double, b double")
        .select(columns.ieee_divide(F.col("a"), F.col("b")).alias("q")).collect()
    ]
    assert found[:2] == [math.inf, -math.inf] and math.isnan(found[2]) and found[3:] == [0.25, None, math.inf]


def test_prior_draws_follow_their_distributions(spark):
    draws = posterior.prior_draws(posterior.draw_ids(spark, 20_000), 3).toPandas()
    again = posterior.prior_draws(posterior.draw_ids(spark, 20_000).repartition(7), 3).toPandas()
    assert draws.sort_values("draw").reset_index(drop=True).equals(again.sort_values("draw").reset_index(drop=True))
    for side in ("control", "sample"):
        assert draws[f"mu_{side}"].between(-1, 1).all() and abs(draws[f"mu_{side}"].median()) < 0.02
        assert draws[f"sigma_{side}"].between(1e-4, 1).all() and draws[f"tau_{side}"].between(1e-4, 1).all()
        assert draws[f"nu_{side}"].mean() == pytest.approx(1.0, abs=0.03)
        quarter = 0.3 * math.tan(0.5 * math.atan(1 / 0.3))
        assert draws[f"mu_{side}"].quantile(0.75) == pytest.approx(quarter, abs=0.02)
    assert abs(np.corrcoef(draws["mu_control"], draws["mu_sample"])[0, 1]) < 0.03
    assert abs(np.corrcoef(draws["mu_control"], draws["sigma_control"])[0, 1]) < 0.03


def brute_marginal(means, n, sd, centre):
    mu = -1 + 0.01 * np.arange(201)[:, None]
    sigma = np.array(posterior.sigma_values())[None, :]
    log_w = -np.log1p((mu / 0.3) ** 2) - np.log1p(((sigma - centre) / 0.3) ** 2) + np.log(sigma)
    se = max(sd / math.sqrt(n), 1e-3)
    for m in means:
        v = sigma**2 + se**2
        log_w = log_w - 0.5 * np.log(v) - 0.5 * (m - mu) ** 2 / v
    w = np.exp(log_w - log_w.max())
    return (w / w.sum()).sum(axis=1)


def test_posterior_grid_against_numpy(spark):
    control, sample = [0.1, 0.12, 0.05], [0.4, 0.55, 0.47, 0.5]
    grid = posterior.posterior_grid(summaries(spark, control, sample))
    assert grid.count() == 2 * 201 * 60
    found = posterior.mu_marginal(grid).toPandas()
    for condition, means, centre in (("control", control, 0.0), ("sample", sample, 0.1)):
        part = found[found["condition"] == condition].sort_values("mu_idx")["w"].to_numpy()
        np.testing.assert_allclose(part, brute_marginal(means, 256, 0.3, centre), atol=1e-10)


def test_posterior_draws_follow_the_grid(spark):
    grid = posterior.posterior_grid(summaries(spark, [0.1, 0.12], [0.4, 0.55])).cache()
    draws = posterior.posterior_draws(grid, posterior.draw_ids(spark, 20_000), [(1, 2), (1, 3)], 1).toPandas()
    assert len(draws) == 20_000 and draws["nu_sample"].isna().all()
    mean = posterior.mu_marginal(grid).groupBy("condition").agg(F.sum(F.col("w") * posterior.mu_at(F.col("mu_idx"))).alias("m"))
    for r in mean.collect():
        assert draws[f"mu_{r.condition}"].mean() == pytest.approx(r.m, abs=0.01)
    assert abs(np.corrcoef(draws["mu_control"], draws["mu_sample"])[0, 1]) < 0.03


def test_identical_and_separated_conditions(spark):
    same = posterior.posterior_grid(summaries(spark, [0.4] * 5, [0.4] * 5))
    assert evidence.grid_bayes_factors(same, [0.1]).collect()[0].bf == pytest.approx(0.0, abs=0.001)
    apart = posterior.posterior_grid(summaries(spark, [0.1] * 3, [0.6] * 3))
    assert evidence.grid_bayes_factors(apart, [0.0]).collect()[0].bf > 100
    lone = posterior.posterior_grid(summaries(spark, [0.1], [0.6]))
    assert evidence.grid_bayes_factors(lone, [0.0]).collect()[0].bf > 1
    shared_link = posterior.posterior_grid(summaries(spark, [0.1] * 3, [0.6] * 3), "shared")
    assert evidence.grid_bayes_factors(shared_link, [0.0]).collect()[0].bf > 10
    with pytest.raises(ValueError):
        posterior.posterior_grid(summaries(spark, [0.1], [0.6]), "loose")


def test_tails_fall_and_complement(spark):
    grid = posterior.posterior_grid(summaries(spark, [0.1] * 3, [0.3] * 3))
    spread = evidence.delta_distribution(evidence.both_marginals(grid))
    total = spread.groupBy("kind").agg(F.sum("p").alias("p")).collect()
    assert all(r.p == pytest.approx(1.0) for r in total)
    tail = evidence.grid_tail(spread, evidence.thresholds_between(-0.8, 0.8, 0.1)).toPandas()
    for _, part in tail.groupby("kind"):
        p = part.sort_values("rho_threshold")["p_above"].to_numpy()
        assert (np.diff(p) <= 1e-12).all()
    np.testing.assert_allclose(tail["p_above"] + tail["p_below"], 1.0)
    prior = evidence.grid_tail(spread, [0.0]).filter("kind = 'prior'").collect()[0].p_above
    half = evidence.grid_tail(spread, [0.0], tie_weight=0.5).filter("kind = 'prior'").collect()[0].p_above
    assert prior == pytest.approx(0.496, abs=5e-4) and half == pytest.approx(0.5)


def samples(spark, posterior_delta, prior_delta):
    rows = [("posterior", 1, 2, i, 0.0, float(d)) for i, d in enumerate(posterior_delta)]
    rows += [("prior", 1, 2, i, 0.0, float(d)) for i, d in enumerate(prior_delta)]
    return spark.createDataFrame(rows, "kind string, ch_x int, ch_y int, draw long, mu_control double, mu_sample double")


def test_draw_based_bayes_factor_and_curve(spark, rng):
    post, prior = rng.normal(0.3, 0.05, 800), rng.normal(0, 0.4, 800)
    drawn = samples(spark, post, prior)
    row = evidence.draw_bayes_factors(drawn, [0.25], 800).collect()[0]

    def tail(v, t):
        q25, q75 = np.quantile(v, [0.25, 0.75])
        h = 0.9 * min(v.std(ddof=1), (q75 - q25) / 1.34) * len(v) ** -0.2
        return np.mean([0.5 * math.erfc((t - x) / h / math.sqrt(2)) for x in v])

    p, q = tail(post, 0.25), tail(prior, 0.25)
    assert (row.p_posterior, row.p_prior) == (pytest.approx(p, abs=1e-6), pytest.approx(q, abs=1e-6))
    assert row.bf == pytest.approx(p / (1 - p) / (q / (1 - q)), rel=1e-4)
    curve = evidence.bayes_factor_curve(evidence.draw_bayes_factors(drawn, [0.0, 0.25], 800)).collect()
    assert len(curve) == 2 and all(r.log10_bf == pytest.approx(math.log10(r.bf)) for r in curve)


def test_infinite_and_undefined_factors(spark):
    tails = spark.createDataFrame(
        [("posterior", 1, 2, 0.0, 1.0, 0.0), ("prior", 1, 2, 0.0, 0.5, 0.5),
         ("posterior", 1, 3, 0.0, 0.0, 1.0), ("prior", 1, 3, 0.0, 0.5, 0.5),
         ("posterior", 2, 3, 0.0, 0.8, 0.2), ("prior", 2, 3, 0.0, 0.5, 0.5)],
        "kind string, ch_x int, ch_y int, rho_threshold double, p_above double, p_below double",
    )
    found = {(r.ch_x, r.ch_y): r.bf for r in evidence.bayes_factors(tails).collect()}
    assert found == {(1, 2): math.inf, (1, 3): 0.0, (2, 3): pytest.approx(4.0)}
    curve = evidence.bayes_factor_curve(evidence.bayes_factors(tails)).collect()
    assert [(r.ch_x, r.ch_y) for r in curve] == [(2, 3)]


def test_density_integrates_to_one(spark, rng):
    drawn = spark.createDataFrame([("a", float(v)) for v in rng.normal(size=1000)], "k string, v double")
    curve = evidence.kde_density(drawn, ["k"], "v", points=200, rows_per_group=1000).toPandas().sort_values("x")
    assert np.trapezoid(curve["density"], curve["x"]) == pytest.approx(1.0, abs=0.01)


def test_thresholds():
    steps = evidence.thresholds_between(-0.8, 0.8, 0.01)
    assert len(steps) == 161 and steps[0] == -0.8 and steps[80] == 0.0 and steps[-1] == 0.8
    with pytest.raises(ValueError):
        evidence.thresholds_between(0.5, 0.5, 0.1)
    with pytest.raises(ValueError):
        evidence.thresholds_between(0.0, 0.5, 0.0)


def test_a_middle_half_of_one_value_has_the_width_of_the_sql(spark):
    """The named queries' SQL takes min(sd, IQR / 1.34) as it is: 0 here, and 0 / 0 for a draw at the threshold."""
    drawn = spark.createDataFrame([("a", v) for v in [-0.5] + [0.25] * 8 + [0.5]], "k string, v double")
    plain = {
        r.rho_threshold: r for r in evidence.kde_tail(drawn, ["k"], "v", [0.0, 0.25], 10, sd_if_flat=False).collect()
    }
    assert (plain[0.0].p_above, plain[0.0].p_below) == pytest.approx((0.9, 0.1), abs=1e-12)
    assert math.isnan(plain[0.25].p_above) and plain[0.25].p_empirical == pytest.approx(0.1)
    density = evidence.kde_density(drawn, ["k"], "v", points=4, rows_per_group=10, sd_if_flat=False).toPandas()
    assert sorted(density["x"]) == pytest.approx([-0.5, -1 / 6, 1 / 6, 0.5]) and density["density"].isna().all()
    smooth = {r.rho_threshold: r for r in evidence.kde_tail(drawn, ["k"], "v", [0.0, 0.25], 10).collect()}
    assert 0 < smooth[0.25].p_above < 1


@pytest.mark.parametrize("bins", [1, 7, 4096])
def test_quantiles_of_large_groups_rank_only_the_bins_that_hold_them(spark, rng, monkeypatch, bins):
    from lumipair.functions import ranking

    ranked = []
    plain = ranking.value_ranks
    monkeypatch.setattr(ranking, "QUANTILE_BINS", bins)
    monkeypatch.setattr(ranking, "value_ranks", lambda df, *rest: ranked.append(df.count()) or plain(df, *rest))
    groups = {
        "spread": rng.normal(size=3000), "ties": rng.integers(0, 4, 999).astype(float), "one": np.array([2.5]),
        "equal": np.full(50, -1.0), "far": np.append(rng.normal(size=400), 1e300), "ends": np.array([-1.7e308, 0.5, 1.7e308]),
    }
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("spread", None)]
    df = spark.createDataFrame(rows, "k string, value double").repartition(6)
    wanted = [0.0, 0.025, 0.25, 0.5, 0.975, 1.0]
    found = quantiles(df, ["k"], wanted, also=(F.count("value").alias("n"),)).collect()
    assert {r.k: r.n for r in found} == {k: len(v) for k, v in groups.items()}
    for r in found:
        assert r["quantiles"] == pytest.approx(np.quantile(groups[r.k], wanted).tolist(), rel=1e-12), r.k
    assert ranked[0] < len(rows) / 2 or bins < 4096


def test_tails_in_blocks_equal_those_of_column_expressions(spark, rng, monkeypatch):
    """Whole groups and cut ones, null keys, values without a number, and widths of 0 and none at all."""
    monkeypatch.setattr(tails, "BLOCK", 64)
    odd = [math.nan, math.inf, -math.inf, 0.25, -0.1]
    rows = [(k, float(v), int(n), h) for k, h in (("a", 0.05), (None, 1e-3), ("c", 0.0), ("d", None)) for v, n in zip(rng.normal(0, 0.3, 60), rng.integers(1, 5, 60))]
    rows += [(k, v, 2, h) for k, h in (("e", 0.1), ("f", 0.0)) for v in odd]
    values = spark.createDataFrame(rows, "k string, value double, m long, h double").repartition(3)
    thresholds = [-0.8, 0.0, 0.25]
    for flat in (True, False):
        at = values.withColumn("rho_threshold", F.explode(F.array(*map(F.lit, thresholds))))
        z = (F.try_divide if flat else columns.ieee_divide)(F.col("value") - F.col("rho_threshold"), F.col("h"))
        step = F.when(F.col("value") > F.col("rho_threshold"), 1.0).otherwise(0.0)
        above, below = F.coalesce(columns.normal_cdf(z), step), F.coalesce(columns.normal_cdf(-z), 1.0 - step)
        wanted = at.groupBy("k", "rho_threshold").agg(*[F.sum(F.col("m") * c) / F.sum("m") for c in (above, below, step)]).collect()
        found = tails.kernel_tails(values, ["k"], thresholds, flat_is_step=flat).collect()
        assert len(found) == len(wanted) == 18
        by_place = {(r[0], r[1]): r[2:] for r in found}
        for r in wanted:
            np.testing.assert_allclose(by_place[r[0], r[1]], r[2:], rtol=1e-12, err_msg=f"{r} {flat}")


def test_a_prior_of_all_pairs_is_computed_once(spark, rng, monkeypatch):
    drawn = samples(spark, rng.normal(0.3, 0.05, 400), rng.normal(0, 0.4, 400))
    drawn = drawn.withColumn("ch_y", F.explode(F.array(F.lit(2), F.lit(3))))
    prior = drawn.filter("kind = 'prior' and ch_y = 2").drop("kind", "ch_x", "ch_y")
    rows = []
    plain = evidence.kernel_tails
    monkeypatch.setattr(evidence, "kernel_tails", lambda values, *a, **b: rows.append(values.count()) or plain(values, *a, **b))
    once = evidence.draw_bayes_factors(drawn.filter("kind = 'posterior'").drop("kind"), [0.0, 0.25], 400, prior=prior)
    assert sum(rows) == 400 + 2 * 400
    each = evidence.draw_bayes_factors(drawn, [0.0, 0.25], 400)
    order = lambda df: sorted(map(tuple, df.collect()))
    assert len(order(once)) == 4
    np.testing.assert_allclose(order(once), order(each), rtol=1e-9)
