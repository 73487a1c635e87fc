import numpy as np
import pytest

from lumipair.plans.analysis import Options, analyse
from lumipair.plans.report import report_columns


def stack(rng, n, mix, prefix):
    """Images of three channels; the second follows the first by the share ``mix``, the third is its own."""
    images = {}
    for k in range(n):
        base = rng.gamma(2.0, 1.0, (3, 48, 48)) + 0.1
        base[1] = mix * base[0] + (1 - mix) * base[1]
        images[("any", f"{prefix}{k}")] = base.tolist()
    return images


@pytest.fixture(scope="module")
def stacks(make_scanlines):
    rng = np.random.default_rng(5)
    return make_scanlines(stack(rng, 3, 0.9, "s")), make_scanlines(stack(rng, 3, 0.0, "c"))


def test_one_pair_against_controls(stacks, spark, tmp_path):
    sample, control = stacks
    result = analyse(sample, control, Options(patches=3, map_patches=4, pair=(1, 2), draws=4000, rho_threshold=0.0))
    assert result.report.columns == report_columns() and len(report_columns()) == 24
    line = result.report.collect()
    assert len(line) == 1 and (line[0].channel_1, line[0].channel_2) == (1, 2)
    assert line[0].bf > 50 and line[0].mean_posterior > 0.5 and abs(line[0].mean_control_posterior) < 0.2
    assert line[0].mean_delta_rho == pytest.approx(line[0].mean_posterior - line[0].mean_control_posterior, abs=1e-9)
    assert line[0].lower_credible_interval_posterior <= line[0].median_posterior <= line[0].upper_credible_interval_posterior
    assert result.samples.groupBy("kind").count().collect()[0]["count"] == 4000
    assert result.empty_images.isEmpty()
    assert result.local_map().count() == 6 * 16
    assert result.patch_labels().count() > 0 and result.density().count() == 2 * 256
    assert result.bayes_factor_curve().count() > 0
    folder = str(tmp_path / "out")
    result.save(folder)
    assert spark.read.option("header", True).option("sep", "|").csv(f"{folder}/report").count() == 1
    assert spark.read.parquet(f"{folder}/masks").count() == 6 * 48 * 48 * 3
    with pytest.raises(Exception, match="(?i)already exists"):
        result.save(folder)


@pytest.mark.parametrize("method", ["block", "pixel"])
def test_all_pairs_against_shuffled_copy(stacks, method):
    sample, _ = stacks
    result = analyse(
        sample, options=Options(patches=3, draws=2000, rho_threshold=0.1, shuffle=True, shuffle_method=method, block=1)
    )
    factors = {(r.ch_x, r.ch_y): r.bf for r in result.bayes_factors.collect()}
    assert factors.keys() == {(1, 2), (1, 3), (2, 3)}
    assert (factors[(1, 2)] > 20) == (method == "pixel")
    assert {r.image_id for r in result.thresholds.filter("condition = 'control'").collect()} == {
        "shuffled_control_s0", "shuffled_control_s1", "shuffled_control_s2"
    }


def test_identical_stacks_give_no_evidence(stacks):
    sample, _ = stacks
    result = analyse(sample, sample, Options(patches=3, pair=(1, 2), draws=2000, method="spearman"))
    assert result.bayes_factors.collect()[0].bf < 0.05


def test_pair_without_data_is_left_out(make_scanlines, stacks):
    sample, control = stacks
    dark = make_scanlines({("any", "d"): [np.ones((48, 48)).tolist(), np.zeros((48, 48)).tolist(), np.ones((48, 48)).tolist()]})
    result = analyse(sample, dark, Options(patches=3, draws=500))
    assert result.report.isEmpty() and result.samples.isEmpty()
    assert result.empty_images.filter("image_id = 'd'").count() == 3


@pytest.mark.parametrize("change", [
    {"patches": 0}, {"map_patches": 0}, {"pair": (1,)}, {"pair": (1, 9)}, {"rho_range": (0.5, 0.5)}, {"method": "cosine"},
    {"shuffle": True, "shuffle_method": "rows"}, {"scale_link": "loose"}, {"draws": 0},
])
def test_options_are_checked_before_any_job(stacks, change):
    with pytest.raises(ValueError):
        analyse(*stacks, Options(**change))


def test_inputs_are_checked(stacks):
    sample, control = stacks
    with pytest.raises(ValueError):
        analyse(sample)
    with pytest.raises(ValueError):
        analyse(sample, control.drop("c3"))
    with pytest.raises(ValueError):
        analyse(sample.drop("c2", "c3"), control)


def test_hierarchical_model_fills_all_columns(make_scanlines, rng):
    images = {}
    for k in range(2):
        x = rng.uniform(1, 2, (48, 48))
        images["sample", f"s{k}"] = [x, x + rng.uniform(0, 0.2, (48, 48))]
        images["control", f"c{k}"] = [x, rng.uniform(1, 2, (48, 48))]
    lines = make_scanlines(images)
    options = Options(patches=4, draws=500, model="hierarchical")
    result = analyse(lines.filter("condition = 'sample'"), lines.filter("condition = 'control'"), options)
    posterior = result.samples.filter("kind = 'posterior'").toPandas()
    assert len(posterior) == 500 and not posterior.isna().any().any()
    assert (posterior.mu_sample > posterior.mu_control).mean() > 0.9
    assert result.report.count() == 1
    with pytest.raises(ValueError):
        Options(model="other").check([1, 2])
