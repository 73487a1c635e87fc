"""Evidence for a higher correlation in the sample: tail probabilities, Bayes factors, densities and summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumipair.functions.columns import ieee_divide
from lumipair.functions.ranking import quantiles, unpivot
from lumipair.operators.posterior import GROUP, MU_POINTS, MU_STEP, mu_marginal, prior_mu_marginal
from lumipair.operators.tails import kernel_tails
from lumipair.schema import PAIR
from lumipair.shared import lookup_join, written

CREDIBLE = (0.025, 0.975)
DENSITY_BINS = 2048


def delta_rho() -> Column:
    return F.col("mu_sample") - F.col("mu_control")


def thresholds_between(low: float, high: float, step: float) -> list[float]:
    if low >= high:
        raise ValueError("the range's lower end must be below its upper end")
    if step <= 0:
        raise ValueError("the step must be positive")
    return [round(low + k * step, 10) for k in range(int(math.floor((high - low) / step + 1e-9)) + 1)]


# ---- from the grid -------------------------------------------------------------------------------------------------


def both_marginals(grid: DataFrame) -> DataFrame:
    """Prior and posterior weights of mu on the grid, told apart by ``kind``."""
    posterior = mu_marginal(grid)
    prior = prior_mu_marginal(posterior.select(*GROUP).distinct())
    return posterior.withColumn("kind", F.lit("posterior")).unionByName(prior.withColumn("kind", F.lit("prior")))


def delta_distribution(marginals: DataFrame) -> DataFrame:
    """Distribution of mu_sample - mu_control on the grid; ``delta_idx`` counts grid steps.

    Each control cell meets the sample cell at a given distance, so the join is on cell numbers of a fixed grid.
    """
    keys = ["kind", *PAIR]
    control = marginals.filter(F.col("condition") == "control").select(*keys, F.col("mu_idx").alias("c"), F.col("w").alias("wc"))
    sample = marginals.filter(F.col("condition") == "sample").select(*keys, "mu_idx", F.col("w").alias("ws"))
    reach = MU_POINTS - 1
    apart = control.withColumn("delta_idx", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn(
        "mu_idx", F.col("c") + F.col("delta_idx")
    )
    return (
        apart.filter(F.col("mu_idx").between(0, reach)).join(sample, [*keys, "mu_idx"])
        .groupBy(*keys, "delta_idx").agg(F.sum(F.col("wc") * F.col("ws")).alias("p"))
    )


def grid_tail(distribution: DataFrame, thresholds: list[float], tie_weight: float = 0.0) -> DataFrame:
    """P(delta rho > t) and its complement, each summed on its own so that neither loses its small values.

    Thresholds are taken in whole grid steps; ``tie_weight`` is the share of the mass at t that counts as above.
    """
    steps = F.array(*[
        F.struct(F.lit(float(t)).alias("rho_threshold"), F.lit(int(round(t / MU_STEP))).alias("t_idx")) for t in thresholds
    ])
    tie = F.lit(float(tie_weight))
    share = F.when(F.col("delta_idx") > F.col("t_idx"), 1.0).when(F.col("delta_idx") == F.col("t_idx"), tie).otherwise(0.0)
    return (
        distribution.select("kind", *PAIR, "delta_idx", "p", F.inline(steps))
        .groupBy("kind", *PAIR, "rho_threshold")
        .agg(F.sum(F.col("p") * share).alias("p_above"), F.sum(F.col("p") * (F.lit(1.0) - share)).alias("p_below"))
    )


# ---- from draws ----------------------------------------------------------------------------------------------------


def summarise(draws: DataFrame, keys: list[str], columns: list[str], rows_per_group: int | None = None) -> DataFrame:
    """Mean, median and 95 % credible interval of each column, one row per (group, column name)."""
    long = unpivot(draws, keys, columns).filter(F.col("value").isNotNull())
    group = [*keys, "name"]
    return quantiles(long, group, [0.5, *CREDIBLE], rows_per_group, (F.avg("value").alias("mean"),)).select(
        *group, "mean", F.col("quantiles")[0].alias("median"),
        F.col("quantiles")[1].alias("lower"), F.col("quantiles")[2].alias("upper"),
    )


def bandwidths(
    draws: DataFrame, keys: list[str], column: str, rows_per_group: int | None = None, sd_if_flat: bool = True
) -> DataFrame:
    """Kernel bandwidth after Silverman (1986): 0.9 min(sd, IQR / 1.34) n^(-1/5).

    Where the middle half of the draws is one value, the standard deviation takes the quartiles' place, or, without
    ``sd_if_flat``, the width is 0.
    """
    long = draws.select(*keys, F.col(column).alias("value")).filter(F.col("value").isNotNull())
    moments = (
        F.count("value").alias("n"), F.stddev_samp("value").alias("sd"),
        F.min("value").alias("low"), F.max("value").alias("high"),
    )
    quarters = quantiles(long, keys, [0.25, 0.75], rows_per_group, moments)
    iqr = (F.col("quantiles")[1] - F.col("quantiles")[0]) / F.lit(1.34)
    least = F.least("sd", iqr)
    spread = F.when(iqr > 0, least).otherwise(F.col("sd")) if sd_if_flat else least
    return quarters.select(
        *keys, "n", "low", "high", (F.lit(0.9) * spread * F.pow(F.col("n"), F.lit(-0.2))).alias("h")
    )


def _over_width(distance: Column, sd_if_flat: bool) -> Column:
    return (F.try_divide if sd_if_flat else ieee_divide)(distance, F.col("h"))


def kde_tail(
    draws: DataFrame, keys: list[str], column: str, thresholds: list[float], rows_per_group: int | None = None,
    sd_if_flat: bool = True,
) -> DataFrame:
    """P(value > t) under a Gaussian kernel density of the draws (``p_above``) and as a plain share (``p_empirical``).

    Equal draws are counted first, so thresholds multiply distinct values only. At a width of 0, which ``sd_if_flat`` keeps
    for draws that are all equal, a draw counts as a step; without it, a draw at the threshold gives 0 / 0, which is NaN.
    """
    width = bandwidths(draws, keys, column, rows_per_group, sd_if_flat)
    values = draws.groupBy(*keys, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("m"))
    return kernel_tails(lookup_join(values.filter(F.col("value").isNotNull()), width, keys), keys, thresholds, flat_is_step=sd_if_flat)


def kde_density(
    draws: DataFrame, keys: list[str], column: str, points: int = 256, bins: int = DENSITY_BINS,
    rows_per_group: int | None = None, sd_if_flat: bool = True,
) -> DataFrame:
    """Density curve of a column: draws are counted in fixed bins, and bins are smoothed at evenly spaced points.

    A width of 0 has no density: NULL, or NaN without ``sd_if_flat``.
    """
    width = bandwidths(draws, keys, column, rows_per_group, sd_if_flat)
    values = draws.select(*keys, F.col(column).alias("value")).filter(F.col("value").isNotNull())
    placed = lookup_join(values, width, keys)
    span = F.col("high") - F.col("low")
    share = F.coalesce(F.try_divide(F.col("value") - F.col("low"), span), F.lit(0.0))
    bin_ = F.least(F.floor(share * F.lit(float(bins))), F.lit(bins - 1))
    counts = placed.groupBy(*keys, "n", "low", "high", "h", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("m"))
    centre = F.col("low") + (F.col("bin") + F.lit(0.5)) * span / F.lit(float(bins))
    left, right = F.col("low") - 3 * F.col("h"), F.col("high") + 3 * F.col("h")
    x = left + F.col("point") * (right - left) / F.lit(float(points - 1))
    z = _over_width(F.col("x") - F.col("centre"), sd_if_flat)
    mass = F.sum(F.col("m") * F.exp(F.lit(-0.5) * z * z))
    area = F.col("n") * F.col("h") * F.lit(math.sqrt(2.0 * math.pi))
    divide = F.try_divide if sd_if_flat else ieee_divide
    return (
        counts.withColumn("centre", centre).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("x", x).groupBy(*keys, "point", "x", "n", "h").agg(mass.alias("mass"))
        .select(*keys, "point", "x", divide(F.col("mass"), area).alias("density"))
    )


# ---- Bayes factors -------------------------------------------------------------------------------------------------


def bayes_factors(tails: DataFrame) -> DataFrame:
    """Posterior odds over prior odds of delta rho > t, from tail probabilities of both kinds."""

    def of(kind: str, column: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(column)))

    both = tails.groupBy(*PAIR, "rho_threshold").agg(
        of("posterior", "p_above").alias("p_posterior"), of("posterior", "p_below").alias("_posterior_below"),
        of("prior", "p_above").alias("p_prior"), of("prior", "p_below").alias("_prior_below"),
    )
    odds = [ieee_divide(F.col(f"p_{kind}"), F.col(f"_{kind}_below")) for kind in ("posterior", "prior")]
    return both.select(*PAIR, "rho_threshold", "p_posterior", "p_prior", ieee_divide(*odds).alias("bf"))


def grid_bayes_factors(grid: DataFrame, thresholds: list[float], tie_weight: float = 0.0) -> DataFrame:
    distribution = delta_distribution(written(both_marginals(grid), "marginals"))
    return bayes_factors(grid_tail(distribution, thresholds, tie_weight))


def draw_bayes_factors(
    samples: DataFrame, thresholds: list[float], rows_per_group: int | None = None, sd_if_flat: bool = True,
    prior: DataFrame | None = None,
) -> DataFrame:
    """Bayes factors from draws of both kinds and all pairs. With ``prior``, draws that hold for every pair, ``samples`` are the
    posterior ones, and what the prior gives is computed once."""

    def tails(draws: DataFrame, keys: list[str]) -> DataFrame:
        return kde_tail(draws.select(*keys, delta_rho().alias("delta_rho")), keys, "delta_rho", thresholds, rows_per_group, sd_if_flat)

    if prior is None:
        return bayes_factors(tails(samples, ["kind", *PAIR]))
    of_posterior = written(tails(samples.withColumn("kind", F.lit("posterior")), ["kind", *PAIR]), "tails")
    of_prior = tails(prior.withColumn("kind", F.lit("prior")), ["kind"])
    each = of_posterior.select(*PAIR, "rho_threshold").join(of_prior, "rho_threshold")
    return bayes_factors(of_posterior.unionByName(each.select(*of_posterior.columns)))


def bayes_factor_curve(factors: DataFrame) -> DataFrame:
    """log10 of the Bayes factor over the thresholds. Values that are not positive become NaN.

    A pair whose values are all NaN or all infinite has no curve and is left out.
    """
    positive = F.when(F.col("bf") > 0, F.col("bf")).otherwise(F.lit(float("nan")))
    curve = factors.select(*PAIR, "rho_threshold", positive.alias("bf"))
    pair = Window.partitionBy(*PAIR)
    real = F.when(~F.isnan("bf"), 1)
    finite = F.when(F.col("bf") != float("inf"), 1)
    return (
        curve.withColumn("_real", F.count(real).over(pair)).withColumn("_finite", F.count(finite).over(pair))
        .filter((F.col("_real") > 0) & (F.col("_finite") > 0))
        .select(*PAIR, "rho_threshold", "bf", F.log10("bf").alias("log10_bf"))
    )
