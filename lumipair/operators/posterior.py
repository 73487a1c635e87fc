"""Prior and posterior of the correlation level of each condition.

Model per condition: image means are normal around a level mu with spread sigma; mu has a Cauchy prior on [-1, 1],
sigma one on [1e-4, 1]. The posterior of (mu, sigma) is evaluated on a fixed grid. An image enters through the mean,
standard deviation and count of its patch correlations.

For a fixed sigma the log likelihood is a parabola in mu, so images are summed into four numbers per sigma, not into one
per grid point. Everything after that has a size given by the grid and the number of channel pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumipair.functions.columns import exponential, random_key, truncated_cauchy, uniform
from lumipair.operators.correlate import usable_rho
from lumipair.schema import IMAGE, PAIR
from lumipair.shared import lookup_join, written

# Priors of the model as (centre, scale, low, high) of truncated Cauchy distributions.
MU_PRIOR = (0.0, 0.3, -1.0, 1.0)
SIGMA_PRIOR = {"control": (0.0, 0.3, 1e-4, 1.0), "sample": (0.1, 0.3, 1e-4, 1.0)}
TAU_PRIOR = (0.1, 0.3, 1e-4, 1.0)

MU_POINTS = 201
MU_STEP = 0.01
SIGMA_POINTS = 60
SMALLEST_ERROR = 1e-3
LONE_PATCH_SD = 0.3
CDF_BUCKETS = 4096

SCALE_LINKS = ("none", "shared")
GROUP = ["condition", *PAIR]


def mu_at(index: Column) -> Column:
    return F.lit(-1.0) + index * F.lit(MU_STEP)


def sigma_values() -> list[float]:
    """Spreads from 1e-4 to 1, evenly spaced in their logarithm."""
    return [10.0 ** (-4.0 + 4.0 * j / (SIGMA_POINTS - 1)) for j in range(SIGMA_POINTS)]


def _sigma_array() -> Column:
    return F.array(*[F.lit(s) for s in sigma_values()])


def image_summary(rho: DataFrame) -> DataFrame:
    """Count, mean, standard deviation and standard error of an image's usable patch correlations."""
    summary = usable_rho(rho).groupBy(*IMAGE, *PAIR).agg(
        F.count("rho").alias("n_patches"), F.avg("rho").alias("mean_rho"), F.stddev_samp("rho").alias("sd_rho")
    )
    return summary.withColumn("se_rho", F.col("sd_rho") / F.sqrt("n_patches"))


def _parabola(df: DataFrame, keys: list[str], value: Column, variance: Column) -> DataFrame:
    """Sums that give the log likelihood of normal values for any common mean."""
    weight = F.lit(1.0) / variance
    return df.groupBy(*keys).agg(
        F.sum(weight).alias("s0"), F.sum(weight * value).alias("s1"), F.sum(weight * value * value).alias("s2"),
        F.sum(F.log(variance)).alias("s_log"),
    )


def _log_likelihood(mean: Column) -> Column:
    square = F.col("s2") - F.lit(2.0) * mean * F.col("s1") + mean * mean * F.col("s0")
    return F.lit(-0.5) * (F.col("s_log") + square)


def _log_cauchy(x: Column, centre: Column | float, scale: float) -> Column:
    z = (x - centre) / F.lit(scale)
    return -F.log(F.lit(1.0) + z * z)


def _sigma_centre() -> Column:
    control, sample = SIGMA_PRIOR["control"][0], SIGMA_PRIOR["sample"][0]
    return F.when(F.col("condition") == "sample", F.lit(sample)).otherwise(F.lit(control))


def _shared_scale(images: DataFrame) -> DataFrame:
    """Log weight of each sigma as the centre of the within-image scales, with tau summed out."""
    own = images.filter(F.col("n_patches") > 1).withColumn(
        "_v", F.col("sd_rho") * F.col("sd_rho") / (2 * (F.col("n_patches") - 1))
    )
    per_tau = own.select(*GROUP, "sd_rho", "_v", F.posexplode(_sigma_array()).alias("tau_idx", "tau"))
    sums = _parabola(per_tau, [*GROUP, "tau_idx", "tau"], F.col("sd_rho"), F.col("tau") * F.col("tau") + F.col("_v"))
    log_tau = _log_cauchy(F.col("tau"), TAU_PRIOR[0], TAU_PRIOR[1]) + F.log("tau")
    cells = sums.select(
        *GROUP, "tau_idx", "s0", "s1", "s2", "s_log", log_tau.alias("log_tau"),
        F.posexplode(_sigma_array()).alias("sigma_idx", "sigma"),
    ).select(*GROUP, "sigma_idx", (F.col("log_tau") + _log_likelihood(F.col("sigma"))).alias("lp"))
    peak = Window.partitionBy(*GROUP, "sigma_idx")
    return (
        cells.withColumn("peak", F.max("lp").over(peak)).groupBy(*GROUP, "sigma_idx")
        .agg((F.log(F.sum(F.exp(F.col("lp") - F.col("peak")))) + F.max("peak")).alias("log_scale"))
    )


def _normalised(cells: DataFrame) -> DataFrame:
    group = Window.partitionBy(*GROUP)
    weight = F.exp(F.col("log_w") - F.max("log_w").over(group))
    return cells.withColumn("w", weight).withColumn("w", F.col("w") / F.sum("w").over(group))


def posterior_grid(images: DataFrame, scale_link: str = "none") -> DataFrame:
    """Posterior weights of (mu, sigma) per condition and channel pair, from ``image_summary`` rows.

    ``scale_link='shared'`` lets sigma also be the centre of the within-image scales, as in the full hierarchical model.
    """
    if scale_link not in SCALE_LINKS:
        raise ValueError(f"the scale link must be one of {SCALE_LINKS}")
    sd = F.coalesce("sd_rho", F.lit(LONE_PATCH_SD))
    error = F.greatest(sd / F.sqrt("n_patches"), F.lit(SMALLEST_ERROR))
    per_sigma = images.select(
        *GROUP, "mean_rho", (error * error).alias("_e2"), F.posexplode(_sigma_array()).alias("sigma_idx", "sigma")
    )
    sums = _parabola(
        per_sigma, [*GROUP, "sigma_idx", "sigma"], F.col("mean_rho"),
        F.col("sigma") * F.col("sigma") + F.col("_e2"),
    )
    log_sigma = _log_cauchy(F.col("sigma"), _sigma_centre(), SIGMA_PRIOR["sample"][1]) + F.log("sigma")
    sums = sums.withColumn("log_sigma", log_sigma)
    if scale_link == "shared":
        sums = sums.join(_shared_scale(images), [*GROUP, "sigma_idx"], "left").withColumn(
            "log_sigma", F.col("log_sigma") + F.coalesce("log_scale", F.lit(0.0))
        )
    cells = sums.withColumn("mu_idx", F.explode(F.sequence(F.lit(0), F.lit(MU_POINTS - 1))))
    mu = mu_at(F.col("mu_idx"))
    log_w = _log_cauchy(mu, MU_PRIOR[0], MU_PRIOR[1]) + F.col("log_sigma") + _log_likelihood(mu)
    return _normalised(cells.select(*GROUP, "mu_idx", "sigma_idx", "sigma", log_w.alias("log_w")))


def mu_marginal(grid: DataFrame) -> DataFrame:
    return grid.groupBy(*GROUP, "mu_idx").agg(F.sum("w").alias("w"))


def prior_mu_marginal(groups: DataFrame) -> DataFrame:
    """Prior weights of mu on the same grid for the given (condition, pair) rows."""
    cells = groups.withColumn("mu_idx", F.explode(F.sequence(F.lit(0), F.lit(MU_POINTS - 1))))
    log_w = _log_cauchy(mu_at(F.col("mu_idx")), MU_PRIOR[0], MU_PRIOR[1])
    return _normalised(cells.select(*GROUP, "mu_idx", log_w.alias("log_w"))).drop("log_w")


def draw_ids(spark: SparkSession, n: int) -> DataFrame:
    if n < 1:
        raise ValueError("at least one draw is needed")
    return spark.range(n).withColumnRenamed("id", "draw")


def prior_draws(draws: DataFrame, seed: int = 0) -> DataFrame:
    """Draws of the eight global parameters from their priors; ``draws`` has one ``draw`` id per row."""
    parameters = ("mu", "nu", "sigma", "tau")
    keyed = draws.select("draw", *[random_key(seed, p, F.col("draw")).alias(f"key_{p}") for p in parameters])
    columns = []
    for which, side in enumerate(("control", "sample")):
        u = {p: uniform(F.col(f"key_{p}"), which) for p in parameters}
        columns += [
            truncated_cauchy(u["mu"], *MU_PRIOR).alias(f"mu_{side}"),
            exponential(u["nu"]).alias(f"nu_{side}"),
            truncated_cauchy(u["sigma"], *SIGMA_PRIOR[side]).alias(f"sigma_{side}"),
            truncated_cauchy(u["tau"], *TAU_PRIOR).alias(f"tau_{side}"),
        ]
    return keyed.select("draw", *columns)


def inverse_cdf(grid: DataFrame, buckets: int = CDF_BUCKETS) -> DataFrame:
    """Cells of the cumulative posterior as intervals [lo, hi), repeated for every bucket of [0, 1) they touch.

    The bucket turns the range join with uniform numbers into an equi-join with few candidates. The table has at most
    (2 cells + buckets) rows per condition and pair.
    """
    order = Window.partitionBy(*GROUP).orderBy("mu_idx", "sigma_idx")
    upto = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cells = grid.filter(F.col("w") > 0).withColumn("hi", upto)
    cells = cells.withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0))).withColumn(
        "hi", F.when(F.lead("hi").over(order).isNull(), F.lit(1.0)).otherwise(F.col("hi"))
    )
    first = F.floor(F.col("lo") * buckets)
    last = F.least(F.floor(F.col("hi") * buckets), F.lit(buckets - 1).cast("long"))
    return (
        cells.filter(F.col("lo") < F.col("hi")).withColumn("bucket", F.explode(F.sequence(F.least(first, last), last)))
        .select(*GROUP, "bucket", "lo", "hi", mu_at(F.col("mu_idx")).alias("mu"), "sigma")
    )


def posterior_draws(
    grid: DataFrame, draws: DataFrame, pairs: list[tuple[int, int]], seed: int = 0, buckets: int = CDF_BUCKETS
) -> DataFrame:
    """Draws of mu and sigma of both conditions per channel pair. Pairs without data on one side give no rows.

    nu and tau have no posterior in this model; their columns are NULL.
    """
    cells = written(inverse_cdf(grid, buckets), "cdf")
    each = F.array(*[F.struct(F.lit(x).alias("ch_x"), F.lit(y).alias("ch_y")) for x, y in pairs])
    rows = draws.select("draw", F.inline(each))
    rows = rows.withColumn("key", random_key(seed, "posterior", F.col("ch_x"), F.col("ch_y"), F.col("draw")))
    most = len(pairs) * (2 * MU_POINTS * SIGMA_POINTS + buckets)
    for which, side in enumerate(("control", "sample")):
        rows = rows.withColumn("u", uniform(F.col("key"), which)).withColumn("bucket", F.floor(F.col("u") * buckets))
        of_side = cells.filter(F.col("condition") == side).select(
            *PAIR, "bucket", "lo", "hi", F.col("mu").alias(f"mu_{side}"), F.col("sigma").alias(f"sigma_{side}")
        )
        rows = (
            lookup_join(rows, of_side, [*PAIR, "bucket"], at_most=most)
            .filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).drop("u", "bucket", "lo", "hi")
        )
    absent = F.lit(None).cast("double")
    return rows.select(
        *PAIR, "draw", "mu_control", absent.alias("nu_control"), "sigma_control", absent.alias("tau_control"),
        "mu_sample", absent.alias("nu_sample"), "sigma_sample", absent.alias("tau_sample"),
    )


def all_samples(prior: DataFrame, posterior: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """Prior and posterior draws of all pairs in one table, told apart by ``kind``."""
    each = F.array(*[F.struct(F.lit(x).alias("ch_x"), F.lit(y).alias("ch_y")) for x, y in pairs])
    have = posterior.select(*PAIR).distinct()
    prior = lookup_join(prior.select(F.inline(each), *prior.columns), have, PAIR)
    return prior.withColumn("kind", F.lit("prior")).unionByName(posterior.withColumn("kind", F.lit("posterior")))
