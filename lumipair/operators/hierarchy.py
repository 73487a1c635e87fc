"""Posterior of the full hierarchical model: eight global parameters, with a level, scale and tail weight of every image.

Within a condition with level mu, spread sigma, tail weight nu and scale spread tau, image k has

    mu_k ~ normal(mu, sigma) on [-1, 1],   sigma_k ~ normal(sigma, tau) on [0, 1],   nu_k ~ exponential with mean nu

and its patch correlations are Student t with nu_k degrees of freedom, scaled by sigma_k and moved by mu_k.

1. *Image tables.* The likelihood of an image is tabulated once on cells of (mu_k, sigma_k, nu_k). Cells first cover all
   values, then, nested, what holds the mass of the first table. A table has a fixed size whatever the number of patches,
   and is all that is needed of the image from then on.
2. *Rounds of weighted draws.* Draws of the four globals of each condition and pair go to all image tables, where the
   image's parameters are summed out: a cell counts with the mass that its conditional prior has there, which is exact
   however narrow that prior is. Log likelihoods are sums over images, combined in tasks before the shuffle.
3. *Adaptation.* The first round draws from the priors, each later one from a normal mixture fitted to the weighted draws of
   the round before, tempered as far as their effective number demands, with a share of draws from the priors. The last rounds
   are weighted by the mixture of their proposals.
4. Posterior draws are picked from the weighted ones by their cumulative weights.

What the driver holds is the draws: ``ROUND_DRAWS`` for each condition and pair, whatever the number of images.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumipair.functions.columns import random_key, uniform
from lumipair.operators.correlate import rho_vectors
from lumipair.operators.posterior import CDF_BUCKETS, GROUP, MU_PRIOR, SIGMA_PRIOR, TAU_PRIOR
from lumipair.schema import IMAGE, PAIR
from lumipair.shared import lookup_join, written

MU_CELLS, SCALE_CELLS, TAIL_CELLS = 40, 24, 12
SCALE_RANGE, TAIL_RANGE = (1e-3, 1.0), (0.1, 100.0)
NESTED = 2
ROUND_DRAWS = 2048
ROUNDS = 7
LAST_ROUNDS = 3
LEAST_EFFECTIVE = 100
FROM_PRIOR = 0.1
PARAMETERS = ("mu", "nu", "sigma", "tau")
TABLE = "mu_edges array<double>, scale_edges array<double>, tail_edges array<double>, log_likelihood array<double>"


def _edges(low: float, high: float, n: int, logarithmic: bool) -> np.ndarray:
    return np.geomspace(low, high, n + 1) if logarithmic else np.linspace(low, high, n + 1)


def _middles(edges: np.ndarray, logarithmic: bool) -> np.ndarray:
    return np.sqrt(edges[1:] * edges[:-1]) if logarithmic else (edges[1:] + edges[:-1]) / 2


def log_likelihood(rho: np.ndarray, mu: np.ndarray, scale: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Of Student t values at all combinations of level, scale and degrees of freedom."""
    constant = np.array([math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - math.log(v * math.pi) / 2 for v in tail.tolist()])
    found = np.zeros((len(mu), len(scale), len(tail)))
    for begin in range(0, len(rho), 256):
        z = (rho[begin:begin + 256, None] - mu[None, :]) ** 2
        for b, s in enumerate(scale.tolist()):
            for c, v in enumerate(tail.tolist()):
                found[:, b, c] += np.log1p(z / (v * s * s)).sum(axis=0) * (-(v + 1) / 2)
    return found + len(rho) * (constant[None, None, :] - np.log(scale)[None, :, None])


def image_table(rho: np.ndarray, nested: int = NESTED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(edges of mu, of sigma, of nu, log likelihood in the middle of each cell) of one image."""
    edges = [_edges(-1.0, 1.0, MU_CELLS, False), _edges(*SCALE_RANGE, SCALE_CELLS, True), _edges(*TAIL_RANGE, TAIL_CELLS, True)]
    for depth in range(nested + 1):
        mu, scale, tail = (_middles(e, i > 0) for i, e in enumerate(edges))
        table = log_likelihood(rho, mu, scale, tail)
        if depth == nested:
            break
        # What holds the mass under flat weights: the next cells span it, with a cell to spare on each side.
        mass = np.exp(table - table.max())
        for axis, n in ((0, MU_CELLS), (1, SCALE_CELLS)):
            own = mass.sum(axis=tuple(i for i in range(3) if i != axis))
            held = np.flatnonzero(own > 1e-9 * own.max())
            low, high = max(0, held[0] - 1), min(n, held[-1] + 2)
            edges[axis] = _edges(edges[axis][low], edges[axis][high], n, axis == 1)
    return *edges, table


def image_tables(rho: DataFrame, nested: int = NESTED) -> DataFrame:
    """One row per image and pair with usable correlations: its likelihood table; at most ``nx * ny`` values go in."""
    keys = [*IMAGE, *PAIR]

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for item in items:
            for i in range(item.num_rows):
                values = item.column(len(keys)).slice(i, 1).flatten().to_numpy(zero_copy_only=False)
                made = [pa.array([part.ravel()], pa.list_(pa.float64())) for part in image_table(values, nested)]
                yield pa.RecordBatch.from_arrays([*(item.column(k).slice(i, 1) for k in range(len(keys))), *made], names=[*keys, *(c.split()[0] for c in TABLE.split(", "))])

    vectors = rho_vectors(rho).select(*keys, "rho")
    kinds = ", ".join(f"{name} {kind}" for name, kind in vectors.select(*keys).dtypes)
    return vectors.mapInArrow(run, f"{kinds}, {TABLE}")


def image_levels(rho: DataFrame, nested: int = NESTED) -> DataFrame:
    """Posterior of each image's own level, scale and tail weight under flat weights on their cells: means and evidence."""
    point = lambda edges, i: (F.element_at(edges, i + 1) + F.element_at(edges, i + 2)) / 2
    middle = lambda edges, i: F.sqrt(F.element_at(edges, i + 1) * F.element_at(edges, i + 2))
    cells = image_tables(rho, nested).select(
        *IMAGE, *PAIR, "mu_edges", "scale_edges", "tail_edges", F.array_max("log_likelihood").alias("top"),
        F.posexplode("log_likelihood").alias("cell", "value"),
    )
    i = F.col("cell")
    size = SCALE_CELLS * TAIL_CELLS
    cells = cells.select(
        *IMAGE, *PAIR, "top", F.exp(F.col("value") - F.col("top")).alias("w"),
        point(F.col("mu_edges"), F.floor(i / size).cast("int")).alias("mu"),
        middle(F.col("scale_edges"), F.floor(i % size / TAIL_CELLS).cast("int")).alias("scale"),
        middle(F.col("tail_edges"), (i % TAIL_CELLS).cast("int")).alias("tail"),
    )
    mean = lambda c: F.sum(F.col("w") * F.col(c)) / F.sum("w")
    return cells.groupBy(*IMAGE, *PAIR).agg(
        (F.max("top") + F.log(F.sum("w") / (MU_CELLS * size))).alias("log_evidence"),
        mean("mu").alias("mean_mu"), mean("scale").alias("mean_sigma"), mean("tail").alias("mean_nu"),
    )


def _upper_tail(x: np.ndarray) -> np.ndarray:
    """Of the standard normal distribution for x >= 0, to a relative error of 1.2e-7 (a Chebyshev fit)."""
    # Fixed values of the fit, lowest power first.
    fit = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    z = x / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.5 * z)
    power = np.zeros_like(t)
    for c in reversed(fit):
        power = power * t + c
    return 0.5 * t * np.exp(power - z * z)


def _normal_mass(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Mass of the standard normal distribution between ``low`` and ``high``."""
    right = _upper_tail(np.abs(low)) - _upper_tail(np.abs(high))
    across = 1.0 - _upper_tail(np.abs(low)) - _upper_tail(np.abs(high))
    return np.maximum(np.where(low >= 0, right, np.where(high <= 0, -right, across)), 0.0)


def summed_out(edges: tuple[np.ndarray, np.ndarray, np.ndarray], table: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Log likelihood of an image for each draw (columns mu, nu, sigma, tau) with its own parameters summed out."""
    mu, nu, sigma, tau = draws.T
    of_mu, of_scale = ((e[:, None] - at) / spread for e, at, spread in ((edges[0], mu, sigma), (edges[1], sigma, tau)))
    in_mu = _normal_mass(of_mu[:-1], of_mu[1:]) / _normal_mass((-1 - mu) / sigma, (1 - mu) / sigma)
    in_scale = _normal_mass(of_scale[:-1], of_scale[1:]) / _normal_mass(-sigma / tau, (1 - sigma) / tau)
    # Far tails are normal to all purposes: the last cell reaches to infinity.
    survival = np.exp(-edges[2][:, None] / nu)
    survival[-1] = 0.0
    in_tail = survival[:-1] - survival[1:]
    n, m, k = MU_CELLS, SCALE_CELLS, TAIL_CELLS
    top = table.max()
    by_tail = np.exp(table - top).reshape(n * m, k) @ in_tail
    total = (np.einsum("as,abs->bs", in_mu, by_tail.reshape(n, m, -1)) * in_scale).sum(axis=0)
    return top + np.log(np.maximum(total, 1e-300))


def summed_likelihood(tables: DataFrame, draws: dict[tuple, np.ndarray]) -> dict[tuple, np.ndarray]:
    """For each (condition, ch_x, ch_y) the log likelihood of its draws, summed over images."""
    spark = tables.sparkSession
    rows = [(*key, own.ravel().tolist()) for key, own in draws.items()]
    # ROUND_DRAWS x 4 numbers for each condition and pair.
    lookup = F.broadcast(spark.createDataFrame(rows, "condition string, ch_x int, ch_y int, draws array<double>"))

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for item in items:
            keys = list(zip(*(item.column(i).to_pylist() for i in range(3)), strict=True))
            for i, key in enumerate(keys):
                parts = [item.column(c).slice(i, 1).flatten().to_numpy(zero_copy_only=False) for c in range(3, 8)]
                own = summed_out(tuple(parts[:3]), parts[3], parts[4].reshape(-1, 4))
                sums[key] = sums[key] + own if key in sums else own
        if sums:
            columns = [pa.array(c, k) for c, k in zip(zip(*sums, strict=True), (pa.string(), pa.int32(), pa.int32()), strict=True)]
            values = pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*columns, values], names=[*GROUP, "sums"])

    joined = tables.select(*GROUP, *(c.split()[0] for c in TABLE.split(", "))).join(lookup, GROUP)
    parts = joined.mapInArrow(run, "condition string, ch_x int, ch_y int, sums array<double>")
    added = parts.select(*GROUP, F.posexplode("sums").alias("i", "s")).groupBy(*GROUP, "i").agg(F.sum("s").alias("s"))
    gathered = added.groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("sums"))
    return {(r.condition, r.ch_x, r.ch_y): np.array([x.s for x in r.sums]) for r in gathered.collect()}


def _priors(condition: str) -> list[tuple[float, float, float, float] | None]:
    side = SIGMA_PRIOR["sample" if condition == "sample" else "control"]
    return [MU_PRIOR, None, side, TAU_PRIOR]


def prior_sample(condition: str, n: int, rng: np.random.Generator) -> np.ndarray:
    found = []
    for prior in _priors(condition):
        u = rng.random(n)
        if prior is None:
            found.append(-np.log1p(-u))
        else:
            centre, scale, low, high = prior
            a, b = (math.atan((x - centre) / scale) for x in (low, high))
            found.append(np.clip(centre + scale * np.tan(a + u * (b - a)), low, high))
    return np.column_stack(found)


def log_prior(condition: str, draws: np.ndarray) -> np.ndarray:
    """Normalised density; minus infinity outside of the bounds."""
    total = np.zeros(len(draws))
    for x, prior in zip(draws.T, _priors(condition), strict=True):
        if prior is None:
            total += np.where(x > 0, -x, -np.inf)
        else:
            centre, scale, low, high = prior
            a, b = (math.atan((v - centre) / scale) for v in (low, high))
            inside = (x >= low) & (x <= high)
            total += np.where(inside, -np.log1p(((x - centre) / scale) ** 2) - math.log(scale * (b - a)), -np.inf)
    return total


def _unbounded(draws: np.ndarray) -> np.ndarray:
    return np.column_stack([np.arctanh(np.clip(draws[:, 0], -1 + 1e-12, 1 - 1e-12)), np.log(draws[:, 1:])])


def _bounded(z: np.ndarray) -> np.ndarray:
    return np.column_stack([np.tanh(z[:, 0]), np.exp(z[:, 1:])])


class Proposal:
    """A mixture of the prior and of Student t distributions with 5 degrees of freedom around parts of weighted draws."""

    TAILS = 5.0

    def __init__(self, condition: str, draws: np.ndarray | None = None, weights: np.ndarray | None = None, parts: int = 3):
        self.condition, self.parts = condition, []
        if draws is None:
            return
        z, w = _unbounded(draws), weights / weights.sum()
        # Parts of equal weight by the spread, the parameter with more than one mode when images are few.
        order = np.argsort(z[:, 2], kind="stable")
        which = np.minimum((np.cumsum(w[order]) * parts).astype(int), parts - 1)
        everything = np.cov(z.T, aweights=w) + 1e-12 * np.eye(4)
        for part in range(parts):
            own = order[which == part]
            if w[own].sum() > 0:
                mean = np.average(z[own], axis=0, weights=w[own])
                centred = (z[own] - mean) * np.sqrt(w[own] / w[own].sum())[:, None]
                spread = 1.5 * (centred.T @ centred) + 0.15 * everything
                self.parts.append((mean, np.linalg.cholesky(spread)))

    def sample(self, n: int, rng: np.random.Generator) -> np.ndarray:
        if not self.parts:
            return prior_sample(self.condition, n, rng)
        from_prior = int(n * FROM_PRIOR)
        found = [prior_sample(self.condition, from_prior, rng)]
        sizes = np.diff(np.linspace(0, n - from_prior, len(self.parts) + 1).astype(int))
        for (mean, root), size in zip(self.parts, sizes.tolist(), strict=True):
            stretch = np.sqrt(self.TAILS / rng.chisquare(self.TAILS, size))[:, None]
            found.append(_bounded(mean + stretch * (rng.standard_normal((size, 4)) @ root.T)))
        made = np.concatenate(found)
        # Draws outside of the bounds have no prior and no weight; they are moved inside to keep the sums finite.
        inside = np.isfinite(log_prior(self.condition, made))
        made[~inside] = prior_sample(self.condition, int((~inside).sum()), rng)
        self.lost = ~inside
        return made

    def log_density(self, draws: np.ndarray) -> np.ndarray:
        prior = log_prior(self.condition, draws)
        if not self.parts:
            return prior
        z = _unbounded(draws)
        jacobian = -np.log1p(-np.minimum(draws[:, 0] ** 2, 1 - 1e-12)) - z[:, 1:].sum(axis=1)
        v = self.TAILS
        constant = math.lgamma((v + 4) / 2) - math.lgamma(v / 2) - 2 * math.log(v * math.pi)
        each = [prior + math.log(FROM_PRIOR)]
        for mean, root in self.parts:
            q = (np.linalg.solve(root, (z - mean).T) ** 2).sum(axis=0)
            density = constant - np.log(np.diag(root)).sum() - (v + 4) / 2 * np.log1p(q / v)
            each.append(density + jacobian + math.log((1 - FROM_PRIOR) / len(self.parts)))
        top = np.max(each, axis=0)
        return top + np.log(np.exp(np.array(each) - top).sum(axis=0))


def effective(log_weights: np.ndarray) -> float:
    """Effective number of weighted draws."""
    w = np.exp(log_weights - log_weights.max())
    return float(w.sum() ** 2 / (w * w).sum())


def tempered(log_weights: np.ndarray, least: float = LEAST_EFFECTIVE) -> np.ndarray:
    """Weights raised to the largest power of at most 1 with an effective number of ``least`` draws."""
    low, high = 0.0, 1.0
    if effective(log_weights) < least:
        for _ in range(40):
            power = (low + high) / 2
            low, high = (power, high) if effective(power * log_weights) >= least else (low, power)
        high = low
    w = np.exp(high * (log_weights - log_weights.max()))
    return w / w.sum()


def weighted_draws(tables: DataFrame, seed: int = 0, rounds: int = ROUNDS, n: int = ROUND_DRAWS) -> DataFrame:
    """(condition, ch_x, ch_y, cell, w, mu, nu, sigma, tau): weighted draws of the posterior of each condition and pair."""
    spark = tables.sparkSession
    groups = sorted((r.condition, r.ch_x, r.ch_y) for r in tables.select(*GROUP).distinct().collect())
    rngs = {key: np.random.default_rng([seed, k]) for k, key in enumerate(groups)}
    proposals = {key: Proposal(key[0]) for key in groups}
    history: dict[tuple, list] = {key: [] for key in groups}
    for _ in range(rounds if groups else 0):
        draws = {key: proposals[key].sample(n, rngs[key]) for key in groups}
        values = summed_likelihood(tables, draws)
        for key in groups:
            own = draws[key]
            target = values[key] + log_prior(key[0], own)
            # All rounds so far as one mixture: a draw's weight is its target by the mean of their densities.
            history[key] = [*history[key][-LAST_ROUNDS + 1:], (proposals[key], own, target)]
            proposals[key] = Proposal(key[0], *_mixed(history[key], temper=True))
    rows = []
    for key in groups:
        own, w = _mixed(history[key], temper=False)
        rows += [(*key, i, float(x), *map(float, d)) for i, (x, d) in enumerate(zip(w, own, strict=True)) if x > 0]
    schema = f"condition string, ch_x int, ch_y int, cell int, w double, {', '.join(f'{p} double' for p in PARAMETERS)}"
    return spark.createDataFrame(rows, schema)


def _mixed(history: list, temper: bool) -> tuple[np.ndarray, np.ndarray]:
    draws = np.concatenate([d for _, d, _ in history])
    target = np.concatenate([t for _, _, t in history])
    densities = np.array([p.log_density(draws) for p, _, _ in history])
    top = densities.max(axis=0)
    log_weights = target - top - np.log(np.exp(densities - top).mean(axis=0))
    return draws, tempered(log_weights, LEAST_EFFECTIVE if temper else 0.0)


def picked(weighted: DataFrame, draws: DataFrame, pairs: list[tuple[int, int]], seed: int = 0, buckets: int = CDF_BUCKETS) -> DataFrame:
    """Posterior draws of all eight parameters per channel pair; pairs without data on one side give no rows.

    Cumulative weights are cut at buckets of [0, 1), so that a draw finds its interval by an equi-join. An interval begins
    where the one before it ends, so that a draw lies in exactly one.
    """
    order = f"(partition by {', '.join(GROUP)} order by cell)"
    intervals = weighted.selectExpr(
        *GROUP, *PARAMETERS, "cell",
        f"sum(w) over (partition by {', '.join(GROUP)} order by cell rows between unbounded preceding and current row) as upto",
    ).selectExpr(
        *GROUP, *PARAMETERS, f"coalesce(lag(upto) over {order}, 0.0D) as lo",
        f"case when lead(upto) over {order} is null then 1.0D else upto end as hi",
    ).filter("lo < hi")
    first, last = F.floor(F.col("lo") * buckets), F.least(F.floor(F.col("hi") * buckets), F.lit(buckets - 1).cast("long"))
    cells = written(intervals.withColumn("bucket", F.explode(F.sequence(F.least(first, last), last))), "weighted-draws")
    each = F.array(*[F.struct(F.lit(x).alias("ch_x"), F.lit(y).alias("ch_y")) for x, y in pairs])
    rows = draws.select("draw", F.inline(each))
    rows = rows.withColumn("key", random_key(seed, "hierarchy", F.col("ch_x"), F.col("ch_y"), F.col("draw")))
    most = len(pairs) * (2 * LAST_ROUNDS * ROUND_DRAWS + buckets)
    for which, side in enumerate(("control", "sample")):
        rows = rows.withColumn("u", uniform(F.col("key"), which)).withColumn("bucket", F.floor(F.col("u") * buckets))
        names = [F.col(p).alias(f"{p}_{side}") for p in PARAMETERS]
        of_side = cells.filter(F.col("condition") == side).select(*PAIR, "bucket", "lo", "hi", *names)
        inside = lookup_join(rows, of_side, [*PAIR, "bucket"], at_most=most).filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
        rows = inside.drop("u", "bucket", "lo", "hi")
    return rows.select(*PAIR, "draw", *[f"{p}_{side}" for side in ("control", "sample") for p in PARAMETERS])


def posterior_draws(rho: DataFrame, draws: DataFrame, pairs: list[tuple[int, int]], seed: int = 0) -> DataFrame:
    """Draws of the eight global parameters from patch correlations."""
    tables = written(image_tables(rho), "image-tables")
    return picked(weighted_draws(tables, seed), draws, pairs, seed)
