"""The whole analysis, from image rows to the report, for one channel pair or for all pairs at once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumipair.operators import correlate, evidence, hierarchy, images, localmap, mask, posterior
from lumipair.operators.shuffle import DEFAULT_BLOCK, as_control, shuffled_control
from lumipair.operators.shuffle import METHODS as SHUFFLE_METHODS
from lumipair.plans.report import result_report
from lumipair.schema import channel_pairs, channels_of, plain_columns
from lumipair.shared import remove_written, written
from lumipair.sources.bands import shape_violations
from lumipair.sources.sinks import append_report, write_new, write_samples


# "grid": normal image levels on a fixed grid; "hierarchical": the full model, with draws of all eight parameters.
MODELS = ("grid", "hierarchical")


@dataclass
class Options:
    patches: int = 16
    map_patches: int = 100
    pair: tuple[int, int] | None = None
    method: str = "pearson"
    draws: int = 100_000
    rho_threshold: float = 0.1
    rho_range: tuple[float, float] = (-0.8, 0.8)
    rho_step: float = 0.01
    shuffle: bool = False
    shuffle_method: str = "block"
    block: int = DEFAULT_BLOCK
    mask_control: bool = False
    scale_link: str = "none"
    seed: int = 0
    model: str = "grid"

    def check(self, channels: list[int]) -> None:
        """Refuse impossible settings before any job starts."""
        if len(channels) < 2:
            raise ValueError("at least two channels are needed")
        if self.patches < 1 or self.map_patches < 1:
            raise ValueError("the number of patches must be at least 1")
        if self.pair is not None:
            if len(self.pair) != 2:
                raise ValueError("exactly two channels must be selected")
            if not set(self.pair) <= set(channels):
                raise ValueError(f"channels {self.pair} are not all among {channels}")
        if self.rho_range[0] >= self.rho_range[1]:
            raise ValueError("the range's lower end must be below its upper end")
        if self.method not in correlate.METHODS:
            raise ValueError(f"the method must be one of {correlate.METHODS}")
        if self.shuffle_method not in SHUFFLE_METHODS:
            raise ValueError(f"the shuffle method must be one of {SHUFFLE_METHODS}")
        if self.scale_link not in posterior.SCALE_LINKS:
            raise ValueError(f"the scale link must be one of {posterior.SCALE_LINKS}")
        if self.model not in MODELS:
            raise ValueError(f"the model must be one of {MODELS}")
        if self.draws < 1:
            raise ValueError("at least one draw is needed")


@dataclass
class Result:
    """The tables of one analysis.

    Thresholds, a shuffled control, correlations, grid and draws are written while ``analyse`` runs; the rest is computed
    where it is used. ``release`` deletes the written tables once the result has been saved.
    """

    scanlines: DataFrame
    masked: DataFrame
    thresholds: DataFrame
    rho: DataFrame
    image_rho: DataFrame
    empty_images: DataFrame
    dropped_images: DataFrame
    grid: DataFrame
    samples: DataFrame
    bayes_factors: DataFrame
    report: DataFrame
    options: Options = field(repr=False)

    def patch_labels(self) -> DataFrame:
        return images.patch_labels(self.rho, self.masked, self.options.patches)

    def local_map(self) -> DataFrame:
        pairs = [self.options.pair] if self.options.pair else None
        return localmap.local_map(self.masked, self.options.map_patches, pairs=pairs, method=self.options.method)

    def dropped_from_map(self) -> DataFrame:
        """Images that the local map leaves out or shows without any correlation."""
        pairs = [self.options.pair] if self.options.pair else None
        return localmap.dropped_from_map(self.masked, self.options.map_patches, pairs=pairs, method=self.options.method)

    def bayes_factor_curve(self) -> DataFrame:
        thresholds = evidence.thresholds_between(*self.options.rho_range, self.options.rho_step)
        factors = evidence.draw_bayes_factors(self.samples, thresholds, rows_per_group=self.options.draws)
        return evidence.bayes_factor_curve(factors)

    def mask_mosaic(self) -> DataFrame:
        """From the images as they came: in masked ones the background 0 may lie above a negative threshold."""
        return mask.mask_mosaic(self.scanlines, self.thresholds)

    def density(self, column: str = "delta_rho") -> DataFrame:
        """Density curves of a parameter, or of the difference of the levels, per kind and pair."""
        draws = self.samples.withColumn("delta_rho", evidence.delta_rho())
        return evidence.kde_density(draws, ["kind", "ch_x", "ch_y"], column, rows_per_group=self.options.draws)

    def save(self, folder: str) -> None:
        """Write report, draws, masks and the list of dropped images below a folder; used folders are refused."""
        write_samples(self.samples, f"{folder}/samples")
        write_new(self.mask_mosaic(), f"{folder}/masks")
        write_new(self.dropped_images, f"{folder}/dropped_images")
        append_report(self.report, f"{folder}/report")


    def release(self) -> None:
        """Delete the tables written in between by this application; its DataFrames stop working."""
        remove_written(self.scanlines.sparkSession)


def refuse_bad_shapes(scanlines: DataFrame) -> None:
    """``ValueError`` for an image with absent rows or with rows or planes that do not have the stated size."""
    found = shape_violations(scanlines).head()
    if found is not None:
        raise ValueError(
            f"image {found.image_id} ({found.condition}) is not a full matrix: {found.n_rows} rows of height {found.max_height}, "
            f"widths from {found.min_width} to {found.max_width}"
        )


def colocalization(
    scanlines: DataFrame, patches: int, pairs: list[tuple[int, int]] | None = None, method: str = "pearson",
    draws: DataFrame | None = None, n_draws: int = 100_000, scale_link: str = "none", seed: int = 0,
    largest: int | None = None, model: str = "grid",
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Patch correlations, image summaries, posterior grid and draws of both kinds for sample and control images.

    A pair for which one side has no usable image has no draws.
    """
    pairs = correlate.check_pairs(scanlines, pairs)
    rho = written(
        correlate.patch_rho(scanlines, patches, pairs=pairs, method=method, largest=largest), "rho"
    )
    summary = posterior.image_summary(rho)
    grid = written(posterior.posterior_grid(summary, scale_link), "grid")
    ids = posterior.draw_ids(scanlines.sparkSession, n_draws) if draws is None else draws
    if model == "hierarchical":
        drawn = written(hierarchy.posterior_draws(rho, ids, pairs, seed), "draws")
    else:
        drawn = written(posterior.posterior_draws(grid, ids, pairs, seed), "draws")
    samples = posterior.all_samples(posterior.prior_draws(ids, seed), drawn, pairs)
    return rho, summary, grid, samples


def analyse(sample: DataFrame, control: DataFrame | None = None, options: Options | None = None) -> Result:
    """Compare sample images with given control images, or with a shuffled copy of the samples."""
    options = options or Options()
    channels = channels_of(sample)
    options.check(channels)
    if not options.shuffle:
        if control is None:
            raise ValueError("without shuffling, control images are needed")
        if channels_of(control) != channels:
            raise ValueError("sample and control images have different channels")
    for side in (sample, control):
        if side is not None:
            refuse_bad_shapes(side)
    sample = sample.withColumn("condition", F.lit("sample"))
    if options.shuffle:
        control = written(
            shuffled_control(sample, options.shuffle_method, options.block, options.seed), "control"
        )
        # Shuffling keeps an image's values, and with them its thresholds.
        of_sample = written(mask.otsu_thresholds(sample), "thresholds")
        thresholds = of_sample.unionByName(as_control(of_sample))
    else:
        control = control.withColumn("condition", F.lit("control"))
        of_each = [mask.otsu_thresholds(side) for side in (sample, control)]
        thresholds = written(of_each[0].unionByName(of_each[1]), "thresholds")
    sample, control = (side.select(*plain_columns(side)) for side in (sample, control))
    if options.shuffle and not options.mask_control:
        masked = mask.apply_mask(sample, thresholds).unionByName(control)
    else:
        masked = mask.apply_mask(sample.unionByName(control), thresholds)
    pairs = [tuple(options.pair)] if options.pair else channel_pairs(channels)
    largest = None if options.method == "pearson" else correlate.largest_patch(sample.unionByName(control), options.patches)
    rho, summary, grid, samples = colocalization(
        masked, options.patches, pairs, options.method, n_draws=options.draws, scale_link=options.scale_link,
        seed=options.seed, largest=largest, model=options.model,
    )
    samples = written(samples, "samples")
    factors = evidence.draw_bayes_factors(samples, [options.rho_threshold], rows_per_group=options.draws)
    return Result(
        scanlines=sample.unionByName(control), masked=masked, thresholds=thresholds, rho=rho, image_rho=summary, empty_images=correlate.empty_images(rho),
        dropped_images=correlate.dropped_images(masked, rho, pairs),
        grid=grid, samples=samples, bayes_factors=factors,
        report=result_report(samples, factors, options.draws), options=options,
    )
