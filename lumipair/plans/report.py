"""The result table: one line of statistics per channel pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumipair.operators.evidence import delta_rho, summarise
from lumipair.schema import PAIR

_STATISTICS = (("mean", "mean"), ("median", "median"), ("lower", "lower_credible_interval"), ("upper", "upper_credible_interval"))

# (name in the report, kind of draws, column of the draws)
_BLOCKS = (
    ("prior", "prior", "mu_sample"),
    ("posterior", "posterior", "mu_sample"),
    ("control_prior", "prior", "mu_control"),
    ("control_posterior", "posterior", "mu_control"),
    ("delta_rho", "posterior", "delta_rho"),
)


def report_columns() -> list[str]:
    return ["channel_1", "channel_2", "rho_threshold", "bf"] + [
        f"{label}_{block}" for block, _, _ in _BLOCKS for _, label in _STATISTICS
    ]


def result_report(samples: DataFrame, factors: DataFrame, rows_per_group: int | None = None) -> DataFrame:
    """24 columns per channel pair from the draws of both kinds and the Bayes factors at one threshold."""
    draws = samples.withColumn("delta_rho", delta_rho())
    stats = summarise(draws, ["kind", *PAIR], ["mu_sample", "mu_control", "delta_rho"], rows_per_group)
    wide = [
        F.max(F.when((F.col("kind") == kind) & (F.col("name") == column), F.col(source))).alias(f"{label}_{block}")
        for block, kind, column in _BLOCKS
        for source, label in _STATISTICS
    ]
    lines = stats.groupBy(*PAIR).agg(*wide).join(factors.select(*PAIR, "rho_threshold", "bf"), PAIR)
    return lines.withColumnsRenamed({"ch_x": "channel_1", "ch_y": "channel_2"}).select(*report_columns())
