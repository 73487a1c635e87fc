import sys
import tempfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lumipair.schema import scanlines_schema  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="/tmp/spark-"))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_scanlines(spark):
    """Scanlines from {(condition, image_id): [plane per channel]}; a plane is a matrix, None stands for missing."""

    def make(images):
        rows, n_channels = [], 0
        for (condition, image_id), planes in images.items():
            height, width = len(planes[0]), len(planes[0][0])
            n_channels = len(planes)
            for r in range(height):
                lines = [[None if v is None else float(v) for v in plane[r]] for plane in planes]
                rows.append((condition, image_id, r, height, width, *lines))
        return spark.createDataFrame(rows, scanlines_schema(list(range(1, n_channels + 1))))

    return make


@pytest.fixture(scope="session")
def planes_of():
    """Back from scanlines to {(condition, image_id): array (channel, row, col)}; missing values become NaN."""

    def collect(scanlines):
        from lumipair.schema import channels_of

        found = {}
        for r in scanlines.orderBy("condition", "image_id", "row").collect():
            lines = [[np.nan if v is None else v for v in r[f"c{c}"]] for c in channels_of(scanlines)]
            found.setdefault((r.condition, r.image_id), []).append(lines)
        return {k: np.array(v, dtype=float).transpose(1, 0, 2) for k, v in found.items()}

    return collect


@pytest.fixture
def rng():
    return np.random.default_rng(20240607)
