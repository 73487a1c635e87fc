import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from lumipair.operators import correlate, images, large_patches
from pyspark.sql import functions as F
from lumipair.operators.rank_methods import concordance, kendall, spearman


def by_patch(df):
    return {(r.ch_x, r.ch_y, r.patch_i, r.patch_j): (r.n, r.rho) for r in df.collect()}


def average_ranks(v):
    return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])


def brute_tau(x, y):
    sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    n = len(x) * (len(x) - 1) / 2
    tx, ty = ((sx == 0).sum() - len(x)) / 2, ((sy == 0).sum() - len(y)) / 2
    return (sx * sy).sum() / 2 / np.sqrt((n - tx) * (n - ty))


BRUTE = {
    "pearson": lambda x, y: np.corrcoef(x, y)[0, 1],
    "spearman": lambda x, y: np.corrcoef(average_ranks(x), average_ranks(y))[0, 1],
    "kendall": brute_tau,
}


def test_exclude_zero(make_scanlines):
    a, b = [1, 2, 0, 3, 4, 0, 5, None], [0, 2, 3, 0, 4, 5, 6, None]
    scanlines = make_scanlines({("sample", "a"): [[a], [b]]})
    kept = correlate.signal_pixels(scanlines, None, 1).collect()
    assert sorted((r.x, r.y) for r in kept) == [(2, 2), (4, 4), (5, 6)]


@pytest.mark.parametrize("method", correlate.METHODS)
def test_patch_correlation_against_direct(make_scanlines, rng, method):
    x, y = rng.random((50, 50)), rng.random((50, 50))
    scanlines = make_scanlines({("sample", "a"): [x.tolist(), y.tolist()]})
    found = by_patch(correlate.patch_rho(scanlines, 5, method=method))
    assert len(found) == 25
    for (_, _, i, j), (n, rho) in found.items():
        part = np.s_[(i - 1) * 10:i * 10, (j - 1) * 10:j * 10]
        assert n == 100 and rho == pytest.approx(BRUTE[method](x[part].ravel(), y[part].ravel()), abs=1e-12)


@pytest.mark.parametrize("method", correlate.METHODS)
def test_zeros_ties_missing_and_empty_patches(make_scanlines, rng, method):
    x = rng.integers(0, 6, (24, 30)).astype(float)
    y = rng.integers(0, 4, (24, 30)).astype(float)
    y[:8, :10] = 0.0
    x[8:16, :10] = 3.0
    x[20, 20] = np.nan
    lists = x.tolist()
    lists[23][29] = None
    scanlines = make_scanlines({("sample", "a"): [lists, y.tolist()]})
    x[23, 29] = np.nan
    found = by_patch(correlate.patch_rho(scanlines, 3, method=method))
    assert len(found) == 9
    for (_, _, i, j), (n, rho) in found.items():
        a, b = (p[(i - 1) * 8:i * 8, (j - 1) * 10:j * 10].ravel() for p in (x, y))
        keep = ~np.isnan(a) & ~np.isnan(b) & (a != 0) & (b != 0)
        a, b = a[keep], b[keep]
        assert n == keep.sum()
        if n <= 15 or len(set(a)) == 1:
            assert rho is None
        else:
            assert rho == pytest.approx(BRUTE[method](a, b), abs=1e-12)
    assert found[(1, 2, 1, 1)] == (0, None) and found[(1, 2, 2, 1)][1] is None


@pytest.mark.parametrize("method", ["spearman", "kendall"])
@pytest.mark.parametrize("limit", [4, 40])
def test_large_patches_equal_small_ones(make_scanlines, rng, method, limit):
    x = rng.integers(0, 40, (24, 24)).astype(float)
    y = np.round(x / 3 + rng.normal(0, 4, (24, 24)), 1)
    x[rng.random((24, 24)) < 0.35] = 17.0
    y[:12, :12] = 0.0
    scanlines = make_scanlines({("sample", "a"): [x.tolist(), y.tolist()], ("control", "b"): [y.tolist(), x.tolist()]})
    small = correlate.patch_rho(scanlines, 2, method=method)
    large = correlate.patch_rho(scanlines, 2, method=method, whole_patch=limit)
    want = {(r.image_id, r.patch_i, r.patch_j): (r.n, r.rho) for r in small.collect()}
    got = {(r.image_id, r.patch_i, r.patch_j): (r.n, r.rho) for r in large.collect()}
    assert want.keys() == got.keys()
    for k, (n, rho) in want.items():
        assert got[k][0] == n and got[k][1] == (None if rho is None else pytest.approx(rho, abs=1e-12))


@pytest.mark.parametrize("method", ["spearman", "kendall"])
def test_size_classes_are_mixed_in_one_result(make_scanlines, rng, method):
    def image(side):
        return [rng.integers(1, 9, (side, side)).astype(float).tolist() for _ in range(2)]

    scanlines = make_scanlines({("sample", "small"): image(8), ("sample", "big"): image(40)})
    whole = by_image(correlate.patch_rho(scanlines, 1, method=method))
    split = by_image(correlate.patch_rho(scanlines, 1, method=method, whole_patch=100))
    assert whole.keys() == split.keys() == {"small", "big"}
    for k in whole:
        assert split[k] == (whole[k][0], pytest.approx(whole[k][1], abs=1e-12))


def by_image(df):
    return {r.image_id: (r.n, r.rho) for r in df.collect()}


def test_kendall_of_one_bigger_patch(make_scanlines, rng):
    x, y = rng.integers(1, 300, (2, 40, 40)).astype(float)
    scanlines = make_scanlines({("sample", "a"): [x.tolist(), y.tolist()]})
    found = by_patch(correlate.patch_rho(scanlines, 1, method="kendall"))
    assert found[(1, 2, 1, 1)] == (1600, pytest.approx(brute_tau(x.ravel(), y.ravel()), abs=1e-12))


def test_monotone_pair_and_affine_invariance(make_scanlines, rng):
    x = rng.random((8, 8)) + 0.1
    scanlines = make_scanlines({("sample", "a"): [x.tolist(), (x**9).tolist(), (3 * x).tolist()]})
    for method, exact in (("spearman", True), ("kendall", True), ("pearson", False)):
        rho = by_patch(correlate.patch_rho(scanlines, 1, method=method))
        assert (rho[(1, 2, 1, 1)][1] == pytest.approx(1.0)) == exact
        assert rho[(1, 3, 1, 1)][1] == pytest.approx(1.0) and abs(rho[(2, 3, 1, 1)][1]) <= 1.0
    swapped = by_patch(correlate.patch_rho(scanlines, 1, pairs=[(2, 1)]))
    straight = by_patch(correlate.patch_rho(scanlines, 1, pairs=[(1, 2)]))
    assert swapped[(2, 1, 1, 1)][1] == pytest.approx(straight[(1, 2, 1, 1)][1])


def test_rectangular_grid(make_scanlines, rng):
    x, y = rng.random((2, 20, 24))
    scanlines = make_scanlines({("sample", "a"): [x.tolist(), y.tolist()]})
    for method in correlate.METHODS:
        found = by_patch(correlate.patch_rho(scanlines, 2, 4, method=method))
        assert len(found) == 8 and {n for n, _ in found.values()} == {60}


def test_argument_checks(make_scanlines):
    scanlines = make_scanlines({("sample", "a"): [[[1, 2]], [[3, 4]]]})
    with pytest.raises(ValueError):
        correlate.patch_rho(scanlines, 1, method="cosine")
    with pytest.raises(ValueError):
        correlate.patch_rho(scanlines, 0)
    with pytest.raises(ValueError):
        correlate.patch_rho(scanlines, 1, pairs=[(1, 5)])
    with pytest.raises(ValueError):
        correlate.patch_rho(scanlines, 1, pairs=[(1, 2, 2)])
    with pytest.raises(ValueError):
        correlate.patch_rho(scanlines.drop("c2"), 1)


def test_empty_images_vectors_and_labels(make_scanlines, rng):
    good = rng.random((2, 8, 8)) + 1
    scanlines = make_scanlines({
        ("sample", "good"): [p.tolist() for p in good],
        ("sample", "dark"): [[[0.0] * 8] * 8, good[1].tolist()],
    })
    rho = correlate.patch_rho(scanlines, 2)
    assert [r.image_id for r in correlate.empty_images(rho).collect()] == ["dark"]
    vectors = correlate.rho_vectors(rho).collect()
    assert [(r.image_id, len(r.rho)) for r in vectors] == [("good", 4)]
    labels = images.patch_labels(rho, scanlines, 2).collect()
    assert {(r.patch_i, r.patch_j): (r.x, r.y) for r in labels} == {
        (1, 1): (2.0, 2.0), (1, 2): (6.0, 2.0), (2, 1): (2.0, 6.0), (2, 2): (6.0, 6.0)
    }


def test_concordance_and_tau_of_many_groups(rng):
    sizes = np.array([5, 0, 1, 200, 33])
    x = rng.integers(0, 12, sizes.sum()).astype(float)
    y = rng.integers(0, 7, sizes.sum()).astype(float)
    weight = rng.integers(1, 4, sizes.sum()).astype(float)
    group = np.repeat(np.arange(5), sizes)
    score = concordance(group, x, y, weight, 5)
    tau, rho = kendall(group, x, y, 5), spearman(group, x, y, 5)
    for g in range(5):
        a, b, w = x[group == g], y[group == g], weight[group == g]
        signs = np.sign(a[:, None] - a) * np.sign(b[:, None] - b)
        assert score[g] == pytest.approx(w @ signs @ w / 2)
        if sizes[g] > 1:
            assert tau[g] == pytest.approx(brute_tau(a, b))
            assert rho[g] == pytest.approx(BRUTE["spearman"](a, b))
    assert np.isnan(tau[1]) and np.isnan(tau[2]) and np.isnan(rho[1]) and np.isnan(rho[2])


def test_heavy_value_has_a_slice_of_its_own(spark, rng):
    x = np.where(rng.random(3000) < 0.4, 5.0, rng.integers(1, 2000, 3000)).astype(float)
    y = rng.permutation(3000).astype(float)
    df = spark.createDataFrame([("p", float(a), float(b)) for a, b in zip(x, y)], "k string, x double, y double")
    found = large_patches.kendall(df, ["k"], 100).collect()
    assert found[0].n == 3000 and found[0].rho == pytest.approx(brute_tau(x, y), abs=1e-12)


def test_rank_methods_compute_few_pixels_at_once(spark, rng, monkeypatch):
    import pyarrow as pa

    from lumipair.operators import rank_methods

    sizes = np.array([3, 0, 9, 2, 2, 40, 1])
    batch = pa.RecordBatch.from_pydict({"c1": [rng.normal(size=n).tolist() for n in sizes]})
    monkeypatch.setattr(rank_methods, "BATCH_PIXELS", 12)
    parts = list(rank_methods.of_few_pixels(batch, sizes))
    assert [p.num_rows for p in parts] == [3, 2, 1, 1] and pa.Table.from_batches(parts).combine_chunks().to_batches()[0].equals(batch)
    rows = [(k, [float(v) for v in rng.integers(0, 9, 20)], [float(v) for v in rng.integers(0, 9, 20)]) for k in range(9)]
    patches = spark.createDataFrame(rows, "k int, c1 array<double>, c2 array<double>").coalesce(1)
    for method in ("spearman", "kendall"):
        small = rank_methods.rho_of_arrays(patches, ["k"], [(1, 2)], method).collect()
        monkeypatch.setattr(rank_methods, "BATCH_PIXELS", 10**6)
        assert sorted(rank_methods.rho_of_arrays(patches, ["k"], [(1, 2)], method).collect()) == sorted(small)
        monkeypatch.setattr(rank_methods, "BATCH_PIXELS", 12)


def test_slices_are_computed_many_at_a_time(spark, rng, monkeypatch):
    """Slices that go on in the next batch, null keys and batches of one slice give the same scores as slice by slice."""
    n = 4000
    cells = pd.DataFrame({
        "k": [None if v == 0 else f"g{v}" for v in np.sort(rng.integers(0, 4, n))],
        "s": 0, "x": rng.integers(0, 30, n).astype(float), "y": rng.integers(0, 20, n).astype(float), "w": rng.integers(1, 4, n),
    })
    cells["s"] = np.sort(rng.integers(0, 6, n)) * 2
    cells = cells.sort_values(["k", "s"], na_position="first", kind="stable").reset_index(drop=True)
    want = []
    for (k, _), part in cells.groupby(["k", "s"], dropna=False, sort=False):
        x, y, w = (part[c].to_numpy() for c in "xyw")
        signs = np.sign(x[:, None] - x) * np.sign(y[:, None] - y)
        want.append((None if pd.isna(k) else k, float((signs * w[:, None] * w).sum() / 2)))
    schema = pa.schema([("k", pa.string()), ("s", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("w", pa.int64())])
    batch = pa.RecordBatch.from_pandas(cells, schema, preserve_index=False)
    for most, rows in ((100_000, 4000), (700, 93), (1, 10)):
        monkeypatch.setattr(large_patches, "BATCH_CELLS", most)
        items = [batch.slice(i, rows) for i in range(0, n, rows)]
        got = [r for b in large_patches._scores(iter(items), ["k"], ["s", "x", "y", "w"]) for r in zip(*(c.to_pylist() for c in b.columns))]
        assert got == want
    df = spark.createDataFrame([(1, float(i % 7), float(i * 5 % 11)) for i in range(300)], "k int, x double, y double")
    plan = large_patches.kendall(df, ["k"], 100)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_ranks_are_counted_on_from_batch_to_batch(spark, rng):
    """Groups that go on in the next batch or slice, with weights and a sum that is carried along."""
    from lumipair.functions.ranking import value_ranks

    n = 3000
    rows = pd.DataFrame({"k": rng.integers(0, 4, n), "v": rng.integers(0, 300, n) / 7, "w": rng.integers(1, 5, n), "z": rng.integers(0, 9, n)})
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 7)
    try:
        ranks = value_ranks(spark.createDataFrame(rows).repartition(3), ["k"], "v", "w", (F.sum("z").alias("z"),))
        got = sorted(map(tuple, ranks.select("k", "v", "ties", "before", "group_rows", "z").collect()))
    finally:
        spark.conf.set(name, before)
    of_value = rows.groupby(["k", "v"])[["w", "z"]].sum().reset_index()
    of_value["before"] = of_value.groupby("k")["w"].cumsum() - of_value["w"]
    of_value["rows"] = of_value.groupby("k")["w"].transform("sum")
    assert got == [(r.k, r.v, r.w, r.before, r.rows, r.z) for r in of_value.itertuples()]


def test_pairs_between_slices_are_spread_by_number(spark):
    """Rows of block and slice are small, but many: joined by their bytes, partitions became one long task."""
    df = spark.createDataFrame([(1, float(i % 7), float(i * 5 % 11)) for i in range(300)], "k int, x double, y double")
    plan = large_patches.kendall(df, ["k"], 20)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
