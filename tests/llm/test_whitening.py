import numpy as np
import pytest

from lumipair.llm import whitening as w
from lumipair.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("d", [1, 2, 3, 8, 64])
@pytest.mark.parametrize("kind", ["random", "graded", "close", "equal", "rank one", "zeros"])
def test_directions_match_the_library(d, kind):
    rng = np.random.default_rng(d)
    m = rng.normal(size=(2 * d + 3, d))
    if kind == "graded":
        m *= 10.0 ** -np.linspace(0, 6, d)
    if kind == "close":
        u, s, v = np.linalg.svd(m, full_matrices=False)
        m = u * (1 + 1e-9 * np.arange(d)) @ v
    if kind == "equal":
        m = np.linalg.qr(m)[0]
    if kind == "rank one":
        m = np.outer(m[:, 0], rng.normal(size=d))
    if kind == "zeros":
        m[:, d // 2:] = 0
    r = w._reduced(m)
    values, vectors = w.directions(r, d)
    want = np.linalg.svd(m, compute_uv=False)
    rank = np.count_nonzero(want > 1e-12 * max(want.max(), 1e-300))
    assert len(values) >= rank
    np.testing.assert_allclose(np.sqrt(values[:rank]), want[:rank], rtol=1e-12 if kind != "graded" else 1e-8)
    vectors = vectors[:rank]
    np.testing.assert_allclose(vectors @ vectors.T, np.eye(rank), atol=1e-8 if kind == "graded" else 1e-10)
    residual = m.T @ (m @ vectors.T) - vectors.T * values[:rank]
    assert np.abs(residual).max(initial=0) <= 1e-11 * max(1.0, want.max() ** 2)


def test_singular_values_keep_relative_accuracy():
    a, b = 10.0 ** -np.arange(0, 30, 3.0), 10.0 ** -np.arange(1, 28, 3.0)
    from fractions import Fraction

    got = np.prod([Fraction(x) for x in w.squared_singular_values(a, b).tolist()])
    want = np.prod([Fraction(x) ** 2 for x in a.tolist()])  # the determinant of B'B
    assert abs(float(got / want) - 1) < 1e-12


def brute(vectors):
    x = np.floor(1024 * np.array(vectors, np.float64)) + 100_000
    centred = x - x.mean(axis=0)
    e, v = np.linalg.eigh(centred.T @ centred / len(x))
    return x, centred, e[::-1], v[:, ::-1]


def test_query_matches_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    x, centred, e, v = brute([r.embedding for r in table])
    got = {(r.vec_id, r.component): r for r in QUERIES["op13_whitening"](spark, SF).collect()}
    assert len(got) == 8 * len(table)
    n = len(table)
    deviation = ((n * x.astype(np.int64) - x.astype(np.int64).sum(axis=0)) ** 2).sum(axis=1)
    white = centred @ v[:, :8] / np.sqrt(e[:8])
    for k in range(8):
        mine = np.array([got[r.vec_id, k + 1].whitened for r in table])
        sign = np.sign(mine @ white[:, k])
        np.testing.assert_allclose(sign * mine, white[:, k], atol=1e-9)
        one = got[table[0].vec_id, k + 1]
        assert abs(one.explained - e[k] / e.sum()) < 1e-10 and one.identity_error < 1e-10 and one.n == n
    assert [got[r.vec_id, 1].deviation for r in table] == deviation.tolist()


def test_bad_vectors_ties_and_nothing(spark):
    rng = np.random.default_rng(3)
    good = [[float(c) for c in rng.normal(size=5)] for _ in range(40)]
    rows = [(i, v, "x") for i, v in enumerate(good)] + [(None, good[0], "x"), (0, good[0], None)]
    bad = [(90, None, "x"), (91, [], "x"), (92, [1.0, None, 1.0, 1.0, 1.0], "x"), (93, [float("nan")] * 5, "x"), (94, [float("inf")] * 5, "x"), (95, [1.0] * 4, "x")]
    schema = "vec_id long, embedding array<float>, n string"
    got = w.whiten(spark.createDataFrame(rows + bad, schema).repartition(3)).collect()
    assert len(got) == 5 * 42 and {r.n for r in got} == {42} and got[0].identity_error < 1e-9
    _, _, e, _ = brute([np.float32(v) for _, v, _ in rows])
    assert np.allclose(sorted({r.explained for r in got}, reverse=True), e / e.sum())
    for nothing in ([], bad[:2], rows[:1], [rows[0]] * 3):
        assert w.whiten(spark.createDataFrame(nothing, schema)).count() == 0


def test_triangles_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(w, "FAN_IN", 3)
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, [float(c) for c in rng.normal(size=4)]) for i in range(200)], "vec_id long, embedding array<double>")
    got = w.whiten(rows.repartition(20)).collect()
    assert len(got) == 800 and got[0].identity_error < 1e-9


def test_deviations_beyond_a_long():
    big = np.array([[1 << 31, 1], [3, 4]], np.int64)
    assert w._deviation(big) == [(1 << 62) + 1, 25] and w._deviation(big * 4) == [None, 400]
