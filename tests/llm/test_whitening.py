"""Jacobi-Davidson pairs and whitened rows against dense linear algebra; odd rows."""

import numpy as np
import pytest

from stratavox.llm.whitening import leading_pairs, minres, op11_whiten_embeddings, whiten


@pytest.mark.parametrize("size,wanted,steps", [(64, 32, 5), (200, 8, 5), (150, 20, 2), (5, 32, 5), (1, 1, 5)])
def test_leading_pairs(size, wanted, steps):
    x = np.random.default_rng(size).standard_normal((500, size))
    dense = x.T @ x / 500
    values, basis = leading_pairs(lambda b: dense @ b, size, wanted, inner=steps)
    want = np.linalg.eigvalsh(dense)[::-1][:wanted]
    assert np.allclose(values, want, rtol=1e-12)
    assert np.linalg.norm(dense @ basis - basis * values, axis=0).max() < 1e-13 * want[0] * 10
    assert np.abs(basis.T @ basis - np.eye(len(values))).max() < 1e-13


def test_repeated_and_zero_eigenvalues():
    turn = np.linalg.qr(np.random.default_rng(1).standard_normal((90, 90)))[0]
    dense = (turn * np.r_[np.full(6, 7.0), np.full(4, 3.0), np.zeros(80)]) @ turn.T
    values, basis = leading_pairs(lambda b: dense @ b, 90, 12)
    assert np.allclose(values, [7] * 6 + [3] * 4 + [0] * 2, atol=1e-12)
    assert np.abs(basis.T @ basis - np.eye(12)).max() < 1e-12


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((12, 12))
    a, right = a + a.T, rng.standard_normal((12, 3))
    x = minres(lambda v: a @ v, right, 40, 1e-13)
    assert np.allclose(a @ x, right, atol=1e-8)


def brute(x):
    x = np.asarray(x, float)
    c = x - x.mean(0)
    e, u = np.linalg.eigh(c.T @ c / len(x))
    e, u = e[::-1][:32], u[:, ::-1][:, :32]
    return e, c @ u / np.sqrt(e), e / e.sum() if len(e) == x.shape[1] else e / np.trace(c.T @ c / len(x))


def test_query_equals_dense_algebra(spark):
    sf = "/root/testdata/sf0.001"
    got = op11_whiten_embeddings(spark, sf).toPandas().sort_values(["vec_id", "component"])
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.floor(64 * np.array([[float(c) for c in r["embedding"]] for r in rows])) + 1_000_000
    e, w, share = brute(x)
    assert list(got["component"][:32]) == list(range(1, 33)) and set(got["n"]) == {len(x)}
    assert np.allclose(np.abs(got["whitened"].to_numpy().reshape(len(x), -1)), np.abs(w), atol=1e-9)
    assert np.allclose(got["explained"].to_numpy()[:32], share, rtol=1e-10)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-10
    n, total = len(x), x.astype(int).sum(0)
    want = [int((((n * r.astype(int)) - total) ** 2).sum()) for r in x]
    assert got["deviation"].to_numpy()[::32].tolist() == want


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, x string, embedding array<float>, id int, component string")


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.5, 1.0, -2.0], [0.25, 0.0, 1.0], [0.25, 0.0, 1.0], [-3.0, 2.0, 0.125], [1.0, 1.0, 1.0]]
    odd = [None, [], [1.0], [1.0, None, 2.0], [nan, 0.0, 0.0], [inf, 0.0, 0.0], [1.0, -inf, 0.0]]
    rows = [(None if i == 1 else i // 2, "a", v, 1, "b") for i, v in enumerate(good + odd)]
    got = whiten(frame(spark, rows)).toPandas()
    e, w, _ = brute(np.floor(64 * np.array(good)))
    assert len(got) == 15 and got["vec_id"].isna().sum() == 3
    assert np.allclose(np.sort(np.abs(got["whitened"])), np.sort(np.abs(w[:, :3]).ravel()), atol=1e-9)


@pytest.mark.parametrize("rows", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 4, [None, []]])
def test_nothing_to_whiten(spark, rows):
    out = whiten(frame(spark, [(i, "a", v, 1, "b") for i, v in enumerate(rows)]))
    assert out.count() == 0
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_flat_dimensions_and_large_entries(spark):
    vectors = [[1e30, 1.0, 5.0], [0.0, 2.0, 5.0], [-1e30, 3.0, 5.0]]
    got = whiten(frame(spark, [(i, "a", v, 1, "b") for i, v in enumerate(vectors)])).toPandas()
    assert set(got["component"]) == {1} and got["deviation"].isna().any()  # beyond 64 bits
