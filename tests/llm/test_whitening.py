import numpy as np
import pytest

from shelfspark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n string, x int"


def brute(rows, components=4):
    """Rows as whiten gives them, with the eigenvectors of the covariance matrix and exact integers."""
    kept = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    m = np.array(fit, float) - np.array(sums) / n
    v = m.T @ m / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return n, {
        i: (sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), np.abs((np.array(x) - np.array(sums) / n) @ vectors / np.sqrt(values)), values / np.trace(v)) for i, x in kept
    }


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "n", 2) for i, v in rows], SCHEMA)


def test_equals_the_covariance_matrix(spark):
    random = np.random.default_rng(5)
    vectors = (random.standard_normal((600, 24)) @ np.diag(np.linspace(2, 0.2, 24)) + 3).astype(np.float32).tolist()
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [None] + [1.0] * 23, [nan] * 24, [1.0] * 23 + [-inf], [1.0] * 23]
    rows = [*enumerate(vectors), *((1000 + i, vectors[0]) for i in range(300)), *((2000 + i, b) for i, b in enumerate(bad)), (None, vectors[1])]
    got = whitening.whiten(frame(spark, rows).repartition(5)).collect()
    n, wanted = brute([r for r in rows if r[1] is None or len(r[1]) != 23])
    assert len(got) == 4 * (len(wanted)) and {r["n"] for r in got} == {n} == {600}
    for r in got:
        deviation, whitened, explained = wanted[r["vec_id"]]
        k = r["component"] - 1
        assert r["deviation"] == deviation and abs(abs(r["whitened"]) - whitened[k]) < 1e-9 and abs(r["explained"] / explained[k] - 1) < 1e-12 and r["identity_error"] < 1e-10
    signs = {(r["component"]): set() for r in got}
    by_id = {(r["vec_id"], r["component"]): r["whitened"] for r in got}
    assert all(by_id[1000, c] == by_id[0, c] for c in signs)


def test_few_vectors_and_none(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [float("nan")])])).count() == 0
    same = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same] == [(1, 0, None, None, None)] * 4
    line = {(r["vec_id"], r["component"]): r for r in whitening.whiten(frame(spark, [(1, [1.0, 2.0, 0.0]), (2, [3.0, 2.0, 0.0])])).collect()}
    assert len(line) == 6 and abs(abs(line[1, 1]["whitened"]) - 1) < 1e-12 and line[1, 2]["whitened"] is None and abs(line[2, 1]["explained"] - 1) < 1e-12
    assert line[1, 1]["deviation"] == 512**2


def test_deviations_of_any_size_are_exact_or_null(spark):
    rows = [(1, [2.0**31, 0.0]), (2, [-(2.0**31), 1.0]), (3, [0.0, 5.0]), (4, [2.0**33, 0.0]), (5, [1.0, float(2**20)])]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(frame(spark, rows)).collect()}
    assert set(got) == {1, 2, 3, 5} and got[1] is None and got[3] == sum((4 * c - s) ** 2 for c, s in [(0, 256), (1280, 256 + 1280 + (1 << 28))])


@pytest.mark.parametrize("seed", range(4))
def test_equal_and_close_values_are_all_found(seed):
    random = np.random.default_rng(seed)
    q, _ = np.linalg.qr(random.standard_normal((120, 120)))
    for values in (np.r_[5, 5, 5, 4, 4, np.linspace(3.99, 1, 115)], np.r_[9, np.full(119, 2.0)], np.zeros(120), np.r_[3, 2.999999, 2.999998, 2.999997, np.linspace(2.9, 0, 116)]):
        a = q @ np.diag(values) @ q.T
        got, vectors = whitening.leading_pairs(lambda v, a=a: a @ v, 120, 4, seed=seed)
        assert np.abs(got - np.sort(values)[::-1][:4]).max() < 1e-12 and np.abs(a @ vectors - vectors * got).max() < 1e-12
