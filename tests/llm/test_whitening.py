import math

import numpy as np

from pagewright.llm.whitening import whiten


def brute(rows, k=8):
    x = np.array([np.floor(1024 * np.array(v, dtype=np.float64)) + 100000 for _, v in rows])
    n, s = len(x), x.sum(0)
    e, q = np.linalg.eigh(np.cov(x.T, bias=True))
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return n, s, e, q, (x - s / n) @ q / np.sqrt(e), ((n * x - s) ** 2).sum(1)


def test_whitening_equals_dense_eigenvectors(spark):
    rng = np.random.default_rng(3)
    scale = np.linspace(3, 0.2, 12)
    good = [(i, (rng.standard_normal(12) * scale).astype(np.float32).tolist()) for i in range(300)]
    good.append((5, good[5][1]))  # a repeated id and vector is one more row of the fit list
    bad = [(1000, None), (1001, [1.0] * 11 + [None]), (1002, [float("nan")] * 12), (1003, [float("inf")] + [0.0] * 11), (1004, [1e30] * 12)]
    df = spark.createDataFrame(
        [(i, v, "x", 1.0) for i, v in good + bad], "vec_id long, embedding array<float>, component string, n double"
    ).repartition(4)
    got = whiten(df).toPandas()
    n, s, e, q, w, dev = brute(good)
    assert len(got) == 8 * len(good) and set(got.n) == {n}
    assert not set(got.vec_id) & {r[0] for r in bad}
    first = got[got.component == 1].sort_values("vec_id", kind="stable")
    order = np.argsort([i for i, _ in good], kind="stable")
    assert (first.deviation.to_numpy() == dev[order]).all()
    trace = np.trace(np.cov(np.array([np.floor(1024 * np.array(v, dtype=np.float64)) + 100000 for _, v in good]).T, bias=True))
    for c in range(8):
        part = got[got.component == c + 1].sort_values("vec_id", kind="stable").whitened.to_numpy()
        want = w[order, c]
        sign = math.copysign(1, part @ want)
        assert np.abs(part - sign * want).max() < 1e-8
        assert abs(got[got.component == c + 1].explained.iloc[0] / (e[c] / trace) - 1) < 1e-9
    assert got.identity_error.max() < 1e-6 and got.identity_error.nunique() == 1


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, None), (2, [float("nan")])], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, []), (2, [])], schema)).count() == 0
    # equal vectors: zero covariance, no component
    assert whiten(spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], schema)).count() == 0
    # two dimensions give at most two components; a shorter vector is dropped
    got = whiten(spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [2.0, 2.5]), (4, [1.0])], schema)).collect()
    assert {r.vec_id for r in got} == {1, 2, 3} and {r.component for r in got} <= {1, 2}
