"""The factor model against dense Gaussian algebra, and on planted panels."""

import numpy as np
import pytest

from tidewater.operators import dynamic_factors as D


def model(p=4, k=2, seed=0):
    rng = np.random.default_rng(seed)
    a = np.array([[0.6, 0.2], [-0.1, 0.4]])[:k, :k]
    return D.DynamicFactors([f"c{i}" for i in range(p)], np.zeros(p), np.ones(p), np.full(p, -np.inf), np.full(p, np.inf), rng.normal(size=(p, k)), a, rng.uniform(0.2, 1, p), np.eye(k) * 1.3)


def drawn(m, lengths, seed=1, missing=0.2):
    rng = np.random.default_rng(seed)
    k, p = m.loadings.shape[1], len(m.columns)
    x = np.full((len(lengths), max(lengths), p), np.nan)
    for b, n in enumerate(lengths):
        f = np.linalg.cholesky(m.start) @ rng.normal(size=k)
        for t in range(n):
            f = f if t == 0 else m.transition @ f + rng.normal(size=k)
            x[b, t] = m.loadings @ f + np.sqrt(m.noise) * rng.normal(size=p)
    x[rng.random(x.shape) < missing] = np.nan
    return x


def dense(m, x):
    """Log likelihood, means and covariances of all factors given all seen values, from one joint normal distribution."""
    t, p = x.shape
    k = m.loadings.shape[1]
    cov = np.zeros((t, t, k, k))
    cov[0, 0] = m.start
    for i in range(1, t):
        cov[i, i] = m.transition @ cov[i - 1, i - 1] @ m.transition.T + np.eye(k)
    for i in range(t):
        for j in range(i + 1, t):
            cov[j, i] = m.transition @ cov[j - 1, i]
            cov[i, j] = cov[j, i].T
    prior = cov.transpose(0, 2, 1, 3).reshape(t * k, t * k)
    h = np.kron(np.eye(t), m.loadings)
    seen = np.isfinite(x.ravel())
    h, v = h[seen], x.ravel()[seen]
    s = h @ prior @ h.T + np.diag(np.tile(m.noise, t)[seen])
    gain = prior @ h.T @ np.linalg.inv(s)
    return -0.5 * (len(v) * np.log(2 * np.pi) + np.linalg.slogdet(s)[1] + v @ np.linalg.solve(s, v)), (gain @ v).reshape(t, k), (prior - gain @ h @ prior).reshape(t, k, t, k)


def test_passes_equal_dense_algebra():
    m = model()
    lengths = [6, 3, 1]
    x = drawn(m, lengths)
    x[0, 2] = np.nan  # a time without any value
    state = D.passes(x, m)
    for b, n in enumerate(lengths):
        likely, mean, cov = dense(m, x[b, :n])
        assert np.isclose(state["likely"][b], likely)
        assert np.allclose(state["smooth"][b, :n], mean)
        for t in range(n):
            assert np.allclose(state["smooth_cov"][b, t], cov[t, :, t])
            assert np.allclose(state["filtered"][b, t], dense(m, x[b, : t + 1])[1][t])
            if t:
                assert np.allclose(state["lag"][b, t], cov[t, :, t - 1])


def frame(spark, x, lengths):
    rows = [(b, t, *(None if np.isnan(v) else float(v) for v in x[b, t])) for b, n in enumerate(lengths) for t in range(n)]
    return spark.createDataFrame(rows, "panel int, at int, " + ", ".join(f"c{i} double" for i in range(x.shape[2]))).repartition(3)


def test_likelihood_rises_and_parameters_return(spark):
    m = model(p=10)
    m.transition = np.diag([0.85, 0.2])
    lengths = [50] * 40
    x = drawn(m, lengths, missing=0.05)
    df = frame(spark, x, lengths)
    got = D.fit(df, m.columns, 2, "at", "panel", rounds=25, clip=None, tolerance=0)
    rises = np.diff(got.log_likelihood)
    assert (rises > -1e-6 * np.abs(got.log_likelihood[:-1])).all() and got.stable
    assert np.allclose(np.sort(np.linalg.eigvals(got.transition).real), [0.2, 0.85], atol=0.08)
    assert np.allclose(got.noise * got.scale**2, m.noise, rtol=0.15)
    stationary = lambda g: sum(np.linalg.matrix_power(g.transition, i) @ np.linalg.matrix_power(g.transition, i).T for i in range(200))
    common = [(g.loadings * s[:, None]) @ stationary(g) @ (g.loadings * s[:, None]).T for g, s in ((m, np.ones(10)), (got, got.scale))]
    assert np.allclose(*common, rtol=0.2, atol=0.2)
    filtered = got.transform(df, "at", "panel")
    assert filtered.columns == ["panel", "at", "factor_1", "factor_2"] and filtered.count() == sum(lengths)


def test_odd_panels(spark):
    rows = [("a", 1, 1.0, None), ("a", 2, float("nan"), 2.0), ("a", None, 5.0, 5.0), ("a", 3, 3.0, 1.0), ("b", 1, None, None), (None, 1, 2.0, 2.5), ("c", 1, float("inf"), 1.0)]
    df = spark.createDataFrame(rows, "key string, at int, x double, f0 double")
    got = D.fit(df, ["x", "f0"], 5, "at", "key", rounds=5)
    assert got.loadings.shape == (2, 1) and np.isfinite(got.loadings).all()
    out = {(r.key, r["at"]): r.factor_1 for r in got.transform(df, "at", "key", smoothed=True).collect()}
    assert set(out) == {("a", 1), ("a", 2), ("a", 3), ("b", 1), (None, 1), ("c", 1)} and np.isfinite(list(out.values())).all()
    whole = D.fit(df.where("at is not null and key = 'a'"), ["x", "f0"], 1, "at", rounds=3)
    assert whole.transform(df.where("key = 'a'"), "at").columns == ["at", "factor_1"]
    with pytest.raises(ValueError):
        D.fit(df.limit(0), ["x"], 1, "at")


def test_projection_and_nowcast(spark):
    rng = np.random.default_rng(7)
    f = np.cumsum(rng.normal(size=120)) * 0.3
    x = np.outer(f, [1.0, -2.0, 0.5]) + rng.normal(size=(120, 3)) * 0.1
    y = 5 + 3 * f + rng.normal(size=120) * 0.1
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "at int, c0 double, c1 double, c2 double, y double")
    m = D.nowcast(df, ["c0", "c1", "c2"], "y", 1, "at", rounds=15, penalties=(0.01, 100.0))
    rows = m.transform(df).orderBy("at").collect()
    want = m.factors.standardised(x) @ np.linalg.pinv(m.factors.loadings).T
    assert np.allclose([r.factor_1 for r in rows], want[:, 0]) and m.head.penalty == 0.01
    off = np.array([r.p for r in m.transform(df).select("at", m.head.predict().alias("p")).orderBy("at").collect()]) - y
    assert off.std() < 0.2 * y.std()
    odd = spark.createDataFrame([(1, None, float("nan"), float("inf"), None)], df.schema)
    assert m.transform(odd).first().factor_1 == 0.0
