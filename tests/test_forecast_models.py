"""Boosted quantiles, lag fits, ridge heads and exact quantiles against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import boosting, lag_fit, order, ridge_head


def frame(spark, x, names, parts=3):
    return spark.createDataFrame([tuple(None if v != v else float(v) for v in r) for r in x], ", ".join(f"{c} double" for c in names)).repartition(parts)


def quantile(v, q):
    v, place = np.sort(v), (len(v) - 1) * q
    a, b = v[int(place)], v[min(int(place) + 1, len(v) - 1)]
    return a + (b - a) * (place - int(place))


def plain_boost(x, y, q, edges, trees, depth, leaves, rate, least_leaf):
    codes = np.stack([np.where(np.isnan(c), len(e) + 1, np.searchsorted(e, c, "left")) for c, e in zip(x.T, edges, strict=True)], 1)
    f = np.full(len(y), quantile(y, q))
    for _ in range(trees):
        root = np.arange(len(y))
        groups, level = [root], [root]
        for _ in range(depth):
            options = []
            for i, rows in enumerate(level):
                best = (0.0, -1, -1)
                g = np.where(y[rows] > f[rows], q, q - 1)
                for c in range(x.shape[1]):
                    for b in range(max(map(len, edges)) + 1):
                        left = codes[rows, c] <= b
                        if min(left.sum(), (~left).sum()) >= least_leaf:
                            gain = g[left].sum() ** 2 / left.sum() + g[~left].sum() ** 2 / (~left).sum() - g.sum() ** 2 / len(g)
                            if gain > best[0] * (1 + 1e-12) + 1e-9:
                                best = (gain, c, b)
                options.append((best, i))
            level_after, taken = [], []
            for (gain, c, b), i in sorted(options, key=lambda o: (-o[0][0], o[1])):
                if c >= 0 and len(groups) + len(taken) < leaves:
                    left = codes[level[i], c] <= b
                    level_after += [level[i][left], level[i][~left]]
                    taken.append(i)
            gone = {id(level[i]) for i in taken}
            groups = [r for r in groups if id(r) not in gone] + level_after
            level = level_after
            if not level:
                break
        for rows in groups:
            f[rows] += rate * quantile(y[rows] - f[rows], q)
    return f


@pytest.mark.parametrize(("sent", "most_cells"), [(1024, 1000), (5, 1000), (1024, 0), (1024, 3)])
def test_boosting_equals_plain_trees(spark, sent, most_cells):
    rng = np.random.default_rng(0)
    x = np.c_[rng.integers(0, 9, 500), np.round(rng.normal(size=500), 1), np.full(500, 3.0)]
    x[::17, 1] = np.nan
    y = x[:, 0] ** 2 + rng.normal(size=500) * (1 + x[:, 0]) + np.where(np.isnan(x[:, 1]), 5, 0)
    y[:60] = 7.0
    df = frame(spark, np.c_[x, y], ["a", "b", "same", "y"])
    m = boosting.fit(df, ["a", "b", "same"], "y", (0.9, 0.1, 0.5), trees=4, depth=3, leaves=6, rate=0.3, bins=100, least_leaf=10, keep_every=2, sent=sent, parts=8, most_cells=most_cells)  # leaves of more rows are narrowed down
    assert m.quantiles == (0.1, 0.5, 0.9)
    codes = np.stack([np.where(np.isnan(c), len(e) + 1, np.searchsorted(e, c, "left")) for c, e in zip(x.T, m.edges, strict=True)], 1).astype(np.uint8)
    got = m.forecasts(codes)
    for i, q in enumerate(m.quantiles):
        assert np.allclose(got[i], plain_boost(x, y, q, m.edges, 4, 3, 6, 0.3, 10)), q
    out = m.predict(df.withColumn("__x0", F.lit("kept"))).collect()
    assert len(out) == 500 and all(r.q_10 <= r.q_50 <= r.q_90 and r["__x0"] == "kept" for r in out)
    assert m.importance()[0][0] == "a" and dict(m.importance())["same"] == 0


def test_boosting_covers_and_takes_odd_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 3, 3000)
    y = np.sin(x) + rng.normal(size=3000) * (0.1 + 0.2 * x)
    df = frame(spark, np.c_[x, y], ["x", "y"])
    m = boosting.fit(df, ["x"], "y", (0.1, 0.9), trees=20, depth=3, bins=32)
    inside = m.predict(df).agg(F.avg(F.col("y").between(F.col("q_10"), F.col("q_90")).cast("double"))).first()[0]
    assert abs(inside - 0.8) < 0.03
    few = frame(spark, [[1.0, 2.0], [float("nan"), 4.0], [3.0, float("nan")], [3.0, float("inf")]], ["x", "y"])
    assert [r.q_50 for r in boosting.fit(few, ["x"], "y", (0.5,), trees=2).predict(few).collect()] == [3.0] * 4
    with pytest.raises(ValueError):
        boosting.fit(few.limit(0), ["x"], "y", (0.5,))


def test_lag_fit_finds_planted_weights(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 7)) * np.r_[np.full(4, 2.0), np.full(3, 50.0)] + 3
    w1, w2 = lag_fit.softmax_weights(4, np.array([-2.0, 0.5]))[0], lag_fit.softmax_weights(3, np.array([1.0, -3.0]))[0]
    y = 10 + 3 * x[:, :4] @ w1 - 0.2 * x[:, 4:] @ w2
    names = [f"c{i}" for i in range(7)]
    df = frame(spark, np.c_[x, y], [*names, "y"])
    m = lag_fit.nonlinear_midas(df, {"a": names[:4], "b": names[4:]}, "y")
    assert np.allclose(m.lag_weights["a"], w1, atol=1e-5) and np.allclose(m.lag_weights["b"], w2, atol=1e-5)
    assert np.allclose([m.slopes["a"][0], m.slopes["b"][0], m.intercept], [3, -0.2, 10], atol=1e-4) and m.loss < 1e-6 * ((y - y.mean()) ** 2).sum()
    noisy = y + rng.normal(size=300)
    df = frame(spark, np.c_[x, noisy], [*names, "y"])
    free = lag_fit.nonlinear_midas(df, {"a": names[:4], "b": names[4:]}, "y", slopes="lag")
    z = np.c_[np.ones(300), x]
    best = z @ np.linalg.lstsq(z, noisy, rcond=None)[0]
    assert np.allclose(free.intercept + x @ free.weights, best, atol=1e-5)
    assert np.isclose(free.loss, ((noisy - best) ** 2).sum(), rtol=1e-6)
    some = lag_fit.nonlinear_midas(df.withColumn("c0", F.lit(1.0)), {"a": names[:4], "b": names[4:]}, "y", degree=0)
    assert np.allclose(some.lag_weights["a"], 0.25)
    with pytest.raises(ValueError):
        lag_fit.nonlinear_midas(df.limit(0), {"a": ["c0"]}, "y")


@pytest.mark.parametrize("n", [60, 20])
def test_ridge_head_takes_the_penalty_with_the_least_later_error(spark, n):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 5))
    y = x @ np.array([1.0, 0, 0.5, 0, 0]) + rng.normal(size=n) * 3
    df = frame(spark, np.c_[x, y, rng.permutation(n)], [*"abcde", "y", "at"])
    at = np.array([r["at"] for r in df.collect()])
    rows = np.array([[r[c] for c in [*"abcde", "y"]] for r in df.collect()])[np.argsort(at)]
    z = (rows - rows.mean(0)) / rows.std(0)

    def fitted(part, p):
        m = part.mean(0)
        c = part - m
        w = np.linalg.solve(c[:, :5].T @ c[:, :5] + p * np.eye(5), c[:, :5].T @ c[:, 5])
        return w, m[5] - m[:5] @ w

    border, errors = int(n * 0.8), {}
    for p in ridge_head.PENALTIES:
        w, b = fitted(z[:border], p)
        errors[p] = ((z[border:, 5] - b - z[border:, :5] @ w) ** 2).mean()
    head = ridge_head.chosen(df, list("abcde"), "y", "at")
    want = min(errors, key=errors.get) if n >= 24 else 0.1
    assert head.penalty == want and (n < 24 or np.allclose(list(head.errors.values()), list(errors.values())))
    w, b = fitted(z, want)
    assert np.allclose(rows[:, :5] @ head.weights + head.intercept, (b + z[:, :5] @ w) * rows[:, 5].std() + rows[:, 5].mean())


def test_exact_quantiles_of_series(spark):
    rng = np.random.default_rng(4)
    rows = [("hot", float(v)) for v in np.round(rng.normal(size=3000), 2)] + [("same", 5.0)] * 2000 + [("one", 1.0), (None, 2.0), (None, 4.0), ("gap", None), ("hot", None)]
    df = spark.createDataFrame(rows, "series string, v double").repartition(5)
    values = {s: np.array([v for k, v in rows if k == s and v is not None]) for s in {k for k, _ in rows}}
    got = {r.series: (r.n, list(r.quantile)) for r in order.quantiles(df, "v", [0.0, 0.1, 0.5, 0.977, 1.0], ["series"]).collect()}
    assert got.keys() == {"hot", "same", "one", None}
    for s, (n, q) in got.items():
        assert n == len(values[s]) and np.allclose(q, np.quantile(values[s], [0.0, 0.1, 0.5, 0.977, 1.0]))
    assert order.quantiles(df, "v", 0.25).first()["quantile"] == pytest.approx(np.quantile(np.concatenate(list(values.values())), 0.25))
    by_size = {r.series: r.w for r in order.quantiles(df, "v", 0.9 + 1 / (F.col("n") + 1), ["series"], "w").collect()}
    assert by_size["one"] == 1.0 and by_size["hot"] == pytest.approx(np.quantile(values["hot"], 0.9 + 1 / 3001))
    assert order.quantiles(df.limit(0), "v", 0.5, ["series"]).count() == 0
    assert order.quantiles(df.where("series = 'gap'"), "v", 0.5).first()["quantile"] is None
