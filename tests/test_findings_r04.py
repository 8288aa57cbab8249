"""What the fourth review found: the case took other work before."""

import numpy as np
from pyspark import RDD

from tidewater.operators import boosting


def drawn(spark, n, parts):
    draw = np.random.default_rng(8)
    x = draw.integers(0, 6, (n, 2)).astype(float)
    x[::31, 1] = np.nan
    y = np.round(x[:, 0] * draw.normal(size=n) + draw.exponential(3, n), 2)  # many are equal
    y[::3] = 2.5
    return spark.createDataFrame([(float(a), None if b != b else float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double").repartition(parts)


def test_a_tree_of_few_cells_copies_no_rows_and_takes_two_jobs(spark, monkeypatch):
    df, kept, jobs = drawn(spark, 6_000, 3), [], []
    persist, collect = RDD.persist, RDD.collect
    monkeypatch.setattr(RDD, "persist", lambda self, *how: kept.append(1) or persist(self, *how))
    monkeypatch.setattr(RDD, "collect", lambda self: jobs.append(1) or collect(self))
    counts = []
    for trees in (1, 6):
        kept.clear(), jobs.clear()
        boosting.fit(df, ["a", "b"], "y", (0.1, 0.5), trees=trees, depth=3)
        counts.append((len(kept), len(jobs)))
    assert counts[0][0] == counts[1][0] == 1  # rows are kept once, not once a tree
    assert counts[1][1] - counts[0][1] <= 5 * 2


def test_trees_of_few_cells_are_those_of_many(spark, monkeypatch):
    df, how = drawn(spark, 6_000, 4), {"quantiles": (0.05, 0.5, 0.9), "trees": 5, "depth": 4, "partitions": 4}
    monkeypatch.setattr(boosting, "CUTS", 8)
    monkeypatch.setattr(boosting, "NEAR", 1)
    many = boosting.fit(df, ["a", "b"], "y", most_cells=0, **how)
    for sent, parts in ((1024, 256), (3, 4)):  # few residuals are sent: leaves are narrowed down by counts
        few = boosting.fit(df, ["a", "b"], "y", sent=sent, parts=parts, **how)
        assert few.trees == many.trees and (few.start == many.start).all()


def test_forecasts_by_cell_are_those_of_rows(spark):
    draw = np.random.default_rng(9)
    x = draw.normal(size=(800, 10)).round(1)
    names = [f"c{i}" for i in range(10)]
    df = spark.createDataFrame([(*map(float, r), float(r.sum())) for r in x], ", ".join(f"{c} double" for c in [*names, "y"])).repartition(2)
    m = boosting.fit(df, names, "y", (0.2, 0.8), trees=3, depth=3)
    rows = m.predict(df).collect()
    codes = np.stack([np.searchsorted(e, [r[c] for r in rows], "left") for c, e in zip(names, m.edges, strict=True)], 1).astype(np.uint8)
    assert (np.sort(m.forecasts(codes), 0) == np.array([[r.q_20, r.q_80] for r in rows]).T).all()
