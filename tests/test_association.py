"""The association report against plain computations, and neighbours by buckets against the exact ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import neighbours, shape
from cohortspark.plans.association import associate
from test_batched import plain_logistic, plain_metrics


def patients(spark, n=800):
    g = np.random.default_rng(6)
    x = g.normal(size=(n, 3)) * [1, 10, 1]
    y = (x[:, 0] + 0.05 * x[:, 1] + g.normal(size=n) > 0.6).astype(int)
    x[g.uniform(size=x.shape) < 0.1] = np.nan
    rows = [(i, *(None if np.isnan(v) else float(v) for v in x[i]), None, int(y[i]), 1.0) for i in range(n)] + [(n, 1.0, 1.0, 1.0, None, 7, 1.0), (n + 1, 1.0, float("nan"), 1.0, None, 1, None)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, blank double, y int, need double").repartition(4), x, y


def test_association_by_plain_steps(spark):
    df, x, y = patients(spark)
    out = associate(df, "id", "y", ["a", "b", "c", "blank", "absent", "y", "need"], required=["need"], similar_to=F.col("id") % 25 == 0, rounds=50)
    report = {(r.section, r.item): r.value for r in out["report"].collect()}
    scores = {r.id: r for r in out["scores"].collect()}
    test = np.array([i in scores for i in range(len(y))])
    assert abs(test.mean() - 0.2) < 0.01 and abs(y[test].mean() - y.mean()) < 0.01 and report["cohort", "rows_used"] == len(y) and report["cohort", "available_features"] == 4
    fill = np.nanmedian(x[~test], 0)
    z = np.where(np.isnan(x), fill, x)
    m, s = z[~test].mean(0), z[~test].std(0)
    w = (z - m) / s
    found = {}
    for ridge in (0.01, 1.0, 100.0):
        beta = plain_logistic(np.column_stack([w[~test], np.zeros((~test).sum())]), y[~test], ridge)
        p = 1 / (1 + np.exp(-(beta[0] + w[test] @ beta[1:4])))
        found[ridge] = (*plain_metrics(y[test], p), p)
        assert np.allclose([report["candidate", f"{ridge}/{k}"] for k in ("auroc", "auprc", "brier_score")], found[ridge][:3], atol=1e-7)
    best = max(found, key=lambda r: (found[r][1], found[r][0], -r))
    assert report["metrics", "ridge"] == best and np.allclose([scores[i].p for i in np.flatnonzero(test)], found[best][3], atol=1e-7)
    assert report["metrics", "auroc_low"] < report["metrics", "auroc"] < report["metrics", "auroc_high"] and report["metrics", "train_rows"] == (~test).sum()
    ranking = {r.feature: r for r in out["ranking"].collect()}
    assert ranking["a"].rank == 1 and ranking["a"].direction == "higher_in_positive" and abs(ranking["need"].importance) < 1e-9
    for i, c in enumerate("abc"):
        assert abs(ranking[c].mean_shift - (z[test & (y == 1), i].mean() - z[test & (y == 0), i].mean())) < 1e-9
    near = {}
    for r in out["similar"].collect():
        near.setdefault(r.query_id, []).append((r.rank, r.base_id, r.d2, r.label))
    assert sorted(near) == [i for i in range(0, len(y), 25) if test[i]]
    for i, rows in near.items():
        d2 = ((w - w[i]) ** 2).sum(1)
        d2[i] = np.inf
        exact = sorted(zip(d2, range(len(d2))))[:3]
        assert len(rows) == 3 and all(label == y[b] for _, b, _, label in rows) and abs(sorted(rows)[0][2] - d2[sorted(rows)[0][1]]) < 1e-9 and len({b for _, b, _, _ in rows} & {b for _, b in exact}) >= 1


def test_too_few_cases_say_so(spark):
    df, _, _ = patients(spark, 200)
    for part, why in ((df.filter("id < 50"), "rows"), (df.filter("y = 0 OR id < 20"), "positive"), (df.select("id", "y"), "features")):
        with pytest.raises(ValueError, match=why):
            associate(part, "id", "y", ["a", "b", "c"])


def test_neighbours_by_buckets(spark):
    g = np.random.default_rng(1)
    centre = g.normal(size=(40, 16)) * 3
    x = centre[g.integers(0, 40, 6000)] + g.normal(size=(6000, 16)) * 0.6
    x[1000:3000] = x[7]  # a third of the rows share one vector
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9000, None)], "id long, v array<double>").repartition(6)
    asked = df.filter("id % 50 = 0")
    found = neighbours.knn_by_buckets(asked, df, "id", "id", "v", 3, bucket=64)
    exact = shape.knn(asked.filter("v IS NOT NULL"), df.filter("v IS NOT NULL"), "id", "id", "v", 3)
    assert neighbours.recall(found, exact).first().recall >= 0.9
    for r in found.collect():
        assert r.query_id != r.base_id and abs(r.d2 - ((x[r.query_id] - x[r.base_id]) ** 2).sum()) < 1e-9
    same = {r.base_id for r in found.filter("query_id = 2000").collect()}
    assert same == {7, 1000, 1001}
    # All in one bucket: the exact answer, also when it is dealt over blocks.
    block, neighbours.BLOCK = neighbours.BLOCK, 500
    try:
        one = neighbours.knn_by_buckets(asked, df, "id", "id", "v", 3, bucket=10**9)
        assert sorted(map(tuple, one.select("query_id", "rank", "base_id").collect())) == sorted(map(tuple, exact.select("query_id", "rank", "base_id").collect()))
    finally:
        neighbours.BLOCK = block
    assert neighbours.knn_by_buckets(asked, df.filter("false"), "id", "id", "v").count() == 0
