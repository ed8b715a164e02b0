"""Intervals, controls and fitted scores against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import batched, evaluate, models, shape, stats


def plain_auroc(y, p, w):
    a, b = (y == 1), (y == 0)
    won = (p[a][:, None] > p[b][None, :]) + 0.5 * (p[a][:, None] == p[b][None, :])
    both = w[a][:, None] * w[b][None, :]
    return (won * both).sum() / both.sum() if both.sum() else None


@pytest.fixture(scope="module")
def scored(spark):
    g = np.random.default_rng(11)
    y = g.integers(0, 2, 150)
    p = np.round(g.uniform(size=150) + 0.4 * y, 1)  # many ties
    return spark.createDataFrame([(i, i // 5, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "id int, ward int, y int, p double")


@pytest.mark.parametrize("kind", ["classes", "wards"])
def test_bootstrap_by_plain_resampling(scored, kind):
    """Every round of cells against a loop over rows with the same draws, also of average precision."""
    d, rounds = scored.toPandas(), 40
    drawn = batched.resampled(scored.repartition(3), "y", "p", rounds, 3, "ward" if kind == "wards" else None)
    if kind == "wards":
        names = {r.ward: r.h for r in scored.select("ward", F.xxhash64("ward").alias("h")).distinct().collect()}
        key = d["ward"].map(names).to_numpy().astype(np.int64).view(np.uint64)
        w = batched.poisson_quantile(batched._uniforms(key, rounds, 3), np.ones((len(d), 1)))
    else:  # all rows of a score and class together have a Poisson weight of their number
        cell = d["p"].to_numpy().view(np.uint64) ^ np.where(d["y"] == 1, 1, 2).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        n = d.groupby(["p", "y"])["id"].transform("size").to_numpy()
        w = batched.poisson_quantile(batched._uniforms(cell, rounds, 3), n[:, None]) / n[:, None]
    assert abs(w.mean() - 1) < 0.1
    y, p = d["y"].to_numpy(), d["p"].to_numpy()
    want = [plain_auroc(y, p, w[:, r]) for r in range(rounds)]
    assert np.allclose(drawn.auroc, want, atol=1e-9)
    for r in range(rounds):
        levels = np.unique(p)[::-1]
        up = np.cumsum([w[(p == s) & (y == 1), r].sum() for s in levels])
        all_ = np.cumsum([w[p == s, r].sum() for s in levels])
        gained = np.diff(np.concatenate([[0], up]))
        assert abs(drawn.auprc[r] - (gained * np.divide(up, all_, out=np.zeros_like(up), where=all_ > 0)).sum() / up[-1]) < 1e-9
    row = evaluate.bootstrap(scored, "y", "p", rounds, 3, "ward" if kind == "wards" else None).first()
    assert row.rounds == rounds and np.allclose([row.low, row.high], np.quantile(want, [0.025, 0.975]), atol=1e-9)


@pytest.mark.parametrize("cluster", [None, "ward"])
@pytest.mark.parametrize("fixed", [False, True])
def test_bootstrap_in_blocks(spark, scored, monkeypatch, cluster, fixed):
    """One range of many cells is drawn a few cells at a time, also where a block ends among the cells of one score."""
    if fixed and not cluster:
        pytest.skip("only clusters are drawn in a fixed number")
    monkeypatch.setattr(batched, "MOST_DRAWN", 10**9)
    whole = batched.resampled(scored, "y", "p", 40, 3, cluster, fixed)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for cells in (1, 4):
            monkeypatch.setattr(batched, "MOST_DRAWN", 40 * cells)
            own = batched.resampled(scored, "y", "p", 40, 3, cluster, fixed)
            assert np.allclose(own.auroc, whole.auroc, atol=1e-12) and np.allclose(own.auprc, whole.auprc, atol=1e-12)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


def test_bootstrap_interval_is_that_of_drawing_rows(spark):
    g = np.random.default_rng(5)
    y = g.integers(0, 2, 3000)
    p = np.round(g.normal(size=3000) + 0.5 * y, 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)] + [(None, 0.5), (1, None)], "y int, p double")
    rank = lambda i: plain_auroc(y[i], p[i], np.ones(len(i)))
    one = [rank(g.integers(0, 3000, 3000)) for _ in range(60)]
    row = evaluate.bootstrap(df, "y", "p").first()
    assert row.rounds == 200 and abs((row.high - row.low) / (3.92 * np.std(one)) - 1) < 0.35 and row.low < rank(np.arange(3000)) < row.high


def test_inverse_laws():
    u = (np.arange(20000) + 0.5) / 20000
    for mean in (0.3, 1.0, 20.0, 64.0, 65.0, 5000.0):
        x = batched.poisson_quantile(u, np.array(mean))
        assert abs(x.mean() - mean) < 0.02 * max(1, mean**0.5) and abs(x.var() / mean - 1) < 0.02
    z = batched.normal_quantile(u)
    assert abs(z.mean()) < 1e-6 and abs(z.var() - 1) < 2e-3 and abs(batched.normal_quantile(np.array([0.975]))[0] - 1.959963985) < 1e-8


def test_shuffled_labels_by_plain_pairs(scored):
    dealt = shape.permute_column(scored.select("id", "y", "p"), "y", "id", 7).toPandas()
    before = scored.toPandas()
    assert sorted(dealt["y"]) == sorted(before["y"]) and not (dealt.sort_values("id")["y"].to_numpy() == before.sort_values("id")["y"].to_numpy()).all()
    r = evaluate.shuffled_label_control(scored, "y", "p", "id", 7).first()
    assert abs(r.auroc - plain_auroc(dealt["y"].to_numpy(), dealt["p"].to_numpy(), np.ones(len(dealt)))) < 1e-9


def test_time_reversal_by_plain_slopes(spark):
    g = np.random.default_rng(2)
    rows, labels, slope, back = [], [], [], []
    for e in range(40):
        t, up = np.sort(g.choice(2000, 6, replace=False)), e % 2
        v = g.normal(0, 1, 6) + (0.001 if up else -0.0003) * t
        rows += [(e, f"2010-01-01 00:00:00 +{int(d)}", int(d), float(x)) for d, x in zip(t, v)]
        labels.append((e, up))
        slope.append(np.polyfit(t, v, 1)[0])
        back.append(np.polyfit(t.min() + t.max() - t, v, 1)[0])
    visits = spark.createDataFrame(rows, "e int, note string, d int, v double").selectExpr("e", "timestamp_seconds(1262304000 + d * 86400L) AS ts", "v")
    y = np.array([b for _, b in labels])
    r = evaluate.time_reversal_control(visits, "e", "ts", "v", spark.createDataFrame(labels, "e int, y int"), "y").first()
    one = np.ones(40)
    assert np.allclose([r.forward, r.reversed], [plain_auroc(y, np.array(slope), one), plain_auroc(y, np.array(back), one)], atol=1e-9)
    assert r.admissible and r.forward > 0.6


def test_logistic_by_newton_steps(spark):
    g = np.random.default_rng(4)
    x = g.normal(size=(600, 2)) * [1.0, 5.0]
    y = (g.uniform(size=600) < 1 / (1 + np.exp(-(x[:, 0] - 0.2 * x[:, 1] - 1.0)))).astype(int)
    df = spark.createDataFrame([(i, int(c), float(a), float(b)) for i, ((a, b), c) in enumerate(zip(x, y))], "id int, y int, a double, b double")
    got = models.logistic(df, df, "y", ["a", "b"]).orderBy("id").toPandas()["score"].to_numpy()
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    z, beta = np.c_[np.ones(600), x / x.std(0, ddof=1)], np.zeros(3)
    ridge = np.diag([0.0, 1e-4, 1e-4])
    for _ in range(30):
        q = 1 / (1 + np.exp(-z @ beta))
        beta += np.linalg.solve((z * (w * q * (1 - q))[:, None]).T @ z / w.sum() + ridge, z.T @ (w * (y - q)) / w.sum() - ridge @ beta)
    assert np.abs(got - 1 / (1 + np.exp(-z @ beta))).max() < 2e-3


def pooled(p, y):
    """Adjacent violators pooled, over distinct scores."""
    blocks = []
    for s in np.unique(p):
        blocks.append([y[p == s].mean(), (p == s).sum(), [s]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, n, own = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + m * n) / (blocks[-1][1] + n), blocks[-1][1] + n, blocks[-1][2] + own]
    return {s: m for m, _, own in blocks for s in own}


def test_calibration_pools_adjacent_violators(spark):
    g = np.random.default_rng(6)
    p = np.round(g.uniform(size=400), 2)
    y = (g.uniform(size=400) < p**2).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int")
    want = pooled(p, y)
    assert all(abs(r.calibrated - want[r.p]) < 1e-9 for r in models.calibrate(df, df, "p", "y").collect())
    one_class = models.calibrate(df.filter("y = 1"), spark.createDataFrame([(1.5,), (-1.0,), (0.3,)], "p double"), "p", "y")
    assert sorted(r.calibrated for r in one_class.collect()) == [0.0, 0.3, 1.0]
    few = models.calibrate(df.limit(40), df, "p", "y").select("p", "calibrated").distinct().orderBy("p").collect()
    assert all(a.calibrated <= b.calibrated for a, b in zip(few, few[1:])) and 0 <= few[0].calibrated <= few[-1].calibrated <= 1


def test_boosted_learns_what_no_line_can(spark):
    g = np.random.default_rng(8)
    x = g.uniform(-1, 1, size=(600, 2))
    df = spark.createDataFrame([(i, int((a > 0) != (b > 0)), float(a), float(b)) for i, (a, b) in enumerate(x)], "id int, y int, a double, b double")
    train, test = df.filter("id < 400"), df.filter("id >= 400")

    def auroc(d):
        d = d.toPandas()
        return plain_auroc(d["y"].to_numpy(), d["score"].to_numpy(), np.ones(len(d)))

    assert auroc(models.boosted(train, test, "y", ["a", "b"])) > 0.95
    assert auroc(models.logistic(train, test, "y", ["a", "b"])) < 0.7
