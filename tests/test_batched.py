"""Batched fits against plain refits, one after another."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import batched


def plain_logistic(x, y, ridge=1.0, balanced=True):
    w = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum())) if balanced else np.ones(len(y))
    z, beta = np.concatenate([np.ones((len(x), 1)), x], 1), np.zeros(x.shape[1] + 1)
    r = np.diag([0.0] + [ridge] * x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ beta))
        beta = beta - np.linalg.solve(z.T @ (z * (w * p * (1 - p))[:, None]) + r, z.T @ (w * (p - y)) + r @ beta)
    return beta


def plain_metrics(y, p):
    won = (p[y == 1][:, None] > p[y == 0]).sum() + 0.5 * (p[y == 1][:, None] == p[y == 0]).sum()
    order = np.unique(p)[::-1]
    tp, n = np.array([((p >= s) & (y == 1)).sum() for s in order]), np.array([(p >= s).sum() for s in order])
    ap = (np.diff(np.concatenate([[0], tp])) * tp / n).sum() / max(1, (y == 1).sum())
    return won / max(1, (y == 1).sum() * (y == 0).sum()), ap, ((p - y) ** 2).mean()


def grouped(seed=4):
    g = np.random.default_rng(seed)
    n = 700
    x = g.normal(size=(n, 3)) * [1, 50, 1] + [0, 1000, 3]
    y = (x[:, 0] + 0.02 * (x[:, 1] - 1000) + g.normal(size=n) > 0.4).astype(float)
    x[g.uniform(size=x.shape) < 0.1] = np.nan
    group = g.choice(["a", "b", "c", "d"], n)
    y[group == "d"] = 0  # a group of one class
    return x, y, group


def test_refits_of_every_group_by_plain_loops(spark):
    x, y, group = grouped()
    rows = [(i, *(None if np.isnan(v) else float(v) for v in x[i]), float(y[i]), None if i % 97 == 0 else str(group[i])) for i in range(len(y))]
    rows += [(1000, 1.0, float("nan"), 2.0, 5.0, "a"), (1001, 1.0, 2.0, 2.0, None, "e")]  # labels that are none
    d = spark.createDataFrame(rows, "id int, u double, v double, w double, y double, g string").repartition(5)
    got = {r.fold: r for r in batched.refit_leave_one_group_out(d, "g", "y", ["u", "v", "w"], rounds=50).collect()}
    own = np.array([r[5] for r in rows[:-2]], object)
    all_y, all_p = [], []
    for k in "abcd":
        test, train = own == k, own != k
        fill = np.nanmedian(x[train], 0)
        filled = np.where(np.isnan(x), fill, x)
        m, s = filled[train].mean(0), filled[train].std(0)
        z = (filled - m) / s
        beta = plain_logistic(z[train], y[train])
        p = 1 / (1 + np.exp(-(beta[0] + z[test] @ beta[1:])))
        auc, ap, brier = plain_metrics(y[test], p)
        r = got[k]
        assert (r.rows, r.positives, r.train_rows, r.train_positives) == (test.sum(), y[test].sum(), train.sum(), y[train].sum())
        assert (r.auroc is None) == (k == "d") and (k == "d" or abs(r.auroc - auc) < 1e-9) and abs(r.auprc - ap) < 1e-6 and abs(r.brier_score - brier) < 1e-6
        all_y.append(y[test])
        all_p.append(p)
    auc, ap, brier = plain_metrics(np.concatenate(all_y), np.concatenate(all_p))
    r = got["pooled"]
    assert abs(r.auroc - auc) < 1e-9 and abs(r.auprc - ap) < 1e-6 and abs(r.brier_score - brier) < 1e-6 and r.auroc_low <= r.auroc_high and set(got) == {"a", "b", "c", "d", "pooled"}


def test_jobs_do_not_grow_with_groups(spark):
    x, y, _ = grouped()

    def jobs(groups):
        tag = f"groups-{groups}"
        d = spark.createDataFrame([(float(a), float(b), i % groups) for i, (a, b) in enumerate(zip(np.nan_to_num(x[:, 0]), y))], "u double, y double, g int").repartition(2)
        spark.sparkContext.addJobTag(tag)
        batched.refit_leave_one_group_out(d, "g", "y", ["u"], rounds=10).count()
        spark.sparkContext.removeJobTag(tag)
        return len(spark.sparkContext.statusTracker().getJobIdsForTag(tag)) if hasattr(spark.sparkContext.statusTracker(), "getJobIdsForTag") else 0

    assert abs(jobs(4) - jobs(25)) <= 8  # Newton steps may differ by a few


def test_linear_probe_by_plain_loops(spark):
    g = np.random.default_rng(9)
    x = g.normal(size=(600, 5))
    first, second = (x[:, 0] + g.normal(size=600) > 0.5).astype(int), (x[:, 1] > 1.0).astype(int)
    rows = [(i, [float(v) for v in x[i]], int(first[i]), None if i % 7 == 0 else int(second[i]), int(i < 20)) for i in range(600)]
    d = spark.createDataFrame(rows, "id int, v array<double>, a int, b int, few int")
    out = batched.linear_probe(d, "id", "v", {"a": F.col("a"), "b": F.col("b"), "few": F.col("few")}).collect()
    got = {(r.label, r.fold): r for r in out}
    assert got["few", "all"].status == "not_evaluated" and "fewer than 50" in got["few", "all"].reason and ("few", "0") not in got
    hashes = {(r.label, r.id): r.h for r in d.select("id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("label")).select("id", "label", F.xxhash64(F.lit(0), "id", "label").alias("h")).collect()}
    for name, y in (("a", first), ("b", second)):
        known = np.array([i for i in range(600) if name == "a" or i % 7])
        fold = {}
        for c in (0, 1):
            for at, i in enumerate(sorted((i for i in known if y[i] == c), key=lambda i: hashes[name, i])):
                fold[i] = at % 5
        fold = np.array([fold[i] for i in known])
        p = np.empty(len(known))
        for k in range(5):
            beta = plain_logistic(x[known][fold != k], y[known][fold != k])
            p[fold == k] = 1 / (1 + np.exp(-(beta[0] + x[known][fold == k] @ beta[1:])))
            auc, ap, brier = plain_metrics(y[known][fold == k], p[fold == k])
            r = got[name, str(k)]
            assert abs(r.auroc - auc) < 1e-6 and abs(r.auprc - ap) < 1e-6 and abs(r.brier_score - brier) < 1e-6
        auc, ap, brier = plain_metrics(y[known], p)
        r = got[name, "all"]
        assert abs(r.auroc - auc) < 1e-6 and abs(r.auprc - ap) < 1e-6 and (r.positives, r.negatives) == ((y[known] == 1).sum(), (y[known] == 0).sum())
    assert batched.linear_probe(d.filter("false"), "id", "v", {"a": F.col("a")}).count() == 0


def test_importance_is_that_of_plain_permutations(spark):
    g = np.random.default_rng(3)
    x = g.normal(size=(900, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + g.normal(size=900) > 1).astype(int)
    predict = lambda v: v[:, 0] + 0.5 * v[:, 1]
    d = spark.createDataFrame([(i, *map(float, x[i]), int(y[i])) for i in range(900)] + [(1000, 1.0, 1.0, 1.0, None)], "id int, a double, b double, c double, y int")
    got = {r.feature: r for r in batched.permutation_importance(d, "y", ["a", "b", "c"], "id", predict, 10, block=200).collect()}
    base = plain_metrics(y, predict(x))[1]
    for i, name in enumerate("abc"):
        loss = []
        for _ in range(20):
            z = x.copy()
            z[:, i] = g.permutation(z[:, i])
            loss.append(base - plain_metrics(y, predict(z))[1])
        assert abs(got[name].importance - np.mean(loss)) < 5 * (np.std(loss) + 1e-9) / 10**0.5 + 1e-9
    assert got["c"].importance == 0 and got["c"].sd == 0


def test_too_many_sums_are_refused(spark):
    with pytest.raises(ValueError, match="fit fewer"):
        batched.sums_over(spark.range(3), lambda b: np.zeros((10**4, 10**4)), (10**4, 10**4))


def test_rank_factors_by_plain_scores(spark):
    import pandas as pd
    from statistics import NormalDist

    g = np.random.default_rng(8)
    x = g.normal(size=(400, 4))
    x[:, 1] = np.round(x[:, 0] + 0.5 * x[:, 1], 1)
    x[:, 3] = 2.0
    x[g.uniform(size=x.shape) < 0.1] = np.nan
    x[:, 3] = np.where(np.isnan(x[:, 3]), np.nan, 2.0)
    x[:5] = np.nan
    rows = [(i, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)]
    d = spark.createDataFrame(rows, "id int, a double, b double, c double, k double").repartition(3)
    got = batched.rank_factors(d, {"all": F.lit(True), "even": F.col("id") % 2 == 0, "none": F.col("id") < 0}, ["a", "b", "c", "k"])
    assert sorted(got) == ["all", "even"]
    for name, own in (("all", x), ("even", x[::2])):
        f = pd.DataFrame(own)
        u = f.rank(method="average", pct=True).clip(0.001, 0.999).fillna(0.5)
        z = u.map(NormalDist().inv_cdf).to_numpy()
        z[:, 3] = np.where(np.isnan(own[:, 3]), 0.0, z[:, 3])
        m = np.nan_to_num(np.corrcoef(z, rowvar=False))
        np.fill_diagonal(m, 1)
        w, v = np.linalg.eigh((m + m.T) / 2)
        m = v @ np.diag(np.maximum(w, 1e-4)) @ v.T
        m = m / np.sqrt(np.outer(np.diag(m), np.diag(m)))
        np.fill_diagonal(m, 1)
        assert np.abs(got[name] - np.linalg.cholesky((m + m.T) / 2 + np.eye(4) * 1e-8)).max() < 1e-9
