"""Whole jobs against brute force and planted answers."""

from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import batched, evaluate, models, shape
from cohortspark.plans import jobs
from cohortspark.sources import io


def blobs(spark, n=40, centres=((0.0, 0.0), (9.0, 0.0), (0.0, 9.0))):
    g = np.random.default_rng(5)
    rows = [(i * n + j, [float(z) for z in g.normal(c, 0.5)], i) for i, c in enumerate(centres) for j in range(n)]
    return spark.createDataFrame(rows, "id long, v array<double>, c int")


def test_cluster_grid_finds_planted_groups_and_records_failures(spark):
    d = blobs(spark)
    grid, labels = jobs.cluster_grid(d, "id", "v", ["kmeans", "unheard of"], [3])
    rows = {r.candidate: r for r in grid.collect()}
    assert rows["unheard of-3"].status == "failed" and rows["unheard of-3"].error
    r = rows["kmeans-3"]
    assert (r.clusters, r.seed_ari, r.part_ari) == (3, 1.0, 1.0) and abs(r.least_share - 1 / 3) < 1e-12
    assert r.calinski_harabasz > 5 * r.null_calinski_harabasz
    got = labels["kmeans-3"].join(d, "id").groupBy("c").agg(F.count_distinct("cluster").alias("n")).collect()
    assert [x.n for x in got] == [1, 1, 1]


def test_cluster_index_in_one_pass(spark):
    """Before, rows were read several times, each as a row a coordinate."""
    d, seen = blobs(spark), spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def counted(x):
        seen.add(1)
        return True

    got = models.cluster_indices(d.filter(counted("id")), "v", "c").first()[0]
    p = d.toPandas()
    x, c = np.stack(p.v), p.c.to_numpy()
    within = sum(((x[c == k] - x[c == k].mean(0)) ** 2).sum() for k in set(c))
    want = ((((x - x.mean(0)) ** 2).sum() - within) / 2) / (within / (len(x) - 3))
    assert abs(got / want - 1) < 1e-12 and seen.value == len(x)
    with pytest.raises(ZeroDivisionError) as e:
        models.cluster_indices(d.filter("c = 0"), "v", "c").first()
    assert models.is_fit_failure(e.value)


def test_shuffled_coordinates_keep_margins(spark):
    d = blobs(spark, 20)
    got = jobs.shuffled_coordinates(d, "id", "v").toPandas().sort_values("id")
    want = d.toPandas().sort_values("id")
    a, b = np.stack(got.v), np.stack(want.v)
    assert got.id.tolist() == want.id.tolist() and np.array_equal(np.sort(a, 0), np.sort(b, 0)) and not np.array_equal(a, b)


def test_silhouette_in_small_blocks(spark):
    """Many blocks give what one would; a row alone in its cluster, and one cluster only, give NULL."""
    d = blobs(spark, 8).unionByName(spark.createDataFrame([(900, [50.0, 50.0], 7)], "id long, v array<double>, c int"))
    p = d.toPandas()
    x, c = np.stack(p.v), p.c.to_numpy()
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = {}
    for i in range(len(x)):
        own = (c == c[i]) & (np.arange(len(x)) != i)
        a = dist[i, own].mean() if own.any() else None
        b = min(dist[i, c == o].mean() for o in set(c) if o != c[i])
        want[int(p.id[i])] = None if a is None else (b - a) / max(a, b)
    got = {r.id: r.silhouette for r in evaluate.silhouette(d, d, "id", "v", "c", block=5).collect()}
    assert got.keys() == want.keys() and got[900] is None
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items() if v is not None)
    one = d.filter("c = 0")
    assert {r.silhouette for r in evaluate.silhouette(one, one, "id", "v", "c").collect()} == {None}


def test_normal_scores_and_their_correlation(spark):
    g = np.random.default_rng(2)
    a = g.integers(0, 12, 300).astype(float)
    b = a + g.normal(0, 4, 300)
    a[::11] = np.nan
    p = pd.DataFrame({"id": range(300), "a": a, "b": b, "k": 1.0})
    d = spark.createDataFrame([(i, None if np.isnan(x) else float(x), float(y), 1.0) for i, x, y in zip(p.id, a, b)], "id int, a double, b double, k double")
    want = {c: p[c].rank(pct=True).clip(0.001, 0.999).fillna(0.5).map(NormalDist().inv_cdf).to_numpy() for c in "abk"}
    got = models.normal_scores(d, ["a", "b"]).toPandas().sort_values("id")
    assert all(np.allclose(got[f"{c}_normal"], want[c]) for c in "ab")
    f = models.rank_correlation_factor(d, ["a", "b", "k"])  # a constant column is correlated with nothing
    m = f @ f.T
    assert np.allclose(np.diag(m), 1, atol=1e-6) and abs(m[0, 1] - np.corrcoef(want["a"], want["b"])[0, 1]) < 1e-6 and abs(m[0, 2]) < 1e-9


def test_score_records_by_plain_components(spark):
    g = np.random.default_rng(4)
    x = g.normal(size=(200, 5)) @ g.normal(size=(5, 5))
    x[150:, 2] += 20  # the odd ones
    cols = [f"f{i}" for i in range(5)]
    rows = [(i, *(None if (i + j) % 23 == 0 else float(z) for j, z in enumerate(r))) for i, r in enumerate(x)]
    d = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in cols))
    p = d.toPandas()
    train = p[p.id < 150][cols]
    z = p[cols].fillna(train.median())
    t = z[p.id < 150]
    v = ((z - t.mean()) / t.std(ddof=0)).to_numpy()
    w, e = np.linalg.eigh(np.cov(v[:150].T))
    axes = e[:, np.argsort(-w)[:3]]
    r = (v - v @ axes @ axes.T) ** 2
    err = r.mean(1)
    for q in jobs.score_records(d.filter("id < 150"), d, "id", cols, 3, 2).collect():
        assert abs(q.error - err[q.id]) < 1e-8 and q.fields == [cols[j] for j in np.argsort(-r[q.id])[:2]]
        assert abs(q.percentile - 100 * (err[:150] <= err[q.id] + 1e-12).mean()) < 0.7


def test_tree_replay_sends_nulls_where_the_node_says(spark):
    nodes = spark.createDataFrame([(0, 0, 0, 1.0, 1, 2, False, 0.0), (0, 1, -1, 0.0, -1, -1, False, 5.0), (0, 2, -1, 0.0, -1, -1, False, 7.0)], "tree int, node int, feature int, threshold double, left int, right int, missing_left boolean, value double")
    d = spark.createDataFrame([(1, 1.0), (2, 1.5), (3, None)], "id long, x double")
    run = lambda n: {r.id: r.raw for r in jobs.replay_trees(d, "id", ["x"], n).collect()}
    assert run(nodes) == {1: 5.0, 2: 7.0, 3: 7.0} and run(nodes.withColumn("missing_left", F.lit(True)))[3] == 5.0
    assert jobs.replay_trees(d.filter("false"), "id", ["x"], nodes).count() == 0


def test_splits_keep_patients_together(spark):
    d = spark.createDataFrame([(i, i % 97, 1990 + i % 20) for i in range(2000)], "id int, who int, yr int")
    late, manifest = jobs.build_splits(d, "who", "yr", 2008)
    rows = {r.split: r for r in manifest.collect()}
    assert sum(r.rows for r in rows.values()) == 2000 and rows["temporal"].first_year == 2008 and max(rows[s].last_year for s in ("train", "validation", "test")) < 2008
    assert late.filter("split <> 'temporal'").groupBy("who").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    capped, _ = jobs.build_splits(d, "who", "yr", 1995)  # beyond the cap the years' quantile decides
    assert capped.filter("split = 'temporal'").count() <= 500


def test_predictive_baseline_skips_with_reason_and_learns(spark):
    g = np.random.default_rng(8)
    x = g.normal(size=600)
    y = (x + g.normal(size=600) * 0.5 > 0).astype(int)
    d = spark.createDataFrame([(i, float(a), int(b), int(b) if i < 30 else None) for i, (a, b) in enumerate(zip(x, y))], "id int, x double, y int, few int")
    r = {q.target: q for q in jobs.predictive_baseline(d, "id", ["y", "few", "gone"], ["x"]).collect()}
    assert (r["gone"].status, r["gone"].reason, r["few"].reason, r["few"].rows_used) == ("skipped", "target column absent", "too few rows", 30)
    assert r["y"].status == "fitted" and r["y"].auroc > 0.9 and r["y"].accuracy > r["y"].baseline_accuracy + 0.2


def test_risk_pipeline_sorts_rows_once_a_model(spark, monkeypatch):
    """Labels are dealt once for all models and splits; both hashes of every model and split were sorted before. The control is that of each split alone."""
    g, n = np.random.default_rng(8), 900
    x = g.integers(0, 5, n)
    d = spark.createDataFrame([(i, float(v), int(g.uniform() < 0.1 + 0.2 * v), ("train", "validation", "test")[i % 3]) for i, v in enumerate(x)], "id long, x double, y int, part string")
    fit = lambda a, b: b.withColumn("score", F.col("x") / 5)
    ranged, sizes = shape.ranged, []
    monkeypatch.setattr(shape, "ranged", lambda df, *more, **kw: (r := ranged(df, *more, **kw), sizes.append(r.count()))[0])
    rows = {(r.model, r.split): r for r in jobs.risk_pipeline(d, "id", "y", "part", {"a": fit, "b": fit}).collect()}
    assert len(rows) == 4 and sum(s for s in sizes if s >= 300) <= 3 * 600
    for (_, part), r in rows.items():
        own = d.filter(F.col("part") == part)
        cal = models.calibrate(d.filter("part = 'validation'").withColumn("score", F.col("x") / 5), own.withColumn("score", F.col("x") / 5), "score", "y")
        assert r.n == 300 and r.events == own.agg(F.sum("y")).first()[0]
        assert abs(r.control - evaluate.shuffled_label_control(cal, "y", "calibrated", "id").first()[0]) < 1e-9
        assert abs(r.brier - cal.agg(F.avg((F.col("calibrated") - F.col("y")) ** 2)).first()[0]) < 1e-9
        assert abs(r.intercept - cal.agg(F.avg("y") - F.avg("calibrated")).first()[0]) < 1e-9


def test_risk_pipeline_selects_what_works(spark):
    """A model of the signal beats one of noise; the choice is made on validation; shuffled labels give about one half."""
    g = np.random.default_rng(9)
    x, z = g.normal(size=2400), g.normal(size=2400)
    y = (g.uniform(size=2400) < 1 / (1 + np.exp(-2 * x))).astype(int)
    d = spark.createDataFrame([(i, float(a), float(b), int(c), ["train", "train", "validation", "test"][i % 4]) for i, (a, b, c) in enumerate(zip(x, z, y))], "id int, x double, z double, y int, part string")
    fit = lambda cols: lambda a, b: models.logistic(a, b, "y", cols)
    rows = {(r.model, r.split): r for r in jobs.risk_pipeline(d, "id", "y", "part", {"noise": fit(["z"]), "signal": fit(["x"])}).collect()}
    assert rows["signal", "test"].selected and not rows["noise", "test"].selected and rows["signal", "test"].auroc > 0.8
    assert all(abs(r.control - 0.5) < 0.08 for r in rows.values()) and rows["signal", "test"].n == 600
    assert 0.3 < rows["signal", "test"].slope < 1.35  # the steps of the isotonic fit reach 0 and 1, which flattens the line


def test_permutation_importance_ranks_the_signal(spark):
    g = np.random.default_rng(1)
    x, z = g.normal(size=500), g.normal(size=500)
    d = spark.createDataFrame([(i, float(a), float(b), int(a > 0.5)) for i, (a, b) in enumerate(zip(x, z))], "id int, x double, z double, y int")
    r = {q.feature: q for q in batched.permutation_importance(d, "y", ["x", "z"], "id", lambda v: v[:, 0] + 0.01 * v[:, 1], 2).collect()}
    assert r["x"].importance > 0.3 and abs(r["z"].importance) < 0.05


def test_baseline_report_agrees_with_plain_numbers(spark):
    d = blobs(spark, 60).unionByName(spark.createDataFrame([(5000 + i, [30.0 + i, -30.0 * i], 9) for i in range(1, 5)], "id long, v array<double>, c int"))
    p, f = (df.toPandas().set_index("id") for df in (models.pca_deviation(d, "id", "v", 1), models.isolation_forest(d, "id", "v", 30)))
    train = p.index % 10 < 7
    e = p.reconstruction_error
    m = e[train].median()
    z = ((e - m) / max(1.4826 * (e[train] - m).abs().median(), 1e-8)).clip(lower=0)[~train]
    s = f.isolation_score.reindex(p.index)[~train]
    top = lambda v: v >= v.quantile(0.95)
    want = {("pca", "mean"): z.mean(), ("pca", "p95"): z.quantile(0.95), ("isolation", "p50"): s.median(), ("agreement", "spearman"): z.rank().corr(s.rank()), ("agreement", "jaccard"): (top(z) & top(s)).sum() / (top(z) | top(s)).sum()}
    got = {(r["item"], r.measure): r.value for r in jobs.baseline_report(d, "id", "v", F.col("id") % 10 < 7, 1, 30).collect()}
    assert len(got) == 8 and all(np.isclose(got[k], v, rtol=1e-6) for k, v in want.items())


def test_profile_model_refuses_small_profiles(spark):
    with pytest.raises(ValueError, match="few"):
        jobs.profile_model(spark.range(300).withColumn("v", F.rand(1)), {"few": F.col("id") < 10}, ["v"], [], [0.5])


def test_export_tables_read_the_wanted_columns(spark, tmp_path):
    (tmp_path / "patients.csv").write_text("Id,DEATHDATE,NAME\na,,x\nb,2001-02-03,y\n")
    (tmp_path / "conditions.csv").write_text("PATIENT,CODE,START\na,12,2000-01-01\nb,123,2000-01-02\n")
    t = io.export_tables(spark, str(tmp_path), {"patients": ["Id", "DEATHDATE"], "conditions": ["PATIENT", "CODE"]})
    assert t["patients"].columns == ["Id", "DEATHDATE"] and [tuple(r) for r in t["patients"].orderBy("Id").collect()] == [("a", None), ("b", "2001-02-03")]
    assert [r.PATIENT for r in io.code_filter(t["conditions"], "CODE", ["12"]).collect()] == ["a"]


def test_rank_agreement_of_a_constant_is_unknown(spark):
    from cohortspark.operators.stats import spearman

    d = spark.createDataFrame([(float(i), 1.0, float(-i)) for i in range(9)], "a double, k double, b double")
    assert spearman(d, "a", "k").first().spearman is None and abs(spearman(d, "a", "b").first().spearman + 1) < 1e-12


def test_sources_rebuild_only_when_stale(spark, tmp_path):
    calls = []

    def build(d):
        calls.append(1)
        return d.groupBy().agg(F.sum("id").alias("n"))

    run = lambda n, settings="a": io.rebuilt(spark.range(n), str(tmp_path / "kept"), build, settings).first().n
    assert [run(5), run(5), run(6), run(6, "b"), run(6, "b")] == [10, 10, 15, 15, 15] and len(calls) == 3


def test_csv_candidate_and_blocking_report(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,2\n3,4\n")
    found, status = io.first_readable(spark, [str(tmp_path / "none.csv"), str(tmp_path / "t.csv")])
    assert found.count() == 2 and [(r.status, r.rows, r.columns) for r in status.collect()] == [("missing", 0, 0), ("loaded", 2, 2)]
    with pytest.raises(ValueError):
        io.write_report(spark.createDataFrame([("rows", "blocking")], "section string, level string"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 1


def test_components_by_plain_eigenvectors(spark):
    """Reconstruction errors and the chart's points are those of the covariance's eigenvectors; signs are any."""
    g = np.random.default_rng(6)
    x = g.normal(size=(120, 4)) @ g.normal(size=(4, 4))
    d = spark.createDataFrame([(i, r.tolist(), i % 3) for i, r in enumerate(x)], "id long, v array<double>, c int")
    v = x - x.mean(0)
    w, e = np.linalg.eigh(v.T @ v)
    axes = e[:, np.argsort(-w)[:2]]
    want = ((v - v @ axes @ axes.T) ** 2).mean(1)
    assert all(abs(r.reconstruction_error - want[r.id]) < 1e-9 for r in models.pca_deviation(d, "id", "v", 2).collect())
    p = models.projection_2d(d, "id", "v", "c").toPandas()
    assert len(p) == 120 and list(p.columns) == ["x", "y", "c"]
    assert all(np.allclose(np.sort(p[n].abs()), np.sort(np.abs(v @ axes[:, j]))) for j, n in enumerate("xy"))
    assert models.projection_2d(d, "id", "v", "c", 10).count() == 10


def test_mixture_and_isolation_find_what_is_planted(spark):
    d = blobs(spark)
    m = models.mixture(d, "v", 3, seed=3)
    assert m.groupBy("c").agg(F.count_distinct("cluster").alias("n")).agg(F.max("n")).first()[0] == 1 and m.agg(F.min("confidence")).first()[0] > 0.99
    odd = d.unionByName(spark.createDataFrame([(999, [40.0, 40.0], 5)], "id long, v array<double>, c int"))
    assert models.isolation_forest(odd, "id", "v", 50).orderBy(F.desc("isolation_score")).first().id == 999
