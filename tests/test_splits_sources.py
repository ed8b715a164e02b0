"""Splits, samples and sources by plain rules: what SQL cannot draw is checked for what it promises."""

import json
from collections import Counter

import pytest

from cohortspark.operators import models as M
from cohortspark.operators import shape as H
from cohortspark.sources import io as IO


@pytest.fixture(scope="module")
def people(spark):
    return spark.range(3000).selectExpr("id", "id % 700 AS who", "IF(id % 10 < 3, 1, 0) AS y", "CAST(id % 97 AS double) AS x").repartition(5)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_group_split_keeps_entities_whole(people):
    f = lambda d: H.group_split(d, "who", [("train", 0.7), ("validation", 0.15), ("test", 0.15)], 3)
    got = f(people)
    assert H.overlap(got, "who", "split").count() == 0 and got.count() == 3000
    n = Counter(r.split for r in got.dropDuplicates(["who"]).collect())
    assert abs(n["train"] / 700 - 0.7) < 0.06 and set(n) == {"train", "validation", "test"}
    assert rows(got) == rows(f(people.repartition(2)))


def test_stratified_split_and_folds_have_exact_sizes(people):
    n = Counter((r.y, r.test) for r in H.stratified_split(people, "y", "id", 0.2).collect())
    assert n == {(1, True): 180, (1, False): 720, (0, True): 420, (0, False): 1680}
    folds = Counter((r.y, r.fold) for r in H.stratified_folds(people, "y", "id", 5).collect())
    assert folds == {(y, k): 180 if y else 420 for y in (0, 1) for k in range(5)}


def test_samples_do_not_depend_on_partitions(people):
    a, b = (H.capped_sample(d, "id", 100, 4) for d in (people, people.repartition(7)))
    assert rows(a) == rows(b) and a.count() == 100
    assert abs(people.filter(H.uniform(1, "id") < 0.8).count() / 3000 - 0.8) < 0.03


def test_permutation_keeps_the_values(people):
    got = {r.id: r.x for r in H.permute_column(people, "x", "id", 2).collect()}
    was = {r.id: r.x for r in people.collect()}
    assert Counter(got.values()) == Counter(was.values()) and sum(got[i] == was[i] for i in was) < 100


def test_poisson_weights(people):
    w = H.poisson_weights(people.select("id"), ["id"], 20).groupBy("round").sum("weight").collect()
    assert len(w) == 20 and all(abs(r[1] / 3000 - 1) < 0.1 for r in w)


def test_temporal_holdout_cap(people):
    d = people.selectExpr("id", "CAST(2000 + id % 10 AS int) AS year")
    late = H.temporal_holdout(d, "year", 2009)
    assert {r.year for r in late.filter("temporal").collect()} == {2009}
    capped = H.temporal_holdout(d, "year", 2002)
    assert capped.filter("temporal").count() <= 0.25 * 3000


def test_isolation_forest_does_not_depend_on_partitions(spark):
    d = spark.range(900).selectExpr("id", "array(CAST(id % 13 + IF(id = 5, 400, 0) AS double), CAST(id % 7 + IF(id = 5, 400, 0) AS double)) AS v")
    a, b = ({r.id: round(r.isolation_score, 9) for r in M.isolation_forest(x, "id", "v", trees=60).collect()} for x in (d.repartition(3), d.repartition(6)))
    assert a == b and sum(v >= a[5] for v in a.values()) <= 90  # the outlier is among the tenth of the highest scores


def test_models_take_null_features(spark):
    d = spark.range(300).selectExpr("id", "CAST(id % 2 AS int) AS y", "IF(id % 11 = 0, NULL, CAST(id % 2 AS double) + 0.1 * (id % 5)) AS x")
    got = M.logistic(d, d, "y", ["x"]).filter("x IS NOT NULL")
    assert got.filter("(score >= 0.5) = (y = 1)").count() == got.count()
    assert M.fit_impute(d.withColumn("none", d.x * None), ["x", "none"])["none"] == (0.0, True)


def test_sources(spark, tmp_path, people):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,\n")
    d = IO.read_csv(spark, str(tmp_path / "a.csv"))
    assert rows(d) == [(1, "x"), (2, None)] and IO.is_ready(d, ["id"]) and not IO.is_ready(d, ["id", "z"])
    assert IO.guarded_csv(spark, str(tmp_path / "a.csv")).count() == 2
    (tmp_path / "b.txt").write_text("id\n1\n")
    (tmp_path / "empty.csv").write_text("")
    for bad, limits in (("b.txt", {}), ("empty.csv", {}), ("a.csv", {"most_bytes": 3}), ("a.csv", {"most_rows": 1})):
        with pytest.raises(ValueError):
            IO.guarded_csv(spark, str(tmp_path / bad), **limits)
    (tmp_path / "c.json").write_text(json.dumps({"version": 1, "entries": [{"a": 1}, {"a": 2}]}))
    assert rows(IO.read_catalogue(spark, str(tmp_path / "c.json"))) == [(1,), (2,)]
    for b, status in (("one", "complete"), ("two", "failed")):
        IO.write_table(people.limit(3).select("id"), str(tmp_path / f"t_{b}"))
        (tmp_path / f"m_{b}.json").write_text(json.dumps({"path": str(tmp_path / f"t_{b}"), "batch": b, "seed": 1, "status": status}))
    assert {r.source_batch for r in IO.read_batches(spark, str(tmp_path / "m_*.json")).collect()} == {"one"}
    with pytest.raises(FileNotFoundError):
        IO.read_batches(spark, str(tmp_path / "m_two.json"))
    found, status = IO.first_readable(spark, [str(tmp_path / "absent"), str(tmp_path / "t_one")])
    assert found.count() == 3 and [r.status for r in status.collect()] == ["missing", "loaded"]
    assert IO.file_fingerprints(spark, str(tmp_path / "a.csv")).first().length == 15
    assert rows(IO.frame_fingerprint(people)) == rows(IO.frame_fingerprint(people.repartition(2).select("y", "x", "who", "id")))
    findings = spark.createDataFrame([("error", "x")], "level string, item string")
    with pytest.raises(ValueError):
        IO.write_report(findings, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 1
    flat = IO.flat_results(spark.createDataFrame([(1, ["a", "b"])], "id int, top array<string>"), "top", 3, {"kind": "k"})
    assert rows(flat) == [(1, "a", "b", None, "k")]
