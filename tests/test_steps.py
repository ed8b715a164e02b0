"""Steps that are kept and read back, parameters and references as tables, and operators that no query reaches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import models, shape
from cohortspark.plans import steps
from cohortspark.plans.incident import Protocol
from cohortspark.sources import io


def history(spark, n=500):
    """People whose values rise before a disease; a third of the others die."""
    g, rows = np.random.default_rng(3), []
    for i in range(n):
        sick, dies = g.uniform() < 0.35, g.uniform() < 0.2
        for d in range(6):
            rows.append((i, f"2020-0{d + 1}-01 00:00:00", f"v{d}", "2020-06-02 00:00:00", "none", None, None, None, "marker", float(g.normal() + (d * 0.6 if sick else 0)), 10 * i + d))
        rows.append((i, "2020-09-01 00:00:00", "end", "2020-06-02 00:00:00", "none", None, None, None, "marker", None, 10 * i + 6))
        if sick:
            rows.append((i, "2020-08-01 00:00:00", None, None, "disease", f"2020-0{int(g.integers(6, 9))}-2{int(g.integers(0, 9))} 00:00:00", None, None, None, None, 10 * i + 7))
        elif dies:
            rows.append((i, "2020-08-01 00:00:00", None, None, "death", "2020-07-15 00:00:00", None, None, None, None, 10 * i + 8))
    d = spark.createDataFrame(rows, "who long, ts string, visit string, index_date string, outcome_type string, event_date string, censoring_date string, site string, code string, value double, at long")
    return d.withColumns({c: F.to_timestamp(c) for c in ("ts", "index_date", "event_date", "censoring_date")})


def test_a_second_run_reads_every_step(spark, tmp_path):
    d, protocol = history(spark), Protocol(["disease"], "death", None, (40, 80), 0.0, 2, 20)
    run = lambda source, settings="": steps.Steps(spark, f"{tmp_path}/risk", source, settings)
    go = lambda s: sorted(map(tuple, steps.cohort_risk(s, d, "who", "code", "value", "at", ["marker"], "disease", protocol, 2030, 10.0).collect()))
    first, second = run(d), run(d)
    a = go(first)
    b = go(second)
    assert a == b and second.made == [] and len(first.made) == 9
    got = {(r[0], r[1], r[2]): r for r in a}
    test = got["hazard", 80, "test"]
    assert test[5] > 0.75 > got["rate", 80, "test"][5] == 0.5 and test[7] < got["rate", 80, "test"][7]
    incidence = spark.read.parquet(f"{tmp_path}/risk/incidence/data")
    wide = incidence.groupBy("who").pivot("horizon", [40, 80]).agg(F.first("cumulative_incidence"))
    assert wide.filter("`40` > `80` OR `80` > 1 OR `40` < 0").count() == 0
    other = run(d.filter("who < 450"))  # another source: everything anew
    go(other)
    assert len(other.made) == 9
    changed = run(d, "other settings")
    steps.Steps.table(changed, "cohort", lambda: d.limit(1))
    assert changed.made == ["cohort"]


def test_few_steps_read_the_events(spark, tmp_path):
    """The fingerprint, the outcome dates and the visits; every section of the report read them before."""
    d, protocol, seen = history(spark, 200), Protocol(["disease"], "death", None, (40, 80), 0.0, 2, 20), spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def counted(x):
        seen.add(1)
        return True

    s = steps.Steps(spark, str(tmp_path), d.filter(counted("at")))
    steps.cohort_risk(s, d.filter(counted("at")), "who", "code", "value", "at", ["marker"], "disease", protocol, 2030, 10.0).collect()
    assert len(s.made) == 9 and 0 < seen.value <= 3 * d.count()


def test_a_step_depends_on_those_before(spark, tmp_path):
    s = steps.Steps(spark, str(tmp_path), spark.range(3))
    s.table("a", lambda: spark.range(4))
    s.table("b", lambda: spark.range(5), "a")
    t = steps.Steps(spark, str(tmp_path), spark.range(3))
    t.table("a", lambda: spark.range(40))
    assert t.made == [] and t.table("b", lambda: spark.range(50), "a").count() == 5
    u = steps.Steps(spark, str(tmp_path), spark.range(30))
    u.table("a", lambda: spark.range(40))
    assert u.table("b", lambda: spark.range(50), "a").count() == 50 and u.made == ["a", "b"]


def test_parameters_replay_the_fit(spark, tmp_path):
    g = np.random.default_rng(0)
    x = g.normal(size=(200, 2)) * [3, 1] + 5
    x[::7, 0] = np.nan
    d = spark.createDataFrame([(i, None if np.isnan(a) else float(a), float(b)) for i, (a, b) in enumerate(x)], "id int, a double, b double")
    io.write_table(steps.parameters(d, ["a", "b"]), f"{tmp_path}/parameters")
    z, names = steps.apply_parameters(d, spark.read.parquet(f"{tmp_path}/parameters"))
    assert names == ["z_a", "z_b", "missing_a"]
    filled = np.where(np.isnan(x), np.nanmedian(x, 0), x)
    want = (filled - filled.mean(0)) / filled.std(0)
    got = np.array([(r.z_a, r.z_b) for r in z.orderBy("id").collect()])
    assert np.allclose(got, want) and z.filter("missing_a = 1").count() == np.isnan(x[:, 0]).sum()


def test_reference_percentiles(spark):
    ref = [float(v) for v in range(100)]
    r = steps.score_reference(spark.createDataFrame([(v,) for v in ref * 2] + [(None,)], "s double"), "s")
    out = {x.s: x for x in steps.against_reference(spark.createDataFrame([(49.0,), (49.5,), (-1.0,), (98.9,), (None,)], "s double"), "s", r).collect()}
    assert out[49.0].percentile == out[49.5].percentile == 50.0 and out[-1.0].percentile == 0.0 and out[None].percentile is None
    assert out[98.9].above_p95 and out[98.9].above_p99 == (98.9 > np.quantile(ref * 2, 0.99)) and not out[49.0].above_p90


def test_identifier_columns(spark):
    d = spark.createDataFrame([(1, 2)], "patient int, row int")
    assert shape.identifier_column(d, ["id", "row", "patient"]) == "row" and shape.identifier_column(d, ["id"]) is None


def test_hazards_by_interval(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=3000)
    h = 1 / (1 + np.exp(2.5 - x))
    rows = [(i, float(a), 0, int(g.uniform() < p), 0) for i, (a, p) in enumerate(zip(x, h))]
    own = spark.createDataFrame(rows, "id int, x double, interval int, event_here int, competing_here int")
    got = models.hazard(own, spark.createDataFrame([(v, 0) for v in (-1.0, 0.0, 1.0)], "x double, interval int"), ["x"]).orderBy("x").collect()
    assert np.allclose([r.h for r in got], 1 / (1 + np.exp(2.5 - np.array([-1.0, 0, 1]))), atol=0.05) and all(r.c == 0 for r in got)
    few = models.hazard(own.filter("event_here = 0"), own.limit(2), ["x"])
    assert few.filter("h IS NULL AND c IS NULL").count() == 2


def test_margin_and_refutations(spark):
    d = models.margin_confidence(spark.createDataFrame([([0.0, 0.0],), ([1.0, 0.0],), ([3.0, 0.0],)], "v array<double>"), "v", [[0.0, 0.0], [4.0, 0.0]])
    assert [r.margin for r in d.collect()] == pytest.approx([1.0, 1 - 1 / 3, 1 - 1 / 3])
    g = np.random.default_rng(2)
    c, t = g.normal(size=2000), g.integers(0, 2, 2000)
    y = 2.0 * t + c + g.normal(size=2000) * 0.1
    f = spark.createDataFrame([(i, float(a), float(b), float(v)) for i, (a, b, v) in enumerate(zip(t, c, y))], "id int, t double, c double, y double")
    effect = {k: models.refute(f, "t", "y", ["c"], "id", k) for k in ("random_cause", "placebo", "subset")}
    assert abs(effect["random_cause"] - 2) < 0.05 and abs(effect["placebo"]) < 0.15 and abs(effect["subset"] - 2) < 0.05


def test_deviation_score(spark):
    d = spark.createDataFrame([(1.0, 2.0), (-1.0, 2.0), (3.0, -5.0), (-1.0, -1.0)], "rec double, lat double")
    assert [r.s for r in d.select(models.deviation_score(F.col("rec"), F.col("lat")).alias("s")).collect()] == pytest.approx([1.3, 0.6, 2.1, 0.0])
