"""Every registered cohort query against its SQL, and the ones without SQL for rows and determinism."""

import duckdb
import pandas as pd
import pytest

from cohortspark.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events embeddings documents benchmark".split()


def plain(df: pd.DataFrame) -> list:
    def one(v):
        if v is None or (not isinstance(v, (list, tuple, str)) and pd.isna(v)):
            return "null"
        if isinstance(v, pd.Timestamp):
            return str(v)
        if isinstance(v, float):
            return f"{v:.5g}"
        return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(one, r)) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL.keys() & QUERIES.keys()))
def test_agrees_with_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(SQL[name])
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.toPandas()) == plain(want.df())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs_and_repeats(spark, sf_dir, name):
    f = QUERIES[name]
    a = f(spark, sf_dir)
    assert a.count() > 0
    if name.startswith(("x_", "s_")):
        assert plain(a.toPandas()) == plain(f(spark, sf_dir).toPandas())


def test_c_index_takes_all_rows(spark):
    """Ties of time and risk, NULLs, and more rows than the sample that was once drawn."""
    import numpy as np

    from cohortspark.operators.stats import c_index

    g = np.random.default_rng(3)
    n = 4000
    time, event, risk = g.integers(0, 300, n), g.integers(0, 2, n), g.integers(0, 150, n).astype(float)
    risk[::17] = np.nan
    ok = (event[:, None] == 1) & (time[:, None] < time[None, :])
    won = (risk[:, None] > risk[None, :]) + 0.5 * (risk[:, None] == risk[None, :])
    rows = [(i, int(t), int(e), None if np.isnan(r) else float(r)) for i, (t, e, r) in enumerate(zip(time, event, risk))] + [(n, None, 1, 500.0), (n + 1, 0, None, 3.0)]
    df = spark.createDataFrame(rows, "id int, t int, e int, r double").repartition(3)
    got = c_index(df, "t", "e", "r").first().c_index
    assert abs(got - won[ok].sum() / ok.sum()) < 1e-12
    assert c_index(df.filter("false"), "t", "e", "r").first().c_index is None


def test_names_and_reports_on_the_schema(spark):
    """What is decided on names, without data."""
    import pytest as pt

    from cohortspark.operators import screen
    from cohortspark.plans import quality

    df = spark.createDataFrame([(1, 2.0, None, "a")], "id int, price double, void double, note string")
    got = quality.leakage_report(df, ["price", "y", "secret", "gone"], ["secret"], ["y"]).collect()
    assert [tuple(r) for r in got] == [("price", None, False), ("y", "label", True), ("secret", "denied", True), ("gone", "absent", False)]
    assert screen.source_of(["age_x", "age_band_1", "other"], ["age", "age_band"]) == {"age_x": "age", "age_band_1": "age_band", "other": None}
    assert screen.field_sets(df, ["void"], ["note"], ["gone", "price"]) == (["price"], ["note"])
    assert screen.schema_report(df, ["price", "note", "x"]).first()[:] == (4, 3, 2, "x", "note")
    names = spark.createDataFrame([("Patient_Name",), ("age",)], "n string")
    assert [tuple(r) for r in screen.name_reasons(names, "n", [("identifier", "name"), ("other", "p")]).collect()] == [("Patient_Name", "identifier")]
    with pt.raises(ValueError):
        screen.allowed_features(df, ["price", "secret_1"], [], ["secret_"])
    with pt.raises(ValueError):
        quality.raise_if_blocking(spark.createDataFrame([("rows", "blocking")], "section string, level string"))


def test_effect_falls_back(spark):
    """Without what the adjusted effect needs the plain difference is given, and said so."""
    from cohortspark.operators.evaluate import effect_with_fallback

    df = spark.createDataFrame([(1, 5.0), (0, 3.0), (1, 7.0)], "t int, y double")
    r = effect_with_fallback(df, "t", "y", ["absent"]).first()
    assert (r.effect, r.execution_mode) == (3.0, "difference_in_means")


def test_robust_smd_without_scale_or_values(spark):
    from cohortspark.operators.stats import robust_smd

    few = spark.createDataFrame([(1, 1.0)] * 4 + [(0, float(i)) for i in range(9)], "g int, v double")
    flat = spark.createDataFrame([(1, float(i)) for i in range(9)] + [(0, 2.0)] * 9, "g int, v double")
    assert robust_smd(few, "g", "v").first().robust_smd is None and robust_smd(flat, "g", "v").first().robust_smd is None


def test_calibration_line(spark):
    """Scores that are right have slope 1 and intercept 0; overconfident ones a slope under 1. Checked against plain Newton steps."""
    import numpy as np

    from cohortspark.operators.evaluate import calibration_line

    g = np.random.default_rng(1)
    p = g.uniform(0.05, 0.95, 4000)
    y = (g.uniform(size=4000) < p).astype(int)
    sharp = 1 / (1 + np.exp(-2 * np.log(p / (1 - p))))
    for score, low, high in ((p, 0.85, 1.15), (sharp, 0.4, 0.6)):
        r = calibration_line(spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, score)], "y int, p double"), "y", "p").first()
        x = np.stack([np.ones(4000), np.log(score / (1 - score))], 1)
        w = np.zeros(2)
        for _ in range(30):
            q = 1 / (1 + np.exp(-x @ w))
            w = w + np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag([0.0, 1.0]), x.T @ (y - q) - np.array([0.0, w[1]]))
        assert abs(r.slope - w[1]) < 1e-6 and low < r.slope < high and abs(r.intercept - (y.mean() - score.mean())) < 1e-9


@pytest.mark.parametrize("name", ["d_profile_problems", "w_cumulative", "n_normaliser"])
def test_scores_at_halves_round_as_in_sql(spark, tmp_path, name):
    """Prices whose scores end in a 5 that doubles can't hold, such as 0.5005."""
    rows = [(999 - i, i % 7, "FOP"[i % 3], 300.0 * (2 * i + 1), pd.Timestamp("1996-03-04") + pd.Timedelta(days=i), "1-URGENT") for i in range(1000)]
    pd.DataFrame(rows, columns=["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]).astype({"o_orderdate": "datetime64[us]"}).to_parquet(tmp_path / "orders.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    assert plain(QUERIES[name](spark, str(tmp_path)).toPandas()) == plain(con.sql(SQL[name]).df())


def test_spread_does_not_depend_on_order(spark):
    from decimal import Decimal, getcontext

    import numpy as np

    from cohortspark.operators.models import fit_normaliser

    v = np.random.default_rng(5).integers(0, 10**6, 60_000) + 10**9
    getcontext().prec = 50
    total, square, n = sum(map(int, v)), sum(int(x) ** 2 for x in v), len(v)
    want = float(((Decimal(square) - Decimal(total) ** 2 / n) / (n - 1)).sqrt())
    for parts in (1, 7):
        got = fit_normaliser(spark.createDataFrame(pd.DataFrame({"v": v.astype(float)})).repartition(parts), ["v"])["v"][1]
        assert abs(got - want) <= 4e-16 * want
