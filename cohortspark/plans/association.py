"""Association of a label with features, from raw rows to a report: select, clean, split, impute, fit, evaluate, rank, and similar cases.

Defined cases: columns without values are no features; rows without a label of 0 or 1 or without a required value are left out; too few rows or cases are an error that says how many there were;
unknown values are filled by medians of the training rows; NaN is unknown.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clean
from ..operators import batched, neighbours, shape, stats
from ..scratch import materialise


def associate(df: DataFrame, key: str, y: str, candidates: Sequence[str], required: Sequence[str] = (), test_share: float = 0.2, ridges: Sequence[float] = (0.01, 1.0, 100.0), least_rows: int = 120, least_cases: int = 20, repeats: int = 10, rounds: int = 500, seed: int = 0, similar_to: Column | None = None) -> dict[str, DataFrame]:
    """report (section, item, value), candidates (metrics of each penalty), ranking (feature, rank, importance, stability, mean_shift, direction), scores (key, y, p of held-out rows), similar (query_id, rank, base_id, d2, label).

    All penalties are fitted in the same passes; the best by average precision, then AUROC, is used. ``similar_to``: the held-out rows whose three nearest rows in the standardised features are asked for.
    """
    here = [c for c in dict.fromkeys(candidates) if c in df.columns and c not in (y, key)]
    d = df.filter(F.col(y).isin(0, 1)).select(key, F.col(y).cast("int").alias(y), *(clean(F.col(c).cast("double")).alias(c) for c in here))
    for c in required:
        d = d.filter(F.col(c).isNotNull())
    n = d.agg(F.count("*").alias("_n"), F.sum(y).alias("_a"), *(F.count(c).alias(c) for c in here)).first()
    features = [c for c in here if n[c]]
    if not features:
        raise ValueError("no features")
    rows, cases = n["_n"], int(n["_a"] or 0)
    if rows < least_rows or min(cases, rows - cases) < least_cases:
        raise ValueError(f"{rows} rows with {cases} positive ones; {least_rows} rows and {least_cases} of each class are needed")
    d = materialise(shape.stratified_split(d.select(key, y, *features), y, key, test_share, seed))
    train, test = d.filter("NOT test"), d.filter("test")
    q = {r.feature: r.q[0] for r in stats.exact_quantiles(shape.to_long(train, [], features), "value", (0.5,), ["feature"]).collect()}  # one row a feature
    fill = np.array([q.get(f, 0.0) for f in features])
    label = F.col(y).cast("double")
    x = d.select(F.array(*features).alias("x"), F.array(*[label] * len(ridges)).alias("y"), F.array(*[F.when(F.col("test"), 0).otherwise(-1)] * len(ridges)).alias("fold"))
    fits = batched.Folds(x, len(ridges), 1, len(features), ridge=ridges, centres=np.tile(fill, (len(ridges), 1)))
    scored = materialise(fits.scored())
    name = F.element_at(F.array(*map(F.lit, map(float, ridges))), F.col("label") + 1)
    judged = materialise(batched._metrics(scored, ["label"]).withColumn("ridge", name))
    table = judged.collect()  # one row a penalty
    best = max(table, key=lambda r: (r.auprc, r.auroc or 0.0, -r.ridge))
    own, i = scored.filter(F.col("label") == best.label), best.label
    interval = batched.resampled(own, "y", "p", rounds, seed).interval()
    design, beta = fits.design, fits.coefficients[i]
    predict = lambda v: 1 / (1 + np.exp(-np.clip(design(i, v) @ beta, -500, 500)))
    held = test.select(key, y, *(F.coalesce(c, F.lit(float(f))).alias(c) for c, f in zip(features, fill)))
    lost = batched.permutation_importance(held, y, features, key, predict, repeats, seed)
    shift = stats.mean_shift(held, y, features)
    place = F.row_number().over(Window.orderBy(F.desc(F.abs("importance")), "feature"))  # one row a feature
    ranking = lost.join(shift, "feature").select("feature", place.alias("rank"), "importance", F.col("sd").alias("stability"), F.col("shift").alias("mean_shift"), F.when(F.col("shift") > 0, "higher_in_positive").otherwise("lower_in_positive").alias("direction"))
    ranking = materialise(ranking)
    numbers = {"auroc": best.auroc, "auprc": best.auprc, **interval, "brier_score": best.brier_score, "positive_rate": cases / rows, "test_positive_rate": best.prevalence, "auprc_lift": best.auprc_lift, "train_rows": rows - best.rows, "test_rows": best.rows, "test_positives": best.positives, "test_negatives": best.rows - best.positives, "ridge": best.ridge}
    found = [("metrics", k, None if v is None else float(v)) for k, v in numbers.items()] + [("cohort", "rows_used", float(rows)), ("cohort", "available_features", float(len(features)))]
    spark = df.sparkSession
    report = [spark.createDataFrame(found, "section string, item string, value double")]
    report += [judged.select(F.lit("candidate").alias("section"), F.concat_ws("/", F.col("ridge").cast("string"), F.lit(m)).alias("item"), F.col(m).cast("double").alias("value")) for m in ("auroc", "auprc", "brier_score")]
    report += [ranking.select(F.lit(f"ranking/{m}").alias("section"), F.col("feature").alias("item"), F.col(m).cast("double").alias("value")) for m in ("rank", "importance", "stability", "mean_shift")]
    memory = neighbours.standardised(d.select(key, y, "test", *features), features, fill, fits.mean[i], fits.sd[i])
    asked = memory.filter(F.col("test") & (similar_to if similar_to is not None else F.lit(False)))
    near = neighbours.knn_by_buckets(asked, memory, key, key, "v")
    similar = near.join(memory.select(F.col(key).cast("long").alias("base_id"), F.col(y).alias("label")), "base_id").select("query_id", "rank", "base_id", "d2", "label")
    weights = held.select(key, y, _score(held, features, fill, fits.mean[i], fits.sd[i], beta).alias("p"))
    return {"report": reduce(DataFrame.unionByName, report), "candidates": judged.drop("label"), "ranking": ranking, "scores": weights, "similar": similar}


def _score(df: DataFrame, features: Sequence[str], fill: np.ndarray, mean: np.ndarray, sd: np.ndarray, beta: np.ndarray) -> Column:
    """The fitted score as an expression over columns."""
    z = sum(((F.coalesce(F.col(c), F.lit(float(f))) - float(m)) / float(s) * float(b) for c, f, m, s, b in zip(features, fill, mean, sd, beta[1:])), F.lit(float(beta[0])))
    return 1 / (1 + F.exp(-z))
