"""Preprocessing, models and scoring on Spark ML or SQL. Fitted parameters are small rows; applying them is column arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException, ArithmeticException, IllegalArgumentException
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clean
from ..scratch import materialise
from .shape import to_long, uniform
from .stats import correlation, exact_quantiles


# ---- preprocessing -------------------------------------------------------------------------------------------------------------
def fit_impute(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, bool]]:
    """Median and whether the column had NULLs in the fit."""
    r = df.agg(*(F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in cols)).first()
    medians = {x.feature: x.q[0] for x in exact_quantiles(to_long(df, [], cols), "value", (0.5,), ["feature"]).collect()}  # one row a column
    return {c: (medians.get(c, 0.0), r[f"n_{c}"] > 0) for c in cols}


def apply_impute(df: DataFrame, fitted: dict[str, tuple[float, bool]]) -> DataFrame:
    flags = {f"{c}_missing": F.col(c).isNull().cast("double") for c, (_, had) in fitted.items() if had}
    return df.withColumns(flags).withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, (m, _) in fitted.items()})


def fit_onehot(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[str, list[str]]]:
    out = {}
    for c in cols:
        rows = df.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).collect()  # the categories, each a column of the result
        out[c] = (rows[0][0] if rows else None, sorted(r[0] for r in rows))
    return out


def apply_onehot(df: DataFrame, fitted: dict[str, tuple[str, list[str]]]) -> DataFrame:
    return df.withColumns({f"{c}={v}": (F.coalesce(F.col(c), F.lit(mode)) == v).cast("double") for c, (mode, values) in fitted.items() for v in values})


def fit_robust_scale(df: DataFrame, cols: Sequence[str], low: float = 0.1, high: float = 0.9) -> dict[str, tuple[float, float]]:
    r = {x.feature: x.q for x in exact_quantiles(to_long(df, [], cols), "value", (low, 0.5, high), ["feature"]).collect()}  # one row a column
    return {c: (r[c][1], (r[c][2] - r[c][0]) or 1.0) if c in r else (0.0, 1.0) for c in cols}


def fit_standard_scale(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    r = df.agg(*(F.avg(c).alias(f"m_{c}") for c in cols), *(F.stddev_pop(c).alias(f"s_{c}") for c in cols)).first()
    return {c: (r[f"m_{c}"], r[f"s_{c}"] or 1.0) for c in cols}


def fit_normaliser(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Median and sample standard deviation of what is known; (0, 1) for a column without values, spread 1 for a constant one."""
    known = {c: clean(F.col(c).cast("double")) for c in cols}
    rough = df.agg(*(F.avg(x).alias(f"m_{c}") for c, x in known.items()), *(F.stddev_samp(x).alias(f"s_{c}") for c, x in known.items())).first()
    spread = {c: rough[f"s_{c}"] for c in cols}
    # Sums of doubles end in other last digits with every order of millions of rows; sums of decimals don't. No square is larger than the number of rows.
    z = {c: (known[c] - rough[f"m_{c}"]) / spread[c] for c in cols if spread[c] and np.isfinite(spread[c])}
    if z:
        exact = lambda x: F.sum(x.cast("decimal(28,18)"))
        r = df.agg(*(a.alias(f"{k}_{c}") for c, x in z.items() for k, a in (("n", F.count(x)), ("one", exact(x)), ("two", exact(x * x))))).first()
        spread |= {c: spread[c] * float((r[f"two_{c}"] - r[f"one_{c}"] ** 2 / r[f"n_{c}"]) / (r[f"n_{c}"] - 1)) ** 0.5 for c in z}
    centre = {x.feature: x.q[0] for x in exact_quantiles(to_long(df, [], cols), "value", (0.5,), ["feature"]).collect()}  # one row a column
    return {c: (float(centre.get(c, 0.0)), float(spread[c] or 1.0)) for c in cols}


def apply_scale(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in fitted.items()})


def _features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Vectors; a NULL feature counts as 0 (impute first where that is not meant)."""
    known = df.withColumns({f"_f_{i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(cols)})
    names = [f"_f_{i}" for i in range(len(cols))]
    return VectorAssembler(inputCols=names, outputCol="_x").transform(known).drop(*names)


def balanced(df: DataFrame, y: str) -> DataFrame:
    n = {r[0]: r[1] for r in df.groupBy(y).count().collect()}  # two classes
    total = sum(n.values())
    return df.withColumn("_w", F.when(F.col(y) == 1, total / (2.0 * max(1, n.get(1, 0)))).otherwise(total / (2.0 * max(1, n.get(0, 0)))))


def is_fit_failure(e: Exception) -> bool:
    """Whether a fit failed for its data or settings; anything else, such as a lost executor or a lack of memory, is no result and must be raised."""
    return isinstance(e, (IllegalArgumentException, AnalysisException, ArithmeticException, ValueError, KeyError, ArithmeticError)) or any(x in str(e) for x in ("SingularMatrixException", "NotConvergedException", "IllegalArgumentException"))


# ---- supervised ----------------------------------------------------------------------------------------------------------------
def _score(model, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return model.transform(_features(df, cols)).withColumn("score", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction", "_w")


def logistic(train: DataFrame, test: DataFrame, y: str, cols: Sequence[str], weighted: bool = True) -> DataFrame:
    d = balanced(train, y) if weighted else train.withColumn("_w", F.lit(1.0))
    return _score(LogisticRegression(featuresCol="_x", labelCol=y, weightCol="_w", regParam=1e-4).fit(_features(d, cols)), test, cols)


def boosted(train: DataFrame, test: DataFrame, y: str, cols: Sequence[str], depth: int = 3, rounds: int = 20, rate: float = 0.1, seed: int = 0) -> DataFrame:
    m = GBTClassifier(featuresCol="_x", labelCol=y, weightCol="_w", maxDepth=depth, maxIter=rounds, stepSize=rate, seed=seed).fit(_features(balanced(train, y), cols))
    return _score(m, test, cols)


def forest(train: DataFrame, test: DataFrame, y: str, cols: Sequence[str], trees: int = 50, depth: int = 6, seed: int = 0) -> DataFrame:
    m = RandomForestClassifier(featuresCol="_x", labelCol=y, weightCol="_w", numTrees=trees, maxDepth=depth, seed=seed).fit(_features(balanced(train, y), cols))
    return _score(m, test, cols)


def hazard(intervals: DataFrame, test: DataFrame, cols: Sequence[str], least: int = 5) -> DataFrame:
    """Cause-specific discrete-time hazards ``h`` and ``c`` for the rows of ``test``; without enough events both are NULL."""
    n = intervals.agg(F.sum("event_here").alias("e"), F.sum("competing_here").alias("c")).first()
    if (n.e or 0) < least:
        return test.withColumn("h", F.lit(None).cast("double")).withColumn("c", F.lit(None).cast("double"))
    own = [*cols, "interval"]
    d = logistic(intervals, test, "event_here", own, weighted=False).withColumnRenamed("score", "h")
    return logistic(intervals, d, "competing_here", own, weighted=False).withColumnRenamed("score", "c") if n.c else d.withColumn("c", F.lit(0.0))


def cumulative_incidence(df: DataFrame, entity: str, interval: str = "interval") -> DataFrame:
    """F = sum of S h, S <- S (1 - h - c), over each entity's intervals in order."""
    steps = F.sort_array(F.collect_list(F.struct(interval, "h", "c")))
    start = F.struct(F.lit(1.0).alias("s"), F.lit(0.0).alias("f"))
    step = lambda a, x: F.struct((a["s"] * F.greatest(F.lit(0.0), 1 - x["h"] - x["c"])).alias("s"), (a["f"] + a["s"] * x["h"]).alias("f"))
    return df.groupBy(entity).agg(F.aggregate(steps, start, step)["f"].alias("cumulative_incidence"))


def calibrate(fit: DataFrame, df: DataFrame, p: str, y: str) -> DataFrame:
    """Isotonic, or logistic on the logit with few rows or events, or unchanged with one class; clipped to [0, 1]."""
    n = fit.agg(F.count("*").alias("n"), F.sum(y).alias("e")).first()
    if not n.n or not n.e or n.e == n.n:
        return df.withColumn("calibrated", F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0)))
    if n.n < 50 or min(n.e, n.n - n.e) < 10:
        from ..functions.columns import logit

        z = lambda d: d.withColumn("_z", logit(F.col(p)))
        return logistic(z(fit), z(df), y, ["_z"], weighted=False).withColumnRenamed("score", "calibrated").drop("_z")
    cells = fit.groupBy(p, y).agg(F.count("*").cast("double").alias("_n"))  # equal scores move together
    m = IsotonicRegression(featuresCol="_x", labelCol=y, weightCol="_n", predictionCol="calibrated").fit(_features(cells, [p]))
    return m.transform(_features(df, [p])).drop("_x").withColumn("calibrated", F.least(F.greatest(F.col("calibrated"), F.lit(0.0)), F.lit(1.0)))


def adjusted_effect(df: DataFrame, t: str, y: str, confounders: Sequence[str]) -> float:
    m = LinearRegression(featuresCol="_x", labelCol=y, solver="normal").fit(_features(df, [t, *confounders]))
    return float(m.coefficients[0])


def refute(df: DataFrame, t: str, y: str, confounders: Sequence[str], key: str, kind: str, seed: int = 0) -> float:
    from .shape import permute_column

    if kind == "random_cause":
        return adjusted_effect(df.withColumn("_r", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(2)).cast("double")), t, y, [*confounders, "_r"])
    if kind == "placebo":
        return adjusted_effect(permute_column(df, t, key, seed), t, y, confounders)
    return adjusted_effect(df.filter(uniform(seed, key) < 0.9), t, y, confounders)


# ---- unsupervised ----------------------------------------------------------------------------------------------------------------
def _vector(df: DataFrame, vec: str) -> DataFrame:
    return df.withColumn("_x", array_to_vector(F.col(vec).cast("array<double>")))


def centred(df: DataFrame, vec: str) -> DataFrame:
    mean = df.select(F.posexplode(F.col(vec).cast("array<double>")).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("_m"))
    return df.crossJoin(F.broadcast(mean)).withColumn("_c", F.zip_with(F.col(vec).cast("array<double>"), "_m", lambda a, b: a - b)).drop("_m")  # one row


def pca_deviation(df: DataFrame, key: str, vec: str, k: int = 16) -> DataFrame:
    """Reconstruction error after projection on k components of the centred vectors."""
    d = _vector(centred(df, vec), "_c")
    m = PCA(k=k, inputCol="_x", outputCol="_z").fit(d)
    z = m.transform(d).select(key, "_c", vector_to_array("_z").alias("z"))
    norm = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)
    return z.select(key, (F.greatest(F.lit(0.0), norm("_c") - norm("z")) / F.size("_c")).alias("reconstruction_error"))  # components are orthonormal


def principal_axes(df: DataFrame, vec: str, k: int) -> np.ndarray:
    """The k first principal axes as columns; p x k values."""
    return PCA(k=k, inputCol="_x", outputCol="_z").fit(_vector(df, vec)).pc.toArray()


def projection_2d(df: DataFrame, key: str, vec: str, label: str, sample: int = 2000, seed: int = 0) -> DataFrame:
    """x, y and label of a hash sample of at most ``sample`` rows on its first two principal axes: points of a chart, without ids. ``sample`` is the feature; signs of the axes are any."""
    from .shape import capped_sample

    d = _vector(centred(materialise(capped_sample(df, key, sample, seed)), vec), "_c")
    z = vector_to_array("_z")
    return PCA(k=2, inputCol="_x", outputCol="_z").fit(d).transform(d).select(z[0].alias("x"), z[1].alias("y"), label)


def deviation_score(rec_z, lat_z):
    zero = F.lit(0.0)
    return 0.7 * F.greatest(zero, rec_z) + 0.3 * F.greatest(zero, lat_z)


def latent_distance(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Mean squared standardised coordinate."""
    long = df.select(key, F.posexplode(F.col(vec).cast("array<double>")).alias("i", "v"))
    s = long.groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    z = (F.col("v") - F.col("m")) / F.coalesce(F.nullif("sd", F.lit(0.0)), F.lit(1.0))
    return long.join(F.broadcast(s), "i").groupBy(key).agg(F.avg(z * z).alias("latent_distance"))  # one row a coordinate


def isolation_forest(df: DataFrame, key: str, vec: str, trees: int = 100, sample: int = 256, seed: int = 0) -> DataFrame:
    """Trees are built in tasks from hash samples of at most ``sample`` rows each; scoring is one pass over all rows."""
    n = df.count()
    share = min(1.0, 2.0 * sample / max(1, n))
    own = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: uniform(seed, t, F.col(key)) < share)  # the trees of a row: no row is there for every tree
    drawn = df.withColumn("tree", F.explode(own)).withColumn("_u", uniform(seed, "tree", key)).select("tree", "_u", F.col(key).alias("k"), F.col(vec).cast("array<double>").alias("v"))

    def build(key_, pdf):
        import pandas as pd

        x = np.stack(pdf.sort_values(["_u", "k"])["v"].to_numpy())[:sample]  # the smallest hashes, in whatever order rows arrive
        rng, nodes = np.random.default_rng(seed * 1_000_003 + int(key_[0])), []

        def grow(rows: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append(None)
            spread = np.flatnonzero(x[rows].max(0) > x[rows].min(0)) if len(rows) > 1 else []
            if depth >= int(np.ceil(np.log2(sample))) or not len(spread):
                nodes[at] = (-1, 0.0, -1, -1, float(len(rows)), depth)
                return at
            f = int(rng.choice(spread))
            cut = float(rng.uniform(x[rows, f].min(), x[rows, f].max()))
            left = x[rows, f] < cut
            nodes[at] = (f, cut, grow(rows[left], depth + 1), grow(rows[~left], depth + 1), float(len(rows)), depth)
            return at

        grow(np.arange(len(x)), 0)
        return pd.DataFrame([(int(key_[0]), *nd) for nd in nodes], columns=["tree", "f", "cut", "l", "r", "size", "depth"])

    table = drawn.groupBy("tree").applyInPandas(build, "tree int, f int, cut double, l int, r int, size double, depth int").orderBy("tree").toPandas()  # at most trees * 2 * sample nodes
    forest_ = [g.to_numpy()[:, 1:] for _, g in table.groupby("tree", sort=True)]

    def average(m):
        m = np.maximum(m, 2)
        return 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m

    def score(batches):
        import pandas as pd

        for b in batches:
            x, total = np.stack(b["v"].to_numpy()), np.zeros(len(b))
            for t in forest_:
                at = np.zeros(len(x), int)
                while (inner := t[at, 0] >= 0).any():
                    i = np.flatnonzero(inner)
                    nd = t[at[i]]
                    at[i] = np.where(x[i, nd[:, 0].astype(int)] < nd[:, 1], nd[:, 2], nd[:, 3]).astype(int)
                total += t[at, 5] + np.where(t[at, 4] > 1, average(t[at, 4]), 0)
            yield pd.DataFrame({"id": b["id"], "isolation_score": 2 ** (-total / max(1, len(forest_)) / average(float(sample)))})

    return df.select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("v")).mapInPandas(score, "id long, isolation_score double").withColumnRenamed("id", key)


def kmeans(df: DataFrame, vec: str, k: int, seeds: Sequence[int] = (0,)) -> tuple[DataFrame, list[list[float]]]:
    """Labels and centres of the best of several seeds."""
    d = _vector(df, vec)
    best = min((KMeans(k=k, seed=s, featuresCol="_x", predictionCol="cluster").fit(d) for s in seeds), key=lambda m: m.summary.trainingCost)
    return best.transform(d).drop("_x"), [list(map(float, c)) for c in best.clusterCenters()]


def mixture(df: DataFrame, vec: str, k: int, seed: int = 0) -> DataFrame:
    m = GaussianMixture(k=k, seed=seed, featuresCol="_x", predictionCol="cluster").fit(_vector(df, vec))
    return m.transform(_vector(df, vec)).withColumn("confidence", F.array_max(vector_to_array("probability"))).drop("_x", "probability")


def margin_confidence(df: DataFrame, vec: str, centres: Sequence[Sequence[float]]) -> DataFrame:
    v = F.col(vec).cast("array<double>")
    d2 = F.array(*(F.aggregate(F.zip_with(v, F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x) for c in centres))
    s = F.sort_array(F.transform(d2, lambda x: F.sqrt(x)))
    return df.withColumn("margin", F.when(s[1] > 0, (s[1] - s[0]) / s[1]).otherwise(0.0))


def cluster_indices(df: DataFrame, vec: str, label: str) -> DataFrame:
    """Calinski-Harabasz from counts, means and variances per cluster, in one pass over the vectors."""
    g = _vector(df, vec).groupBy(label).agg(Summarizer.metrics("count", "mean", "variance").summary(F.col("_x")).alias("s")).collect()  # one row a cluster
    n, mean = np.array([r.s["count"] for r in g], float), np.array([r.s["mean"].toArray() for r in g])
    own = np.array([r.s["variance"].toArray().sum() for r in g]) * (n - 1)
    known = np.array([r[0] is not None for r in g])
    within, k = float(own[known].sum()), int(known.sum())
    total = float(own.sum() + (n[:, None] * (mean - n @ mean / n.sum()) ** 2).sum())
    index = (total - within) / (k - 1) / (within / (float(n.sum()) - k))
    return df.sparkSession.createDataFrame([(index,)], "calinski_harabasz double")


def best_or_abstain(candidates: DataFrame, gates: dict[str, str], rank_by: str) -> DataFrame:
    """Candidates with their failed gates; the best admissible one is selected, none if no candidate passes all."""
    failed = F.filter(F.array(*(F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in gates.items())), lambda x: x.isNotNull())
    d = candidates.withColumn("failed", failed)
    r = F.row_number().over(Window.partitionBy(F.size("failed") == 0).orderBy(F.desc(rank_by), "candidate"))  # a grid of candidates
    return d.withColumn("selected", (F.size("failed") == 0) & (r == 1))


def normal_scores(df: DataFrame, cols: Sequence[str], low: float = 0.001) -> DataFrame:
    """``<c>_normal``: the standard normal quantile of the average percent rank, kept within ``low`` and 1 - ``low``; 0 for NULL."""
    from pyspark.sql.functions import pandas_udf

    from .batched import normal_quantile
    from .shape import average_pct_rank

    @pandas_udf("double")
    def quantile(p: pd.Series) -> pd.Series:
        return pd.Series(normal_quantile(p.to_numpy()))

    for c in cols:
        df = average_pct_rank(df, c)
    u = lambda c: F.when(F.col(f"{c}_pct").isNull(), 0.5).otherwise(F.least(F.greatest(F.col(f"{c}_pct"), F.lit(low)), F.lit(1 - low)))
    return df.withColumns({f"{c}_normal": quantile(u(c)) for c in cols}).drop(*(f"{c}_pct" for c in cols))


def rank_correlation_factor(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Cholesky factor of the correlation of normal scores of all rows; p x p values reach the driver."""
    from .batched import rank_factors

    return rank_factors(df, {"all": F.lit(True)}, cols)["all"]
