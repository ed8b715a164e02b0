"""Evaluation beyond single metrics: controls, resampled intervals, folds by group, choice and promotion of models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import logit, null_safe
from ..scratch import materialise
from . import batched, models, shape, stats


def auprc_lift(df: DataFrame, y: str, p: str) -> DataFrame:
    base = df.filter(F.col(p).isNotNull()).agg(F.avg(y).alias("prevalence"))
    return stats.average_precision(df, y, p).crossJoin(base).select("average_precision", "prevalence", F.try_divide("average_precision", "prevalence").alias("lift"))  # two single rows


def calibration_line(df: DataFrame, y: str, p: str, steps: int = 12, weight: str | None = None) -> DataFrame:
    """Intercept (mean outcome minus mean score) and slope of a logistic curve on the logit, by Newton steps over sums; slope penalty 1/2 b^2. ``weight``: how many rows a row stands for."""
    w = F.col(weight) if weight else F.lit(1)
    d = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).select(F.col(y).cast("double").alias("y"), F.col(p).alias("p"), logit(F.col(p)).alias("z"), w.alias("w"))
    g = materialise(d.groupBy("p", "z").agg(F.sum(F.col("y") * F.col("w")).alias("s"), F.sum("w").alias("n")))  # equal scores move together; every step reads these sums only
    a = b = 0.0
    for _ in range(steps):
        q = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("z"))))
        w = F.col("n") * q * (1 - q)
        e = F.col("s") - F.col("n") * q
        r = g.agg(F.sum(e), F.sum(e * F.col("z")), F.sum(w), F.sum(w * F.col("z")), F.sum(w * F.col("z") * F.col("z"))).first()
        if r[0] is None or not r[2]:
            break
        g0, g1, h00, h01, h11 = r[0], r[1] - b, r[2], r[3], r[4] + 1.0
        det = h00 * h11 - h01 * h01
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-12:
            break
    return g.agg((F.try_divide(F.sum("s"), F.sum("n")) - F.try_divide(F.sum(F.col("p") * F.col("n")), F.sum("n"))).alias("intercept"), F.lit(b).alias("slope"))


def constant_baseline(train: DataFrame, test: DataFrame, y: str) -> DataFrame:
    """Metrics of the training rate as everybody's score."""
    rate = train.agg(F.avg(y).alias("_rate"))
    return stats.threshold_metrics(test.crossJoin(F.broadcast(rate)), y, "_rate").crossJoin(rate.withColumnRenamed("_rate", "rate"))  # one row


def best_by(candidates: DataFrame, order: Sequence[str], name: str = "model") -> DataFrame:
    """The candidate with the largest values of ``order``, the first name on ties."""
    key = F.struct(*(F.col(o) for o in order))
    best = candidates.agg(F.max(key).alias("k"))
    return candidates.join(best, key == F.col("k")).groupBy(*order).agg(F.min(name).alias(name))


def error_by_split(df: DataFrame, split: str, error: str) -> DataFrame:
    return df.groupBy(split).agg(F.avg(error).alias("mse"), F.count("*").alias("n"))


def promotion_gates(df: DataFrame, old: str, new: str, old_score: str, new_score: str, better: float = 0.01, agree: float = 0.8) -> DataFrame:
    """Errors of two models over the same rows, rank agreement of their scores, and whether each gate holds."""
    m = df.agg(F.avg(old).alias("old_mse"), F.avg(new).alias("new_mse"), F.count_if(F.col(old).isNull() | F.col(new).isNull()).alias("unmatched")).crossJoin(stats.spearman(df, old_score, new_score))  # two single rows
    gain = 1 - F.col("new_mse") / F.col("old_mse")
    gates = {"improved": gain >= better, "agrees": F.col("spearman") >= agree, "same_rows": F.col("unmatched") == 0}
    d = m.withColumns({n: null_safe(g) for n, g in gates.items()})
    return d.withColumn("promoted", F.col("improved") & F.col("agrees") & F.col("same_rows"))


def leave_one_group_out(df: DataFrame, group: str, y: str, p: str) -> DataFrame:
    """Metrics of each group as the held-out fold, and of all folds together; folds of one class have no AUROC of their own but stay in the pool."""
    n = df.groupBy(group).agg(F.count("*").alias("n"), F.sum(y).alias("events"))
    per = n.join(stats.auroc(df, y, p, by=[group]), group)
    one = (F.col("events") == 0) | (F.col("events") == F.col("n"))
    per = per.select(F.col(group).cast("string").alias("fold"), "n", "events", F.when(~one, F.col("auroc")).alias("auroc"))
    pool = df.agg(F.lit("pooled").alias("fold"), F.count("*").alias("n"), F.sum(y).alias("events")).crossJoin(stats.auroc(df, y, p))  # two single rows
    return per.unionByName(pool)


def bootstrap(df: DataFrame, y: str, p: str, rounds: int = 200, seed: int = 0, cluster: str | None = None) -> DataFrame:
    """low, high of the AUROC, and the rounds that had both classes. Weights are drawn for each class apart, or per cluster."""
    drawn = batched.resampled(df, y, p, rounds, seed, cluster)
    x = drawn.interval()
    return df.sparkSession.createDataFrame([(x.get("auroc_low"), x.get("auroc_high"), int((drawn.auroc == drawn.auroc).sum()))], "low double, high double, rounds long")


def shuffled_label_control(df: DataFrame, y: str, p: str, key: str, seed: int = 0) -> DataFrame:
    """AUROC when labels are dealt anew: about one half."""
    return stats.auroc(shape.permute_column(df.select(key, y, p), y, key, seed), y, p)


def time_reversal_control(visits: DataFrame, entity: str, ts: str, value: str, labels: DataFrame, y: str, least_drop: float = 0.02) -> DataFrame:
    """AUROC of the slope with visits in order and in reversed order; an order-sensitive score must lose ``least_drop``."""
    slope = f"{value}_slope_per_year"
    w, at = Window.partitionBy(entity), F.unix_micros(F.col(ts).cast("timestamp"))
    back = visits.withColumn(ts, F.timestamp_micros(F.min(at).over(w) + F.max(at).over(w) - at))
    one = lambda v: stats.auroc(stats.trajectory_features(v, entity, ts, [value]).join(labels, entity), y, slope)
    d = one(visits).withColumnRenamed("auroc", "forward").crossJoin(one(back).withColumnRenamed("auroc", "reversed"))  # two single rows
    return d.withColumn("admissible", F.col("forward") - F.col("reversed") >= least_drop)


def davies_bouldin(df: DataFrame, vec: str, label: str) -> DataFrame:
    """From centres and mean distances; clusters are few, so their pairs are too."""
    x = df.select(label, F.monotonically_increasing_id().alias("row"), F.col(vec).cast("array<double>").alias("v"))
    long = x.select(label, F.posexplode("v").alias("i", "v")).groupBy(label, "i").agg(F.avg("v").alias("m"))
    centre = long.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))  # one vector a cluster
    apart = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda s, t: (s - t) * (s - t)), F.lit(0.0), lambda acc, s: acc + s))
    spread = x.join(F.broadcast(centre), label).groupBy(label, "c").agg(F.avg(apart(F.col("v"), F.col("c"))).alias("s"))
    a, b = (spread.select(F.col(label).alias(f"l{k}"), F.col("c").alias(f"c{k}"), F.col("s").alias(f"s{k}")) for k in "ab")
    worst = a.join(b, F.col("la") != F.col("lb")).groupBy("la").agg(F.max((F.col("sa") + F.col("sb")) / apart(F.col("ca"), F.col("cb"))).alias("r"))  # clusters x clusters
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def negative_controls(df: DataFrame, label: str, controls: Mapping[str, str], limit: float = 0.3) -> DataFrame:
    """Association of a labelling with what it should not follow: ``controls`` maps a column to 'category' or 'number'. NULL categories are a level."""
    parts = None
    for c, kind in controls.items():
        if kind == "category":
            d = df.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("__null__")))
            own = stats.cramers_v(d, label, c).select(F.lit(c).alias("control"), F.col("cramers_v").alias("strength"))
        else:
            own = stats.correlation_ratio(df, label, c).select(F.lit(c).alias("control"), F.col("eta").alias("strength"))
        parts = own if parts is None else parts.unionByName(own)
    return parts.withColumn("dominates", F.coalesce(F.col("strength") > limit, F.lit(False)))


def batch_scores(df: DataFrame, key: str, score: Column, reference: DataFrame, reference_score: str) -> DataFrame:
    """Scores of a batch with their percentile in the reference and its band."""
    from ..functions.columns import percentile_band

    d = shape.reference_percentile(df.withColumn("score", score), "score", reference, reference_score)
    return d.select(key, "score", "percentile", percentile_band(F.col("percentile")).alias("band"))


def effect_with_fallback(df: DataFrame, t: str, y: str, confounders: Sequence[str]) -> DataFrame:
    """Adjusted effect; where it cannot be fitted the plain difference, said so in ``execution_mode``."""
    try:
        effect, mode = models.adjusted_effect(df, t, y, confounders), "adjusted"
    except Exception as e:  # the reason is recorded
        if not models.is_fit_failure(e):
            raise
        return stats.difference_in_means(df, t, y).withColumn("execution_mode", F.lit("difference_in_means")).withColumn("warning", F.lit(type(e).__name__))
    return df.sparkSession.createDataFrame([(effect, mode, None)], "effect double, execution_mode string, warning string")


def silhouette(queries: DataFrame, base: DataFrame, key: str, vec: str, label: str, block: int = 4096) -> DataFrame:
    """Exact Euclidean silhouette of the stated query rows against all base rows, and a NULL for rows alone in their cluster or where there is one cluster only. Blocks of queries meet blocks of base rows
    in one task each, which keeps a sum and a count per query and cluster."""
    import numpy as np
    import pandas as pd

    blocks = lambda d: max(1, -(-d.count() // block))
    nq, nb = blocks(queries), blocks(base)
    dealt = lambda d, n: d.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("c"), F.col(vec).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("own"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = dealt(queries, nq).withColumn("b", every(nb)).withColumnRenamed("own", "q")
    b = dealt(base, nb).withColumn("q", every(nq)).withColumnRenamed("own", "b")

    def sums(left, right):
        out = []
        if len(left) and len(right):
            y, ids, (names, at) = np.stack(right["v"].to_numpy()), right["id"].to_numpy(), np.unique(right["c"].to_numpy(), return_inverse=True)
            for i, c, x in zip(left["id"], left["c"], left["v"]):
                d = np.sqrt(((y - np.asarray(x)) ** 2).sum(1))
                w = (ids != i).astype(float)
                out += zip([i] * len(names), [c] * len(names), names, np.bincount(at, d * w), np.bincount(at, w))
        return pd.DataFrame(out, columns=["id", "c", "other", "s", "n"])

    g = q.groupBy("q", "b").cogroup(b.groupBy("q", "b")).applyInPandas(sums, "id long, c long, other long, s double, n double")
    m = g.groupBy("id", "c", "other").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("m"))
    ab = m.groupBy("id", "c").agg(F.max(F.when(F.col("c") == F.col("other"), F.col("m"))).alias("a"), F.min(F.when(F.col("c") != F.col("other"), F.col("m"))).alias("b"))
    return ab.select(F.col("id").alias(key), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).alias("silhouette"))
