"""Whole jobs composed of the operators: reliability report, preparation, risk and clustering pipelines, baselines, pooling, batch scoring.

Reports are rows (section, item, value, level), like those of ``quality``. Models are fitted on Spark; what reaches the driver are fitted parameters and one row per candidate.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import composite_key, null_safe, percentile_band
from ..operators import batched, evaluate, models, screen, shape, stats
from ..scratch import materialise
from . import cohort as plans
from . import quality

SPLITS = (("train", 0.7), ("validation", 0.15), ("test", 0.15))


def _level(bad: Column, kind: str) -> Column:
    return F.when(null_safe(bad), kind).otherwise("info")


def _finding(df: DataFrame, section: str, item: Column, value: Column, level: Column | None = None) -> DataFrame:
    return df.select(F.lit(section).alias("section"), item.cast("string").alias("item"), value.cast("double").alias("value"), (F.lit("info") if level is None else level).alias("level"))


# ---- reports -----------------------------------------------------------------------------------------------------------------------
def reliability_report(df: DataFrame, key: str, age: str, cycle: str, split: str, cols: Sequence[str], wanted: Sequence[str], ranges: Mapping[str, tuple[float, float]], labels: Sequence[str], denied: Sequence[str], weights: Sequence[str]) -> DataFrame:
    """Eleven sections and the tiers of features. Plausibility, coverage and drift look at adults; no usable feature is a blocking finding."""
    c, adult = F.col, screen.adults(df, age)
    here = [w for w in wanted if w in df.columns]
    names = df.sparkSession.createDataFrame([(w, float(w in df.columns), w in denied) for w in wanted], "name string, present double, denied boolean")
    n = df.agg(F.count("*").alias("n"))
    pl = stats.plausibility(adult, ranges)
    dup = stats.duplicate_report(df.select(key, *cols), key)
    per_split = stats.coverage(adult, here, [split]).select("feature", c(split).cast("string").alias("part"), "coverage")
    cap = quality.capabilities(df, key, [cycle], labels)
    drift = stats.cycle_drift(adult, here, cycle)
    tiers = plans.eligibility(adult, wanted, cycle, ranges, denied)
    share = lambda w: F.avg(null_safe(c(w) > 0).cast("double")).alias(w)
    parts = [
        _finding(n, "provenance", F.lit("rows"), c("n")),
        _finding(n, "provenance", F.lit("columns"), F.lit(len(df.columns))),
        _finding(names, "schema", c("name"), c("present"), _level(c("present") == 0, "warning")),
        _finding(pl, "plausibility", c("feature"), c("out_of_range") / c("observed"), F.when(c("hard"), "blocking").otherwise(_level(c("flagged"), "warning"))),
        _finding(dup, "duplicates", F.lit("duplicate_rows"), c("duplicate_rows"), _level(c("duplicate_rows") > 0, "warning")),
        _finding(dup, "duplicates", F.lit("repeated_ids"), c("repeated_ids"), _level(c("repeated_ids") > 0, "warning")),
        _finding(per_split, "coverage", F.concat_ws("/", "feature", "part"), c("coverage")),
        _finding(drift, "drift", c("feature"), c("max_shift"), _level(c("drift"), "warning")),
        _finding(drift, "availability", c("feature"), c("availability"), _level(c("gap"), "warning")),
        _finding(stats.label_counts(df, labels), "labels", c("label"), c("positive")),
        _finding(names.filter("denied"), "leakage", c("name"), c("present"), F.lit("blocking")),
        _finding(shape.to_long(df.agg(*map(share, weights)), [], weights), "weights", c("feature"), c("value")),
        _finding(cap, "capability", c("supports"), c("usable_labels")),
        _finding(n, "row_counts", F.lit("rows"), c("n")),
        _finding(adult.agg(F.count("*").alias("n")), "row_counts", F.lit("adults"), c("n")),
        _finding(adult.groupBy(split).agg(F.count("*").alias("n")), "row_counts", c(split), c("n")),
        _finding(tiers, "tier", F.concat_ws("/", "feature", "tier"), c("coverage")),
        _finding(tiers.agg(F.count_if(c("tier") == "usable_now").alias("n")), "tier", F.lit("usable features"), c("n"), _level(c("n") == 0, "blocking")),
    ]
    return reduce(DataFrame.unionByName, parts)


def research_pass(steps: Mapping[str, DataFrame]) -> DataFrame:
    """Findings of several reports, stamped by step; a step without section and level is counted by its first column."""
    out = []
    for name, d in steps.items():
        if "section" not in d.columns:
            d = _finding(d.groupBy(d.columns[0]).agg(F.count("*").alias("n")), name, F.col(d.columns[0]), F.col("n"))
        out.append(d.select(F.lit(name).alias("step"), "section", "item", "value", "level"))
    return reduce(DataFrame.unionByName, out)


def build_report(df: DataFrame, targets: Sequence[str], status: DataFrame) -> DataFrame:
    """Labelled, positive and negative rows per target, and one finding per source; ``status`` is (path, status)."""
    t = stats.label_counts(df, targets)
    rows = [_finding(t, "labelled", F.col("label"), F.col("positive") + F.col("negative")), _finding(t, "positive", F.col("label"), F.col("positive")), _finding(t, "negative", F.col("label"), F.col("negative"))]
    loaded = F.col("status") == "loaded"
    return reduce(DataFrame.unionByName, [*rows, _finding(status, "source", F.col("path"), loaded.cast("double"), _level(~loaded, "warning"))])


# ---- preparation ---------------------------------------------------------------------------------------------------------------------
def build_splits(cohort: DataFrame, entity: str, year: str, cutoff: int, fractions: Sequence[tuple[str, float]] = SPLITS, cap: float = 0.25, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rows with ``split`` (the temporal holdout takes precedence), and a manifest: rows, entities and years per split."""
    d = shape.temporal_holdout(shape.group_split(cohort, entity, fractions, seed), year, cutoff, cap)
    d = d.withColumn("split", F.when(F.col("temporal"), "temporal").otherwise(F.col("split"))).drop("temporal")
    manifest = d.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct(entity).alias("entities"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))
    return d, manifest


def prepare(events: DataFrame, entity: str, code: str, value: str, features: Sequence[str], outcome: str, index_days: float, horizons: Sequence[int], order: str, rules: Mapping[str, Column]) -> dict[str, DataFrame]:
    """Validated events -> cohort -> visits up to the index date -> patient features with labels; the events' time is ``ts``. Keys: findings, cohort, visits, features, splits, manifest, timeline."""
    good, findings = plans.validate_events(events, [entity, "ts", code], "ts", order, rules)
    cohort = plans.build_cohort(good, entity, outcome, index_days, horizons)
    before = shape.before_index(good, entity, "ts", cohort.select(entity, "index_date"))
    visits = shape.visit_matrix(before, entity, "ts", code, value, features, order)
    labels = [c for c in cohort.columns if c.startswith(("label_", "eligible_"))]
    feats = stats.trajectory_features(visits, entity, "ts", [f"feature_{f}" for f in features]).join(cohort.select(entity, "time_days", "cause", *labels), entity)
    splits, manifest = build_splits(cohort.withColumn("index_year", F.year("index_date")), entity, "index_year", 9999)
    timeline = quality.timeline_checks(visits.join(cohort.select(entity, "index_date", "time_days"), entity), "ts", "index_date", "time_days")
    return {"findings": findings, "cohort": cohort, "visits": visits, "features": feats, "splits": splits, "manifest": manifest, "timeline": timeline}


def pool_cycles(cycles: Sequence[tuple[str, Sequence[DataFrame]]], key: str) -> DataFrame:
    """Components of each cycle joined on the participant, cycles stacked by name with their place and a key that holds across cycles."""
    stamped = [shape.full_join_chain(parts, key).withColumn("survey_cycle", F.lit(name)).withColumn("survey_cycle_index", F.lit(i)) for i, (name, parts) in enumerate(cycles)]
    d = shape.union_loose(stamped)
    return d.withColumn("global_id", composite_key("survey_cycle", key))


# ---- scoring ---------------------------------------------------------------------------------------------------------------------------
def score_dataset(df: DataFrame, key: str, score: Column, required: Sequence[str], reference: DataFrame, reference_score: str) -> DataFrame:
    """Every row with its status; accepted ones have score, percentile in the reference and band, the others say which fields they lack."""
    lack = screen.problems({c: F.col(c).isNull() for c in required})
    d = df.withColumn("missing", F.array_join(lack, ",")).withColumn("_own", F.when(F.size(lack) == 0, score))
    p = shape.reference_percentile(d.filter("_own IS NOT NULL"), "_own", reference, reference_score).select(key, "percentile")
    out = d.join(p, key, "left")
    return out.select(key, F.when(F.col("missing") == "", "scored").otherwise("rejected").alias("status"), "missing", F.col("_own").alias("score"), "percentile", F.when(F.col("percentile").isNotNull(), percentile_band(F.col("percentile"))).alias("band"))


def assess(df: DataFrame, key: str, required: Sequence[str], optional: Sequence[str], probability: Column, bands: Sequence[tuple[float, str]]) -> DataFrame:
    """Per record: ``incomplete`` with the required fields that it lacks, or ``assessed`` with probability and band; ``follow_ups`` are the optional fields not given. ``bands``: (from, name), ascending."""
    lack, more = (screen.problems({c: F.col(c).isNull() for c in cols}) for cols in (required, optional))
    p = F.when(F.size(lack) == 0, probability)
    band = F.coalesce(*(F.when(p >= at, name) for at, name in reversed(list(bands))))
    return df.select(key, F.when(F.size(lack) == 0, "assessed").otherwise("incomplete").alias("status"), F.array_join(lack, ",").alias("missing"), p.alias("probability"), band.alias("band"), F.array_join(more, ",").alias("follow_ups"))


def pathways(standout: DataFrame, questions: DataFrame, rank_by: str, k: int = 3) -> DataFrame:
    """At most ``k`` features per pathway, the strongest first; ``questions`` is (pathway, feature)."""
    return screen.top_per_group(questions.join(standout, "feature"), "pathway", [F.desc(rank_by), "feature"], k)


def score_records(train: DataFrame, records: DataFrame, key: str, cols: Sequence[str], k: int, top: int = 5) -> DataFrame:
    """Scaled records, encoded by ``k`` principal components of the training rows: mean squared error of the decoding, its percentile among the training rows and the ``top`` fields that contribute most. A NULL counts as the training median."""
    fitted = models.fit_impute(train, cols)
    scale = models.fit_standard_scale(models.apply_impute(train, fitted), cols)
    ready = lambda d: models.apply_scale(models.apply_impute(d, fitted), scale).select(key, F.array(*cols).alias("v"))
    x = ready(train)
    axes = models.principal_axes(x, "v", k)  # p x k values

    def decode(batches):
        import pandas as pd

        for b in batches:
            v = np.stack(b["v"].to_numpy())
            r = (v - v @ axes @ axes.T) ** 2
            best = np.argsort(-r, axis=1, kind="stable")[:, :top]
            yield pd.DataFrame({"id": b["id"], "error": r.mean(1), "fields": [[cols[j] for j in row] for row in best]})

    run = lambda d: d.select(F.col(key).alias("id"), "v").mapInPandas(decode, "id long, error double, fields array<string>").withColumnRenamed("id", key)
    return shape.reference_percentile(run(ready(records)), "error", run(x), "error").select(key, "error", "percentile", "fields")


def replay_trees(df: DataFrame, key: str, cols: Sequence[str], nodes: DataFrame, base: float = 0.0) -> DataFrame:
    """Raw score of a tree ensemble given as nodes (tree, node, feature or -1 for a leaf, threshold, left, right, missing_left, value): x <= threshold goes left, a NULL where ``missing_left`` says. The nodes are the model, and travel with the task."""
    trees = [g.sort_values("node").reset_index(drop=True) for _, g in nodes.toPandas().groupby("tree")]

    def walk(batches):
        import pandas as pd

        for b in batches:
            x, total = np.array([[np.nan if z is None else z for z in v] for v in b["v"]], float).reshape(len(b), len(cols)), np.full(len(b), base)
            for t in trees:
                f, at = t["feature"].to_numpy(), np.zeros(len(b), int)
                cut, left, right, na, val = (t[c].to_numpy() for c in ("threshold", "left", "right", "missing_left", "value"))
                while (i := np.flatnonzero(f[at] >= 0)).size:
                    n = at[i]
                    z = x[i, f[n]]
                    at[i] = np.where(np.where(np.isnan(z), na[n], z <= cut[n]), left[n], right[n])
                total += val[at]
            yield pd.DataFrame({"id": b["id"], "raw": total})

    return df.select(F.col(key).alias("id"), F.array(*(F.col(c).cast("double") for c in cols)).alias("v")).mapInPandas(walk, "id long, raw double").withColumnRenamed("id", key)


def reload_parity(train: DataFrame, test: DataFrame, key: str, y: str, cols: Sequence[str], path: str, tolerance: float = 1e-9) -> DataFrame:
    """Scores of a fitted model against those of its saved and reloaded copy; ``path`` lies in shared storage."""
    m = LogisticRegression(featuresCol="_x", labelCol=y, weightCol="_w", regParam=1e-4).fit(models._features(models.balanced(train, y), cols))
    m.write().overwrite().save(path)
    a, b = (models._score(k, test, cols).select(key, "score") for k in (m, LogisticRegressionModel.load(path)))
    return shape.parity(a, b, [key], "score", tolerance)


# ---- model jobs --------------------------------------------------------------------------------------------------------------------------
Fit = Callable[[DataFrame, DataFrame], DataFrame]


def predictive_baseline(df: DataFrame, key: str, targets: Sequence[str], cols: Sequence[str], least: int = 80) -> DataFrame:
    """A logistic model per target over complete rows with a stratified 80/20 split, next to the constant baseline; a target without column, values or rows is skipped with the reason."""
    out, schema = [], "target string, status string, reason string, rows_used long, auroc double, average_precision double, accuracy double, baseline_accuracy double"
    for t in targets:
        feats = [c for c in cols if c != t]
        if t not in df.columns:
            out.append((t, "skipped", "target column absent", None, None, None, None, None))
            continue
        d = screen.training_frame(df, t, feats)
        n = d.count()
        if n < least:
            out.append((t, "skipped", "too few rows", n, None, None, None, None))
            continue
        d = materialise(shape.stratified_split(d, t, key, 0.2))
        train, test = d.filter("NOT test"), d.filter("test")
        s = materialise(models.logistic(train, test, t, feats, weighted=False).select(t, "score"))
        rate = train.agg(F.avg(t)).first()[0]
        hit = s.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col(t)).cast("double")), F.avg((F.lit(int(rate >= 0.5)) == F.col(t)).cast("double"))).first()
        out.append((t, "fitted", None, n, stats.auroc(s, t, "score").first()[0], stats.average_precision(s, t, "score").first()[0], hit[0], hit[1]))
    return df.sparkSession.createDataFrame(out, schema)


def risk_pipeline(df: DataFrame, key: str, y: str, split: str, fits: Mapping[str, Fit], group: str = "overall") -> DataFrame:
    """Per model and split: rows, events, AUROC, average precision, Brier and calibration line of scores calibrated on ``validation``, the AUROC of shuffled labels as control, and whether
    the model was selected (on validation alone; none if no model is admissible)."""
    train, rest = df.filter(F.col(split) == "train"), df.filter(F.col(split) != "train")
    metrics, dealt = None, shape.dealt_values(rest.select(key, split, F.col(y).alias("_dealt")), "_dealt", key, by=[split])  # of every model
    for name, fit in fits.items():
        raw = materialise(fit(train, rest).select(key, y, split, "score"))
        p = models.calibrate(raw.filter(F.col(split) == "validation"), raw, "score", y).select(key, y, split, "calibrated")
        cells = shape.permuted_by(p, dealt, key, by=[split]).groupBy(split, y, "_dealt", "calibrated").agg(F.count("*").alias("_n"))
        cells = materialise(cells)  # every metric reads these counts only
        parts = [r[0] for r in cells.select(split).distinct().orderBy(split).collect()]  # the splits
        m = cells.groupBy(split).agg(F.sum("_n").alias("n"), F.sum(F.col(y) * F.col("_n")).cast("long").alias("events"))
        lines = (evaluate.calibration_line(cells.filter(F.col(split) == part), y, "calibrated", weight="_n").withColumn(split, F.lit(part)) for part in parts)
        own = {"by": [split], "weight": "_n"}
        for one in (stats.auroc(cells, y, "calibrated", **own), stats.average_precision(cells, y, "calibrated", **own), stats.brier(cells, y, "calibrated", **own), reduce(DataFrame.unionByName, lines), stats.auroc(cells, "_dealt", "calibrated", **own).withColumnRenamed("auroc", "control")):
            m = m.join(one, split)  # a row a split
        m = m.select(*(c for c in m.columns if c != split), F.lit(name).alias("model"), F.col(split).alias("split"), F.lit(group).alias("group"))
        metrics = m if metrics is None else metrics.unionByName(m)
    metrics = materialise(metrics)
    best = plans.select_model(metrics.filter("split = 'validation'").select("group", "model", "slope", "auroc"), ["group"]).select("group", F.col("model").alias("_best"))
    return metrics.join(best, "group").withColumn("selected", F.coalesce(F.col("model") == F.col("_best"), F.lit(False))).drop("_best", "group")


def baseline_report(df: DataFrame, key: str, vec: str, train: Column, k: int = 16, trees: int = 200) -> DataFrame:
    """Two unsupervised deviation scores over the rows that are not ``train``: distributions, rank agreement and overlap of the top twentieth. The reconstruction error is taken as a robust z of the training rows, cut at 0."""
    p, f = models.pca_deviation(df, key, vec, k), models.isolation_forest(df, key, vec, trees)
    d = materialise(df.select(key, train.alias("_train")).join(p, key).join(f, key))
    ref = stats.robust_location_scale(d.filter("_train"), "reconstruction_error")
    d = d.crossJoin(F.broadcast(ref)).filter("NOT _train").withColumn("pca", F.greatest(F.lit(0.0), (F.col("reconstruction_error") - F.col("median")) / F.col("scale")))  # one row
    one = lambda c, n: stats.distribution(d, c).select(F.lit(n).alias("item"), *(F.struct(F.lit(k_).alias("name"), F.col(k_).alias("value")).alias(k_) for k_ in ("mean", "p50", "p95")))
    rows = lambda x: x.select("item", F.explode(F.array("mean", "p50", "p95")).alias("x")).select("item", F.col("x.name").alias("measure"), F.col("x.value").alias("value"))
    agree = lambda x, n, c: x.select(F.lit("agreement").alias("item"), F.lit(n).alias("measure"), F.col(c).alias("value"))
    return reduce(DataFrame.unionByName, [rows(one("pca", "pca")), rows(one("isolation_score", "isolation")), agree(stats.spearman(d, "pca", "isolation_score"), "spearman", "spearman"), agree(stats.top_flag_jaccard(d, "pca", "isolation_score"), "jaccard", "jaccard")])


def prototypes(df: DataFrame, label: str, cols: Sequence[str], panel: int = 8, least: int = 5) -> DataFrame:
    """Per cluster and feature: median, robust standardised difference from all rows (NULL with too few values or no scale), its direction and, for the ``panel`` largest, the place."""
    long = shape.to_long(df, [label], cols)
    every = stats.robust_location_scale(long, "value", ["feature"], floor=0.0).withColumnRenamed("median", "_all")
    own = stats.exact_quantiles(long, "value", (0.5,), [label, "feature"]).select(label, "feature", F.col("q")[0].alias("median"))
    n = long.groupBy(label, "feature").agg(F.count("value").alias("n"))
    d = n.filter(F.col(label).isNotNull()).join(own, [label, "feature"], "left").join(F.broadcast(every), "feature", "left")  # one row a feature
    d = d.withColumn("smd", F.when(F.col("n") >= least, F.try_divide(F.col("median") - F.col("_all"), F.nullif("scale", F.lit(0.0)))))
    place = F.row_number().over(Window.partitionBy(label).orderBy(F.desc_nulls_last(F.abs("smd")), "feature"))  # clusters x features
    d = d.withColumn("panel", place)
    return d.select(label, "feature", "n", "median", "smd", F.when(F.col("smd") > 0, "higher").when(F.col("smd").isNotNull(), "lower").alias("direction"), F.when(F.col("smd").isNotNull() & (F.col("panel") <= panel), F.col("panel")).cast("long").alias("panel"))


def cluster_grid(df: DataFrame, key: str, vec: str, methods: Sequence[str], ks: Sequence[int], seed: int = 0, other_seed: int = 1, fraction: float = 0.8, rounds: int = 1) -> tuple[DataFrame, dict[str, DataFrame]]:
    """One row per method and number of clusters: indices, least share of a cluster, agreement (adjusted Rand) with fits of another seed and of parts of the rows, the index of rows whose
    columns were dealt apart, or the failure; and the labels of each."""
    fits = {"kmeans": lambda d, k, s: models.kmeans(d, vec, k, (s,))[0].select(key, vec, "cluster"), "mixture": lambda d, k, s: models.mixture(d, vec, k, s).select(key, vec, "cluster")}
    out, labels = [], {}
    schema = "candidate string, k int, status string, error string, clusters long, least_share double, calinski_harabasz double, davies_bouldin double, seed_ari double, part_ari double, null_calinski_harabasz double"
    null = materialise(shuffled_coordinates(df, key, vec, seed))
    for m in methods:
        for k in ks:
            try:
                fit = fits[m]
                d = materialise(fit(df, k, seed))
                ari = lambda o: stats.adjusted_rand(d.select(key, "cluster").join(o.select(key, F.col("cluster").alias("other")), key), "cluster", "other").first()[0]  # noqa: B023, E731
                size = d.groupBy("cluster").count().agg(F.count("*"), F.min("count") / F.sum("count")).first()
                parts = [ari(fit(df.filter(shape.uniform(seed + 7 + r, key) < fraction), k, seed)) for r in range(rounds)]
                index = lambda x: models.cluster_indices(x, vec, "cluster").first()[0]
                out.append((f"{m}-{k}", k, "evaluated", None, size[0], size[1], index(d), evaluate.davies_bouldin(d, vec, "cluster").first()[0], ari(fit(df, k, other_seed)), float(np.mean(parts)) if parts else None, index(fit(null, k, seed))))
                labels[f"{m}-{k}"] = d.select(key, "cluster")
            except Exception as e:  # a candidate that cannot be fitted is a row of the report
                if not models.is_fit_failure(e):
                    raise
                out.append((f"{m}-{k}", k, "failed", str(e)[:200], None, None, None, None, None, None, None))
    return df.sparkSession.createDataFrame(out, schema), labels


def shuffled_coordinates(df: DataFrame, key: str, vec: str, seed: int = 0) -> DataFrame:
    """Rows whose coordinates are dealt anew, each on its own: the same margins without clusters. Ranks by one hash take the values ranked by another."""
    long = df.select(key, F.posexplode(F.col(vec).cast("array<double>")).alias("i", "v")).withColumn("one", F.lit(1))
    rank = lambda d, s: shape.running_totals(d.withColumn("_h", F.xxhash64(F.lit(s), "i", key)), ["_h", key], ["one"], by=["i"]).withColumnRenamed("one_before", "_r")
    d = rank(long.drop("v"), seed).select(key, "i", "_r").join(rank(long, seed + 1).select("i", "_r", "v"), ["i", "_r"])
    return d.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias(vec))  # one vector a row


def cluster_pipeline(df: DataFrame, key: str, vec: str, methods: Sequence[str], ks: Sequence[int], least_share: float = 0.02, least_ari: float = 0.6) -> DataFrame:
    """The grid with failed gates and the selected candidate: stable under seeds and parts, no tiny cluster, better than dealt-apart rows; the lowest Davies-Bouldin index wins."""
    grid, _ = cluster_grid(df, key, vec, methods, ks)
    gates = {"one cluster": "clusters >= 2", "tiny cluster": f"least_share >= {least_share}", "seeds": f"seed_ari >= {least_ari}", "parts": f"part_ari >= {least_ari}", "null": "calinski_harabasz > null_calinski_harabasz"}
    return models.best_or_abstain(grid.withColumn("_by", -F.col("davies_bouldin")), gates, "_by").drop("_by")


def profile_model(df: DataFrame, profiles: Mapping[str, Column], continuous: Sequence[str], categories: Sequence[str], probs: Sequence[float], least: int = 250, few: int = 50, factors: bool = True) -> DataFrame:
    """Aggregates from which rows like those of each profile can be drawn, no row among them: weight, share missing, quantiles (of all rows where a profile has under ``few`` values) and shares of
    categories, and with ``factors`` the Cholesky factor of the rank correlation (field: its row, item: its column). A profile of under ``least`` rows is an error."""
    n = df.agg(F.count("*").alias("all"), *(F.count_if(m).alias(p) for p, m in profiles.items())).first()
    if small := [p for p in profiles if n[p] < least]:
        raise ValueError(f"profiles of under {least} rows: {small}")
    row = lambda d, p, kind, field, item, value: d.select(F.lit(p).alias("profile"), F.lit(kind).alias("kind"), field.alias("field"), item.cast("string").alias("item"), value.cast("double").alias("value"))
    out = [df.sparkSession.createDataFrame([(p, "weight", None, None, n[p] / n["all"]) for p in profiles], "profile string, kind string, field string, item string, value double")]
    grid = lambda d: stats.exact_quantiles(shape.to_long(d, [], continuous), "value", probs, ["feature"])
    for p, m in profiles.items():
        d = df.filter(m)
        share = screen.share_measured(d, continuous)
        out.append(row(share, p, "missing", F.col("feature"), F.lit(None), 1 - F.col("share")))
        q = share.select("feature", "measured").join(grid(d).withColumnRenamed("q", "own"), "feature", "left").join(grid(df), "feature", "left")
        q = q.select("feature", F.posexplode(F.when(F.col("measured") >= few, F.col("own")).otherwise(F.col("q"))).alias("i", "x"))
        out.append(row(q, p, "quantile", F.col("feature"), F.element_at(F.array(*map(F.lit, probs)), F.col("i") + 1), F.col("x")))
        out += [row(screen.category_distribution(d, c, df).filter("share > 0"), p, "category", F.lit(c), F.col(c), F.col("share")) for c in categories]
    if factors:
        cells = [(p, "factor", continuous[i], continuous[j], float(f[i, j])) for p, f in batched.rank_factors(df, dict(profiles), continuous).items() for i in range(len(continuous)) for j in range(i + 1)]
        out.append(df.sparkSession.createDataFrame(cells, out[0].schema))
    return reduce(DataFrame.unionByName, out)
