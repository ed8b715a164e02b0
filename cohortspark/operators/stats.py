"""Aggregations, evaluation metrics and association measures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import days_between, null_safe
from ..scratch import materialise
from .shape import ranged, running_totals, to_long, totals_in


def outcome_table(events: DataFrame, entity: str, outcomes: Sequence[str]) -> DataFrame:
    """One shuffle: first date of every outcome, first record, last record and distinct visits."""
    firsts = (F.min(F.when(F.col("outcome_type") == o, F.col("event_date"))).alias(f"{o}_date") for o in outcomes)
    return events.groupBy(entity).agg(F.min("ts").alias("first_observation"), F.max("ts").alias("last_record"), F.count_distinct("ts").alias("visits"), *firsts)


def first_by(df: DataFrame, entity: str, value: str, order: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(entity).agg(F.min_by(value, F.struct(order, value)).alias(f"first_{value}"))


def coverage(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Share of non-NULL values overall and by each cut, in one pass (grouping sets)."""
    long = to_long(df, list(by), cols)
    share = F.avg(F.when(F.col("value").isNotNull(), 1.0).otherwise(0.0))
    g = long.groupingSets([["feature"], *(["feature", b] for b in by)], "feature", *by)
    return g.agg(share.alias("coverage"), F.count("*").alias("n"))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by, q (array, linear interpolation) from running counts of distinct values: no group's values meet in one task. NULL and NaN values and NULL groups are left out."""
    known = df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in [value, *by]))
    return _quantiles_in(ranged(_value_counts(known, value, by), ["_x"]), probs, by)


def _value_counts(known: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    return known.groupBy(*by, F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("n")).filter(~F.isnan("_x"))


def _quantiles_in(counts: DataFrame, probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """by, q of a table of counts (_x, n) in ranges of _x; the table may be counted by more columns than ``by``."""
    r = totals_in(counts, ["_x"], ["n"], by=by)
    place = lambda p: F.lit(float(p)) * (F.col("n_total") - 1)
    at = lambda h: F.max(F.when((F.col("n_before") <= h) & (h < F.col("n_before") + F.col("n")), F.col("_x")))
    ends = [c for i, p in enumerate(probs) for c in (at(F.floor(place(p))).alias(f"_l{i}"), at(F.ceil(place(p))).alias(f"_h{i}"))]
    g = r.groupBy(*by).agg(F.max("n_total").alias("n_total"), *ends)
    return g.select(*by, F.array(*(F.col(f"_l{i}") + (place(p) - F.floor(place(p))) * (F.col(f"_h{i}") - F.col(f"_l{i}")) for i, p in enumerate(probs))).alias("q"))


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    q = exact_quantiles(to_long(df, list(by), cols), "value", probs, [*by, "feature"])
    return q.select(*by, "feature", *(F.col("q")[i].alias(f"p{round(100 * p)}") for i, p in enumerate(probs)))


def distribution(df: DataFrame, c: str, by: Sequence[str] = ()) -> DataFrame:
    q = exact_quantiles(df, c, (0.5, 0.9, 0.95, 0.99), by)
    m = df.groupBy(*by).agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd"))
    d = m.join(q, list(by), "left") if by else m.crossJoin(q)  # single rows
    return d.select(*by, "mean", "sd", *(F.col("q")[i].alias(n) for i, n in enumerate(("p50", "p90", "p95", "p99"))))


def cycle_drift(df: DataFrame, cols: Sequence[str], cycle: str, limit: float = 1.0, least: float = 0.01, least_cycles: float = 0.60) -> DataFrame:
    """feature, max_shift, cycles, availability, drift, gap of every feature with an interquartile range.

    max_shift: largest distance of any cycle's median from the pooled one, in pooled interquartile ranges, flagged as drift over ``limit``; a cycle measures a feature if more than
    ``least`` of its rows have it, and a feature that less than ``least_cycles`` of the cycles measure has a gap. Rows of no cycle count for the pooled values only. Values are counted once, by feature, cycle and value.
    """
    long = to_long(df, [cycle], cols)
    counts = ranged(_value_counts(long.filter("value IS NOT NULL"), "value", ["feature", cycle]), ["_x"])
    pooled = _quantiles_in(counts, (0.25, 0.5, 0.75), ["feature"]).select("feature", F.col("q")[1].alias("m"), (F.col("q")[2] - F.col("q")[0]).alias("iqr")).filter("iqr > 0")
    medians = _quantiles_in(counts.filter(F.col(cycle).isNotNull()), (0.5,), ["feature", cycle]).select("feature", cycle, F.col("q")[0].alias("cm"))
    share = long.filter(F.col(cycle).isNotNull()).groupBy("feature", cycle).agg(F.avg(F.col("value").isNotNull().cast("double")).alias("share"))
    per = share.join(medians, ["feature", cycle], "left").join(pooled, "feature")
    d = per.groupBy("feature").agg(F.coalesce(F.max(F.abs(F.col("cm") - F.col("m")) / F.col("iqr")), F.lit(0.0)).alias("max_shift"), F.count_if(F.col("share") > least).alias("cycles"), F.count("*").alias("_all"))
    d = d.withColumn("availability", F.col("cycles") / F.col("_all")).drop("_all")
    return d.withColumn("drift", F.col("max_shift") > limit).withColumn("gap", F.col("availability") < least_cycles)


def plausibility(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    table = F.create_map(*(F.lit(x) for n, (a, b) in ranges.items() for x in (n, f"{a}|{b}")))
    long = to_long(df, [], list(ranges)).filter("value IS NOT NULL").withColumn("_r", F.split(F.element_at(table, F.col("feature")), r"\|").cast("array<double>"))
    bad = (F.col("value") < F.col("_r")[0]) | (F.col("value") > F.col("_r")[1])
    g = long.groupBy("feature").agg(F.count("*").alias("observed"), F.count_if(bad).alias("out_of_range"), F.min("value").alias("least"), F.max("value").alias("most"))
    share = F.col("out_of_range") / F.col("observed")
    return g.withColumn("flagged", share > 0.01).withColumn("hard", share > 0.10)


def duplicate_report(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct rows and ids: two aggregation levels instead of a distinct over whole rows in one group."""
    per = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    ids = per.groupBy(key).agg(F.sum("_n").alias("_rows"), F.count("*").alias("_distinct"))
    return ids.agg(F.sum("_rows").alias("rows"), (F.sum("_rows") - F.sum("_distinct")).alias("duplicate_rows"), F.count(key).alias("ids"), F.count_if(F.col("_rows") > 1).alias("repeated_ids"))


def label_counts(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    long = to_long(df, [], labels, "label")
    return long.groupBy("label").agg(F.count_if(F.col("value") == 1).alias("positive"), F.count_if(F.col("value") == 0).alias("negative"), F.count_if(F.col("value").isNull()).alias("missing"))


def horizon_gate(df: DataFrame, time: str, event: str, horizons: Sequence[float], least: int = 50) -> DataFrame:
    d = df.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    g = d.groupBy("horizon").agg(F.count_if((F.col(event) == 1) & (F.col(time) <= F.col("horizon"))).alias("events"), F.count_if(F.col(time) >= F.col("horizon")).alias("non_events"))
    return g.withColumn("open", (F.col("events") >= least) & (F.col("non_events") >= least))


def count_gate(df: DataFrame, c: str, least: int = 50) -> DataFrame:
    return df.filter(F.col(c).isNotNull()).groupBy(c).count().withColumn("open", F.col("count") >= least)


def class_balance(df: DataFrame, horizons: Sequence[int], time: str, cause: str) -> DataFrame:
    """Per horizon: cases, competing, censored before and prevalence among the eligible."""
    d = df.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).withColumn("_in", F.col(time) <= F.col("horizon"))
    case, comp = (F.col(cause) == 1) & F.col("_in"), (F.col(cause) == 2) & F.col("_in")
    cens = (F.col(cause) == 0) & (F.col(time) < F.col("horizon"))
    g = d.groupBy("horizon").agg(F.count_if(case).alias("cases"), F.count_if(comp).alias("competing"), F.count_if(cens).alias("censored"), F.count_if(~cens & ~comp).alias("eligible"))
    return g.withColumn("prevalence", F.col("cases") / F.nullif(F.col("eligible"), F.lit(0)))


def trajectory_features(visits: DataFrame, entity: str, ts: str, cols: Sequence[str]) -> DataFrame:
    """Count, last, mean, delta and slope per year of every measure, and the context of the history (visits, days, visits per year, median gap, share missing), in one grouping."""
    gap = days_between(F.col(ts), F.lag(ts).over(Window.partitionBy(entity).orderBy(ts)))
    years = days_between(F.col(ts), F.min(ts).over(Window.partitionBy(entity))) / 365.25
    d, aggs = visits.withColumn("_t", years).withColumn("_gap", gap), []
    for c in cols:
        v, t = F.col(c), F.when(F.col(c).isNotNull(), F.col("_t"))
        last, first = F.max_by(v, t), F.min_by(v, t)
        # Of one value, or values of one time, change and slope are 0; without any they are unknown.
        slope = F.when(F.count(v) > 0, F.coalesce(F.try_divide(F.covar_pop(v, t), F.nullif(F.var_pop(t), F.lit(0.0))), F.lit(0.0)))
        aggs += [F.count(v).alias(f"{c}_observed_count"), last.alias(f"{c}_last"), F.avg(v).alias(f"{c}_mean"), F.when(F.count(v) >= 2, last - first).when(F.count(v) > 0, 0.0).alias(f"{c}_delta"), slope.alias(f"{c}_slope_per_year")]
    seen = sum((F.count(c) for c in cols), F.lit(0))
    burden = 1 - seen / (F.count("*") * len(cols))
    density = F.round(F.count("*") / (F.greatest(F.max("_t") * 365.25, F.lit(1.0)) / 365.25), 4)
    return d.groupBy(entity).agg(F.count("*").alias("visit_count"), (F.max("_t") * 365.25).alias("history_days"), density.alias("visit_density_per_year"), F.coalesce(F.median("_gap"), F.lit(0.0)).alias("median_visit_gap_days"), burden.alias("missingness_burden"), *aggs)


# ---- association -----------------------------------------------------------------------------------------------------------
def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    n = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    return n.withColumn("na", F.sum("n").over(Window.partitionBy("a"))).withColumn("nb", F.sum("n").over(Window.partitionBy("b")))


def cramers_v(df: DataFrame, a: str, b: str, bias_correction: bool = True) -> DataFrame:
    """chi2 of the table by sum n_ab^2 / (n_a n_b), then V; cells are few, so the last step is one small aggregation."""
    c = contingency(df, a, b)
    s = c.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))).alias("q"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("k"))
    n, r, k = F.col("n"), F.col("r"), F.col("k")
    chi2 = n * (F.col("q") - 1)
    s = s.withColumn("chi2", chi2)
    phi2 = F.col("chi2") / n
    if bias_correction:
        phi2 = F.greatest(F.lit(0.0), phi2 - (k - 1) * (r - 1) / (n - 1))
        r, k = r - (r - 1) * (r - 1) / (n - 1), k - (k - 1) * (k - 1) / (n - 1)
    return s.select("chi2", F.sqrt(phi2 / F.least(r - 1, k - 1)).alias("cramers_v"))


def correlation_ratio(df: DataFrame, label: str, value: str, least: int = 10) -> DataFrame:
    g = df.filter(F.col(value).isNotNull()).groupBy(label).agg(F.avg(value).alias("m"), F.count("*").alias("n"), F.sum(F.col(value) * F.col(value)).alias("s2"))
    t = g.agg(F.sum(F.col("m") * F.col("n")).alias("s"), F.sum("n").alias("n"), F.sum("s2").alias("s2"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("b"))
    mean2 = F.col("s") * F.col("s") / F.col("n")
    return t.select(F.when(F.col("n") >= least, F.sqrt((F.col("b") - mean2) / F.nullif(F.col("s2") - mean2, F.lit(0.0)))).alias("eta"))


def _median(df: DataFrame, c: str, by: Sequence[str], name: str) -> DataFrame:
    return exact_quantiles(df, c, (0.5,), by).select(*by, F.col("q")[0].alias(name))


def robust_location_scale(df: DataFrame, c: str, by: Sequence[str] = (), floor: float = 1e-8) -> DataFrame:
    """Median and 1.4826 times the median absolute deviation (``floor`` at least)."""
    m = _median(df, c, by, "median")
    d = df.join(m, list(by)) if by else df.crossJoin(F.broadcast(m))  # without groups m has one row
    mad = _median(d.withColumn("_off", F.abs(F.col(c) - F.col("median"))), "_off", by, "mad")
    out = m.join(mad, list(by)) if by else m.crossJoin(mad)  # single rows
    return out.select(*by, "median", F.greatest(1.4826 * F.col("mad"), F.lit(floor)).alias("scale"))


def robust_smd(df: DataFrame, group: str, value: str, least: int = 5) -> DataFrame:
    """(median of the group - median of the others) / scale of the others, for a 0/1 group column; NULL with fewer than ``least`` values on a side or no scale."""
    ref = robust_location_scale(df.filter(F.col(group) == 0), value, floor=0.0)
    g = _median(df.filter(F.col(group) == 1), value, (), "gm")
    n = df.agg(F.count(F.when(F.col(group) == 1, F.col(value))).alias("a"), F.count(F.when(F.col(group) == 0, F.col(value))).alias("b"))
    smd = F.try_divide(F.col("gm") - F.col("median"), F.nullif("scale", F.lit(0.0)))
    return n.join(g, how="left").join(ref, how="left").select(F.when((F.col("a") >= least) & (F.col("b") >= least), smd).alias("robust_smd"))  # single rows


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation; NULL where a column is constant (``corr`` raises there)."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def average_ranks(df: DataFrame, c: str) -> DataFrame:
    r = running_totals(df.groupBy(c).agg(F.count("*").alias("n")), [c], ["n"])
    return r.select(c, (F.col("n_before") + (F.col("n") + 1) / 2).alias(f"{c}_rank"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    d = df.select(a, b).dropna()
    d = d.join(average_ranks(d, a), a).join(average_ranks(d, b), b)
    return d.agg(correlation(F.col(f"{a}_rank"), F.col(f"{b}_rank")).alias("spearman"))


def top_flag_jaccard(df: DataFrame, a: str, b: str, q: float = 0.95) -> DataFrame:
    cut = exact_quantiles(df, a, (q,)).select(F.col("q")[0].alias("_qa")).crossJoin(exact_quantiles(df, b, (q,)).select(F.col("q")[0].alias("_qb")))  # single rows
    d = df.crossJoin(F.broadcast(cut))  # one row
    x, y = F.col(a) >= F.col("_qa"), F.col(b) >= F.col("_qb")
    return d.agg((F.count_if(x & y) / F.count_if(x | y)).alias("jaccard"))


def difference_in_means(df: DataFrame, t: str, y: str) -> DataFrame:
    return df.agg((F.avg(F.when(F.col(t) == 1, F.col(y))) - F.avg(F.when(F.col(t) == 0, F.col(y)))).alias("effect"))


def stratified_effect(df: DataFrame, t: str, y: str, stratum: str) -> DataFrame:
    g = df.groupBy(stratum).agg((F.avg(F.when(F.col(t) == 1, F.col(y))) - F.avg(F.when(F.col(t) == 0, F.col(y)))).alias("e"), F.count("*").alias("n")).filter("e IS NOT NULL")
    return g.agg((F.sum(F.col("e") * F.col("n")) / F.sum("n")).alias("effect"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    c = contingency(df, a, b)
    s = c.agg(F.sum(pairs("n")).alias("ab"), F.sum("n").alias("n"), F.sum(pairs("na") / F.col("na") * F.col("n")).alias("sa"), F.sum(pairs("nb") / F.col("nb") * F.col("n")).alias("sb"))
    expected = F.col("sa") * F.col("sb") / pairs("n")
    return s.select(((F.col("ab") - expected) / ((F.col("sa") + F.col("sb")) / 2 - expected)).alias("ari"))


def clusterwise_jaccard(df: DataFrame, a: str, b: str) -> DataFrame:
    return contingency(df, a, b).groupBy(F.col("a").alias("cluster")).agg(F.max(F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("jaccard"))


def cluster_sizes(df: DataFrame, label: str) -> DataFrame:
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row a cluster


def size_profile(df: DataFrame, label: str, noise: object = -1) -> DataFrame:
    """One row: rows, clusters, share of noise and of the smallest cluster (both of all rows); rows without a label are noise."""
    n = df.groupBy(F.coalesce(F.col(label), F.lit(noise)).alias("c")).agg(F.count("*").alias("n"))
    own = F.when(F.col("c") != noise, F.col("n"))
    return n.agg(F.sum("n").alias("rows"), F.count(own).alias("clusters"), F.coalesce(F.try_divide(F.sum("n") - F.coalesce(F.sum(own), F.lit(0)), F.sum("n")), F.lit(0.0)).alias("noise_share"), F.coalesce(F.try_divide(F.min(own), F.sum("n")), F.lit(0.0)).alias("smallest_share"))


def deviation_by_cluster(df: DataFrame, label: str, deviation: str) -> DataFrame:
    """label, n, median and 90th percentile of the deviation of a cluster's rows."""
    q = exact_quantiles(df, deviation, (0.5, 0.9), [label])
    n = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(deviation).alias("n"))
    return n.join(q, label, "left").select(label, "n", F.col("q")[0].alias("deviation_median"), F.col("q")[1].alias("deviation_p90"))


def suppressed_prevalence(df: DataFrame, group: str, y: str, least: int = 50) -> DataFrame:
    g = df.groupBy(group).agg(F.count(y).alias("n"), F.avg(y).alias("_p"))
    return g.select(group, F.when(F.col("n") >= least, F.col("n")).alias("n"), F.when(F.col("n") >= least, F.col("_p")).alias("prevalence"), (F.col("n") < least).alias("suppressed"))


def mean_shift(df: DataFrame, y: str, cols: Sequence[str]) -> DataFrame:
    d = to_long(df, [y], cols).groupBy("feature").agg((F.avg(F.when(F.col(y) == 1, F.col("value"))) - F.avg(F.when(F.col(y) == 0, F.col("value")))).alias("shift"))
    return d.withColumn("direction", F.when(F.col("shift") > 0, "higher").otherwise("lower"))


def array_topk_frequency(df: DataFrame, arr: str, per_row: int = 3, k: int = 10) -> DataFrame:
    n = df.select(F.explode(F.slice(arr, 1, per_row)).alias("item")).groupBy("item").count()
    return n.orderBy(F.desc("count"), "item").limit(k)


# ---- evaluation of (label, score) ----------------------------------------------------------------------------------------------
def _by_score(df: DataFrame, y: str, p: str, by: Sequence[str], weight: str | None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1)
    g = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by, F.col(p).alias("s")).agg(F.sum(F.when(F.col(y) == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) == 0, w).otherwise(0)).alias("neg"))
    return running_totals(g, ["s"], ["pos", "neg"], descending=True, by=by)


def auroc(df: DataFrame, y: str, p: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Mann-Whitney with ties at one half, over distinct scores; 0.5 with one class."""
    d = _by_score(df, y, p, by, weight)
    won = F.sum(F.col("neg") * (F.col("pos_before") + F.col("pos") / 2.0))
    return d.groupBy(*by).agg(F.coalesce(won / F.nullif(F.max("pos_total") * F.max("neg_total"), F.lit(0)), F.lit(0.5)).alias("auroc"))


def average_precision(df: DataFrame, y: str, p: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    d = _by_score(df, y, p, by, weight)
    tp = F.col("pos_before") + F.col("pos")
    precision = tp / F.nullif(tp + F.col("neg_before") + F.col("neg"), F.lit(0))
    return d.groupBy(*by).agg(F.sum(F.col("pos") / F.nullif(F.col("pos_total"), F.lit(0)) * precision).alias("average_precision"))


def threshold_metrics(df: DataFrame, y: str, p: str, at: float = 0.5) -> DataFrame:
    hit, pos = F.col(p) >= at, F.col(y) == 1
    d = df.agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    d = d.select(div(tp + tn, tp + fp + fn + tn).alias("accuracy"), div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(tn, tn + fp).alias("specificity"), div(tp + fp, tp + fp + fn + tn).alias("positive_rate"))
    return d.withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / 2).withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def brier(df: DataFrame, y: str, p: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    e = (F.col(p) - F.col(y)) * (F.col(p) - F.col(y))
    return df.groupBy(*by).agg((F.try_divide(F.sum(e * F.col(weight)), F.sum(F.when(e.isNotNull(), F.col(weight)))) if weight else F.avg(e)).alias("brier"))


def calibration_curve(df: DataFrame, y: str, p: str, key: str) -> DataFrame:
    """Equal-count chunks by score, sizes as of ntile, from global ranks."""
    d = running_totals(df.withColumn("one", F.lit(1)), [p, key], ["one"])
    n = F.col("one_total")
    b = F.least(F.lit(10), F.greatest(F.lit(1), F.floor(n / 10)))
    size, extra = F.floor(n / b), F.pmod(n, b)
    r = F.col("one_before")
    chunk = F.when(r < extra * (size + 1), F.floor(r / (size + 1))).otherwise(extra + F.floor((r - extra * (size + 1)) / size))
    return d.groupBy(chunk.alias("chunk")).agg(F.avg(p).alias("mean_score"), F.avg(y).alias("observed"), F.count("*").alias("n"))


def decision_curve(df: DataFrame, y: str, p: str, thresholds: Sequence[float]) -> DataFrame:
    d = df.select(F.col(y).alias("_y"), F.col(p).alias("_p"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    hit, pos, t = F.col("_p") >= F.col("threshold"), F.col("_y") == 1, F.col("threshold")
    g = d.groupBy("threshold").agg(F.count_if(hit).alias("flagged"), F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count("*").alias("n"), F.avg("_y").alias("prevalence"))
    odds = t / (1 - t)
    return g.select("threshold", "flagged", (F.col("flagged") / F.col("n")).alias("flagged_share"), "tp", "fp", (100 * F.col("fp") / F.col("n")).alias("false_alerts_per_100"), (F.col("tp") / F.col("n") - F.col("fp") / F.col("n") * odds).alias("net_benefit"), (F.col("prevalence") - (1 - F.col("prevalence")) * odds).alias("treat_all"))


def c_index(df: DataFrame, time: str, event: str, risk: str) -> DataFrame:
    """Harrell's C over all pairs of an event and a later time; ties of risk count one half, pairs with a NULL risk count as lost.

    Dyadic blocks of risk ranks: two ranks are the two halves of one block at exactly one level. There, events of the upper half are
    counted before the rows of the lower half by running totals over time, so no pair is ever a row.
    """
    cells = df.filter(F.col(time).isNotNull()).groupBy(F.col(time).alias("t"), F.col(risk).alias("v")).agg(F.count("*").alias("n"), F.count_if(F.col(event) == 1).alias("e"))
    ranks = running_totals(cells.filter("v IS NOT NULL").select("v").distinct().withColumn("one", F.lit(1)), ["v"], ["one"]).select("v", F.col("one_before").alias("r"), F.col("one_total").alias("ranks"))
    ranked = materialise(cells.join(ranks, "v", "left").select("t", "n", "e", "r", "ranks"))
    bits = int(ranked.agg(F.max("ranks")).first()[0] or 1).bit_length()
    level = F.col("level")
    upper = F.expr("shiftright(r, level) & 1") == 1
    zero = F.lit(0).cast("long")
    # Level -2: all pairs, -1: ties; from 0 the halves of blocks of 2^(level + 1) ranks.
    d = ranked.withColumn("level", F.explode(F.when(F.col("r").isNull(), F.array(F.lit(-2))).otherwise(F.sequence(F.lit(-2), F.lit(bits - 1)))))
    block = F.when(level == -2, zero).when(level == -1, F.col("r")).otherwise(F.expr("shiftright(r, level + 1)"))
    d = d.select(level, block.alias("block"), "t", F.when((level < 0) | upper, F.col("e")).otherwise(zero).alias("early"), F.when((level < 0) | ~upper, F.col("n")).otherwise(zero).alias("late"))
    d = running_totals(d.groupBy("level", "block", "t").agg(F.sum("early").alias("early"), F.sum("late").alias("late")), ["level", "block", "t"], ["early"])
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    # What lies before the block is the same for all its rows.
    per = d.groupBy("level", "block").agg((F.sum(whole("late") * whole("early_before")) - F.sum("late").cast("decimal(19,0)") * F.min("early_before").cast("decimal(19,0)")).alias("pairs"))
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("pairs"))), F.lit(0)).cast("double")
    return per.agg(F.try_divide(of(level >= 0) + of(level == -1) / 2, of(level == -2)).alias("c_index"))


def subgroup_metrics(df: DataFrame, y: str, p: str, groups: Sequence[str], least: int = 10) -> DataFrame:
    long = df.select(F.col(y).alias("y"), F.col(p).alias("p"), *groups).unpivot(["y", "p"], list(groups), "subgroup", "level")
    n = long.groupBy("subgroup", "level").agg(F.count("*").alias("n"), F.sum("y").alias("events"), F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"))
    d = n.join(auroc(long, "y", "p", by=["subgroup", "level"]), ["subgroup", "level"])
    ok = (F.col("events") >= least) & (F.col("events") < F.col("n"))
    return d.select("subgroup", "level", "n", "events", F.when(ok, F.col("brier")).alias("brier"), F.when(ok, F.col("auroc")).alias("auroc"))


def any_violation(rules: Mapping[str, Column]) -> Column:
    """Codes of the rules that a row breaks."""
    return F.filter(F.array(*(F.when(null_safe(bad), F.lit(code)) for code, bad in rules.items())), lambda x: x.isNotNull())
