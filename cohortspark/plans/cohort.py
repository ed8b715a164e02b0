"""Compositions: event validation, cohort, labels, reliability, eligibility."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import days_between, null_safe
from ..operators import shape, stats


def harmonise_units(df: DataFrame, code: str, unit: str, value: str, table: DataFrame) -> DataFrame:
    """``table``: (code, unit, target_unit, slope, intercept), a fixed table of some dozen rows. Unknown units stay and are marked."""
    d = df.join(F.broadcast(table), [code, unit], "left")  # a fixed table
    return d.withColumn(value, F.coalesce(F.col(value) * F.col("slope") + F.col("intercept"), F.col(value))).withColumn("unit_known", F.col("slope").isNotNull()).withColumn(unit, F.coalesce("target_unit", unit)).drop("slope", "intercept", "target_unit")


def null_implausible(df: DataFrame, code: str, value: str, reason: str, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    bad = F.lit(False)
    for name, (low, high) in ranges.items():
        bad = bad | (null_safe(F.col(code) == name) & null_safe(~F.col(value).between(low, high)))
    return df.withColumn(reason, F.when(bad, "implausible").otherwise(F.col(reason))).withColumn(value, F.when(~bad, F.col(value)))


def validate_events(df: DataFrame, keys: Sequence[str], ts: str, arrival: str, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, last copy per key, and a findings table (code, rows)."""
    marked = df.withColumn("_v", stats.any_violation(rules))
    findings = marked.select(F.explode("_v").alias("code")).groupBy("code").agg(F.count("*").alias("rows"))
    good = shape.keep_last(marked.filter(F.size("_v") == 0).drop("_v"), keys, [F.desc(arrival)])
    removed = df.groupBy(*keys).count().agg(F.lit("duplicate_key").alias("code"), F.sum(F.col("count") - 1).alias("rows"))
    return good, findings.unionByName(removed)


def build_cohort(events: DataFrame, entity: str, outcome: str, index_days: float, horizons: Sequence[int], min_history: float = 0.0, min_visits: int = 1) -> DataFrame:
    """Index date = first record + index_days; prevalent cases, short histories and few visits are excluded; labels per horizon.

    cause: 1 outcome, 2 competing, 0 censored; label 1 within the horizon, 0 known free, NULL censored before it.
    """
    o = stats.outcome_table(events, entity, [outcome, "competing"])
    index = F.timestamp_micros(F.unix_micros(F.col("first_observation").cast("timestamp")) + F.lit(int(index_days * 86_400_000_000)))
    d = o.withColumn("index_date", index)
    d = d.withColumn("follow_up_days", days_between(F.col("last_record"), F.col("index_date")))
    d = d.withColumn("event_days", days_between(F.col(f"{outcome}_date"), F.col("index_date"))).withColumn("competing_days", days_between(F.col("competing_date"), F.col("index_date")))
    d = d.withColumn("excluded_prevalent", null_safe(F.col("event_days") <= 0)).withColumn("excluded_short", null_safe(F.col("follow_up_days") <= 0)).withColumn("excluded_visits", F.col("visits") < min_visits)
    d = d.filter(~F.col("excluded_prevalent") & ~F.col("excluded_short") & ~F.col("excluded_visits"))
    first = F.least("event_days", "competing_days", "follow_up_days")
    d = d.withColumn("time_days", first).withColumn("cause", F.when(null_safe(F.col("event_days") == first), 1).when(null_safe(F.col("competing_days") == first), 2).otherwise(0))
    for h in horizons:
        label = F.when((F.col("cause") == 1) & (F.col("time_days") <= h), 1).when(F.col("time_days") >= h, 0).when((F.col("cause") == 2), 0)
        d = d.withColumn(f"label_{h}", label).withColumn(f"eligible_{h}", label.isNotNull().cast("int"))
    return d


def eligibility(df: DataFrame, cols: Sequence[str], cycle: str, ranges: Mapping[str, tuple[float, float]], denied: Sequence[str] = (), evidence_gap: Sequence[str] = (), weak_evidence: Sequence[str] = (), least: float = 0.05, usable: float = 0.5) -> DataFrame:
    """feature, coverage, tier, reasons of every candidate and every denied column.

    prohibited: denied; unavailable: absent, or covered by less than ``least``; qualified_use: covered by less than ``usable``, a gap between cycles, drift, values out of range, an evidence gap or weak
    evidence; usable_now: none of these.
    """
    spark = df.sparkSession
    here, c = [x for x in cols if x in df.columns and x not in denied], F.col
    names = [(x, x in denied, x in df.columns, x in evidence_gap, x in weak_evidence) for x in dict.fromkeys([*cols, *(x for x in denied if x in df.columns)])]
    d = spark.createDataFrame(names, "feature string, denied boolean, present boolean, evidence_gap boolean, weak_evidence boolean")
    if here:
        cov = shape.to_long(df, [], here).groupBy("feature").agg(F.avg(c("value").isNotNull().cast("double")).alias("coverage"))
        d = d.join(cov, "feature", "left").join(stats.cycle_drift(df, here, cycle).select("feature", "drift", "gap"), "feature", "left").join(stats.plausibility(df, {k: v for k, v in ranges.items() if k in here}).select("feature", "flagged"), "feature", "left")
    else:
        d = d.withColumns({"coverage": F.lit(None).cast("double"), **{x: F.lit(None).cast("boolean") for x in ("drift", "gap", "flagged")}})
    rules = {"coverage": c("coverage") < usable, "gap": c("gap"), "drift": c("drift"), "range": c("flagged"), "evidence_gap": c("evidence_gap"), "weak_evidence": c("weak_evidence")}
    reasons = F.array_join(F.filter(F.array(*(F.when(null_safe(bad), name) for name, bad in rules.items())), lambda x: x.isNotNull()), ",")
    out = [("prohibited", "denied", c("denied")), ("unavailable", "absent", ~c("present")), ("unavailable", "coverage", null_safe(c("coverage") < least))]
    tier, why = F.when(reasons == "", "usable_now").otherwise("qualified_use"), reasons
    for name, reason, bad in reversed(out):
        tier, why = F.when(bad, name).otherwise(tier), F.when(bad, reason).otherwise(why)
    return d.select("feature", "coverage", tier.alias("tier"), why.alias("reasons"))


def select_model(candidates: DataFrame, group: Sequence[str], min_slope: float = 0.2, min_auroc: float = 0.6) -> DataFrame:
    """The admissible candidate whose slope is nearest to 1 (ties: higher AUROC, then name); groups without one abstain."""
    ok = (F.col("slope") >= min_slope) & (F.col("auroc") >= min_auroc)
    r = F.row_number().over(Window.partitionBy(*group).orderBy(F.abs(F.col("slope") - 1), F.desc("auroc"), "model"))
    best = candidates.filter(ok).withColumn("r", r).filter("r = 1").drop("r")
    return candidates.select(*group).distinct().join(best, list(group), "left").withColumn("abstains", F.col("model").isNull())
