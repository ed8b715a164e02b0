"""Jobs in steps that are kept: a step is read back while the fingerprint of its source, its settings and the steps before it holds, and made anew otherwise.

Fitted parameters and score references are tables as well, so a model can be replayed without fitting. A lost run leaves whole steps only, for a step's fingerprint is written after its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from functools import cache, reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models, shape, stats
from ..scratch import materialise
from ..sources import io
from . import incident, jobs


class Steps:
    def __init__(self, spark: SparkSession, path: str, source: DataFrame, settings: str = ""):
        self.spark, self.path = spark, path
        self.base = f"{io.frame_fingerprint(source).first()[0]}|{settings}"
        self.prints: dict[str, str] = {}
        self.made: list[str] = []

    def table(self, name: str, build: Callable[[], DataFrame], *needs: str) -> DataFrame:
        """The rows of a step, which depends on the source and on the steps ``needs``."""
        now = hashlib.sha256("|".join([self.base, name, *(self.prints[n] for n in needs)]).encode()).hexdigest()
        self.prints[name] = now
        at = f"{self.path}/{name}"
        try:
            kept = self.spark.read.parquet(f"{at}/fingerprint").first()
        except AnalysisException:  # nothing kept yet
            kept = None
        if kept is None or kept[0] != now:
            self.made.append(name)
            io.write_table(build(), f"{at}/data")
            io.write_table(self.spark.createDataFrame([(now,)], "fingerprint string"), f"{at}/fingerprint")
        return self.spark.read.parquet(f"{at}/data")


# ---- parameters and references ------------------------------------------------------------------------------------------------------
def parameters(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """feature, place, median, had_missing, mean, sd (of the filled values): a row a feature."""
    filled = models.fit_impute(train, cols)
    d = train.select(*(F.coalesce(F.col(c).cast("double"), F.lit(float(filled[c][0]))).alias(c) for c in cols))
    scaled = models.fit_standard_scale(d, cols)
    rows = [(c, i, float(filled[c][0]), bool(filled[c][1]), float(scaled[c][0] or 0.0), float(scaled[c][1])) for i, c in enumerate(cols)]
    return train.sparkSession.createDataFrame(rows, "feature string, place int, median double, had_missing boolean, mean double, sd double")


def apply_parameters(df: DataFrame, table: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with z_<feature> for every row of a table of parameters (one row a feature reaches the driver), and a flag for those that had missing values; and the names."""
    rows = sorted(table.collect(), key=lambda r: r.place)
    new = {f"z_{r.feature}": (F.coalesce(F.col(r.feature).cast("double"), F.lit(r.median)) - r.mean) / r.sd for r in rows}
    new |= {f"missing_{r.feature}": F.col(r.feature).isNull().cast("double") for r in rows if r.had_missing}
    return df.withColumns(new), list(new)


def score_reference(scores: DataFrame, c: str) -> DataFrame:
    """The distribution of a score to keep: its different values with counts, and its 90th, 95th and 99th percentile on every row."""
    q = stats.exact_quantiles(scores, c, (0.9, 0.95, 0.99))
    n = scores.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("double").alias("value")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(q.select(*(F.col("q")[i].alias(f"p{p}") for i, p in enumerate((90, 95, 99))))))  # one row


def against_reference(df: DataFrame, c: str, reference: DataFrame) -> DataFrame:
    """``df`` with the percentile of its score in a kept reference, and whether it lies above the 90th, 95th and 99th one."""
    both = reference.select(F.col("value").alias("_v"), "n", F.lit(0).alias("q")).unionByName(df.filter(F.col(c).isNotNull()).select(F.col(c).cast("double").alias("_v")).distinct().select("_v", F.lit(0).cast("long").alias("n"), F.lit(1).alias("q")))
    both = both.groupBy("_v").agg(F.sum("n").alias("n"), F.max("q").alias("q"))
    place = shape.running_totals(both, ["_v"], ["n"]).filter("q = 1").select(F.col("_v").alias(c), (100.0 * (F.col("n_before") + F.col("n")) / F.col("n_total")).alias("percentile"))
    limits = reference.select("p90", "p95", "p99").limit(1)
    d = df.join(place, c, "left").crossJoin(F.broadcast(limits))  # one row
    return d.withColumns({f"above_p{p}": F.col(c) > F.col(f"p{p}") for p in (90, 95, 99)}).drop("p90", "p95", "p99")


# ---- a cohort's risk, from events to metrics ---------------------------------------------------------------------------------------------
def cohort_risk(steps: Steps, events: DataFrame, entity: str, code: str, value: str, order: str, features: Sequence[str], outcome: str, protocol: incident.Protocol, cutoff: int, width: float = 1.0, least_events: int = 5) -> DataFrame:
    """split, horizon, model, rows, events, auroc, average_precision, brier of the incidence by a cause-specific hazard with its competing part, and of the training rate; every table and parameter on the way is a kept step."""
    longest = float(max(protocol.horizons))
    dates = cache(lambda: materialise(incident.outcome_dates(events, entity, protocol)))  # a row an entity, for the cohort and the counts of its report
    cohort = steps.table("cohort", lambda: incident.cohort_of(dates(), protocol)[0])
    steps.table("cohort_report", lambda: incident.cohort_report(cohort, incident.cohort_of(dates(), protocol)[1], protocol), "cohort")
    visits = steps.table("visits", lambda: shape.visit_matrix(shape.before_index(events.filter("outcome_type = 'none'").drop("index_date"), entity, "ts", cohort.select(entity, "index_date")), entity, "ts", code, value, features, order), "cohort")
    names = [f"feature_{f}" for f in features]
    labels = [c for c in cohort.columns if c.startswith(f"{outcome}_")]
    feats = steps.table("features", lambda: stats.trajectory_features(visits, entity, "ts", names).join(cohort.select(entity, "index_year", *labels), entity), "visits")
    split = steps.table("splits", lambda: jobs.build_splits(feats, entity, "index_year", cutoff)[0], "features")
    own = [f"{n}_{k}" for n in names for k in ("last", "mean", "delta", "slope_per_year")] + ["visit_count", "missingness_burden"]
    train = split.filter("split = 'train'")
    table = steps.table("parameters", lambda: parameters(train, own), "splits")
    x, cols = apply_parameters(split.withColumn("time", F.col(f"{outcome}_time_days")).withColumn("event", F.col(f"{outcome}_cause")), table)
    keep = [entity, "split", "time", "event", *labels, *cols]
    rest = [float(h) for h in protocol.horizons]
    every = F.sequence(F.lit(0), F.lit(int(-(-longest // width)) - 1))

    def incidence() -> DataFrame:
        intervals = shape.person_intervals(x.filter("split = 'train'").select(*keep), "time", "event", longest, width)
        h = materialise(models.hazard(intervals, x.select(*keep).withColumn("interval", F.explode(every)), cols, least_events).select(entity, "interval", "h", "c"))  # every horizon reads it
        parts = [models.cumulative_incidence(h.filter(F.col("interval") < F.ceil(F.lit(t) / width)).filter("h IS NOT NULL"), entity).select(entity, F.lit(int(t)).alias("horizon"), "cumulative_incidence") for t in rest]
        return reduce(DataFrame.unionByName, parts)

    risk = steps.table("incidence", incidence, "parameters")
    steps.table("reference", lambda: score_reference(risk.filter(F.col("horizon") == int(rest[-1])).join(train.select(entity), entity), "cumulative_incidence"), "incidence")

    def metrics() -> DataFrame:
        out = []
        for h in protocol.horizons:
            d = split.filter(F.col(f"{outcome}_{h}_eligible") == 1).select(entity, "split", F.col(f"{outcome}_{h}_label").alias("y"))
            rate = d.filter("split = 'train'").agg(F.coalesce(F.avg("y"), F.lit(0.0)).alias("p"))
            scored = d.join(risk.filter(F.col("horizon") == h).select(entity, F.col("cumulative_incidence").alias("p")), entity).withColumn("model", F.lit("hazard"))
            scored = scored.unionByName(d.crossJoin(F.broadcast(rate)).withColumn("model", F.lit("rate")))  # one row
            out.append(scored.withColumn("horizon", F.lit(int(h))))
        s, by = materialise(reduce(DataFrame.unionByName, out)), ["model", "horizon", "split"]
        n = s.groupBy(*by).agg(F.count("*").alias("rows"), F.sum("y").cast("long").alias("events"))
        return n.join(stats.auroc(s, "y", "p", by), by).join(stats.average_precision(s, "y", "p", by), by).join(stats.brier(s, "y", "p", by), by)

    return steps.table("metrics", metrics, "incidence", "splits")
