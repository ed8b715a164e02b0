"""Incident cohorts by index and censoring dates: one row an entity, exclusions counted, causes with a competing outcome, labels by horizon, and the report.

Events are rows of (entity, ts, visit, index_date, outcome_type, event_date, censoring_date, site); ``none`` is an observation, any other type an outcome.

Defined cases: an entity without an index date has no history and is excluded; one without observations has no visits; dates of one outcome that repeat count once, the first; a NULL censoring date leaves the last record as the end of
follow-up; repeated rows change nothing; extra columns are ignored; an empty table gives an empty cohort and a report of zeros.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import days_between, null_safe
from ..operators import stats


@dataclass(frozen=True)
class Protocol:
    outcomes: Sequence[str]
    competing: str = "death"
    site_of: str | None = None
    horizons: Sequence[int] = (365, 1095, 1825)
    least_history: float = 0.0
    least_visits: int = 1
    least_events: int = 50


def outcome_dates(events: DataFrame, entity: str, protocol: Protocol) -> DataFrame:
    """One shuffle: index date, last record, first observation and visits before, the first date of each outcome, the site of the first ``site_of`` event, censoring date and end of follow-up."""
    kind, none = F.col("outcome_type"), null_safe(F.col("outcome_type") == "none")
    outcome = kind.isNotNull() & ~none
    firsts = [F.min(F.when(kind == o, F.col("event_date"))).alias(f"{o}_date") for o in dict.fromkeys([*protocol.outcomes, protocol.competing])]
    site = F.min_by("site", F.when((kind == protocol.site_of) & F.col("site").isNotNull(), F.struct("event_date", "site"))) if protocol.site_of else F.lit(None).cast("string")
    d = events.groupBy(entity).agg(
        F.max("index_date").alias("index_date"), F.max("ts").alias("last_record"), F.min(F.when(none, F.col("ts"))).alias("first_observation"),
        F.count_distinct(F.when(none, F.col("visit"))).alias("visits"), *firsts, site.alias("site"), F.max(F.when(outcome, F.col("censoring_date"))).alias("censoring_date"),
    )
    return d.withColumn("follow_up_end", F.coalesce("censoring_date", "last_record")).withColumn("history_days", days_between(F.col("index_date"), F.col("first_observation")))


def _reasons(protocol: Protocol) -> dict[str, Column]:
    prevalent = {f"prevalent_{o}": null_safe(F.col(f"{o}_date") <= F.col("index_date")) for o in protocol.outcomes}
    return prevalent | {"short_history": F.coalesce("history_days", F.lit(-1.0)) < protocol.least_history, "insufficient_visits": F.col("visits") < protocol.least_visits}


def incident_cohort(events: DataFrame, entity: str, protocol: Protocol) -> tuple[DataFrame, DataFrame]:
    """The cohort, and the exclusions (reason, entities; an entity may have several) with the entities before and after."""
    return cohort_of(outcome_dates(events, entity, protocol), protocol)


def cohort_of(table: DataFrame, protocol: Protocol) -> tuple[DataFrame, DataFrame]:
    """``incident_cohort`` from its outcome dates."""
    reasons = _reasons(protocol)
    out = reduce(lambda a, b: a | b, reasons.values())
    n = table.agg(F.count("*").alias("before"), F.coalesce(F.count_if(~out), F.lit(0)).alias("after"), *(F.coalesce(F.count_if(bad), F.lit(0)).alias(r) for r, bad in reasons.items()))
    counts = n.select(F.explode(F.array(*(F.struct(F.lit(c).alias("reason"), F.col(c).alias("entities")) for c in n.columns))).alias("x")).select("x.*")
    d = table.filter(~out).withColumn("follow_up_days", days_between(F.col("follow_up_end"), F.col("index_date"))).withColumn("index_year", F.year("index_date"))
    days = lambda c: days_between(F.col(c), F.col("index_date"))
    for o in protocol.outcomes:
        event, death, end = days(f"{o}_date"), days(f"{protocol.competing}_date"), F.col("follow_up_days")
        d = d.withColumn(f"{o}_event_days", event)
        seen = null_safe(event <= end)
        first = null_safe(death <= end) & (~seen | null_safe(death < event))
        d = d.withColumn(f"{o}_time_days", F.when(seen, event).when(first, death).otherwise(end)).withColumn(f"{o}_cause", F.when(seen, 1).when(first, 2).otherwise(0))
        time, cause = F.col(f"{o}_time_days"), F.col(f"{o}_cause")
        for h in protocol.horizons:
            label = null_safe((cause == 1) & (F.col(f"{o}_event_days") <= h))
            new = {"label": label, "eligible": label | null_safe((time >= h) & (cause != 1)), "censored_before": ~label & (cause == 0) & null_safe(time < h), "competing_before": ~label & (cause == 2) & null_safe(time < h)}
            d = d.withColumns({f"{o}_{h}_{name}": c.cast("int") for name, c in new.items()})
    return d, counts


def cohort_report(cohort: DataFrame, counts: DataFrame, protocol: Protocol) -> DataFrame:
    """section, item, value: entities, exclusions, follow-up (median, 10th and 90th percentile, longest), index years, gates of every outcome and horizon, sites."""
    row = lambda d, section, item, value: d.select(F.lit(section).alias("section"), item.cast("string").alias("item"), value.cast("double").alias("value"))
    q = stats.exact_quantiles(cohort, "follow_up_days", (0.1, 0.5, 0.9, 1.0))
    out = [row(counts.filter("reason IN ('before', 'after')"), "entities", F.col("reason"), F.col("entities")), row(counts.filter("reason NOT IN ('before', 'after')"), "exclusions", F.col("reason"), F.col("entities"))]
    out += [row(q, "follow_up_days", F.lit(name), F.col("q")[i]) for i, name in enumerate(("p10", "median", "p90", "max"))]
    out.append(row(cohort.groupBy("index_year").agg(F.count("*").alias("n")), "index_year", F.col("index_year"), F.col("n")))
    names = [(o, h) for o in protocol.outcomes for h in protocol.horizons]
    cells = [F.struct(F.lit(f"{o}/{h}").alias("item"), F.coalesce(F.count_if((F.col(f"{o}_{h}_label") == 1)), F.lit(0)).alias("events"), F.coalesce(F.count_if((F.col(f"{o}_{h}_label") == 0) & (F.col(f"{o}_{h}_eligible") == 1)), F.lit(0)).alias("non_events")) for o, h in names]
    gates = cohort.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    open_ = (F.col("events") >= protocol.least_events) & (F.col("non_events") >= protocol.least_events)
    out += [row(gates, "events", F.col("item"), F.col("events")), row(gates, "non_events", F.col("item"), F.col("non_events")), row(gates, "gate_open", F.col("item"), open_.cast("int"))]
    sites = cohort.filter("site IS NOT NULL").groupBy("site").agg(F.count("*").alias("n"))
    out += [row(sites, "site_events", F.col("site"), F.col("n")), row(sites, "site_open", F.col("site"), (F.col("n") >= protocol.least_events).cast("int"))]
    return reduce(DataFrame.unionByName, out)
