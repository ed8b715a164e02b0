"""Validation of patient events: types, vocabulary, units, repeated rows, order, impossible values, missingness, outcomes and row rules, as cleaned rows and one report.

Defined cases: times and numbers that cannot be read become NULL and are counted; NaN is NULL; of rows with one key the last by ``order`` stays; a NULL unit is not converted and not unknown; a value outside its range is removed and says so; extra
columns stay; an empty table has a report of counts that are 0.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean, null_safe
from ..operators import shape
from ..scratch import materialise

OBSERVED, REMOVED = "observed", "invalid_value_removed"
LEAST_BURDEN = 0.10


@dataclass(frozen=True)
class EventRules:
    """Column names of the events, and what their values are held against. ``units``: (code, unit) -> (unit, slope, intercept)."""

    entity: str
    ts: str
    code: str
    value: str
    order: str
    unit: str = "unit"
    reason: str = "missingness_reason"
    outcome: str = "outcome_type"
    event_date: str = "event_date"
    index_date: str = "index_date"
    censoring_date: str = "censoring_date"
    site: str = "site"
    provenance: str = "provenance"
    reasons: Sequence[str] = (OBSERVED, REMOVED)
    outcomes: Sequence[str] = ("none",)
    site_outcomes: Sequence[str] = ()
    units: Mapping[tuple[str, str], tuple[str, float, float]] = field(default_factory=dict)
    ranges: Mapping[str, tuple[float, float]] = field(default_factory=dict)


def row_rules(r: EventRules) -> dict[str, Column]:
    """What a row must not be."""
    c, none = F.col, F.coalesce(F.col(r.outcome), F.lit("none")) == "none"
    return {
        "missing value without a reason": c(r.value).isNull() & null_safe(c(r.reason) == OBSERVED) & none, "outcome without a date": ~none & ~null_safe(c(r.outcome) == "censored") & c(r.event_date).isNull(),
        "event before index": c(r.event_date) < c(r.index_date), "censoring before index": c(r.censoring_date) < c(r.index_date), "site without cancer": c(r.site).isNotNull() & ~null_safe(c(r.outcome).isin(*r.site_outcomes)),
    }


def _converted(d: DataFrame, r: EventRules) -> DataFrame:
    """Values in the units of the table, as one expression over its rows; ``_unit``: converted, unknown or kept."""
    value, unit, state = F.col(r.value), F.col(r.unit), F.lit("kept")
    codes = sorted({code for code, _ in r.units})
    state = F.when(F.col(r.code).isin(*codes) & F.col(r.unit).isNotNull() & F.col(r.value).isNotNull(), "unknown").otherwise(state) if codes else state
    for code in codes:  # units that others are converted to
        state = F.when(null_safe((F.col(r.code) == code) & F.col(r.unit).isin(*{to for (c, _), (to, *_) in r.units.items() if c == code})), "kept").otherwise(state)
    for (code, name), (to, slope, intercept) in r.units.items():
        here = null_safe((F.col(r.code) == code) & (F.col(r.unit) == name))
        value, unit = F.when(here, F.col(r.value) * slope + intercept).otherwise(value), F.when(here, to).otherwise(unit)
        state = F.when(here, F.lit("kept" if (slope, intercept) == (1.0, 0.0) else "converted")).otherwise(state)
    return d.withColumns({"_unit": state, r.value: value, r.unit: unit})


def validate(events: DataFrame, r: EventRules, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """The cleaned rows, and the report (section, item, value, level). ``strict`` raises where the report has a hard finding."""
    needed = [r.entity, r.ts, r.code, r.value, r.order, r.unit, r.reason, r.outcome, r.event_date, r.index_date, r.censoring_date, r.site, r.provenance]
    if missing := [c for c in needed if c not in events.columns]:
        raise ValueError(f"missing columns: {missing}")
    kinds = dict(events.dtypes)
    time = lambda c: F.try_to_timestamp(F.col(c)) if kinds[c] == "string" else F.col(c)
    d = events.withColumns({c: time(c) for c in (r.ts, r.event_date, r.index_date, r.censoring_date)}).withColumn(r.value, clean(F.col(r.value).try_cast("double")))
    d = _converted(d, r)
    low_high = F.create_map(*(F.lit(x) for n, (a, b) in r.ranges.items() for x in (n, F.array(F.lit(float(a)), F.lit(float(b)))))) if r.ranges else F.lit(None).cast("map<string,array<double>>")
    window = F.try_element_at(low_high, F.col(r.code))
    bad = null_safe((F.col(r.value) < window[0]) | (F.col(r.value) > window[1]))
    one = shape.keep_last(d, [r.entity, r.ts, r.code, r.outcome], [F.desc(r.order)])
    one = one.withColumn("_seen", F.col(r.value).isNotNull()).withColumn("_bad", bad).withColumn(r.value, F.when(~F.col("_bad"), F.col(r.value))).withColumn(r.reason, F.when(F.col("_bad"), REMOVED).otherwise(F.col(r.reason)))
    d, one = materialise(d), materialise(one)
    none = F.coalesce(F.col(r.outcome), F.lit("none")) == "none"
    count = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    rows = lambda section, x, item, value, level=F.lit("info"): x.select(F.lit(section).alias("section"), item.cast("string").alias("item"), value.cast("double").alias("value"), level.alias("level"))
    hard = lambda n: F.when(n > 0, "hard").otherwise("info")

    def items(section: str, x: DataFrame, level: bool = False) -> DataFrame:
        e = x.select(F.explode(F.array(*(F.struct(F.lit(c).alias("item"), F.col(f"`{c}`").cast("double").alias("v")) for c in x.columns))).alias("x"))
        return rows(section, e, F.col("x.item"), F.col("x.v"), hard(F.col("x.v")) if level else F.lit("info"))

    known = F.col(r.outcome).isin(*r.outcomes) | F.col(r.outcome).isNull()
    out = [
        items("rows", d.agg(F.count("*").alias("rows"), F.count_distinct(r.entity).alias("entities"), count(none).alias("observations"), count(~none).alias("outcomes"), count(F.col("_unit") == "converted").alias("converted units"))),
        items("issues", d.agg(count(F.col(r.ts).isNull()).alias("unreadable time"), count(F.col(r.reason).isNotNull() & ~F.col(r.reason).isin(*r.reasons)).alias("unknown reason"), count(~known).alias("unknown outcome"), count(F.col(r.provenance).isNull()).alias("no provenance"), count(F.col("_unit") == "unknown").alias("unknown unit")), True),
        items("row rules", d.agg(*(count(null_safe(rule)).alias(name) for name, rule in row_rules(r).items())), True),
        items("duplicates", d.agg(F.count("*").alias("n")).crossJoin(one.agg(F.count("*").alias("m"))).select((F.col("n") - F.col("m")).alias("removed"))),  # two single rows
        items("missing", one.agg(count(none & F.col(r.value).isNull()).alias("rows without value"))),
    ]
    back = shape.order_violations(one, r.entity, r.ts, r.order).agg(F.coalesce(F.sum("violations"), F.lit(0)).alias("arrived out of order"))
    seen = one.filter(F.col(r.code).isin(*r.ranges)).groupBy(r.code).agg(F.count_if(F.col("_seen")).alias("n"), F.count_if(F.col("_bad")).alias("bad"))
    of = one.filter(none)
    out += [
        items("order", back), rows("impossible", seen, F.col(r.code), F.col("bad"), F.when(F.col("bad") > LEAST_BURDEN * F.col("n"), "hard").otherwise("info")), rows("missing/reason", of.filter(F.col(r.reason).isNotNull()).groupBy(r.reason).count(), F.col(r.reason), F.col("count")),
        rows("coverage", of.filter(F.col(r.code).isNotNull()).groupBy(r.code).agg(F.avg(F.col(r.value).isNotNull().cast("double")).alias("s")), F.col(r.code), F.col("s")), rows("outcomes", one.filter(~none).groupBy(r.outcome).count(), F.col(r.outcome), F.col("count")),
        items("outcomes", one.agg(F.count_distinct(F.when(~none, F.col(r.entity))).alias("entities with any"))), rows("sites", one.filter(~none & F.col(r.site).isNotNull()).groupBy(r.site).count(), F.col(r.site), F.col("count")),
    ]
    report = materialise(reduce(DataFrame.unionByName, out))
    if strict and (found := report.filter("level = 'hard'").limit(20).collect()):
        raise ValueError("; ".join(f"{x.section}: {x.item} ({x.value:g})" for x in found))
    return one.drop("_unit", "_seen", "_bad"), report
