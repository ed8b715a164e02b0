"""Event validation and incident cohorts in their defined cases."""

import pytest
from pyspark.sql import functions as F

from cohortspark.plans.events import EventRules, validate
from cohortspark.plans.incident import Protocol, cohort_report, incident_cohort

RULES = EventRules("who", "ts", "code", "value", "at", outcomes=("none", "cancer"), site_outcomes=("cancer",), units={("g", "mg"): ("g", 0.001, 0.0)}, ranges={"g": (0.0, 10.0)})
COLUMNS = "who int, ts string, code string, value string, at int, unit string, missingness_reason string, outcome_type string, event_date string, index_date string, censoring_date string, site string, provenance string, extra int"


def events(spark):
    base = dict(who=1, ts="2020-01-01 00:00:00", code="g", value="5", at=1, unit="g", missingness_reason="observed", outcome_type="none", event_date=None, index_date="2020-02-01 00:00:00", censoring_date=None, site=None, provenance="p", extra=7)
    rows = [base, base | dict(at=2, value="6000", unit="mg"), base | dict(at=3, ts="2020-01-02 00:00:00", value="99"), base | dict(at=4, ts="soon", value="x"), base | dict(at=5, ts="2020-01-03 00:00:00", value="NaN"), base | dict(at=6, ts="2020-01-04 00:00:00", unit=None)]
    rows += [base | dict(who=2, at=7, code=None, value=None, missingness_reason=None, outcome_type="cancer", event_date="2020-01-15 00:00:00", site="lung")]
    return spark.createDataFrame([tuple(r.values()) for r in rows], COLUMNS)


def test_validation(spark):
    clean, report = validate(events(spark), RULES)
    got = {(r.section, r.item): (r.value, r.level) for r in report.collect()}
    assert got["duplicates", "removed"][0] == 1 and got["rows", "converted units"][0] == 1 and got["issues", "unreadable time"] == (1, "hard") and got["issues", "unknown unit"][0] == 0
    assert got["row rules", "event before index"] == (1, "hard") and got["row rules", "missing value without a reason"][0] == 2 and got["impossible", "g"] == (1, "hard") and got["missing/reason", "invalid_value_removed"][0] == 1
    values = {r.at: (r.value, r.unit, r.extra) for r in clean.collect()}
    assert values == {2: (6.0, "g", 7), 3: (None, "g", 7), 4: (None, "g", 7), 5: (None, "g", 7), 6: (5.0, None, 7), 7: (None, "g", 7)}
    with pytest.raises(ValueError, match="unreadable time"):
        validate(events(spark), RULES, strict=True)
    with pytest.raises(ValueError, match="missing columns"):
        validate(events(spark).drop("site"), RULES)
    none, report = validate(events(spark).filter("false"), RULES)
    assert none.count() == 0 and report.agg(F.sum("value")).first()[0] == 0


def test_incident_cases(spark):
    t = lambda d: f"2020-01-{d:02d} 00:00:00"
    rows = []
    for who, index, outcomes in ((1, 10, [("disease", 12, None)]), (2, 10, [("death", 12, None), ("disease", 14, None)]), (3, 10, [("disease", 9, None)]), (4, None, []), (5, 10, [("other", 11, 20)])):
        rows += [(who, t(d), f"v{d}", None if index is None else t(index), "none", None, None, None) for d in (1, 5, 25)]
        rows += [(who, t(d), None, None if index is None else t(index), o, t(d), None if c is None else t(c), None) for o, d, c in outcomes]
    d = spark.createDataFrame(rows, "who int, ts string, visit string, index_date string, outcome_type string, event_date string, censoring_date string, site string")
    d = d.withColumns({c: F.to_timestamp(c) for c in ("ts", "index_date", "event_date", "censoring_date")})
    p = Protocol(["disease"], "death", None, (5,), 1.0, 2, 1)
    cohort, counts = incident_cohort(d.unionByName(d), "who", p)  # repeated rows change nothing
    got = {r.who: r for r in cohort.collect()}
    assert sorted(got) == [1, 2, 5] and {r.reason: r.entities for r in counts.collect()} == {"before": 5, "after": 3, "prevalent_disease": 1, "short_history": 1, "insufficient_visits": 0}
    assert (got[1].disease_cause, got[1].disease_time_days, got[1].disease_5_label, got[1].disease_5_eligible) == (1, 2.0, 1, 1)
    assert (got[2].disease_cause, got[2].disease_time_days) == (1, 4.0)  # an observed disease counts, whatever comes first
    assert (got[5].disease_cause, got[5].follow_up_days, got[5].disease_5_eligible) == (0, 10.0, 1)  # censored at its date, not at the last record
    report = {(r.section, r.item): r.value for r in cohort_report(cohort, counts, p).collect()}
    assert report["events", "disease/5"] == 2 and report["non_events", "disease/5"] == 1 and report["gate_open", "disease/5"] == 1 and report["follow_up_days", "median"] == 15.0
    none, zero = incident_cohort(d.filter("false"), "who", p)
    assert none.count() == 0 and zero.agg(F.sum("entities")).first()[0] == 0
