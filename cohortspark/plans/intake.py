"""Intake of an upload: one pass over the file writes its rows, told apart by why they were rejected, and observes all that the report says.

Defined cases: a file without header, without rows or with a wrong extension is refused, and one whose columns by name or value identify persons is refused with the columns, after its rows were overwritten by nothing; values that are
no number make a row corrupt; bytes that are no UTF-8 become the replacement character; repeated rows are counted as they are; absent features are unavailable.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import clean, null_safe
from ..sources import io
from . import quality

CORRUPT = "_corrupt_record"


class Refused(ValueError):
    """The upload must not be processed; ``columns`` says why, column by column."""

    def __init__(self, reason: str, columns: Sequence[tuple[str, str]] = ()):
        super().__init__(reason)
        self.columns = list(columns)


@dataclass(frozen=True)
class Intake:
    """What an upload is held against. ``numeric`` and ``categories`` are the features; the other names are lists or patterns of column names and values."""

    numeric: Sequence[str]
    categories: Sequence[str] = ()
    age: str | None = None
    key: str | None = None
    times: Sequence[str] = ()
    labels: Sequence[str] = ()
    denied: Sequence[str] = ()
    identifier_names: Mapping[str, str] = field(default_factory=dict)  # kind -> pattern of the lower-case name
    identifier_values: Mapping[str, str] = field(default_factory=dict)  # kind -> pattern of a whole value
    ranges: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    least_share: float = 0.2  # of a column's values, from which on it identifies persons
    usable: float = 0.5
    least: float = 0.05
    tolerance: float = 0.01
    least_features: int = 3
    least_numeric: int = 2
    most_scored: int = 2000

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categories]


def _name_findings(names: Sequence[str], spec: Intake) -> list[tuple[str, str]]:
    import re

    plain = {n: re.sub("[^a-z0-9]+", "_", n.lower()) for n in names}
    kind = lambda n: next((k for k, p in spec.identifier_names.items() if re.search(p, plain[n])), None)
    return [(n, k) for n in names if n not in (spec.age, spec.key) and (k := kind(n))]


def _reason(here: Sequence[str], spec: Intake) -> Column:
    """The first reason against a row, NULL for an accepted one."""
    n = lambda cols: sum((F.col(c).isNotNull().cast("int") for c in cols if c in here), F.lit(0))
    age = [("age", ~null_safe(F.col(spec.age).between(18, 120)))] if spec.age in here else []
    rules = [("corrupt", F.col(CORRUPT).isNotNull()), *age, ("features", n(spec.features) < spec.least_features), ("numeric", n(spec.numeric) < spec.least_numeric)]
    out = F.lit(None).cast("string")
    for name, bad in reversed(rules):
        out = F.when(bad, name).otherwise(out)
    return out


def take_in(spark: SparkSession, path: str, spec: Intake, out: str) -> tuple[DataFrame, DataFrame]:
    """The accepted rows, and the report (section, item, value, level). All rows are written under ``out``, accepted ones apart from rejected ones, with ``reject_reason``."""
    header = io.csv_header(spark, path)
    if found := _name_findings(header, spec):
        raise Refused("columns name persons", found)
    kind = lambda c: "double" if c in spec.numeric or c in spec.labels else "string"
    # A session of its own: what observes is kept by the session, and Spark's fitted models cannot be sent to tasks from a session that has it.
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    d = io.permissive_csv(own, path, [(c, kind(c)) for c in header], CORRUPT)
    here = [c for c in spec.features if c in header]
    texts = [c for c in header if kind(c) == "string" and c != spec.key]
    d = d.withColumns({c: clean(F.col(c)) if kind(c) == "double" else F.nullif(F.trim(c), F.lit("")) for c in header if c != spec.key})
    d = d.withColumn("reject_reason", _reason(here, spec)).withColumn("accepted", F.col("reject_reason").isNull())
    seen = Observation()
    number = lambda c: F.count_if(F.col(c).isNotNull())
    metrics = {"rows": F.count(F.lit(1)), "accepted": F.count_if(F.col("accepted"))} | {f"reason_{r}": F.count_if(F.col("reject_reason") == r) for r in ("corrupt", "age", "features", "numeric")}
    metrics |= {f"known_{i}": number(c) for i, c in enumerate(header)}
    metrics |= {f"outside_{i}": F.count_if((F.col(c) < spec.ranges[c][0]) | (F.col(c) > spec.ranges[c][1])) for i, c in enumerate(header) if c in here and c in spec.ranges}
    metrics |= {f"like_{i}_{j}": F.count_if(F.col(c).rlike(f"^(?:{p})$")) for i, c in enumerate(header) if c in texts for j, p in enumerate(spec.identifier_values.values())}
    # The only pass over the file.
    d.observe(seen, *(m.alias(n) for n, m in metrics.items())).write.mode("overwrite").partitionBy("accepted").parquet(out)
    m = {k: v or 0 for k, v in seen.get.items()}
    if not m["rows"]:
        raise Refused("no rows")
    kinds = list(spec.identifier_values)
    found = [(c, kinds[j]) for i, c in enumerate(header) if c in texts for j in range(len(kinds)) if m[f"known_{i}"] and m[f"like_{i}_{j}"] >= spec.least_share * m[f"known_{i}"]]
    if found:
        spark.createDataFrame([], d.schema).write.mode("overwrite").parquet(out)  # nothing of it is kept
        raise Refused("values identify persons", list(dict(reversed(found)).items())[::-1])
    stored = spark.read.schema(d.schema).parquet(out)
    findings = spark.createDataFrame(_findings(header, here, m, spec), "section string, item string, value double, level string")
    if spec.key in header:
        cap = quality.capabilities(stored, spec.key, spec.times, [x for x in spec.labels if x in header])
        findings = findings.unionByName(cap.select(F.lit("capability").alias("section"), F.col("supports").alias("item"), F.col("repeated_ids").cast("double").alias("value"), F.lit("info").alias("level")))
    return stored.filter("accepted").drop("accepted", "reject_reason", CORRUPT), findings


def _findings(header: Sequence[str], here: Sequence[str], m: Mapping[str, int], spec: Intake) -> list[tuple[str, str, float, str]]:
    """Everything the report says, from the observed numbers: a list as long as the header."""
    level = lambda bad, kind: kind if bad else "info"
    denied = [c for c in header if c in spec.denied]
    out = [("file", "rows", m["rows"], "info"), ("file", "columns", len(header), "info")]
    out += [("schema", f"mapped/{c}", 1, "info") for c in here] + [("schema", f"missing/{c}", 1, "warning") for c in spec.features if c not in header]
    out += [("schema", f"prohibited/{c}", 1, "warning") for c in denied] + [("schema", f"unmapped/{c}", 1, "info") for c in header if c not in spec.features and c not in denied]
    usable = False
    for c in spec.features:
        tier, why = "unavailable", "absent"
        if c in here:
            i, total = header.index(c), m["rows"]
            share, outside = m[f"known_{i}"] / total, m.get(f"outside_{i}", 0)
            beyond = outside / m[f"known_{i}"] if m[f"known_{i}"] else 0.0
            out += [("coverage", c, share, level(share < spec.usable, "warning")), ("missing", c, 1 - share, "info")]
            if outside:
                out.append(("range", c, beyond, level(beyond > spec.tolerance, "warning")))
            tier = "unavailable" if share < spec.least else "qualified_use" if share < spec.usable or beyond > spec.tolerance else "usable_now"
            why = ",".join(w for w, bad in (("coverage", share < spec.usable), ("implausible", beyond > spec.tolerance), ("few implausible", 0 < beyond <= spec.tolerance)) if bad) or "none"
            usable |= tier != "unavailable"
        out.append(("tier", f"{c}/{tier}/{why}", 1, "info"))
    out += [("tier", f"{c}/prohibited/denied", 1, "info") for c in denied]
    out += [("rejected", r, m[f"reason_{r}"], "info") for r in ("corrupt", "age", "features", "numeric")]
    out += [("rows", "accepted", m["accepted"], "info"), ("rows", "rejected", m["rows"] - m["accepted"], "info"), ("rows", "will be scored", min(m["accepted"], spec.most_scored), "info"), ("rows", "cap applied", m["accepted"] > spec.most_scored, "info")]
    blocker = "no usable feature" if not usable else "no accepted row" if not m["accepted"] else None
    out.append(("ready", blocker or "ready", blocker is None, level(blocker is not None, "blocking")))
    return [(a, b, float(v), x) for a, b, v, x in out]
