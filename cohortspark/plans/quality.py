"""Reports over whole tables: integrity, leakage, capabilities, timelines, catalogue rules. Findings are rows (section, item, level, value)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import null_safe
from ..operators import screen, shape, stats


def _rows(d: DataFrame, section: str, items: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """One row per item of a one-row frame: its value and level."""
    arr = F.array(*(F.struct(F.lit(n).alias("item"), v.cast("double").alias("value"), level.alias("level")) for n, (v, level) in items.items()))
    return d.select(F.explode(arr).alias("x")).select(F.lit(section).alias("section"), "x.*")


def integrity_report(df: DataFrame, key: str, cols: Sequence[str], labels: Sequence[str], ranges: Mapping[str, tuple[float, float]], least_rows: int = 500) -> DataFrame:
    """Size, duplicates, labels of one class, coverage and plausibility as findings: info, warning or blocking."""
    c = F.col
    level = lambda bad, kind: F.when(null_safe(bad), kind).otherwise("info")
    dup = stats.duplicate_report(df.select(key, *cols), key)
    size = _rows(dup, "rows", {"rows": (c("rows"), level(c("rows") < least_rows, "blocking")), "duplicate_rows": (c("duplicate_rows"), level(c("duplicate_rows") > 0, "warning")), "repeated_ids": (c("repeated_ids"), level(c("repeated_ids") > 0, "warning"))})
    lab = stats.label_counts(df, labels).select(F.lit("labels").alias("section"), c("label").alias("item"), c("positive").cast("double").alias("value"), level((c("positive") == 0) | (c("negative") == 0), "blocking").alias("level"))
    cov = screen.share_measured(df, cols).select(F.lit("coverage").alias("section"), c("feature").alias("item"), c("share").alias("value"), level(c("share") < 0.05, "warning").alias("level"))
    pl = stats.plausibility(df, ranges)
    share = c("out_of_range") / c("observed")
    bad = pl.select(F.lit("plausibility").alias("section"), c("feature").alias("item"), share.alias("value"), F.when(c("hard"), "blocking").when(c("flagged"), "warning").otherwise("info").alias("level"))
    return size.unionByName(lab).unionByName(cov).unionByName(bad)


def raise_if_blocking(findings: DataFrame) -> None:
    if n := findings.filter("level = 'blocking'").count():
        raise ValueError(f"{n} blocking findings")


def leakage_report(df: DataFrame, features: Sequence[str], denied: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Each feature with why it must not be one; no data are read."""
    why = [(f, "denied" if f in denied else "label" if f in labels else "absent" if f not in df.columns else None) for f in features]
    return df.sparkSession.createDataFrame(why, "feature string, reason string").withColumn("leaks", F.col("reason").isin("denied", "label") & F.col("reason").isNotNull())


def capabilities(df: DataFrame, key: str, times: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """One row: repeated ids, time columns, labels with both classes, and which outputs those allow."""
    have = [t for t in times if t in df.columns]
    ids = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n") > 1, F.lit(False)).alias("repeated_ids"))
    both = stats.label_counts(df, labels).agg(F.count_if((F.col("positive") > 0) & (F.col("negative") > 0)).alias("usable_labels")) if labels else df.sparkSession.createDataFrame([(0,)], "usable_labels long")
    d = ids.crossJoin(both).withColumn("time_columns", F.lit(len(have)).cast("long"))  # two single rows
    return d.withColumn("supports", F.when(F.col("repeated_ids") & (F.col("time_columns") > 0), "trajectories").when(F.col("usable_labels") > 0, "association").otherwise("description"))


def timeline_checks(df: DataFrame, ts: str, index: str, time: str) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.count_if(F.col(ts) > F.col(index)).alias("after_index"), F.count_if(F.col(time) < 0).alias("negative_times"))


def visit_row_problems(denied: Sequence[str], columns: Sequence[str], ts: str, index: str, key: str) -> Column:
    """Denied names are the same for all rows; keys and times are per row."""
    bad_names = [c for c in columns if c in denied]
    return screen.problems({"denied column": F.lit(bool(bad_names)), "no key": F.col(key).isNull(), "after index": F.col(ts) > F.col(index)})


def catalogue_issues(df: DataFrame, key: str, text: str, required: Sequence[str], phrases: Mapping[str, str], least_words: int = 5) -> DataFrame:
    """Issues of catalogue entries, a row each: missing fields, repeated keys, too short statements, phrases that a rule forbids. One window on the key."""
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    rules = {f"missing {c}": F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "") for c in required}
    rules |= {"short": words < least_words} | {name: F.lower(F.col(text)).rlike(p) for name, p in phrases.items()}
    repeated = df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key, F.lit("repeated key").alias("issue"))
    return df.select(key, F.explode(screen.problems(rules)).alias("issue")).unionByName(repeated)


def routing(df: DataFrame, key: str, issues: DataFrame, blocking: Sequence[str]) -> DataFrame:
    """Entries without issues can be presented, those with others than blocking ones are for research, the rest is held back."""
    g = issues.groupBy(key).agg(F.max(F.col("issue").isin(*blocking).cast("int")).alias("b"))
    route = F.when(F.col("b").isNull(), "presentable").when(F.col("b") == 0, "research").otherwise("held")
    return df.select(key).distinct().join(g, key, "left").select(key, route.alias("route"))


def registry_frame(df: DataFrame, text: Mapping[str, Mapping[str, float]], event: str, time: str, horizon: float, order: Sequence[str]) -> DataFrame:
    """A clinical registry made even: categories as ordinals, a censored event label, rows without any label dropped, ids in order."""
    from ..functions.columns import horizon_event, map_ordinal

    d = df.withColumns({f"{c}_ordinal": map_ordinal(F.col(c), m) for c, m in text.items()}).withColumn("label", horizon_event(F.col(event), F.col(time), horizon))
    return screen.sequential_id(screen.any_target(d, ["label"]), order)


def merge_batches(batches: Sequence[DataFrame], entity: str, keys: Sequence[str], order: str) -> DataFrame:
    """Batches in order: an entity counts in its first batch only, repeated keys keep their last row."""
    u = shape.union_loose([b.withColumn("source_batch", F.lit(i)) for i, b in enumerate(batches)])
    return shape.keep_last(shape.first_seen_batch(u, entity, "source_batch"), keys, [F.desc(order)])
