"""Predicates, screens and small reports over tables. Names are decided on the schema; data are read once, by one aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import days_between, null_safe
from ..scratch import materialise
from .shape import running_totals, to_long
from .stats import exact_quantiles


# ---- filters ---------------------------------------------------------------------------------------------------------
def adults(df: DataFrame, age: str, least: float = 18) -> DataFrame:
    return df.filter(F.col(age).try_cast("double") >= least)


def named_filter(df: DataFrame, filters: Mapping[str, Column], name: str) -> DataFrame:
    """One filter of a registry; an unknown name is an error."""
    if name not in filters:
        raise KeyError(f"no filter {name!r}; there are {sorted(filters)}")
    return df.filter(null_safe(filters[name]))


def training_frame(df: DataFrame, target: str, required: Sequence[str]) -> DataFrame:
    """Rows with a 0/1 target and all required fields, as numbers."""
    d = df.withColumns({c: F.col(c).try_cast("double") for c in required})
    return d.filter(F.col(target).isin(0, 1)).dropna(subset=list(required))


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def any_target(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    return df.dropna(how="all", subset=list(targets))


def carried_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """The columns among ``cols`` that hold a value in some row."""
    present = [c for c in cols if c in df.columns]
    row = df.agg(*(F.count(c).alias(c) for c in present)).first() if present else {}
    return [c for c in present if row[c]]


def allowed_features(df: DataFrame, allow: Sequence[str], deny: Sequence[str], deny_prefixes: Sequence[str] = ()) -> list[str]:
    """Allowlist minus denylist, with data; a denied name on the allowlist is a leak and raises."""
    leaked = [c for c in allow if c in deny or any(c.startswith(p) for p in deny_prefixes)]
    if leaked:
        raise ValueError(f"denied columns on the allowlist: {leaked}")
    return carried_columns(df, allow)


def field_sets(df: DataFrame, required: Sequence[str], optional: Sequence[str], fallback: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Required and optional fields that carry data; without a required one the first fallback that does."""
    have = set(carried_columns(df, [*required, *optional, *fallback]))
    need = [c for c in required if c in have] or [c for c in fallback if c in have][:1]
    return need, [c for c in optional if c in have and c not in need]


def model_columns(names: Sequence[str], suffixes: Sequence[str], forbidden: Sequence[str]) -> list[str]:
    return [n for n in names if any(n.endswith(s) for s in suffixes) and not any(t in n for t in forbidden)]


def derive_if_absent(df: DataFrame, exprs: Mapping[str, Column]) -> DataFrame:
    return df.withColumns({n: e for n, e in exprs.items() if n not in df.columns})


def unknown_keys(json: Column, allowed: Sequence[str]) -> Column:
    """Keys of a JSON object that are not on the list."""
    return F.array_except(F.map_keys(F.from_json(json, "map<string,string>")), F.array(*map(F.lit, allowed)))


def name_reasons(names: DataFrame, name: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Names with the reason of the first pattern that they match."""
    plain = F.lower(F.col(name))
    reason = F.coalesce(*(F.when(plain.rlike(p), F.lit(why)) for why, p in rules))
    return names.select(name, reason.alias("reason")).filter("reason IS NOT NULL")


def value_screen(df: DataFrame, cols: Sequence[str], patterns: Mapping[str, str], least_share: float = 0.2) -> DataFrame:
    """Per text column and pattern the share of non-NULL values that match; flagged from ``least_share`` on. All rows are read."""
    n = df.agg(*(F.avg(F.col(c).rlike(p).cast("double")).alias(f"{i}_{j}") for i, c in enumerate(cols) for j, p in enumerate(patterns.values())))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(name).alias("pattern"), F.col(f"{i}_{j}").alias("share")) for i, c in enumerate(cols) for j, name in enumerate(patterns)))
    return n.select(F.explode(rows).alias("x")).select("x.*", F.coalesce(F.col("x.share") >= least_share, F.lit(False)).alias("flagged"))


def accept_history(df: DataFrame, entity: str, ts: str, cols: Sequence[str], least: int = 2, most: int = 24) -> DataFrame:
    """Per entity whether its visits can be used, with the first reason against it."""
    filled = reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in cols))
    g = df.groupBy(entity).agg(F.count("*").alias("visits"), F.count_distinct(ts).alias("times"), F.count_if(filled).alias("filled"))
    reason = F.when(F.col("visits") < least, "too few visits").when(F.col("visits") > most, "too many visits").when(F.col("times") < least, "too few times").when(F.col("filled") < least, "too few values")
    return g.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def problems(rules: Mapping[str, Column]) -> Column:
    """Names of the rules that a row breaks, in order."""
    return F.filter(F.array(*(F.when(null_safe(bad), F.lit(n)) for n, bad in rules.items())), lambda x: x.isNotNull())


def profile_problems(schema: Mapping[str, dict]) -> Column:
    """Problems of a row by a schema: name -> required, low, high, values, decimals."""
    rules: dict[str, Column] = {}
    for name, s in schema.items():
        c = F.col(name)
        if s.get("required"):
            rules[f"{name}: blank"] = c.isNull()
        if "low" in s:
            rules[f"{name}: range"] = ~c.between(s["low"], s["high"])
        if "values" in s:
            rules[f"{name}: category"] = ~c.isin(*s["values"])
        if "decimals" in s:
            rules[f"{name}: decimals"] = F.round(c, s["decimals"]) != c
    return problems(rules)


def horizon_rows(entities: DataFrame, scores: DataFrame, entity: str, horizons: Sequence[int]) -> DataFrame:
    """A row per entity and horizon: the estimate, or the abstention said as such. ``scores``: (entity, horizon, estimate)."""
    grid = entities.select(entity).distinct().withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    d = grid.join(scores, [entity, "horizon"], "left")
    return d.select(entity, "horizon", "estimate", F.when(F.col("estimate").isNull(), "abstained").otherwise("estimated").alias("status"))


# ---- joins -----------------------------------------------------------------------------------------------------------
def left_lookup(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b, key, "left")


def inner_on(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b, key, "inner")


def attach_features(intervals: DataFrame, features: DataFrame, key: str) -> DataFrame:
    return intervals.join(features, key, "left")


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def reattach(df: DataFrame, source: DataFrame, key: str, cols: Sequence[str], order: str) -> DataFrame:
    """Columns of the source's first row of each key (by ``order``), given back to rows that lost them."""
    first = source.groupBy(key).agg(*(F.min_by(c, order).alias(c) for c in cols))
    return df.drop(*cols).join(first, key, "left")


def flag_members(df: DataFrame, c: str, sets: Mapping[str, Sequence[str]]) -> DataFrame:
    return df.withColumns({name: null_safe(F.col(c).isin(*values)) for name, values in sets.items()})


def collect_matches(df: DataFrame, ref: DataFrame, key: str, value: str) -> DataFrame:
    """Per row of ``df`` the sorted distinct values of its key in ``ref`` (a catalogue), empty without any."""
    g = ref.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("matches"))  # of one catalogue key
    return df.join(g, key, "left").withColumn("matches", F.coalesce("matches", F.array().cast("array<string>")))


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b, key, "left_anti")


def distinct_ids(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).filter(F.col(key).isNotNull()).distinct()


# ---- aggregates ------------------------------------------------------------------------------------------------------
def first_row(df: DataFrame, entity: str, order: Sequence[str]) -> DataFrame:
    """The first row of each entity, all columns kept."""
    rest = [c for c in df.columns if c != entity]
    g = df.groupBy(entity).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return g.select(entity, "x.*")


def event_counts(df: DataFrame, entity: str, ts: str, value: str) -> DataFrame:
    visits = df.groupBy(entity, ts).agg(F.count("*").alias("n"), F.count(value).alias("v"))
    per = visits.groupBy(entity).agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.count("*").alias("visits"))
    return per.agg(F.sum("n").alias("rows"), F.count(entity).alias("entities"), F.sum("visits").alias("visits"), F.sum("v").alias("observations"))


def outcome_counts(df: DataFrame, entity: str, outcome: str, none: str = "none") -> DataFrame:
    """Rows and entities of each outcome; observations are not counted."""
    return df.filter(F.col(outcome) != none).groupBy(F.col(outcome).alias("outcome")).agg(F.count("*").alias("rows"), F.count_distinct(entity).alias("entities"))


def slot_audit(df: DataFrame, recomputed: Column, stored: str) -> DataFrame:
    """Stored labels against recomputed ones: positives of both, and rows that disagree."""
    a, b = F.col(stored), F.col("_r")
    return df.withColumn("_r", recomputed).agg(F.count_if(a == 1).alias("stored"), F.count_if(b == 1).alias("recomputed"), F.count_if((a == 1) & null_safe(b != 1)).alias("only_stored"), F.count_if((b == 1) & null_safe(a != 1)).alias("only_recomputed"))


def horizon_gate_labels(df: DataFrame, labels: Mapping[int, tuple[str, str]], least: int = 50) -> DataFrame:
    """Gate per horizon from label and eligibility columns: eligible rows only."""
    rows = F.array(*(F.struct(F.lit(h).cast("long").alias("horizon"), F.col(a).alias("label"), F.col(e).alias("ok")) for h, (a, e) in labels.items()))
    d = df.select(F.explode(rows).alias("x")).select("x.*").filter("ok = 1")
    g = d.groupBy("horizon").agg(F.count_if(F.col("label") == 1).alias("events"), F.count_if(F.col("label") == 0).alias("non_events"))
    return g.withColumn("open", (F.col("events") >= least) & (F.col("non_events") >= least))


def exclusions(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """How many rows each flag takes, how many any, and how many stay."""
    hit = reduce(lambda a, b: a | b, (null_safe(F.col(f)) for f in flags))
    return df.agg(F.count("*").alias("before"), *(F.count_if(F.col(f)).alias(f) for f in flags), F.count_if(hit).alias("excluded"), F.count_if(~hit).alias("after"))


def category_distribution(df: DataFrame, c: str, fallback: DataFrame, least: int = 50) -> DataFrame:
    """Shares of the categories; with fewer than ``least`` rows those of the fallback population."""
    count = lambda d, name: d.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias(name))
    d = count(df, "_a").join(count(fallback, "_b"), c, "full")
    whole = Window.partitionBy()  # one row a category
    own = F.coalesce(F.sum("_a").over(whole), F.lit(0))
    share = F.when(own >= least, F.col("_a") / own).otherwise(F.col("_b") / F.sum("_b").over(whole))
    return d.select(c, share.alias("share"), F.when(own >= least, "own").otherwise("fallback").alias("source")).filter("share IS NOT NULL")


def band_histogram(df: DataFrame, c: str, edges: Sequence[float]) -> DataFrame:
    """Rows per band [e0, e1), ..., [e_last, inf); bands without rows count 0."""
    bounds = [*edges, None]
    test = lambda a, b: (F.col(c) >= a) & (F.lit(True) if b is None else F.col(c) < b)
    n = df.agg(*(F.count_if(test(a, b)).alias(f"b{i}") for i, (a, b) in enumerate(zip(bounds, bounds[1:]))))
    rows = F.array(*(F.struct(F.lit(float(a)).alias("from"), F.col(f"b{i}").alias("n")) for i, a in enumerate(edges)))
    return n.select(F.explode(rows).alias("x")).select(F.col("x.from").alias("band_from"), "x.n")


def catalogue_summary(df: DataFrame, cuts: Sequence[str]) -> DataFrame:
    return to_long_text(df, cuts).groupBy("cut", "level").agg(F.count("*").alias("n"))


def to_long_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*(F.col(c).cast("string").alias(c) for c in cols)).unpivot([], list(cols), "cut", "level")


def schema_report(df: DataFrame, allow: Sequence[str]) -> DataFrame:
    """One row: columns by class, allowed ones that are there and that are missing. No job reads data."""
    numeric = [c for c, k in df.dtypes if k in ("int", "bigint", "double", "float", "smallint", "tinyint") or k.startswith("decimal")]
    row = (len(df.columns), len(numeric), len(set(allow) & set(df.columns)), ",".join(sorted(set(allow) - set(df.columns))), ",".join(sorted(set(allow) & set(df.columns) - set(numeric))))
    return df.sparkSession.createDataFrame([row], "columns int, numeric int, present int, missing string, non_numeric string")


def follow_up_summary(df: DataFrame, entity: str, ts: str) -> DataFrame:
    """Visits and days of follow-up of the entities: least, 10th percentile, median, 90th percentile, most and mean."""
    per = materialise(df.groupBy(entity).agg(F.count_distinct(ts).alias("v"), days_between(F.max(ts), F.min(ts)).alias("f")))
    probs = {"p10": 0.1, "median": 0.5, "p90": 0.9}
    q = [exact_quantiles(per, c, list(probs.values())).select(*(F.col("q")[i].alias(f"{n}_{p}") for i, p in enumerate(probs))) for c, n in (("v", "visits"), ("f", "follow_up"))]
    m = per.agg(F.min("v").alias("visits_min"), F.max("v").alias("visits_max"), F.avg("v").alias("visits_mean"), F.min("f").alias("follow_up_min"), F.max("f").alias("follow_up_max"), F.avg("f").alias("follow_up_mean"))
    return m.join(q[0], how="left").join(q[1], how="left")  # three single rows


def share_measured(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return to_long(df, [], cols).groupBy("feature").agg(F.count("value").alias("measured"), F.avg(F.col("value").isNotNull().cast("double")).alias("share"))


def distinct_values(df: DataFrame, c: str) -> DataFrame:
    return df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))


# ---- windows, orders -------------------------------------------------------------------------------------------------
def days_since_first(df: DataFrame, entity: str, ts: str) -> DataFrame:
    return df.withColumn("days_since_first", days_between(F.col(ts), F.min(ts).over(Window.partitionBy(entity))))


def sequential_id(df: DataFrame, order_by: Sequence[str], name: str = "row_id") -> DataFrame:
    """1..n in the order of the columns (which must tell rows apart), from range partitions and their offsets."""
    r = running_totals(df.withColumn("_one", F.lit(1)), order_by, ["_one"])
    return r.withColumn(name, F.col("_one_before") + 1).drop("_one", "_one_before", "_one_total")


def cap(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def sorted_output(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.orderBy(*keys)


def top_per_group(df: DataFrame, group: str, order: Sequence, k: int) -> DataFrame:
    """The k first rows of each group: the standout features of a pathway."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)


# ---- nested ----------------------------------------------------------------------------------------------------------
def source_of(names: Sequence[str], sources: Sequence[str]) -> dict[str, str | None]:
    """Longest source name that a transformed name begins with."""
    return {n: max((s for s in sources if n == s or n.startswith(s + "_")), key=len, default=None) for n in names}


def group_means(vec: Column, groups: Mapping[str, Sequence[int]]) -> dict[str, Column]:
    """Mean of the vector's components of each group (0-based places)."""
    return {g: sum((F.get(vec, F.lit(i)) for i in own), F.lit(0.0)) / len(own) for g, own in groups.items()}


def outcome_rows(df: DataFrame, entity: str, date: str, outcome: Column, template: Mapping[str, str]) -> DataFrame:
    """Rows of the event schema for outcomes: constant columns of the template's types are NULL."""
    return df.select(entity, F.col(date).alias("event_date"), outcome.alias("outcome_type"), F.concat(F.lit("outcome:"), outcome).alias("feature_code"), *(F.lit(None).cast(k).alias(n) for n, k in template.items()))
