"""Joins, sets, windows, reshaping and splits, each from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clean, days_between
from ..scratch import materialise


# ---- projections and filters ---------------------------------------------------------------------------------------
def keep_list(df: DataFrame, wanted: Sequence[str], prefix: str, key: str) -> DataFrame:
    return df.select(key, *(F.col(c).alias(f"{prefix}_{c}") for c in wanted if c in df.columns and c != key))


def coalesce_legacy(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    return df.withColumns({new: F.coalesce(*(F.col(c) for c in (new, old) if c in df.columns)) for new, old in pairs.items()})


def finite_vectors(df: DataFrame, vec: str) -> DataFrame:
    return df.filter(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def usable_columns(train: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns with two different values or more, by one aggregation over the training rows."""
    row = train.agg(*(f(c).alias(f"{i}_{n}") for i, c in enumerate(cols) for n, f in (("least", F.min), ("most", F.max)))).first()
    return [c for i, c in enumerate(cols) if row[f"{i}_least"] is not None and row[f"{i}_least"] != row[f"{i}_most"]]


def identifier_column(df: DataFrame, priority: Sequence[str]) -> str | None:
    return next((c for c in priority if c in df.columns), None)


# ---- joins -----------------------------------------------------------------------------------------------------------
def full_join_chain(dfs: Sequence[DataFrame], key: str) -> DataFrame:
    return reduce(lambda a, b: a.join(b, key, "full"), dfs)


def before_index(df: DataFrame, entity: str, ts: str, index: DataFrame) -> DataFrame:
    """Rows at or before their entity's index date; ``index`` is (entity, index_date)."""
    return df.join(index, entity, "left").filter(F.col(ts) <= F.col("index_date"))


def first_seen_batch(df: DataFrame, entity: str, batch: str) -> DataFrame:
    """Rows of the first batch in which their entity occurs."""
    return df.withColumn("_first", F.min(batch).over(Window.partitionBy(entity))).filter(F.col(batch) == F.col("_first")).drop("_first")


def map_codes(df: DataFrame, code: str, table: DataFrame, how: str = "inner") -> DataFrame:
    return df.join(table, code, how)


def parity(a: DataFrame, b: DataFrame, key: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """One row: compared, missing, max_abs_difference, passed."""
    j = a.select(*key, F.col(value).alias("_a")).join(b.select(*key, F.col(value).alias("_b")), list(key), "full")
    missing = F.count_if(F.col("_a").isNull() | F.col("_b").isNull())
    worst = F.max(F.abs(F.col("_a") - F.col("_b")))
    return j.agg(F.count("*").alias("compared"), missing.alias("missing"), worst.alias("max_abs_difference"), ((missing == 0) & (F.coalesce(worst, F.lit(0.0)) <= tolerance)).alias("passed"))


def knn(queries: DataFrame, base: DataFrame, query_id: str, base_id: str, vec: str, k: int = 3, block: int = 4096) -> DataFrame:
    """Exact k nearest neighbours by squared distance. Queries and base rows are dealt into blocks of about ``block`` rows by hash; each pair of blocks is
    compared in one task, which keeps k per query; those few are ranked in the end."""
    dealt = lambda d, key, n: d.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).withColumn("own", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    nq, nb = (max(1, -(-d.count() // block)) for d in (queries, base))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = dealt(queries, query_id, nq).withColumn("b", every(nb)).withColumnRenamed("own", "q")
    b = dealt(base, base_id, nb).withColumn("q", every(nq)).withColumnRenamed("own", "b")

    def nearest(left, right):
        import numpy as np
        import pandas as pd

        out = []
        if len(left) and len(right):
            y, ids = np.stack(right["v"].to_numpy()), right["id"].to_numpy()
            for i, x in zip(left["id"], left["v"]):
                d2 = ((y - np.asarray(x)) ** 2).sum(1)
                d2[ids == i] = np.inf
                best = np.lexsort((ids, d2))[:k]
                out += [(int(i), int(ids[j]), float(d2[j])) for j in best if np.isfinite(d2[j])]
        return pd.DataFrame(out, columns=["query_id", "base_id", "d2"])

    near = q.groupBy("q", "b").cogroup(b.groupBy("q", "b")).applyInPandas(nearest, "query_id long, base_id long, d2 double")
    r = F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "base_id"))
    return near.withColumn("rank", r).filter(F.col("rank") <= k).select("query_id", "rank", "base_id", "d2")


def as_of(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, value: str) -> DataFrame:
    """For each left row the last right value at or before it: one union and one window, no range join."""
    u = left.select(key, F.col(left_ts).alias("_ts"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"), F.lit(1).alias("_side")).unionByName(right.select(key, F.col(right_ts).alias("_ts"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType).alias("_l"), F.col(value).alias("_v"), F.lit(0).alias("_side")))
    w = Window.partitionBy(key).orderBy("_ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return u.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1").select("_l.*", F.col("_v").alias(f"as_of_{value}"))


def pick_index_visit(df: DataFrame, entity: str, ts: str, window_end: Column, follow_up_days: float, min_history_days: float, min_prior: int) -> DataFrame:
    """The latest visit with enough follow-up after it and enough history before it."""
    w = Window.partitionBy(entity).orderBy(ts)
    d = df.select(entity, ts).distinct().withColumn("first", F.min(ts).over(Window.partitionBy(entity))).withColumn("prior", F.row_number().over(w) - 1)
    ok = d.filter((days_between(window_end, F.col(ts)) >= follow_up_days) & (days_between(F.col(ts), F.col("first")) >= min_history_days) & (F.col("prior") >= min_prior))
    return ok.groupBy(entity).agg(F.max(ts).alias("index_date"))


# ---- windows -----------------------------------------------------------------------------------------------------------
def group_zscore(df: DataFrame, c: str, keys: Sequence[str], most_keys: int = 100_000) -> DataFrame:
    """Mean and deviation per key are aggregated before the shuffle and joined back; up to ``most_keys`` keys travel to the rows, so no key's rows meet in one task.
    A NULL key has no score; beyond ``most_keys`` Spark joins by key and may split large ones."""
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    mean, sd = fresh(df, "mean_of_key"), fresh(df, "sd_of_key")
    per = materialise(df.filter(known).groupBy(*keys).agg(F.avg(c).alias(mean), F.stddev_samp(c).alias(sd)))
    per = F.broadcast(per) if per.limit(most_keys + 1).count() <= most_keys else per
    return df.join(per, list(keys), "left").withColumn(f"{c}_z", (F.col(c) - F.col(mean)) / F.nullif(F.col(sd), F.lit(0.0))).select(*(df[x] for x in df.columns if x != f"{c}_z"), f"{c}_z")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {x.lower() for x in df.columns}
    return next(n for i in range(len(taken) + 1) if (n := f"{stem}{i or ''}") not in taken)


def gap_since_previous(df: DataFrame, entity: str, ts: str) -> DataFrame:
    return df.withColumn("gap_days", F.coalesce(days_between(F.col(ts), F.lag(ts).over(Window.partitionBy(entity).orderBy(ts))), F.lit(0.0)))


def visit_index(df: DataFrame, entity: str, ts: str) -> DataFrame:
    return df.withColumn("visit_index", F.dense_rank().over(Window.partitionBy(entity).orderBy(ts)) - 1)


def last_k(df: DataFrame, entity: str, ts: str, k: int, ties: Sequence[str] = ()) -> DataFrame:
    """The last k rows of each entity, numbered from 0; rows of one time are ordered by ``ties``."""
    w = Window.partitionBy(entity)
    d = df.withColumn("_r", F.row_number().over(w.orderBy(F.desc(ts), *(F.desc(c) for c in ties)))).filter(F.col("_r") <= k)
    return d.withColumn("visit_index", F.row_number().over(w.orderBy(F.desc("_r"))) - 1).drop("_r")


def reverse_index(df: DataFrame, entity: str, idx: str) -> DataFrame:
    return df.withColumn(idx, F.max(idx).over(Window.partitionBy(entity)) - F.col(idx))


def keep_last(df: DataFrame, keys: Sequence[str], order_by: Sequence) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))).filter("_r = 1").drop("_r")


def order_violations(df: DataFrame, entity: str, ts: str, arrival: str) -> DataFrame:
    """Per entity the number of rows whose time lies before that of the row that arrived before."""
    back = F.col(ts) < F.lag(ts).over(Window.partitionBy(entity).orderBy(arrival))
    return df.withColumn("_b", back).groupBy(entity).agg(F.count_if("_b").alias("violations"))


def average_pct_rank(df: DataFrame, c: str) -> DataFrame:
    """Average-rank percent rank: counts per value, then running sums over ranges of values; no window over all rows."""
    r = running_totals(df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")), [c], ["n"])
    total = F.col("n_total")
    return df.join(r.select(c, ((F.col("n_before") + (F.col("n") + 1) / 2) / total).alias(f"{c}_pct")), c, "left")


def running_totals(df: DataFrame, order: Sequence[str], values: Sequence[str], descending: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Adds v_before (sum of the rows before) and v_total for each value column, in global order, without a single-partition window.

    Rows are range-partitioned; sums inside a range are windows per range, and the offsets of the ranges come from one small table.
    """
    return totals_in(ranged(df, order, descending), order, values, descending, by)


def _ordered(order: Sequence[str], descending: bool) -> list[Column]:
    return [F.desc(o) for o in order] if descending else [F.asc(o) for o in order]


def ranged(df: DataFrame, order: Sequence[str], descending: bool = False) -> DataFrame:
    """``df`` in ranges of ``order``, written once; ``totals_in`` may be asked for several groupings of it."""
    # The number of the range is kept by the checkpoint: a second run of the sampling could cut elsewhere.
    return materialise(df.repartitionByRange(*_ordered(order, descending)).withColumn("_p", F.spark_partition_id()))


def totals_in(d: DataFrame, order: Sequence[str], values: Sequence[str], descending: bool = False, by: Sequence[str] = ()) -> DataFrame:
    keys = [*by, "_p"]
    sums = d.groupBy(*keys).agg(*(F.sum(v).alias(f"_{v}") for v in values))
    ahead = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by) if by else Window.partitionBy()
    offsets = sums.select(*keys, *(F.coalesce(F.sum(f"_{v}").over(ahead), F.lit(0)).alias(f"_o_{v}") for v in values), *(F.sum(f"_{v}").over(whole).alias(f"{v}_total") for v in values))
    w = Window.partitionBy(*keys).orderBy(*_ordered(order, descending)).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({f"_b_{v}": F.coalesce(F.sum(v).over(w), F.lit(0)) for v in values}).join(offsets, keys)
    out = d.withColumns({f"{v}_before": F.col(f"_b_{v}") + F.col(f"_o_{v}") for v in values})
    return out.drop("_p", *(f"_b_{v}" for v in values), *(f"_o_{v}" for v in values))


def reference_percentile(df: DataFrame, c: str, ref: DataFrame, ref_c: str) -> DataFrame:
    """Share of reference values at or below each distinct value of ``c``, times 100."""
    both = ref.select(F.col(ref_c).alias("_v"), F.lit(1).alias("n"), F.lit(0).alias("q")).unionByName(df.select(F.col(c).alias("_v")).distinct().select("_v", F.lit(0).alias("n"), F.lit(1).alias("q"))).groupBy("_v").agg(F.sum("n").alias("n"), F.max("q").alias("q"))
    r = running_totals(both.filter("_v IS NOT NULL"), ["_v"], ["n"]).filter("q = 1")
    return df.join(r.select(F.col("_v").alias(c), (100.0 * (F.col("n_before") + F.col("n")) / F.col("n_total")).alias("percentile")), c, "left")


def tertile(df: DataFrame, c: str, tie: str) -> DataFrame:
    """low / mid / high by first rank, right-closed cuts at 1 + (n-1)/3 and 1 + 2(n-1)/3."""
    r = running_totals(df.filter(F.col(c).isNotNull()).withColumn("one", F.lit(1)), [c, tie], ["one"])
    rank, n = F.col("one_before") + 1, F.col("one_total")
    cut = lambda k: rank <= 1 + k * (n - 1) / 3
    return r.withColumn("tertile", F.when(cut(1), "low").when(cut(2), "mid").otherwise("high")).drop("one", "one_before", "one_total")


def row_topk(c: str, k: int = 5) -> Column:
    return F.slice(F.sort_array(c, asc=False), 1, k)


def drop_top_share(df: DataFrame, c: str, share: float, ties: Sequence[str] = ()) -> DataFrame:
    """Without the floor(n * share) rows of the largest values; of equal values those with the larger ``ties`` go first."""
    one = fresh(df, "one")
    r = running_totals(df.withColumn(one, F.lit(1)), [c, *ties], [one], descending=True)
    return r.filter(F.col(f"{one}_before") >= F.floor(F.col(f"{one}_total") * share)).drop(one, f"{one}_before", f"{one}_total")


# ---- sets and reshaping ------------------------------------------------------------------------------------------------
def union_loose(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def overlap(df: DataFrame, entity: str, split: str) -> DataFrame:
    """Entities that occur in several splits."""
    return df.groupBy(entity).agg(F.count_distinct(split).alias("splits")).filter("splits > 1")


def one_hot(df: DataFrame, c: str, values: Sequence[str], prefix: str | None = None) -> DataFrame:
    return df.withColumns({f"{prefix or c}_{v}": F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)) for v in values})


def visit_matrix(events: DataFrame, entity: str, ts: str, code: str, value: str, features: Sequence[str], order: str) -> DataFrame:
    """One row per (entity, time): the first value by ``order``, NULL included, and a mask per feature, the gap and the density; one pivot with fixed values, so no extra job."""
    m = events.groupBy(entity, ts).pivot(code, list(features)).agg(F.min_by(F.struct(F.col(value).alias("v")), F.col(order)))
    m = m.select(entity, ts, *(F.col(f)["v"].alias(f"feature_{f}") for f in features)).withColumns({f"mask_{f}": F.col(f"feature_{f}").isNotNull().cast("int") for f in features})
    w = Window.partitionBy(entity)
    m = visit_index(gap_since_previous(m, entity, ts), entity, ts)
    span = days_between(F.max(ts).over(w), F.min(ts).over(w))
    m = m.withColumn("visit_density_per_year", F.round(F.count("*").over(w) / (F.greatest(span, F.lit(1.0)) / 365.25), 4))
    return m.withColumn("observed_feature_count", sum((F.col(f"mask_{f}") for f in features), F.lit(0)))


def person_intervals(df: DataFrame, time: str, event: str, horizon: float, width: float) -> DataFrame:
    """One row per entity and interval until the event or the end of observation; event 1 is the target, 2 a competing one."""
    t = F.least(F.greatest(F.col(time), F.lit(1.0)), F.lit(horizon))
    d = df.withColumn("_n", F.ceil(t / width).cast("int")).withColumn("interval", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    ends = (F.col("interval") == F.col("_n") - 1) & (F.col(time) <= horizon)
    return d.withColumn("event_here", (ends & (F.col(event) == 1)).cast("int")).withColumn("competing_here", (ends & (F.col(event) == 2)).cast("int")).drop("_n")


def sequences(visits: DataFrame, entity: str, idx: str, values: Sequence[str], k: int, normaliser: dict[str, tuple[float, float]] | None = None, gap: str | None = None) -> DataFrame:
    """entity, length, sequence: array of k arrays (values with NULL as 0, masks, and the ``gap`` in years), padded by zeros. ``normaliser``: centre and spread of a value. The last k visits by ``idx``, ties by the values."""
    scaled = lambda c: (F.col(c).cast("double") - normaliser[c][0]) / normaliser[c][1] if normaliser else F.col(c).cast("double")
    years = [F.coalesce(F.col(gap).cast("double"), F.lit(0.0)) / 365.25] if gap else []
    row = F.array(*(F.coalesce(scaled(c), F.lit(0.0)) for c in values), *(F.col(c).isNotNull().cast("double") for c in values), *years)
    d = last_k(visits, entity, idx, k, values).groupBy(entity).agg(F.sort_array(F.collect_list(F.struct(F.col("visit_index"), row.alias("row")))).alias("s"))
    zero = F.array_repeat(F.lit(0.0), 2 * len(values) + len(years))
    return d.select(entity, F.size("s").alias("length"), F.concat(F.transform("s", lambda x: x["row"]), F.array_repeat(zero, F.lit(k) - F.size("s"))).alias("sequence"))


def to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """NULL for NaN."""
    return df.select(*ids, *(clean(F.col(c).cast("double")).alias(c) for c in cols)).unpivot(list(ids), list(cols), name, value)


# ---- splits and resampling: all draws are hashes of keys, so results don't depend on partitioning --------------------------------
def uniform(seed: int, *cols) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1_000_000)) / 1_000_000.0


def group_split(df: DataFrame, entity: str, fractions: Sequence[tuple[str, float]], seed: int = 0) -> DataFrame:
    u = uniform(seed, entity)
    upto, out = 0.0, None
    for name, f in fractions:
        upto += f
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return df.withColumn("split", out.otherwise(fractions[-1][0]))


def temporal_holdout(df: DataFrame, year: str, cutoff: int, cap: float = 0.25) -> DataFrame:
    """Marks rows from ``cutoff`` on; if they exceed the cap, those beyond the (1 - cap) quantile of the year instead."""
    s = df.agg(F.avg((F.col(year) >= cutoff).cast("double")).alias("share"), F.percentile(year, 1 - cap).alias("q"))
    return df.crossJoin(F.broadcast(s)).withColumn("temporal", F.when(F.col("share") <= cap, F.col(year) >= cutoff).otherwise(F.col(year) > F.col("q"))).drop("share", "q")  # s has one row


def stratified_split(df: DataFrame, label: str, key: str, fraction: float, seed: int = 0) -> DataFrame:
    r = running_totals(df.withColumn("one", F.lit(1)).withColumn("_h", F.xxhash64(F.lit(seed), key)), ["_h", key], ["one"], by=[label])
    return r.withColumn("test", F.col("one_before") < F.greatest(F.lit(1), F.round(F.col("one_total") * fraction))).drop("one", "_h", "one_before", "one_total")


def stratified_folds(df: DataFrame, label: str, key: str, k: int, seed: int = 0) -> DataFrame:
    r = running_totals(df.withColumn("one", F.lit(1)).withColumn("_h", F.xxhash64(F.lit(seed), key)), ["_h", key], ["one"], by=[label])
    return r.withColumn("fold", F.pmod(F.col("one_before"), F.lit(k))).drop("one", "_h", "one_before", "one_total")


def capped_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def dealt_values(df: DataFrame, c: str, key: str, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """by, _r, c: the values that ``permuted_by`` deals, in the order of a hash (within ``by``); several frames of the same rows can share them."""
    one = df.select(key, c, *by).withColumn("one", F.lit(1)).withColumn("_h", F.xxhash64(F.lit(seed + 1), key))
    return running_totals(one, ["_h", key], ["one"], by=by).select(*by, F.col("one_before").alias("_r"), c)


def permuted_by(df: DataFrame, dealt: DataFrame, key: str, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with the value of ``dealt`` at the rank of its rows by another hash."""
    one = df.withColumn("one", F.lit(1)).withColumn("_h", F.xxhash64(F.lit(seed), key))
    a = running_totals(one, ["_h", key], ["one"], by=by).drop("one", "_h", "one_total").withColumnRenamed("one_before", "_r")
    return a.join(dealt, [*by, "_r"]).drop("_r")


def permute_column(df: DataFrame, c: str, key: str, seed: int = 0) -> DataFrame:
    """``c`` dealt anew: rows ranked by one hash receive the values ranked by another."""
    return permuted_by(df.drop(c), dealt_values(df, c, key, seed), key, seed)


def poisson_weights(df: DataFrame, key: Sequence[str], rounds: int, seed: int = 0) -> DataFrame:
    """Bootstrap: every row times rounds with a Poisson(1) weight drawn from a hash."""
    d = df.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("_u", uniform(seed, "round", *key))
    steps = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)  # the distribution function of Poisson(1)
    return d.withColumn("weight", sum(((F.col("_u") >= s).cast("int") for s in steps), F.lit(0))).drop("_u")
