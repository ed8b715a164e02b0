"""Column expressions. NaN is NULL: ``clean`` converts at the borders, which are the readers, ``col_or_null`` and ``shape.to_long``; comparisons with NULL give NULL unless said otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentinel codes of survey answers (fixed values).
SENTINELS = (7.0, 9.0, 77.0, 99.0, 777.0, 999.0, 6666.0, 7777.0, 9999.0, 99999.0)


def clean(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def clean_numbers(df: DataFrame) -> DataFrame:
    """``df`` with NULL for NaN in its columns of numbers."""
    return df.withColumns({c: clean(F.col(f"`{c}`")) for c, kind in df.dtypes if kind in ("double", "float")})


def null_safe(p: Column) -> Column:
    """A predicate that is false where it is unknown."""
    return F.coalesce(p, F.lit(False))


def col_or_null(df: DataFrame, name: str, kind: str = "double") -> Column:
    c = F.col(name).try_cast(kind) if name in df.columns else F.lit(None).cast(kind)
    return clean(c) if kind in ("double", "float") else c


def yes_no(c: Column) -> Column:
    return F.when(c == 1, 1.0).when(c == 2, 0.0)


def drop_codes(c: Column, codes: Sequence[float] = SENTINELS) -> Column:
    return F.when(~c.isin(*codes), c)


def below(c: Column, limit: float) -> Column:
    return F.when(c < limit, c)


def between(c: Column, low: float, high: float) -> Column:
    return F.when(c.between(low, high), c)


def flag(c: Column, op: str, k: float) -> Column:
    """1.0 / 0.0 by a comparison, NULL for NULL."""
    test = {">=": c >= k, ">": c > k, "<=": c <= k, "<": c < k}[op]
    return F.when(c.isNotNull(), test.cast("double"))


def bounded_difference(a: Column, b: Column, low: float, high: float) -> Column:
    return between(a - b, low, high)


def subtype_proxy(has: Column, onset: Column, treated: Column, cutoff: float = 25) -> Column:
    """0 without the disease, 1 early onset and treated, 2 any other case (also when onset or treatment is unknown)."""
    early = null_safe((onset < cutoff) & (treated == 1))
    return F.when(has == 0, 0.0).when((has == 1) & early, 1.0).when(has == 1, 2.0)


def age_gap(a_age: Column, b_age: Column, a_flag: Column, b_flag: Column, window: float = 3) -> dict[str, Column]:
    gap = F.when((a_flag == 1) & (b_flag == 1), b_age - a_age)
    return {"gap": gap, "same_year": F.when(gap.isNotNull(), (gap == 0).cast("double")), "within": F.when(gap.between(0, window), 1.0).when((a_flag == 1) & (b_flag == 0), 0.0)}


def ever_now(ever: Column, now: Column) -> Column:
    """0 never, 1 former, 2 current."""
    return F.when(ever == 2, 0.0).when((ever == 1) & (now == 3), 1.0).when((ever == 1) & now.isin(1, 2), 2.0)


def ordered_status(rules: Sequence[tuple[Column, float]]) -> Column:
    """The last rule that holds wins."""
    return reduce(lambda out, r: F.when(null_safe(r[0]), F.lit(r[1])).otherwise(out), rules, F.lit(None).cast("double"))


def product_ratio(a: Column, b: Column, k: float) -> Column:
    return a * b / k


def reciprocal(c: Column, k: float = 100.0) -> Column:
    return F.when(c > 0, k / c)


def square(c: Column) -> Column:
    return c * c


def change(prior: Column, now: Column) -> Column:
    return now - prior


def interaction(a: Column, b: Column) -> Column:
    return a * b


def year_of(c: Column) -> Column:
    return F.year(c)


def missing_burden(cols: Sequence[str]) -> Column:
    return missing_count(cols) / float(len(cols))


def current_status(ever: Column, now: Column) -> Column:
    """1 current, 0 known not to be."""
    return F.when(ever == 2, 0.0).when(now.isin(1, 2), 1.0).when(now == 3, 0.0)


def band(c: Column, edges: Sequence[float], labels: Sequence[str] | None = None, right: bool = True) -> Column:
    """Bins (e0, e1], ..., (e_last, inf) if ``right``, else [e0, e1), ...; outside of all: NULL."""
    labels = labels or [str(i) for i in range(len(edges))]
    out = F.lit(None).cast("string")
    for e, name in zip(edges, labels):
        out = F.when((c > e) if right else (c >= e), F.lit(name)).otherwise(out)
    return out


def percentile_band(c: Column) -> Column:
    p = F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0))
    return F.when(c.isNull(), "unavailable").when(p >= 99, "99+").when(p >= 95, "95-99").when(p >= 90, "90-95").otherwise("0-90")


def cycle_weight(cycle: Column, weights: Mapping[str, Column], factors: Mapping[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, factor in factors.items():
        out = F.when(cycle == name, weights[name] * factor).otherwise(out)
    return out


def composite_key(*cols: str, sep: str = ":") -> Column:
    return F.concat_ws(sep, *(F.col(c).cast("string") for c in cols))


def map_ordinal(c: Column, mapping: Mapping[str, float]) -> Column:
    pairs = [F.lit(x) for k, v in mapping.items() for x in (k.upper(), float(v))]
    return F.try_element_at(F.create_map(*pairs), F.upper(F.trim(c)))


def horizon_event(event: Column, time: Column, horizon: float) -> Column:
    """1 event within the horizon, 0 known to be free of it until then, NULL censored before or event unknown."""
    return F.when((event == 1) & (time <= horizon), 1.0).when(event.isNotNull() & (time >= horizon), 0.0)


def parse_utc(c: Column) -> Column:
    return F.try_to_timestamp(c)


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000.0)


def sigmoid(c: Column, clip: float = 35.0) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(c, F.lit(-clip)), F.lit(clip))))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))


def profile_masks(rules: Mapping[str, Column]) -> dict[str, Column]:
    """Mutually exclusive masks: a row belongs to the first rule that holds."""
    out, taken = {}, F.lit(False)
    for name, rule in rules.items():
        out[name] = null_safe(rule) & ~taken
        taken = taken | null_safe(rule)
    return out


def case_document(cols: Sequence[str], n: int = 8) -> Column:
    return F.concat_ws("; ", *(F.concat(F.lit(f"{c}="), F.round(F.col(c).cast("double"), 3).cast("string")) for c in cols[:n]))


def scrub_paths(c: Column) -> Column:
    return F.regexp_replace(c, r"(?:[A-Za-z]:\\|/)(?:[\w.-]+[\\/])+[\w.-]*", "<path>")


def availability(cols: Sequence[str]) -> Column:
    return F.concat(*(F.col(c).isNotNull().cast("int").cast("string") for c in cols))


def digitize(c: Column, edges: Sequence[float]) -> Column:
    return F.when(c.isNotNull(), sum(((c >= e).cast("int") for e in sorted(set(edges))), F.lit(0)))


def direction(c: Column) -> Column:
    return F.when(c > 0, "higher").when(c < 0, "lower").when(c == 0, "equal")


def out_of_range(ranges: Mapping[str, tuple[float, float]]) -> Column:
    """array<struct<name,value>> of the values outside their range."""
    items = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value"), null_safe(~F.col(n).between(a, b)).alias("bad")) for n, (a, b) in ranges.items()))
    return F.transform(F.filter(items, lambda x: x["bad"]), lambda x: F.struct(x["name"], x["value"]))


def readiness(required: Sequence[str], optional: Sequence[str]) -> Column:
    items = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(level).alias("level"), F.col(n).isNull().alias("missing")) for level, names in (("high", required), ("medium", optional)) for n in names))
    return F.transform(F.filter(items, lambda x: x["missing"]), lambda x: F.struct(x["name"], x["level"]))


def confidence(p: Column, n_missing: Column, n_optional: int) -> Column:
    return 0.6 * 2 * F.abs(p - 0.5) + 0.4 * (1 - n_missing / n_optional)


def confidence_label(c: Column) -> Column:
    return F.when(c >= 0.78, "high").when(c >= 0.62, "moderate").otherwise("low")


def missing_count(cols: Sequence[str]) -> Column:
    return sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))


def any_slot(slots: Sequence[str], code: float) -> Column:
    """1 if any slot holds the code, 0 if some slot is filled but none holds it, NULL if all are empty."""
    arr = F.array(*map(F.col, slots))
    return F.when(null_safe(F.exists(arr, lambda x: x == code)), 1.0).when(F.exists(arr, lambda x: x.isNotNull()), 0.0)


def scoreable(features: Sequence[str], numeric: Sequence[str], age: str, least: int = 3, least_numeric: int = 2) -> Column:
    n = lambda cols: sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    return (n(features) >= least) & (n(numeric) >= least_numeric) & null_safe(F.col(age).between(18, 120))


def name_screen(c: Column, patterns: Sequence[str], allowed: Sequence[str] = ()) -> Column:
    plain = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_")
    return reduce(lambda a, b: a | b, (plain.rlike(p) for p in patterns)) & ~plain.isin(*allowed or ("",))
