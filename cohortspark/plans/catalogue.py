"""Rules for the entries of an evidence catalogue, each as column arithmetic over the entry: a row of every issue, and what may be shown of an entry.

Phrases are looked for in arrays of words, not by one expression a phrase: a rule names its words place by place, and counts only where no denial stands within a window of words before.

Defined cases: a NULL or blank field is empty; a NULL text or list has no words or statements; entries with a NULL key are checked like others and are not repeated keys of each other; repeated rows are repeated keys; very long texts are arrays of
one row; extra columns are ignored unless the caller names them as unknown; an empty table has no issues.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import null_safe

URL = r"^https?://\S+$"
DOI = r"^10\.\d{4,}/\S+$"
PLACEHOLDERS = ("unknown", "n.a.")  # fixed values


@dataclass(frozen=True)
class Phrase:
    """Words that follow each other, for each place the ones that will do; ``denials`` within ``window`` words before take it back, ``designs`` permit it."""

    name: str
    places: Sequence[Sequence[str]]
    denials: Sequence[str] = ()
    window: int = 4
    designs: Sequence[str] = ()


@dataclass(frozen=True)
class Rules:
    key: str
    required: Sequence[str] = ()
    texts: Sequence[str] = ()
    source: str | None = None
    doi: str | None = None
    related: str | None = None  # a list of URLs
    statements: Sequence[str] = ()  # lists of non-empty strings
    allowed: str | None = None  # of those the list that needs a source
    design: str | None = None
    unknown: str | None = None  # a list of keys that are not known
    phrases: Sequence[Phrase] = field(default_factory=tuple)


def words(text: Column) -> Column:
    """Words of ASCII letters and digits, in lower case."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, "[^a-z0-9]+"), lambda w: w != "")


def phrase_places(w: Column, p: Phrase) -> Column:
    """Places (from 0) at which the phrase begins and is not denied."""
    n = len(p.places)
    at = lambda i, k: F.get(w, i + k).isin(*p.places[k])
    starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
    found = F.filter(starts, lambda i: reduce(lambda a, b: a & b, (at(i, k) for k in range(n))))
    if not p.denials:
        return found
    before = lambda i: F.slice(w, F.greatest(i - p.window, F.lit(0)) + 1, F.least(i, F.lit(p.window)))
    return F.filter(found, lambda i: ~F.arrays_overlap(before(i), F.array(*map(F.lit, p.denials))))


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


def issues(df: DataFrame, rules: Rules) -> DataFrame:
    """key, field, severity (hard or soft), issue of everything against an entry. One pass, and one grouping by key for repeated ones."""
    found: list[tuple[str, str, str, Column]] = [(c, "hard", "empty", _text(c) == "") for c in rules.required]
    url = lambda c: _text(c).rlike(URL)
    known = lambda c: ~_text(c).isin(*PLACEHOLDERS, "")
    if rules.source:
        found.append((rules.source, "hard", "no URL", known(rules.source) & ~url(rules.source)))
    if rules.doi:
        found.append((rules.doi, "hard", "no DOI", known(rules.doi) & ~_text(rules.doi).rlike(DOI)))
    if rules.source and rules.doi:
        found.append((rules.source, "soft", "no source", ~known(rules.source) & ~known(rules.doi)))
        if rules.allowed:
            some = null_safe(F.size(rules.allowed) > 0)
            found.append((rules.allowed, "hard", "statements need a source", some & ~url(rules.source) & ~_text(rules.doi).rlike(DOI)))
    if rules.related:
        found.append((rules.related, "hard", "related source is no URL", null_safe(F.exists(rules.related, lambda x: ~null_safe(x.rlike(URL))))))
    found += [(c, "hard", "empty statement", null_safe(F.exists(c, lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""))) for c in rules.statements]
    if rules.unknown:
        found.append((rules.unknown, "hard", "unknown keys", null_safe(F.size(rules.unknown) > 0)))
    for c in rules.texts:
        for p in rules.phrases:
            permitted = null_safe(F.lower(F.col(rules.design)).isin(*p.designs)) if rules.design and p.designs else F.lit(False)
            found.append((c, "hard", p.name, (F.size(phrase_places(F.col(f"_words_{c}"), p)) > 0) & ~permitted))
    d = df.withColumns({f"_words_{c}": words(F.col(c)) for c in rules.texts})
    one = lambda c, severity, issue, bad: F.when(null_safe(bad), F.struct(F.lit(c).alias("field"), F.lit(severity).alias("severity"), F.lit(issue).alias("issue")))
    rows = d.select(rules.key, F.explode(F.filter(F.array(*(one(*f) for f in found)), lambda x: x.isNotNull())).alias("x")).select(rules.key, "x.*")
    again = df.filter(F.col(rules.key).isNotNull()).groupBy(rules.key).agg(F.count("*").alias("n")).filter("n > 1")
    return rows.unionByName(again.select(rules.key, F.lit(rules.key).alias("field"), F.lit("hard").alias("severity"), F.lit("repeated key").alias("issue")))


def shown(df: DataFrame, found: DataFrame, key: str, allowed: str, denied: str) -> DataFrame:
    """key, route, statements, denied: entries without issues are presentable with their allowed statements less the denied ones, those with soft issues only are for research and show none, the rest is held back."""
    worst = found.groupBy(key).agg(F.max((F.col("severity") == "hard").cast("int")).alias("_hard"))
    d = df.select(key, F.coalesce(allowed, F.array().cast("array<string>")).alias("_a"), F.coalesce(denied, F.array().cast("array<string>")).alias("denied")).join(worst, key, "left")
    route = F.when(F.col("_hard").isNull(), "presentable").when(F.col("_hard") == 0, "research").otherwise("held")
    none = F.array().cast("array<string>")
    return d.select(key, route.alias("route"), F.when(F.col("_hard").isNull(), F.array_except("_a", "denied")).otherwise(none).alias("statements"), "denied")


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("severity", "issue").agg(F.count("*").alias("rows"))
