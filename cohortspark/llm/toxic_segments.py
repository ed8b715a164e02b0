"""Toxic passages: maximum-scoring segments of token log-odds, calibrated by extreme values.

Tokens are lower-cased words; an unknown word falls back to its first ``PREFIX`` letters. Weights are log-odds of toxic against other labelled
documents with an informative Dirichlet prior, kept where their z-score is high, at the lower end of their interval (BOUND standard errors); any other word costs ``DRIFT``. A linear-time scan finds
every maximal segment. Scores of the best segment follow an extreme-value law on clean text
(lambda and K after Karlin and Altschul); a logistic curve over the normalised score and the number of significant segments
gives the probability. Weights are learnt on remainders 1-3 of crc32(doc_id) mod 5, the curve on remainder 4; remainder 0 is held out.

Labels: at most ``train_rows`` labelled rows, chosen by a hash, are used to fit. Defined cases: null or empty text scores like a text without
toxic words; rows without a label are scored too; null labels are ignored, the larger of repeated labels counts; without any
toxic label every score is 0; repeated rows are scored each on its own; very long texts
are scored whole; extra columns are ignored, whatever their names are. The model is bounded by its parameters: VOCABULARY tokens of the highest z; of a text's
segments the highest score and the number of significant ones, up to FEW, make the probability.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, pa_schema, remainder5, slices, texts_of

WORD = re.compile(r"[^\W\d_]+")
PREFIX, DRIFT, Z, BOUND, PRIOR, VOCABULARY, FOLD, FEW = 4, -0.25, 2.5, 1.64, 0.1, 20_000, 3, 4
SCHEMA = "doc_id long, score double, predicted int, segments array<struct<start:int,end:int,score:double>>"


def tokens_of(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words | {w[:PREFIX] + "*" for w in words if len(w) > PREFIX}


COUNTS = "token string, toxic int, n long"


def _counts(batches, out: pa.Schema):
    """Documents per token and class within the task."""
    n = {0: Counter(), 1: Counter()}
    for b in batches:
        for text, toxic in zip(texts_of(b), b.column("toxic").to_pylist()):
            n[toxic].update(tokens_of(text))
    for label, c in n.items():
        keys = list(c)
        for i in range(0, len(keys), 50_000):
            part = keys[i : i + 50_000]
            yield pa.RecordBatch.from_pydict({"token": part, "toxic": [label] * len(part), "n": [c[k] for k in part]}, schema=out)


def log_odds(train: DataFrame) -> dict[str, float]:
    """The at most VOCABULARY tokens whose log-odds are surely positive, with a Dirichlet prior of PRIOR times the pooled counts."""
    n = train.select("text", "toxic").mapInArrow(lambda batches, out=pa_schema(COUNTS): _counts(batches, out), COUNTS).groupBy("token").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("o"))
    total = train.groupBy("toxic").count().collect()
    docs = {r[0]: r[1] for r in total}
    if not docs.get(1) or not docs.get(0):
        return {}
    # Presence per document: the odds compare documents that hold the token with those that don't.
    prior = PRIOR * (F.col("t") + F.col("o"))
    share = docs[1] / (docs[0] + docs[1])
    a, b = F.col("t") + prior * share + 0.01, F.col("o") + prior * (1 - share) + 0.01
    delta = F.log(a / (docs[1] * (1 + PRIOR) - a + 0.5)) - F.log(b / (docs[0] * (1 + PRIOR) - b + 0.5))
    error = F.sqrt(1 / a + 1 / b)
    scored = n.filter("t >= 3").select("token", (delta - BOUND * error).alias("d"), (delta / error).alias("z"))
    rows = scored.filter((F.col("z") >= Z) & (F.col("d") > 0.5)).orderBy(F.desc("z"), "token").limit(VOCABULARY).collect()
    return {r[0]: float(r[1]) for r in rows}


class Weights(dict):
    """Weight of a word, worked out once; bounded."""

    def __init__(self, odds: dict[str, float]):
        super().__init__()
        self.odds = odds

    def __missing__(self, w: str) -> float:
        x = self.odds.get(w)
        if x is None and len(w) > PREFIX:
            x = self.odds.get(w[:PREFIX] + "*")
        if len(self) > 300_000:
            self.clear()
        self[w] = x = DRIFT if x is None else x
        return x


def segments(w: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time after Ruzzo and Tompa; only positive entries open one."""
    total = np.concatenate([[0.0], np.cumsum(w)])
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    for i in np.flatnonzero(w > 0).tolist():
        start, left, right = i, total[i], total[i + 1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((start, i + 1, left, right))
    return [(a, b, float(r - x)) for a, b, x, r in stack]


def measure(text: str, weights: Weights) -> tuple[int, list[tuple[int, int, float]], np.ndarray]:
    words = WORD.findall(text.lower())
    w = np.fromiter(map(weights.__getitem__, words), float, len(words))
    return len(words), segments(w) if len(w) and w.max() > 0 else [], w


def karlin_lambda(values: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of sum p e^(lambda s) = 1; one more occurrence of each value keeps it finite."""
    p = (counts + 1) / (counts + 1).sum()
    if values.max() <= 0 or (p * values).sum() >= 0:
        return 0.1
    low, high = 1e-6, 1.0
    while (p * np.exp(np.minimum(high * values, 600))).sum() < 1 and high < 50:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * values, 600))).sum() < 1 else (low, mid)
    return low


class Calibration:
    """Extreme-value normalisation and the logistic curve."""

    def __init__(self, lam: float = 0.1, log_k: float = 0.0, curve: tuple[float, float, float] | None = None):
        self.lam, self.log_k, self.curve = lam, log_k, curve

    def features(self, n: int, scores: list[float]) -> tuple[float, float]:
        bits = [self.lam * s - self.log_k - np.log(max(n, 1)) for s in scores]
        significant = sum(b > 4.6 for b in bits)  # about one clean text in a hundred
        return float(np.clip(max(bits, default=-10.0), -10, 40)) / 10, float(min(significant, FEW))

    def probability(self, n: int, scores: list[float]) -> float:
        if self.curve is None:
            return 0.0
        x, k = self.features(n, scores)
        a, b, c = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * x + c * k, -50, 50))))

    def fit(self, rows: list[tuple[int, list[float], int]]) -> None:
        clean = np.array([self.lam * max(s, default=0.0) - np.log(max(n, 1)) for n, s, y in rows if y == 0 and s])
        self.log_k = float(clean.mean() - 0.5772) if len(clean) >= 20 else 0.0
        x = np.array([(1.0, *self.features(n, s)) for n, s, _ in rows])
        y, w = np.array([r[2] for r in rows], float), np.zeros(3)
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
            w = w + np.linalg.solve(h, x.T @ (y - p) - 0.05 * w)
        self.curve = tuple(map(float, w))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = 40_000) -> tuple[dict[str, float], Calibration]:
    usable = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").withColumn("r", remainder5(F.col("doc_id"))).filter("r <> 0").groupBy("doc_id", "r").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).collect()  # train_rows rows at most
    spark = docs.sparkSession
    sample = spark.createDataFrame([tuple(r) for r in chosen], "doc_id long, r long, toxic int")
    # One text of each labelled id, however many rows have that id: the sample stays bounded.
    text = F.coalesce("text", F.lit(""))
    train = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "r", "toxic").agg(F.min_by(text, F.xxhash64(text)).alias("text"))
    odds = log_odds(train.filter(F.col("r") <= FOLD))
    if not odds:
        return {}, Calibration()
    kinds = "n int, scores array<double>, toxic int, value array<double>, times array<long>"

    out = pa_schema(kinds)

    def look(batches):
        weights = Weights(odds)
        for b in (part for batch in batches for part in slices(batch)):
            rows = [(*measure(t, weights), y) for t, y in zip(texts_of(b), b.column("toxic").to_pylist())]
            hist = [np.unique(np.round(w, 2), return_counts=True) for _, _, w, _ in rows]
            yield pa.RecordBatch.from_pydict({"n": [r[0] for r in rows], "scores": [sorted((s for _, _, s in r[1]), reverse=True)[:FEW] for r in rows], "toxic": [r[3] for r in rows], "value": [h[0].tolist() for h in hist], "times": [h[1].tolist() for h in hist]}, schema=out)

    seen = train.filter(F.col("r") > FOLD).select("text", "toxic").mapInArrow(look, kinds).collect()  # a part of the bounded sample
    background: Counter = Counter()
    for r in seen:
        if r.toxic == 0:
            background.update(dict(zip(r.value, r.times)))
    for v in set(np.round(list(odds.values()), 2).tolist()):
        background[v] += 0
    values = np.array(sorted(background) or [DRIFT])
    c = Calibration(karlin_lambda(values, np.array([background[v] for v in values], float)))
    if {r.toxic for r in seen} == {0, 1}:
        c.fit([(r.n, r.scores, r.toxic) for r in seen])
    else:
        c.curve = (-4.6, 10.0, 1.0)  # too few labels for a curve: significance alone decides
    return odds, c


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = 40_000) -> DataFrame:
    """doc_id, held_out, score, predicted and the significant segments (in words). No shuffle of texts."""
    odds, c = fit(docs, labels, train_rows)

    def setup():
        weights = Weights(odds)

        def f(batch):
            rows = [measure(t, weights)[:2] for t in texts_of(batch)]
            p = [c.probability(n, [s for _, _, s in segs]) for n, segs in rows]
            kept = [[{"start": a, "end": b, "score": s} for a, b, s in segs if c.lam * s - c.log_k - np.log(max(n, 1)) > 4.6] for n, segs in rows]
            return {"doc_id": batch.column("doc_id"), "score": p, "predicted": [int(x >= 0.5) for x in p], "segments": kept}

        return f

    d = map_text(docs.select("doc_id", "text"), None, SCHEMA, setup)
    return d.select("doc_id", (remainder5(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted", "segments")


def reject_toxic(docs: DataFrame, labels: DataFrame, train_rows: int = 40_000) -> DataFrame:
    """The documents that are not predicted toxic, all columns kept."""
    odds, c = fit(docs, labels, train_rows)

    def run(batches):
        weights = Weights(odds)
        for b in (part for batch in batches for part in slices(batch)):
            keep = [c.probability(n, [s for _, _, s in segs]) < 0.5 for n, segs, _ in (measure(t, weights) for t in texts_of(b))]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
