"""Quality rules from tokeniser fertility.

Per document: characters per token of a public byte-level BPE, the share of bytes that a public piece BPE spells byte by byte,
and the entropy of its tokens (over the logarithm of their number). Per language, fences (quartiles -/+ ``reach`` times
their distance) come from a histogram over all documents; a document outside a fence, or failing the base rules, is not kept.

Defined cases: null or empty text has no words and fails the base rule; a null language is a language of its own; one with fewer
than ``LEAST`` documents that pass the base rules gets the fences of all documents together; a distance under 10 bins counts as 10; repeated rows count each; very long texts
are measured whole; extra columns are ignored, whatever their names are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_text, materialise, texts_of
from .tokens import TokenCache, tokenizer_path

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
METRICS = ("chars_per_token", "byte_fallback", "entropy")
GRAIN = 1000  # bins per unit of a metric
WEIGHT = 20  # documents that the fences of all languages count for in those of one
SCHEMA = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_tokens long, " + ", ".join(f"{m} int" for m in METRICS)


def repeated_words(words: list) -> int:
    """Words inside 3-word windows that occur at least twice in the text, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    k = len(ids)
    key = w[:-2] * k + w[1:-1]
    key = (np.unique(key, return_inverse=True)[1] if k > 2_000_000 else key) * k + w[2:]  # no overflow: k^3 < 2^63 below that
    _, where, count = np.unique(key, return_inverse=True, return_counts=True)
    again = count[where] > 1
    hit = np.zeros(n, bool)
    for shift in range(3):
        hit[shift : n - 2 + shift] |= again
    return int(hit.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    raw = text.encode()
    words = raw.split()  # bytes.split() cuts at exactly these six characters
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += WORDS.search(line) is not None
        else:
            seen.add(line)
    return len(words), len(text) - len(raw) + len(raw.translate(None, b" \t\n\x0b\x0c\r")), len(raw) - len(raw.translate(None, b"#*$%&|<>")), dup, repeated_words(words)


def _measure(path: str, pieces: str) -> Callable[[], Callable[[pa.RecordBatch], dict]]:
    def setup():
        cache, known = TokenCache(path), _known_chars(pieces)

        def fallback(text: str) -> int:
            return 0 if text.isascii() else sum(len(c.encode()) for c in text if not known[c])

        def f(batch):
            rows = []
            for text in texts_of(batch):
                n, chars, symbols, dup, repeat = base_counts(text)
                ids = np.frombuffer(cache.encode(text), "<u4")
                count = np.bincount(ids) if len(ids) else np.zeros(1)
                p = count[count > 0] / max(len(ids), 1)
                entropy = float(-(p * np.log2(p)).sum()) / math.log2(len(ids)) if len(ids) > 1 else 0.0
                share = fallback(text) / max(len(text.encode()), 1)
                rows.append((n, chars, symbols, dup, repeat, n < 50 or 100 * repeat > 50 * n, len(ids), *(int(round(x * GRAIN)) for x in (len(text) / max(len(ids), 1), share, entropy))))
            names = [x.split()[0] for x in SCHEMA.split(", ")][2:]
            return {"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), **{k: [r[i] for r in rows] for i, k in enumerate(names)}}

        return f

    return setup


class _Known(dict):
    """Whether the piece vocabulary spells a character without falling back to bytes."""

    def __init__(self, model):
        super().__init__()
        self.model = model

    def __missing__(self, c: str) -> bool:
        self[c] = known = not any(self.model.is_byte(i) for i in self.model.encode("a" + c + "a"))
        return known


def _known_chars(path: str) -> _Known:
    import sentencepiece

    return _Known(sentencepiece.SentencePieceProcessor(model_file=path))


def fences(measured: DataFrame, reach: float) -> DataFrame:
    """lang, metric, low, high in bins, from exact quartiles of the histogram of documents that pass the base rules; and the fences of all languages together.

    The fences of a language are drawn towards those of all by WEIGHT documents, so a language of few is judged almost like all and one of many by itself, without a step between.
    """
    long = measured.filter("NOT base_failed").select("lang", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("bin")) for m in METRICS))).alias("x")).select("lang", "x.*")
    hist = long.groupBy("lang", "metric", "bin").agg(F.count("*").alias("n")).withColumn("pooled", F.explode(F.array(F.lit(False), F.lit(True))))
    hist = hist.groupBy("pooled", F.when(~F.col("pooled"), F.col("lang")).alias("lang"), "metric", "bin").agg(F.sum("n").alias("n"))
    part = Window.partitionBy("pooled", "lang", "metric")
    cum = hist.withColumn("upto", F.sum("n").over(part.orderBy("bin"))).withColumn("all", F.sum("n").over(part))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bin")))
    quart = cum.groupBy("pooled", "lang", "metric").agg(at(0.25).alias("q1"), at(0.75).alias("q3"), F.max("all").alias("all"))
    gap = F.greatest(F.col("q3") - F.col("q1"), F.lit(10))
    quart = quart.select("pooled", "lang", "metric", "all", (F.col("q1") - reach * gap).alias("low"), (F.col("q3") + reach * gap).alias("high"))
    every = quart.filter("pooled").select("metric", F.col("low").alias("low_"), F.col("high").alias("high_"))  # a row a metric
    drawn = lambda c: F.when(F.col("pooled"), F.col(c)).otherwise((F.col("all") * F.col(c) + WEIGHT * F.col(f"{c}_")) / (F.col("all") + WEIGHT)).alias(c)
    return quart.join(F.broadcast(every), "metric").select("pooled", "lang", "metric", drawn("low"), drawn("high"))


def fertility(docs: DataFrame, bpe: str = "byte_bpe_50k.tiktoken", pieces: str = "piece_bpe_32k.model", reach: float = 2.5) -> DataFrame:
    """One row per document: base counts, base_failed, kept and the three measures. The texts are read once."""
    measured = materialise(map_text(docs.select("doc_id", "lang", "text"), None, SCHEMA, _measure(tokenizer_path(bpe), tokenizer_path(pieces))))
    band = F.struct(F.col("metric"), F.col("low"), F.col("high"))
    bands = fences(measured, reach).groupBy("pooled", "lang").agg(F.collect_list(band).alias("bands"))
    own = bands.filter("NOT pooled").select(F.col("lang").alias("_lang"), F.col("bands").alias("own"))
    # One row of pooled fences, at most.
    d = measured.join(own, F.col("lang").eqNullSafe(F.col("_lang")), "left").join(F.broadcast(bands.filter("pooled").select(F.col("bands").alias("all_bands"))), how="left")
    d = d.withColumn("bands", F.coalesce("own", "all_bands"))
    value = F.create_map(*(x for m in METRICS for x in (F.lit(m), F.col(m))))
    inside = F.coalesce(F.forall("bands", lambda b: (F.element_at(value, b["metric"]) >= b["low"]) & (F.element_at(value, b["metric"]) <= b["high"])), F.lit(True))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return d.select(*names, (~F.col("base_failed") & inside).alias("kept"), "n_tokens", *((F.col(m) / GRAIN).alias(m) for m in METRICS))
