"""Benchmark decontamination: an FM-index of each shard of training text is searched for the benchmark's phrases.

A shard is a slice of a partition. Words that no phrase holds cannot be part of an occurrence, so the index covers the stretches of
words known to the benchmark that are long enough. Backward search runs all phrases through the wavelet ranks, the sampled positions
locate the occurrences, and overlapping ones merge into removal spans. No shuffle of texts.

Phrases travel with the tasks in parts of about ``part_words`` benchmark words (long items are cut into overlapping chunks). A benchmark of one part takes
one pass over the texts. A larger one takes a pass for each part, one after the other: the driver and the tasks hold one part at a time, each pass writes the
hits of its part, and the hits of a row meet in the end.

Defined cases: very long texts are searched whole; null or wordless text and items have no words; a repeated item id counts once; an item with fewer words than a window is
one window; an empty benchmark hits nothing; a null item id counts as the id ''; repeated rows are cut alike; an empty table gives an empty one; ``occurrences`` ignores extra columns, ``remove_spans`` keeps
them whatever their names are.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import fresh_name, map_text, materialise, pa_schema, slices, texts_of
from .fm_index import FmIndex

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # every byte of a character beyond ASCII is at least 0x80
WINDOW = 10
CHUNK = 5000  # windows of an item that stay together
PART_WORDS = 250_000
SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())


class Phrases:
    """Distinct windows by length, as rows of word numbers (2 and up), with the items each belongs to."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            w = [self.number.setdefault(x, len(self.number) + 2) for x in words_of(text)]
            for i in range(max(1, len(w) - window + 1) if w else 0):
                found.setdefault(tuple(w[i : i + window]), set()).add(item)
        self.by_length = {}
        for n in sorted({len(p) for p in found}):
            own = [p for p in found if len(p) == n]
            self.by_length[n] = (np.array(own, np.int64), [sorted(found[p]) for p in own])
        self.shortest = min(self.by_length, default=0)


def search(docs: list[list[bytes]], phrases: Phrases) -> list[tuple[set[str], list[tuple[int, int]]]]:
    """Per document the items that occur and the merged (start, end) word spans of all occurrences."""
    out: list[tuple[set[str], list[tuple[int, int]]]] = [(set(), []) for _ in docs]
    stretches, doc_of, word_of = [], [], []
    get = phrases.number.get
    for d, words in enumerate(docs):
        w = np.fromiter((get(x, 0) for x in words), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], w > 0, [0]]).astype(np.int8)))
        for a, b in edge.reshape(-1, 2):
            if phrases.shortest and b - a >= phrases.shortest:
                stretches.append(w[a:b])
                doc_of.append(d)
                word_of.append(a)
    if not stretches:
        return out
    index = FmIndex(stretches)
    begin = np.concatenate([[0], np.cumsum([len(s) + 1 for s in stretches])])
    spans: list[list[tuple[int, int]]] = [[] for _ in docs]
    for n, (rows, items) in phrases.by_length.items():
        low, high = index.intervals(rows)
        which = np.flatnonzero(high > low)
        size = (high - low)[which]
        first = np.repeat(low[which] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        place = index.locate(first)
        stretch = np.searchsorted(begin, place, "right") - 1
        for phrase, s, at in zip(np.repeat(which, size).tolist(), stretch.tolist(), place.tolist()):
            start = int(word_of[s] + at - begin[s])
            out[doc_of[s]][0].update(items[phrase])
            spans[doc_of[s]].append((start, start + n))
    for d, own in enumerate(spans):
        out[d][1].extend(merge(own))
    return out


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _chunks(benchmark: DataFrame) -> DataFrame:
    """item, part of its words (joined by spaces) and their number: every window of the item is whole in one chunk."""
    schema = "item string, text string, n long"
    out = pa_schema(schema)

    def cut(batches):
        for b in batches:
            for item, text in zip(b.column("item").to_pylist(), texts_of(b)):
                w = words_of(text)
                own = [w[i : i + CHUNK + WINDOW - 1] for i in range(0, max(1, len(w) - WINDOW + 1), CHUNK)] if w else []
                yield pa.RecordBatch.from_pydict({"item": [item] * len(own), "text": [b" ".join(x).decode() for x in own], "n": list(map(len, own))}, schema=out)

    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").mapInArrow(cut, schema).distinct()


def _parts(chunks: DataFrame, part_words: int) -> int:
    return max(1, -(-(chunks.agg(F.sum("n")).first()[0] or 0) // part_words))


def _searched(docs: DataFrame, chunks: DataFrame, part_words: int, finish, schema) -> DataFrame:
    """``finish`` (slice, items and merged spans of its rows, their words if known, the phrases if all are at hand -> columns of ``schema``, which rows stay) for all rows of ``docs``."""
    n = _parts(chunks, part_words)
    part, out = F.pmod(F.xxhash64("item", "text"), F.lit(n)), pa_schema(schema)
    if n == 1:
        phrases = Phrases([(r.item, r.text) for r in chunks.collect()])  # part_words at most

        def once(batches):
            for batch in batches:
                for b in slices(batch):
                    words = [words_of(t) for t in texts_of(b)]
                    yield _columns(finish(b, search(words, phrases), list(map(len, words)), phrases), out)

        return docs.mapInArrow(once, schema)
    row, items, own_spans = (fresh_name(docs, c) for c in ("row_of_pass", "items_found", "spans_found"))
    keyed = materialise(docs.withColumn(row, F.monotonically_increasing_id()))
    hits: DataFrame | None = None
    for k in range(n):
        phrases = Phrases([(r.item, r.text) for r in chunks.filter(part == k).collect()])  # about part_words
        own = materialise(_pass(keyed.select(F.col(row).alias("row"), "text"), phrases))
        hits = own if hits is None else hits.unionByName(own)
    # Of one row: at most a list of each part.
    met = hits.groupBy(F.col("row").alias(row)).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias(items), F.flatten(F.collect_list("spans")).alias(own_spans))

    def last(batches):
        for batch in batches:
            for b in slices(batch):
                spans = [merge([(x["start"], x["end"]) for x in s or ()]) for s in b.column(own_spans).to_pylist()]
                yield _columns(finish(b, [(i or [], s) for i, s in zip(b.column(items).to_pylist(), spans)], None, None), out)

    return keyed.join(met, row, "left").drop(row).mapInArrow(last, schema)


def _columns(made: tuple[dict, list[bool] | None], out: pa.Schema) -> pa.RecordBatch:
    cols, keep = made
    b = pa.RecordBatch.from_pydict({n: cols[n] for n in out.names}, schema=out)
    return b if keep is None else b.filter(pa.array(keep, pa.bool_()))


def _pass(keyed: DataFrame, phrases: Phrases) -> DataFrame:
    """One pass over the texts: row, items and spans of the rows with a hit of these phrases."""
    schema = "row long, items array<string>, spans array<struct<start:int,end:int>>"

    def f(b: pa.RecordBatch) -> dict:
        hit = [(r, *x) for r, x in zip(b.column("row").to_pylist(), search([words_of(t) for t in texts_of(b)], phrases)) if x[1]]
        return {"row": [r for r, _, _ in hit], "items": [sorted(i) for _, i, _ in hit], "spans": [[{"start": x, "end": y} for x, y in s] for _, _, s in hit]}

    return map_text(keyed, f, schema)


def occurrences(docs: DataFrame, benchmark: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, items, spans (merged, in words) of every row of ``docs``."""

    def measure(b: pa.RecordBatch, found: list, n_words: list[int] | None, phrases: Phrases | None):
        n = [len(words_of(t)) for t in texts_of(b)] if n_words is None else n_words
        return {"doc_id": b.column("doc_id"), "n_words": n, "n_hit": [sum(y - x for x, y in s) for _, s in found], "items": [sorted(i) for i, _ in found], "spans": [[{"start": x, "end": y} for x, y in s] for _, s in found]}, None

    return _searched(docs.select("doc_id", "text"), materialise(_chunks(benchmark)), part_words, measure, SCHEMA)


def decontamination_report(docs: DataFrame, benchmark: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    d = occurrences(docs, benchmark, part_words)
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans")


_ANY_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # the same words before lower-casing


def remove_spans(docs: DataFrame, benchmark: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """The documents without any hit word; those of which no word is left go. All columns are kept, whatever their names are.

    Words on both sides of a cut may form a window anew, so what was cut is searched again until nothing is hit; every round takes words away.
    """
    names, again = docs.columns, fresh_name(docs, "cut_in_this_pass")
    schema = StructType([*docs.schema.fields, StructField(again, BooleanType())])

    def clean(b: pa.RecordBatch, found: list, n_words: list[int] | None, phrases: Phrases | None):
        new, at, first = b.column("text").to_pylist(), range(b.num_rows), [bool(s) for _, s in found]
        while at := [i for i, (_, s) in zip(at, found) if s]:
            spans = [s for _, s in found if s]
            for i, s in zip(at, spans):
                new[i] = _cut(new[i], s)
            if phrases is None:
                break
            found = search([words_of(new[i]) for i in at], phrases)
        cols = {n: b.column(n) for n in names} | {"text": new, again: [hit and phrases is None for hit in first]}
        if "n_chars" in cols:
            cols["n_chars"] = [len(t) if hit else n for n, hit, t in zip(b.column("n_chars").to_pylist(), first, new)]
        return cols, [not hit or bool(_ANY_WORD.search(t)) for hit, t in zip(first, new)]

    done: DataFrame | None = None
    chunks = materialise(_chunks(benchmark))
    while True:
        d = _searched(docs, chunks, part_words, clean, schema)
        if _parts(chunks, part_words) == 1:
            return d.drop(again)
        d = materialise(d)
        docs = d.filter(again).drop(again)
        clear = d.filter(~F.col(again)).drop(again)
        done = clear if done is None else done.unionByName(clear)
        if docs.isEmpty():
            return done


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    at = [m.span() for m in _ANY_WORD.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join([*out, text[last:]])
