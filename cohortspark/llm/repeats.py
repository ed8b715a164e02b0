"""Removal of every byte that lies in a string of ``length`` bytes which starts anywhere else as well.

Strings meet in shards by their content. Of the grams in a string the one with the smallest hash (the leftmost, if it is there twice) is its anchor, so equal
strings have equal anchors at equal places. Strings with one anchor that begin side by side form a segment of text. Anchors that occur once
need nothing more; the segments of the others meet by anchor, and equal segments become one with a count. What is left of an anchor are
segments that differ; of those a shard takes the parts that differ around the same text and gets a suffix array by induced sorting, and its permuted common prefixes of ``length`` or more tell the strings that
occur twice. An anchor with more than MOST bytes of different segments, such as the edge of a very common passage, is dealt over more shards: by
parts of NARROW strings that begin side by side and the hash of the text which these have in common, and then by single strings.

Equal texts are one from the start. Their table is bucketed by the hash of the text, so it is shuffled once.

Defined cases: a null text is empty; texts shorter than ``length`` keep every byte; equal texts, repeated rows and rows with null id are documents of their own, so the strings of copies
all go; extra columns are ignored; very long texts are read in parts of PART bytes, and one has as many segments as it needs; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import shared_dir
from .common import materialise, pa_schema, slices
from .suffix_array import permuted_prefixes, suffix_array

LENGTH = 400
GRAM = 100
PART = 4 << 20  # strings of a text that are looked at together
SHARD = 1 << 20  # bytes of segments in one suffix array, or one anchor's, if it has more
MOST = 4 << 20
NARROW, NEAR = 16, 32  # strings that begin side by side: of parts that are dealt over shards, and of those looked at inside of one
_LOW, _SHIFT = np.uint64((1 << 24) - 1), np.uint64(32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _SHIFT)) * _MIX
    return h ^ (h >> _SHIFT)


@cache
def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the bytes, powers of an odd base and of its inverse, modulo 2^64."""
    base = 0x5851F42D4C957F2D
    powers = [np.cumprod(np.full(n, b, np.uint64)) for b in (base, pow(base, -1, 1 << 64))]
    return _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)), *powers


def gram_hashes(t: np.ndarray, gram: int) -> np.ndarray:
    size = 1 << max(16, (len(t) + 1).bit_length())
    number, power, inverse = _tables(size)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(number[t] * power[: len(t)])])
    return _mixed((sums[gram:] - sums[:-gram]) * inverse[: len(t) - gram + 1])


def anchors(t: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of strings with one anchor: the first string's place, the anchor's place and its hash."""
    h = gram_hashes(t, gram)
    least = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    wide, size = length - gram + 1, 1
    while 2 * size <= wide:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    if size < wide:
        least = np.minimum(least[: len(least) - (wide - size)], least[wide - size :])
    place = (least & _LOW).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    return first, place[first], h[place[first]]


def _runs(data: bytes, length: int, gram: int) -> tuple[list, list, list]:
    out: tuple[list, list, list] = ([], [], [])
    for a in range(0, len(data) - length + 1, PART):
        t = np.frombuffer(data[a : a + PART + length - 1], np.uint8)
        first, place, h = anchors(t, length, gram)
        for x, y in zip(out, (first + a, place + a, h.view(np.int64))):
            x.append(y)
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in out)


def _shards_of(batches):
    """Arrow tables of whole keys (g1, g2) with about SHARD bytes of segments; rows come sorted by key."""
    rest: pa.Table | None = None
    for batch in batches:
        for part in slices(batch, "seg", SHARD):
            table = pa.Table.from_batches([part])
            rest = table if rest is None else pa.concat_tables([rest, table])
            if sum(c.nbytes for c in rest.column("seg").chunks) < SHARD:
                continue
            key = np.stack([rest.column(c).to_numpy() for c in ("g1", "g2")], 1)
            other = np.flatnonzero((key != key[-1]).any(1))
            if len(other):
                yield rest.slice(0, int(other[-1]) + 1)
                rest = rest.slice(int(other[-1]) + 1)
    if rest is not None:
        yield rest


def repeated_strings(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment a mask of the strings (by their first byte) that are anywhere else in the segments."""
    size = np.array([len(s) for s in segments])
    t = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.int64) + 2
    begin = np.cumsum(size + 1) - size - 1
    t[begin + size] = 1  # a byte 0 inside of a text is another character than the gap
    t = np.append(t, 0)
    sa = suffix_array(t, 258)
    prefix = permuted_prefixes(t, sa)
    rank = np.empty(len(t), np.int64)
    rank[sa] = np.arange(len(t))
    behind = np.append(prefix[sa[1:]], 0)[rank]  # with the next one in the order
    twice = np.maximum(prefix, behind) >= length
    return [twice[b : b + max(0, n - length + 1)] for b, n in zip(begin, size)]


def _parts(seg: bytes, n: int, anchor: int, narrow: int, length: int):
    """(part, what its strings have in common, first string, string after the last) of a segment: parts go by the distance to the anchor, so equal strings are in equal parts, and what a part has in
    common is in every string of it, whether that is in this segment or not."""
    low = 0
    while low < n:
        part = (anchor - low) // narrow
        begin = anchor - part * narrow
        high = min(n, begin + 1)
        yield part, seg[begin : begin - narrow + 1 + length], low, high
        low = high


def _twice(t: pa.Table, length: int) -> list[np.ndarray]:
    """For each segment (different ones of several keys) a mask of the strings that another one of its key has too.

    Only parts of NEAR strings whose common text another segment shares can hold such strings. Parts that are equal are decided by that; a suffix array is made of those that differ around the same text.
    """
    segs, n = t.column("seg").to_pylist(), t.column("n").to_pylist()
    places: dict[tuple, dict[bytes, list[tuple[int, int]]]] = {}
    for i, (g1, g2, seg, m, anchor) in enumerate(zip(t.column("g1").to_pylist(), t.column("g2").to_pylist(), segs, n, t.column("anchor").to_pylist())):
        for part, common, low, high in _parts(seg, m, anchor, NEAR, length):
            places.setdefault((g1, g2, part, xxhash.xxh3_128_digest(common)), {}).setdefault(seg[low : high - 1 + length], []).append((i, low))
    out = [np.zeros(m, bool) for m in n]
    differ: list[bytes] = []
    where: list[list[tuple[int, int]]] = []
    for own in places.values():
        for sub, at in own.items():
            if len(at) > 1:
                for i, low in at:
                    out[i][low : low + len(sub) - length + 1] = True
        if len(own) > 1:
            differ += own
            where += own.values()
    if differ:
        for mask, at in zip(repeated_strings(differ, length), where):
            for i, low in at:
                out[i][low : low + len(mask)] |= mask
    return out


def _intervals(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return [{"a": int(a), "b": int(b)} for a, b in edge.reshape(-1, 2)]


_PIECE = "g1 long, g2 long, s1 long, s2 long, p1 long, p2 long, p3 long, p4 long, at int, n int, anchor int, seg binary"
_KEY, _OWN, _PARENT = ["g1", "g2"], ["s1", "s2"], ["p1", "p2", "p3", "p4"]


def _hash2(x: bytes) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(x), np.int64).tolist())


class _Pieces:
    """Rows of _PIECE; the text of a segment is sent with the first row that a task has of it."""

    def __init__(self):
        self.rows, self.sent, self.bytes = [], set(), 0

    def add(self, key: tuple[int, int], parent: tuple, at: int, n: int, anchor: int, seg: bytes) -> None:
        own = _hash2(seg)
        if len(self.sent) > 500_000:
            self.sent.clear()
        new = (*key, *own) not in self.sent
        self.sent.add((*key, *own))
        self.rows.append((*key, *own, *parent, at, n, anchor, seg if new else None))
        self.bytes += 120 + new * len(seg)

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), schema)], schema=schema)
        self.rows, self.bytes = [], 0
        return out


def _resolved(pieces: DataFrame, length: int, narrow: int) -> DataFrame:
    """p1..p4, a, b: the strings a <= at < b of the parents that occur twice. ``pieces``: _PIECE; ``narrow``: strings of a part, if a key has too many."""
    pieces = materialise(pieces)
    sets = materialise(pieces.groupBy(*_KEY, *_OWN).agg(F.count("*").alias("count"), F.first("n").alias("n"), F.first("anchor").alias("anchor"), F.first("seg", ignorenulls=True).alias("seg")))
    size = materialise(sets.groupBy(*_KEY).agg(F.count("*").alias("sets"), F.sum(F.length("seg")).alias("bytes")).filter("sets > 1"))
    known = sets.join(size, _KEY).select(*_KEY, *_OWN, "count", "n", "anchor", "seg", "bytes")
    whole = sets.filter("count > 1").select(*_KEY, *_OWN, F.lit(0).alias("a"), F.col("n").alias("b"))
    out, small = pa_schema("g1 long, g2 long, s1 long, s2 long, a int, b int"), known.filter(F.col("bytes") <= MOST)

    def sort_shards(batches):
        for t in _shards_of(batches):
            once = t.column("count").to_numpy() == 1  # of the others all strings are known to occur twice
            found = [(i, x["a"], x["b"]) for i, m in enumerate(_twice(t, length)) if once[i] for x in _intervals(m)]
            rows = pa.array([i for i, _, _ in found], pa.int64())
            cols = [t.column(c).take(rows).combine_chunks() for c in (*_KEY, *_OWN)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([a for _, a, _ in found], pa.int32()), pa.array([b for *_, b in found], pa.int32())], schema=out)

    dealt = small.select(*_KEY, *_OWN, "count", "n", "anchor", "seg").repartition(*_KEY).sortWithinPartitions(*_KEY)
    found = whole.unionByName(dealt.mapInArrow(sort_shards, "g1 long, g2 long, s1 long, s2 long, a int, b int"))
    large = known.filter(F.col("bytes") > MOST)
    if narrow and not large.isEmpty():
        schema = pa_schema(_PIECE)

        def split(batches):
            made = _Pieces()
            for batch in batches:
                cols = [batch.column(c).to_pylist() for c in (*_KEY, *_OWN, "n", "anchor", "seg")]
                for g1, g2, s1, s2, n, anchor, seg in zip(*cols):
                    for part, common, low, high in _parts(seg, n, anchor, narrow, length):
                        made.add(_hash2(b"%d,%d,%d," % (g1, g2, part) + common), (g1, g2, s1, s2), low, high - low, anchor - low, seg[low : high - 1 + length])
                    if made.bytes > SHARD:
                        yield made.batch(schema)
            if made.rows:
                yield made.batch(schema)

        parts = _resolved(large.select(*_KEY, *_OWN, "n", "anchor", "seg").mapInArrow(split, _PIECE), length, 1 if narrow > 1 else 0)
        found = found.unionByName(parts.select(F.col("p1").alias("g1"), F.col("p2").alias("g2"), F.col("p3").alias("s1"), F.col("p4").alias("s2"), "a", "b"))
    found = materialise(found.groupBy(*_KEY, *_OWN).agg(F.collect_list(F.struct("a", "b")).alias("strings")))  # of one segment
    d = pieces.select(*_KEY, *_OWN, *_PARENT, "at").join(found, [*_KEY, *_OWN])
    return d.select(*_PARENT, "at", F.explode("strings").alias("x")).select(*_PARENT, (F.col("at") + F.col("x.a")).alias("a"), (F.col("at") + F.col("x.b")).alias("b"))


def _keys() -> tuple:
    """128 bits of the text, null as empty."""
    text = F.coalesce("text", F.lit(""))
    return F.xxhash64(F.lit(1), text).alias("ka"), F.xxhash64(F.lit(2), text).alias("kb")


def _units(docs: DataFrame) -> DataFrame:
    """ka, kb, copies, text of the different texts, as a table in buckets of (ka, kb)."""
    spark = docs.sparkSession
    name = f"texts_{uuid.uuid4().hex}"
    ways = int(spark.conf.get("spark.sql.shuffle.partitions"))
    units = docs.select(*_keys(), F.coalesce("text", F.lit("")).alias("text")).groupBy("ka", "kb").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    units.write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").bucketBy(ways, "ka", "kb").saveAsTable(name)
    return spark.table(name)


def _anchor_rows(units: DataFrame, length: int, gram: int) -> DataFrame:
    """ka, kb, h, place, first: of each text the hashes and places of its anchors, and where their strings begin."""
    schema = "ka long, kb long, h array<long>, place array<long>, first array<long>"
    out = pa_schema(schema)

    def run(batches):
        for batch in batches:
            for b in slices(batch):
                made = [(ka, kb, *_runs(t.encode(), length, gram)) for ka, kb, t in zip(b.column("ka").to_pylist(), b.column("kb").to_pylist(), b.column("text").to_pylist())]
                made = [(ka, kb, h, place, first) for ka, kb, first, place, h in made if len(h)]
                yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], f.type) for i, f in enumerate(out)], schema=out)

    return units.select("ka", "kb", "text").filter(F.octet_length("text") >= length).mapInArrow(run, schema)


def _first_pieces(units: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """_PIECE: the segments of the anchors that occur more than once."""
    one = rows.select("ka", "kb", F.posexplode("h").alias("i", "h"))
    # A table of its own, so that Spark can split what many texts have in the join.
    repeated = materialise(one.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    kept = one.join(repeated.hint("merge"), "h", "left_semi").groupBy("ka", "kb").agg(F.collect_list("i").alias("kept"))  # of one text
    out = pa_schema(_PIECE)

    def cut(batches):
        made = _Pieces()
        for batch in batches:
            for b in slices(batch):
                for ka, kb, text, h, place, first, kept in zip(*(b.column(c).to_pylist() for c in ("ka", "kb", "text", "h", "place", "first", "kept"))):
                    data = text.encode()
                    ends = [*first[1:], len(data) - length + 1]
                    for i in kept:
                        a, n = first[i], ends[i] - first[i]
                        made.add((h[i], 0), (ka, kb, 0, 0), a, n, place[i] - a, data[a : a + n - 1 + length])
                        if made.bytes > SHARD:
                            yield made.batch(out)
        if made.rows:
            yield made.batch(out)

    d = units.select("ka", "kb", "text").join(rows.join(kept, ["ka", "kb"]), ["ka", "kb"])
    return d.mapInArrow(cut, _PIECE)


_TEXT_RESULT = "ka long, kb long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def _marked(units: DataFrame, strings: DataFrame | None, length: int) -> DataFrame:
    """_TEXT_RESULT of every text: the merged spans of its strings that occur twice, and the bytes that are left."""
    out = pa_schema(_TEXT_RESULT)
    d = units if strings is None else units.join(strings, ["ka", "kb"], "left")

    def mark(batches):
        for batch in batches:
            for b in slices(batch):
                rows = []
                for ka, kb, copies, text, found in zip(*(b.column(c).to_pylist() for c in ("ka", "kb", "copies", "text", "strings"))):
                    data = text.encode()
                    spans: list[list[int]] = []
                    if copies > 1 and len(data) >= length:
                        spans = [[0, len(data)]]
                    else:
                        for x in sorted((x["a"], x["b"] - 1 + length) for x in found or ()):
                            if spans and x[0] <= spans[-1][1]:
                                spans[-1][1] = max(spans[-1][1], x[1])
                            else:
                                spans.append(list(x))
                    kept, last = [], 0
                    for x, y in spans:
                        kept.append(data[last:x])
                        last = y
                    rows.append((ka, kb, len(data), [{"start": x, "end": y} for x, y in spans], b"".join([*kept, data[last:]])))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return d.select("ka", "kb", "copies", "text", "strings").mapInArrow(mark, _TEXT_RESULT)


def repeats_of_texts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """ka, kb, n_bytes, spans, kept of the different texts of ``docs``."""
    units = _units(docs)
    rows = materialise(_anchor_rows(units, length, gram))
    strings = _resolved(_first_pieces(units, rows, length), length, NARROW)
    strings = strings.groupBy(F.col("p1").alias("ka"), F.col("p2").alias("kb")).agg(F.collect_list(F.struct("a", "b")).alias("strings"))  # of one text
    return _marked(units, strings, length)


def _for_documents(docs: DataFrame, texts: DataFrame) -> DataFrame:
    return docs.select("doc_id", *_keys()).join(texts, ["ka", "kb"]).drop("ka", "kb")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, spans (start, end of the removed bytes), kept (the bytes that are left, in which a character may be cut) of every row of ``docs``."""
    return _for_documents(docs, repeats_of_texts(docs, length, gram))


def repeat_digest(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``."""
    texts = repeats_of_texts(docs, length, gram)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return _for_documents(docs, texts.select("ka", "kb", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")))
