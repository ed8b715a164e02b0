"""N-gram Jaccard self-join by a grouped prefix join.

A document's set holds its distinct word shingles (64-bit hashes of five words); a set is known by 128 bits. In one global order of shingles - rare ones by hash first, frequent ones
by count last - two sets of Jaccard similarity ``t`` or more share a shingle in their prefixes of n - ceil(t n) + 1. Documents with the same size and
prefix form one group; groups that share a prefix shingle and fit in size are candidates; those are expanded and verified on whole sets.

Equal sets are one node from the start. A large group of near copies is not paired out: first each bucket (shingle, size band) compares its members with one pivot
only, and links found make components; buckets inside one component need nothing more. Then every pair of
different components that is left in a bucket is compared, so no link between components is lost.

Defined cases: null or wordless text has the empty set (n_shingles 0, its own component); fewer than five words make one shingle; repeated
rows and equal texts are linked; a null ``doc_id`` never names a component unless all its members are null; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_name, map_text, materialise, pa_schema, slices, texts_of
from .components import components

K, PERCENT = 5, 80
HEAVY = 1 << 17  # frequent shingles whose counts order them last: a bound on what is sent to tasks
STEPS = 8  # of the histogram of counts, for each power of two
LOCAL, COUNT_BYTES = 2, 16 << 20  # a slice of so many bytes reports a shingle that so many different sets of it hold
BLOOM_LOG, PARITY_LOG, FOLDED = 24, 11, 8
ROUNDS = 1  # rounds with pivots before the last one, which takes every pair that is left
BLOCK = 2048  # rows of a bucket that one task compares with each other or with another block
_MIX = np.uint64(0x9E3779B97F4A7C15)
EMPTY = np.zeros(0, np.int64)


class _WordHash(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


def shingles(text: str, hashes: _WordHash, k: int = K) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles (of all words, if fewer than k)."""
    words = text.encode().lower().split()
    if not words:
        return EMPTY
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    out = np.full(n, min(len(h), k), np.uint64)
    for j in range(min(k, len(h))):
        out = (out ^ h[j : j + n]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _node(s: np.ndarray, renamed: dict[tuple[int, int], int] | None = None) -> int:
    """64 bits of the set; another number where different sets share those (``renamed``: by 128 bits)."""
    bits = _bits(s)
    return renamed.get(bits, bits[0]) if renamed else bits[0]


def _bits(s: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes(), seed=len(s)), np.int64).tolist()) if len(s) else (0, 0)


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Values, sorted, and counts of the at most HEAVY shingles with the highest counts among those that slices report.

    A histogram of the counts (a bounded number of steps) gives the least count to fetch, so that tasks send HEAVY rows in all, not each.
    """

    out = pa_schema("t long, n long")

    def run(batches):
        hashes = _WordHash()
        for batch in batches:
            for b in slices(batch, limit=COUNT_BYTES):
                parts = {_node(s): s for s in (shingles(t, hashes) for t in texts_of(b))}  # equal sets count once
                values, n = np.unique(np.concatenate([EMPTY, *parts.values()]), return_counts=True)
                many = n >= LOCAL
                yield pa.RecordBatch.from_pydict({"t": values[many], "n": n[many]}, schema=out)

    counts = materialise(docs.select("text").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")))
    step = F.floor(F.log2(F.col("n").cast("double")) * STEPS)
    least, fetched = None, 0
    for at, rows in sorted(counts.groupBy(step.alias("at")).count().collect(), reverse=True):
        fetched += rows
        if fetched > HEAVY:
            break
        least = at
    if least is None:
        return EMPTY, EMPTY
    most = counts.filter(step >= least).toArrow().sort_by("t")
    return most.column("t").to_numpy(), most.column("n").to_numpy()


class _Order:
    """Prefixes under the global order."""

    def __init__(self, values: np.ndarray, counts: np.ndarray):
        self.values, self.counts = values, counts

    def prefix(self, s: np.ndarray, percent: int) -> np.ndarray:
        p = prefix_size(len(s), percent)
        if not len(self.values):
            return s[:p]
        at = np.minimum(np.searchsorted(self.values, s), len(self.values) - 1)
        weight = np.where(self.values[at] == s, self.counts[at], 0)
        return s[np.lexsort([s, weight])[:p]]


def _fits(a, b, percent: int):
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * percent)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    return _answer(*_groups(docs.select("doc_id", "text"), percent))


def _groups(texts: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Members (a row for every row of ``texts``; its column ``row``, if there is one, is kept) and the labels of linked nodes."""
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    own = [c for c in ("row", "text_hash") if c in texts.columns]
    order = _Order(*_frequent(texts))

    def nodes():
        hashes = _WordHash()

        def f(b: pa.RecordBatch) -> dict:
            sets = [shingles(t, hashes) for t in texts_of(b)]
            heads = [order.prefix(s, percent) for s in sets]
            return {"doc_id": b.column("doc_id"), "n": [len(s) for s in sets], "node": [_node(s) for s in sets], "other": [_bits(s)[1] for s in sets], "head": [_node(h) for h in heads], "prefix": heads, "parity": [_parity(s) for s in sets]} | {c: b.column(c) for c in own}

        return f

    members = materialise(map_text(texts, None, "doc_id long, n int, node long, other long, head long, prefix array<long>, parity array<long>" + "".join(f", {c} long" for c in own), nodes))
    renamed = _clashes(members)
    if renamed:
        new = F.create_map(*(F.lit(x) for (a, b), c in renamed.items() for x in (f"{a},{b}", c)))
        members = materialise(members.withColumn("node", F.coalesce(F.try_element_at(new, F.concat_ws(",", "node", "other")), "node")))
    # Groups: same size, same prefix. The leader stands for its group in the buckets.
    groups = members.filter("n > 0").groupBy("n", "head").agg(F.min("node").alias("g"), F.first("prefix").alias("prefix"))
    entries = groups.select("g", "n", F.posexplode("prefix").alias("pos", "t"))
    bucket = materialise(entries.withColumn("m", F.count("*").over(Window.partitionBy("t"))).filter("m > 1").select("t", "g", "n", "pos"))
    in_group = members.filter("n > 0").select("node", "n", "head").distinct()
    leader = in_group.groupBy("n", "head").agg(F.min("node").alias("g"), F.count("*").alias("size")).filter("size > 1")
    # Only groups of several nodes need a table of members; any other group is its leader.
    label: DataFrame | None = None
    expand = materialise(in_group.join(leader, ["n", "head"]).select("g", "node", "n"))
    links: DataFrame | None = None
    tested: DataFrame | None = None
    for r in range(ROUNDS + 1):
        pairs = _star_pairs(bucket, expand, label, r, percent) if r < ROUNDS else _last_pairs(bucket, expand, label, members, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["u", "v"], "left_anti")
        alike = _alike(pairs, members, percent)
        alike = materialise(_hooks(alike) if r < ROUNDS else alike.select("u", "v"))
        verified = materialise(_verify(texts, alike, members, percent, renamed))
        new = verified.filter("linked").select("u", "v")
        links = new if links is None else links.unionByName(new)
        tested = verified.select("u", "v") if tested is None else tested.unionByName(verified.select("u", "v"))
        label = materialise(components(links))
    return members, label


def _band(percent: int):
    return F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int")


def _star_pairs(bucket: DataFrame, expand: DataFrame, label: DataFrame | None, r: int, percent: int) -> DataFrame:
    """Each bucket's members against one pivot of it (another one each round), and each group's members against its leader."""
    b = bucket.withColumn("band", _band(percent))
    if label is not None:
        b = _open_buckets(b, label)
    # The next lower band has a pivot too: similar sets may lie on both sides of the border.
    near = Window.partitionBy("t").orderBy("band")
    key = F.struct(F.xxhash64(F.col("g"), F.col("t"), F.lit(r)).alias("h"), F.col("g").alias("p"), F.col("n").alias("pn"))
    pivots = F.array(F.min(key).over(near.rangeBetween(0, 0)), F.min(key).over(near.rangeBetween(-1, -1)))
    b = b.select("g", "n", pivots.alias("pivots")).select("g", "n", F.explode("pivots").alias("pivot")).filter(F.col("pivot").isNotNull() & _fits(F.col("n"), F.col("pivot.pn"), percent))
    inside = expand.select(F.col("node").alias("u"), F.col("g").alias("v"))
    return b.select(F.col("g").alias("u"), F.col("pivot.p").alias("v")).unionByName(inside).filter("u <> v").distinct()


def _hooks(alike: DataFrame) -> DataFrame:
    """Of each member's pivots the closest and the one with the smallest hash: whole sets are compared for these only.

    Members of one component mostly agree on the second one. What stays apart meets again in the last round, which takes every pair.
    """
    kept = alike.groupBy("u").agg(F.min(F.struct("apart", "v"))["v"].alias("a"), F.min(F.struct(F.xxhash64("v"), "v"))["v"].alias("b"))
    d = kept.select("u", F.explode(F.array_distinct(F.array("a", "b"))).alias("v"))
    return d.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _labelled(df: DataFrame, column: str, label: DataFrame) -> DataFrame:
    return df.join(label.withColumnRenamed("node", column), column, "left").withColumn("label", F.coalesce("label", column))


def _open_buckets(b: DataFrame, label: DataFrame) -> DataFrame:
    """Buckets whose members lie in several components."""
    part = Window.partitionBy("t")
    return _labelled(b, "g", label).withColumn("lo", F.min("label").over(part)).withColumn("hi", F.max("label").over(part)).filter("lo <> hi").drop("lo", "hi", "label")


def _nodes_of(bucket: DataFrame, expand: DataFrame, label: DataFrame) -> DataFrame:
    """Bucket entries per node, with labels: groups of one node stand for themselves; a group of several is a bucket of its own as well."""
    several = materialise(_labelled(expand, "node", label).select("g", "n", "node", "label"))
    one = label.join(several, "node", "left_anti").select(F.col("node").alias("g"), "node", "label")
    known = several.select("g", "node", "label").unionByName(one)
    d = bucket.join(known, "g", "left").select("t", "n", "pos", F.coalesce("node", "g").alias("node"), F.coalesce("label", "g").alias("label"))
    return d.unionByName(several.select(F.xxhash64("g", F.lit("group")).alias("t"), "n", F.lit(0).alias("pos"), "node", "label"))


PAIR_SCHEMA = "u long, v long"


def _last_pairs(bucket: DataFrame, expand: DataFrame, label: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """All node pairs of different components within a bucket that sizes, positions and parity words allow.

    Rows of a bucket lie side by side in one task and are compared there by arrays, so pairs that cannot be similar are never rows.
    A bucket of more than BLOCK rows is dealt out as pairs of blocks.
    """
    d = _nodes_of(bucket, expand, label).withColumn("band", _band(percent))
    near = Window.partitionBy("t").orderBy("band").rangeBetween(-1, 1)
    d = d.withColumn("lo", F.min("label").over(near)).withColumn("hi", F.max("label").over(near)).filter("lo <> hi")
    d = d.withColumn("blocks", F.ceil(F.count("*").over(Window.partitionBy("t")) / BLOCK).cast("int")).select("t", "n", "pos", "node", "label", "blocks")
    # Words of the parity bits laid over each other: fewer bits give a weaker bound, but still an exact one.
    own = members.filter("n > 0").groupBy("node").agg(F.first(_folded(F.col("parity"), F.lit(FOLDED))).alias("parity"))
    d = d.withColumn("a", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")).join(own, "node")
    d = d.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("x", F.least("a", "b")).withColumn("y", F.greatest("a", "b"))
    d = d.repartition("t", "x", "y").sortWithinPartitions("t", "x", "y", "node").select("t", "x", "y", "a", "n", "pos", "node", "label", "parity")
    out = pa_schema(PAIR_SCHEMA)
    return d.mapInArrow(lambda batches: _within(batches, percent, out), PAIR_SCHEMA).distinct()


def _within(batches, percent: int, out: pa.Schema):
    """Pairs inside each run of equal (t, x, y); the last run of a batch waits for the next one."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        key = np.stack([table.column(c).to_numpy() for c in ("t", "x", "y")], 1)
        begin = int(np.flatnonzero((key != key[-1]).any(1))[-1] + 1) if (key != key[-1]).any() else 0
        rest = table.slice(begin)
        yield _compare(table.slice(0, begin), key[:begin], percent, out)
    if rest is not None:
        yield _compare(rest, np.stack([rest.column(c).to_numpy() for c in ("t", "x", "y")], 1), percent, out)


def _compare(table: pa.Table, key: np.ndarray, percent: int, out: pa.Schema) -> pa.RecordBatch:
    rows = len(key)
    if rows < 2:
        return pa.RecordBatch.from_pydict({"u": [], "v": []}, schema=out)
    a, n, pos, node, label = (table.column(c).to_numpy().astype(np.int64) for c in ("a", "n", "pos", "node", "label"))
    parity = _flat(table.column("parity")).view(np.uint64).reshape(rows, -1)  # bitwise_count takes absolute values of signed numbers
    starts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1])
    end = np.repeat(np.concatenate([starts[1:], [rows]]), np.diff(np.concatenate([starts, [rows]])))
    u, v = [], []
    for apart in range(1, int(np.diff(np.concatenate([starts, [rows]])).max())):
        i = np.flatnonzero(np.arange(rows) + apart < end)
        j = i + apart
        both = n[i] + n[j]
        least = percent * both  # (100 + percent) times the overlap that is needed
        ok = (label[i] != label[j]) & ((key[i, 1] == key[i, 2]) | (a[i] != a[j]))
        ok &= ((n[i] - pos[i]) * (100 + percent) >= least) & ((n[j] - pos[j]) * (100 + percent) >= least)
        ok &= np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent
        i, j = i[ok], j[ok]
        if len(i):
            differ = np.bitwise_count(parity[i] ^ parity[j]).sum(1, dtype=np.int64)
            ok = differ * (100 + percent) <= (n[i] + n[j]) * (100 - percent)
            u.append(np.minimum(node[i], node[j])[ok])
            v.append(np.maximum(node[i], node[j])[ok])
    pairs = np.unique(np.stack([np.concatenate([EMPTY, *u]), np.concatenate([EMPTY, *v])], 1), axis=0)
    return pa.RecordBatch.from_pydict({"u": pairs[:, 0], "v": pairs[:, 1]}, schema=out)


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.asarray(c.flatten()) for c in column.chunks])


def _parity(s: np.ndarray) -> np.ndarray:
    """Bit i tells whether an odd number of shingles falls on place i. Two such words of bits differ in no more places than the sets do in shingles.

    Long sets have more bits, two to four for each shingle, for in fewer all places are as often odd as even. Places are the low bits of the
    hash, so laying halves over each other gives what a shorter set has.
    """
    places = 1 << max(PARITY_LOG, (len(s) - 1).bit_length() + 1 if len(s) else 0)
    odd = np.bincount(s.view(np.uint64) & np.uint64(places - 1), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _folded(words, n):
    """Parity words laid over each other until ``n`` are left."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.aggregate(F.sequence(i, F.size(words) - 1, n), F.lit(0).cast("long"), lambda x, j: x.bitwiseXOR(F.get(words, j))))


def _alike(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """u, v, apart: the pairs that may still reach the similarity, by sizes and parity words; an exact bound, so none that does is lost."""
    own = members.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("parity").alias("b"))
    side = lambda k: own.select(F.col("node").alias(k), F.col("n").alias("n" + k), F.col("b").alias("b" + k))
    n = F.least(F.size("bu"), F.size("bv"))
    bu, bv = (F.when(F.size(b) == n, F.col(b)).otherwise(_folded(F.col(b), n)) for b in ("bu", "bv"))
    apart = F.aggregate(F.zip_with(bu, bv, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    # J >= t means that the sets differ in at most (1 - t) / (1 + t) of the sum of their sizes.
    d = pairs.join(side("u"), "u").join(side("v"), "v").filter(_fits(F.col("nu"), F.col("nv"), percent)).withColumn("apart", apart)
    return d.filter(F.col("apart") * (100 + percent) <= (F.col("nu") + F.col("nv")) * (100 - percent)).select("u", "v", "apart")


def _bloom(pairs: DataFrame, members: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over one text (by hash) of each node of ``pairs``; 2^BLOOM_LOG / 8 bytes at most reach the driver."""
    one = members.groupBy("node").agg(F.min("text_hash").alias("x"))
    needed = one.join(pairs.select(F.explode(F.array("u", "v")).alias("node")), "node", "left_semi")
    place = needed.select(F.shiftrightunsigned("x", 64 - BLOOM_LOG).alias("p"))
    rows = place.select(F.shiftright("p", 6).cast("int").alias("w"), F.expr("shiftleft(1L, CAST(p & 63 AS INT))").alias("b")).groupBy("w").agg(F.bit_or("b")).collect()
    out = np.zeros(1 << (BLOOM_LOG - 6), np.int64)
    if rows:
        out[[r[0] for r in rows]] = [r[1] for r in rows]
    return out


def _in_bloom(bloom: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes.view(np.uint64) >> np.uint64(64 - BLOOM_LOG)
    return (bloom.view(np.uint64)[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def _clashes(members: DataFrame) -> dict[tuple[int, int], int]:
    """New numbers of the sets that differ in 128 bits but not in the first 64: of 10^10 sets about three pairs do."""
    both = members.filter("n > 0").groupBy("node").agg(F.min("other").alias("least"), F.max("other").alias("most")).filter("least <> most")
    found = sorted((r[0], r[1]) for r in both.join(members, "node").select("node", "other").distinct().collect())
    return {x: xxhash.xxh3_64_intdigest(repr(x)) - (1 << 63) for x in found}


def _verify(texts: DataFrame, pairs: DataFrame, members: DataFrame, percent: int, renamed: dict[tuple[int, int], int]) -> DataFrame:
    """u, v, linked: whole sets of the pairs' nodes, made again from the texts, are compared. Texts that no pair needs are not shingled."""
    bloom = _bloom(pairs, members)

    def setup():
        hashes = _WordHash()

        def f(b: pa.RecordBatch) -> dict:
            needed = b.filter(pa.array(_in_bloom(bloom, b.column("text_hash").to_numpy())))
            sets = [shingles(t, hashes) for t in texts_of(needed)]
            return {"node": [_node(s, renamed) for s in sets], "s": sets}

        return f

    sets = map_text(texts, None, "node long, s array<long>", setup).groupBy("node").agg(F.first("s").alias("s"))
    one = pairs.join(sets.select(F.col("node").alias("u"), F.col("s").alias("su")), "u")
    both = one.join(sets.select(F.col("node").alias("v"), F.col("s").alias("sv")), "v")
    common = F.size(F.array_intersect("su", "sv"))
    return both.select("u", "v", (common * 100 >= (F.size("su") + F.size("sv") - common) * percent).alias("linked"))


def _answer(members: DataFrame, label: DataFrame) -> DataFrame:
    info = members.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    named = _labelled(info, "node", label)
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    by_node = named.join(smallest, "label").select("node", "component_id")
    d = members.join(by_node, "node", "left")
    return d.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_per_group(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of every component, all columns kept, whatever their names and types are: the one with the smallest id (null last), then with the smallest number.

    Rows are numbered and written first, so repeated ids, null ids and rows that differ in any column are told apart. A wordless row is a component of its own and stays.
    """
    row = fresh_name(docs, "row")
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()))
    members, label = _groups(numbered.select("doc_id", "text", F.col(row).alias("row")), percent)
    named = _labelled(members.filter("n > 0").select("doc_id", "node", "row"), "node", label)
    first = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))["row"].alias(row))
    keep = first.select(row).unionByName(members.filter("n = 0").select(F.col("row").alias(row)))
    return numbered.join(keep, row, "left_semi").drop(row)
