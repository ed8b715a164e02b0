"""Trie of conversation prefixes, by hashes of blocks of BLOCK turns.

Conversations are grouped by the digests of successive blocks first: a block is known by the digest of the blocks before it and its own. Equal blocks
after equal blocks become one row with a count. Where a digest has one continuation only, the turns inside that block are nodes with the block's members. Where
siblings diverge, and only there, the prefixes of the different blocks are hashed turn by turn and grouped. A digest is the XOR of 128-bit hashes of (place,
turns of the block), so that of a long conversation comes from range partitions and their offsets, never from one task.

Sums over subtrees need no walk of the tree. A conversation owns the nodes of which it is the smallest member; those are an end of its path. So the turns of all nodes below one are the
path of its smallest member and what its other members own, and each leaf belongs to the conversation that owns it.

Defined cases: a row of null conv_id belongs to no conversation; null roles and texts are empty; rows with equal conv_id and turn are ordered by the hash of role and text, repeated rows are
turns of their own; a conversation without turns ends at the root; very long texts are only hashed; extra columns are ignored; an empty table gives no nodes.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.shape import running_totals
from .common import materialise, pa_schema

BLOCK = 4
MOST_OPENING = 5  # turns that conversations of a hundred may share
CHUNK = 1024  # conversation ids that travel together
_ID, _PARENT = ["id1", "id2"], ["p1", "p2"]
_SET = [*_PARENT, "k", "d1", "d2"]


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, i (place, from 0), h1, h2 (hash of role and text), chars."""
    turn = [F.coalesce(c, F.lit("")) for c in ("role", "text")]
    t = conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", *(F.xxhash64(F.lit(s), *turn).alias(f"h{s}") for s in (1, 2)), F.length(turn[1]).cast("long").alias("chars"), F.lit(1).alias("one"))
    t = materialise(running_totals(t, ["conv_id", "turn", "h1", "h2"], ["one"]).select("conv_id", "h1", "h2", "chars", F.col("one_before").alias("place")))
    first = t.groupBy("conv_id").agg(F.min("place").alias("first"))
    return t.join(first, "conv_id").select("conv_id", (F.col("place") - F.col("first")).alias("i"), "h1", "h2", "chars")


def with_shared_openings(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of conversations that take their first turns (a hash of the id tells how many) from the first one of their hundred; and conv_id, turns of all."""
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    id_ = F.col("conv_id")
    c = own.select("conv_id", "n", (id_ - id_ % 100).alias("base"), (F.crc32(id_.cast("string").cast("binary")) % (MOST_OPENING + 1)).alias("h"))
    c = c.join(own.filter(id_ % 100 == 0).select(id_.alias("base"), F.col("n").alias("there")), "base", "left")
    c = materialise(c.withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))).withColumn("turns", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    rest = turns.join(c.select("conv_id", "h", "taken", "turns"), "conv_id").filter("i >= h").withColumn("i", F.col("i") - F.col("h") + F.col("taken"))
    opening = turns.filter((id_ % 100 == 0) & (F.col("i") < MOST_OPENING)).withColumnRenamed("conv_id", "base")
    taken = c.select("conv_id", "base", "h", "turns").join(opening, "base").filter("i < h")
    cols = ("conv_id", "i", "h1", "h2", "chars", "turns")
    return rest.select(*cols).unionByName(taken.select(*cols)), c.select("conv_id", "turns")


def _digest(seed: int, n: Column) -> Column:
    """64 bits of the place of the block and its first ``n`` turns."""
    return F.xxhash64(F.lit(seed), F.col("k"), F.slice("a1", 1, n), F.slice("a2", 1, n))


def _blocks(turns: DataFrame) -> DataFrame:
    """A row of each block of each conversation: p1, p2 (digest and chars, before, of the blocks before), k, d1, d2 (own digest), a1, a2, lengths (of its turns), chars, ends (the last one)."""
    d = turns.withColumn("k", F.floor(F.col("i") / BLOCK)).groupBy("conv_id", "k").agg(F.sort_array(F.collect_list(F.struct("i", "h1", "h2", "chars"))).alias("t"), F.first("turns").alias("turns"))
    part = lambda c: F.transform("t", lambda x: x[c])
    d = d.select("conv_id", "k", part("h1").alias("a1"), part("h2").alias("a2"), part("chars").alias("lengths"), (F.floor((F.col("turns") - 1) / BLOCK) == F.col("k")).alias("ends"))
    d = d.withColumns({"d1": _digest(1, F.size("a1")), "d2": _digest(2, F.size("a1")), "chars": F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)})
    # Running digests: a window for each conversation and range, and the offsets of those that lie in several ranges.
    d = materialise(d.repartitionByRange("conv_id", "k").withColumn("range", F.spark_partition_id()))
    own = d.groupBy("conv_id", "range").agg(F.bit_xor("d1").alias("x1"), F.bit_xor("d2").alias("x2"), F.sum("chars").alias("xc"))
    ahead = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = own.select("conv_id", "range", F.bit_xor("x1").over(ahead).alias("o1"), F.bit_xor("x2").over(ahead).alias("o2"), F.sum("xc").over(ahead).alias("oc")).filter("oc IS NOT NULL")
    before = Window.partitionBy("conv_id", "range").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    d = d.withColumns({"w1": F.bit_xor("d1").over(before), "w2": F.bit_xor("d2").over(before), "wc": F.sum("chars").over(before)}).join(ahead, ["conv_id", "range"], "left")
    d = d.withColumns({"p1": zero("w1").bitwiseXOR(zero("o1")), "p2": zero("w2").bitwiseXOR(zero("o2")), "before": zero("wc") + zero("oc")})
    return materialise(d.select("conv_id", *_SET, "before", "a1", "a2", "lengths", "chars", "ends"))


def _nodes(sets: DataFrame, sums: list[str]) -> DataFrame:
    """id1, id2, p1, p2 (of the parent), depth, chars, before, n, m, ends and ``sums`` of every node but the root, from the different blocks."""
    size = F.size("a1")
    turn = F.transform(F.sequence(F.lit(1), size), lambda t: F.struct(t.alias("t"), _digest(1, t).alias("g1"), _digest(2, t).alias("g2")))
    d = sets.withColumn("turn", turn).select(*_PARENT, "k", "several", "lengths", "before", "n", "m", "ends", *sums, "turn", F.explode("turn").alias("x"))
    t, up = F.col("x.t"), F.get("turn", F.col("x.t") - 2)
    node = [F.col(p).bitwiseXOR(F.col(f"x.g{s}")).alias(f"id{s}") for s, p in enumerate(_PARENT, 1)]
    parent = [F.col(p).bitwiseXOR(F.coalesce(up[f"g{s}"], F.lit(0).cast("long"))).alias(p) for s, p in enumerate(_PARENT, 1)]
    before = F.col("before") + F.aggregate(F.slice("lengths", 1, t - 1), F.lit(0).cast("long"), lambda a, x: a + x)
    ends = F.when(t == F.size("turn"), F.col("ends")).otherwise(0)
    d = d.select("several", *node, *parent, (F.col("k") * BLOCK + t).alias("depth"), F.get("lengths", t - 1).alias("chars"), before.alias("before"), "n", "m", ends.alias("ends"), *sums)
    one = ["depth", "chars", "before"]  # the same for all rows of a node
    refined = d.filter("several").groupBy(*_ID, *_PARENT, *one).agg(F.sum("n").alias("n"), F.min("m").alias("m"), F.sum("ends").alias("ends"), *(F.sum(s).alias(s) for s in sums))
    return d.filter("NOT several").drop("several").unionByName(refined)


def _with_root(nodes: DataFrame, members: DataFrame, sums: list[str]) -> DataFrame:
    """``nodes`` and the root; ``members``: conv_id, turns and ``sums`` of every conversation."""
    root = members.agg(F.count("*").alias("n"), F.min("conv_id").alias("m"), F.coalesce(F.count_if(F.expr("turns = 0")), F.lit(0)).alias("ends"), *(F.sum(s).alias(s) for s in sums)).filter("n > 0")
    none = F.lit(0).cast("long")
    return nodes.unionByName(root.select(*(none.alias(c) for c in (*_ID, "depth", "chars", "before")), *(F.lit(None).cast("long").alias(c) for c in _PARENT), "n", "m", "ends", *sums))


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """A row of each node. ``turns``: conv_id, i, h1, h2, chars, turns (their number) of the conversations; ``members``: conv_id and turns of all of them."""
    rows, members = _blocks(turns), materialise(members)
    sets = rows.groupBy(*_SET).agg(F.count("*").alias("n"), F.min("conv_id").alias("m"), F.count_if("ends").alias("ends"), *(F.first(c).alias(c) for c in ("a1", "a2", "lengths", "before")))
    sets = materialise(sets)
    sets = sets.join(sets.groupBy(*_PARENT).agg((F.count("*") > 1).alias("several")), _PARENT)
    owned = _with_root(_nodes(sets, []), members, []).groupBy(F.col("m").alias("conv_id")).agg(F.sum("chars").alias("owned"), F.count_if(F.expr("n = ends")).alias("leaves"))
    path = rows.groupBy("conv_id").agg(F.sum("chars").alias("path"))
    sums = ["path", "owned", "leaves"]
    of = members.join(path, "conv_id", "left").join(owned, "conv_id", "left").select("conv_id", "turns", *(F.coalesce(s, F.lit(0)).alias(s) for s in sums))
    of = materialise(of)
    of_sets = rows.select("conv_id", *_SET).join(of.drop("turns"), "conv_id").groupBy(*_SET).agg(*(F.sum(s).alias(s) for s in sums))
    nodes = materialise(_with_root(_nodes(sets.join(of_sets, _SET), sums), of, sums))
    smallest = of.select(F.col("conv_id").alias("m"), F.col("path").alias("m_path"), F.col("owned").alias("m_owned"))
    children = nodes.filter("p1 IS NOT NULL").groupBy(F.col("p1").alias("id1"), F.col("p2").alias("id2")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("id1").alias("p1"), F.col("id2").alias("p2"), F.col("m").alias("parent_conv_id"))
    last = rows.filter("ends").select("conv_id", F.col("p1").bitwiseXOR(F.col("d1")).alias("id1"), F.col("p2").bitwiseXOR(F.col("d2")).alias("id2"))
    none = F.lit(0).cast("long")
    digests = _ends(last.unionByName(members.filter("turns = 0").select("conv_id", none.alias("id1"), none.alias("id2"))))
    d = nodes.join(smallest, "m").join(children, _ID, "left").join(parents, _PARENT, "left").join(digests, _ID, "left")
    below = F.col("owned") - F.col("m_owned") + F.col("m_path") - F.col("before")  # chars of the different nodes
    return d.select(
        F.col("m").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("path") - F.col("n") * F.col("before") - below).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


_PIECE = "id1 long, id2 long, low long, ids string, ends_sha256 string"


def _ends(last: DataFrame) -> DataFrame:
    """id1, id2, ends_sha256: the hash of the ids of the conversations that end at a node, in order.

    Ranges of (node, conversation) give the hash of every node that lies inside of one range; the others, of which a range has two, send their ids in chunks, so a node at which very many end is
    read as a stream by one task, for a hash has no other way, but is never held there.
    """
    out = pa_schema(_PIECE)

    def ranges(batches):
        node, ids, open_ = None, [], True  # the first node may have begun before
        made: list[tuple] = []

        def chunk():
            made.append((*node, ids[0], ",".join(map(str, ids)), None))
            ids.clear()

        for batch in batches:
            for a, b, c in zip(*(batch.column(x).to_pylist() for x in (*_ID, "conv_id"))):
                if (a, b) != node:
                    if node is not None and open_ and ids:
                        chunk()
                    elif node is not None and not open_:
                        made.append((*node, None, None, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
                    open_ = node is None
                    node, ids = (a, b), []
                ids.append(c)
                if len(ids) >= CHUNK:
                    open_ = True
                    chunk()
            yield pa.RecordBatch.from_pylist([dict(zip(out.names, m)) for m in made], schema=out)
            made.clear()
        if node is not None and ids:
            chunk()  # the last node may go on behind
        yield pa.RecordBatch.from_pylist([dict(zip(out.names, m)) for m in made], schema=out)

    found = materialise(last.repartitionByRange(*_ID, "conv_id").sortWithinPartitions(*_ID, "conv_id").mapInArrow(ranges, _PIECE))
    whole = "id1 long, id2 long, ends_sha256 string"
    schema = pa_schema(whole)

    def joined(batches):
        node, state = None, None
        for batch in batches:
            made = []
            for a, b, ids in zip(*(batch.column(x).to_pylist() for x in (*_ID, "ids"))):
                if (a, b) != node:
                    if node is not None:
                        made.append((*node, state.hexdigest()))
                    node, state = (a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, m)) for m in made], schema=schema)
        if node is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*node, state.hexdigest())))], schema=schema)

    pieces = found.filter("ids IS NOT NULL").select(*_ID, "low", "ids").repartition(*_ID).sortWithinPartitions(*_ID, "low")
    return found.filter("ids IS NULL").select(*_ID, "ends_sha256").unionByName(pieces.mapInArrow(joined, whole))
