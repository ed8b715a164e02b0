"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (law ``bytes``).

Every shard owns ``VNODES`` points of a ring of hash values; a document belongs to the shard whose point comes next
clockwise. A shard takes at most ``(1 + SLACK)`` of the mean bytes; what overflows continues clockwise to the next shard with room.
Documents of over ``1/GRAIN`` of a shard's mean (at most shards * GRAIN by arithmetic) are placed one by one; the others flow by
the running sum of bytes within their arc, for which only the sums per arc are needed (shards * VNODES rows). DataFrame
functions do all work on documents; the driver plans over those bounded sums alone.

Defined cases: null text has 0 bytes; repeated rows are placed each on its own; rows of null ``doc_id`` are spread over the ring by their place in the table;
the text's crc is hashed with the id; copies of a text under other ids may lie in other shards; very long texts are sizes like others; extra columns are ignored, whatever their names are; an empty table gives an empty one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

VNODES, SLACK, GRAIN, OVERHEAD, CELL_BITS = 128, 0.0005, 64, 16, 12
ORDER = ("h", "key", "text_crc32")
LAW = "bytes"


def ring(spark, shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(hash, shard) of every virtual node, by hash."""
    nodes = spark.range(shards).select("id", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("v"))
    return sorted((r[0], r[1]) for r in nodes.select(F.xxhash64("id", "v", F.lit("ring")), "id").collect())


def arc_table(spark, bounds: list[int]) -> DataFrame:
    """For each equal cell of the hash space its points and the next one after it, as (point, arc)."""
    cells, rows = 1 << CELL_BITS, []
    for cell in range(-cells // 2, cells // 2):
        low, high = cell << (64 - CELL_BITS), (cell + 1) << (64 - CELL_BITS)
        inside = range(bisect_left(bounds, low), bisect_left(bounds, high) + 1)
        rows.append((cell, [((bounds[i] if i < len(bounds) else (1 << 63) - 1), i % len(bounds)) for i in inside]))
    return spark.createDataFrame(rows, "cell long, points array<struct<point:bigint,arc:int>>")


def plan(owner: list[int], large: list[tuple[int, int]], small: dict[int, int], shards: int, cap: float) -> tuple[list[int], dict[int, list[tuple[int, int]]]]:
    """Walk the ring once. ``large``: (arc, bytes) in ring order; ``small``: bytes per arc.

    Returns the shard of each large one, and per arc the (bytes until, shard) cuts of its flow.
    """
    load = [0.0] * shards

    def clockwise(arc: int, need: float) -> int:
        """First shard clockwise with room for ``need``; the least loaded if none has."""
        seen: set[int] = set()
        for k in range(len(owner)):
            s = owner[(arc + k) % len(owner)]
            if s not in seen:
                if load[s] + need <= cap:
                    return s
                seen.add(s)
                if len(seen) == shards:
                    break
        return min(range(shards), key=lambda s: (load[s], s))

    places = [0] * len(large)
    for i in sorted(range(len(large)), key=lambda i: (-large[i][1], i)):  # the largest first, so that the last ones fit
        arc, size = large[i]
        places[i] = clockwise(arc, size)
        load[places[i]] += size
    cuts: dict[int, list[tuple[int, int]]] = {}
    for arc in sorted(small):
        done, rest = 0, small[arc]
        while rest > 0:
            s = clockwise(arc, min(rest, 1))
            part = min(rest, max(1, int(cap - load[s])))
            load[s] += part
            done, rest = done + part, rest - part
            cuts.setdefault(arc, []).append((done, s))
    return places, cuts


def ring_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: this law depends on loads)."""
    spark = docs.sparkSession
    points = ring(spark, shards)
    bounds, owner = [p for p, _ in points], [s for _, s in points]
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    d = docs.select("doc_id", (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    # Rows without an id have their place in the table as a key, or equal ones among them would be one place of the ring.
    d = d.withColumn("key", F.coalesce("doc_id", -1 - F.monotonically_increasing_id())).withColumn("h", F.xxhash64("key", "text_crc32", F.lit("key")))
    d = d.withColumn("cell", F.shiftright("h", 64 - CELL_BITS)).join(F.broadcast(arc_table(spark, bounds)), "cell")  # 2^CELL_BITS rows
    d = materialise(d.withColumn("arc", F.get(F.filter("points", lambda p: p["point"] >= F.col("h")), F.lit(0))["arc"]).drop("cell", "points"))
    total = d.agg(F.sum("size")).first()[0] or 0
    d = d.withColumn("large", F.col("size") > total / (shards * GRAIN))
    # Fewer than shards * GRAIN rows: together they hold at most the total.
    big = sorted(map(tuple, d.filter("large").select("arc", *ORDER, "size").collect()))
    sums = {r[0]: r[1] for r in d.filter("NOT large").groupBy("arc").agg(F.sum("size")).collect()}
    places, cuts = plan(owner, [(b[0], b[-1]) for b in big], sums, shards, total / shards * (1 + SLACK) + 1)
    told, ranks = [], Counter()
    for (arc, *_), s in zip(big, places):
        ranks[arc] += 1
        told.append((arc, True, ranks[arc], s))
    told += [(arc, False, until, s) for arc, parts in cuts.items() for until, s in parts]
    table = spark.createDataFrame(told, "arc int, large boolean, until long, shard int").groupBy("arc", "large").agg(F.sort_array(F.collect_list(F.struct("until", "shard"))).alias("cuts"))
    by_ring = Window.partitionBy("arc", "large").orderBy(*ORDER, "size")
    at = F.when(F.col("large"), F.row_number().over(by_ring).cast("long")).otherwise(F.sum("size").over(by_ring.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("at", at).join(F.broadcast(table), ["arc", "large"])  # at most shards * (VNODES * 2 + GRAIN) cuts
    d = d.withColumn("shard", F.get(F.filter("cuts", lambda c: c["until"] >= F.col("at")), F.lit(0))["shard"])
    return _slots(d).select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _slots(d: DataFrame) -> DataFrame:
    """Gapless numbers within a shard: ranks within (shard, arc) plus the counts of the arcs before."""
    counts = d.groupBy("shard", "arc").count()
    ahead = counts.withColumn("ahead", F.sum("count").over(Window.partitionBy("shard").orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = d.withColumn("r", F.row_number().over(Window.partitionBy("shard", "arc").orderBy(*ORDER, "size")))
    return ranked.join(ahead.select("shard", "arc", F.coalesce("ahead", F.lit(0)).alias("ahead")), ["shard", "arc"]).withColumn("slot", (F.col("ahead") + F.col("r") - 1).cast("long"))
