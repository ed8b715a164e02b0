"""Nearest neighbours by an index of buckets: random hyperplanes give each vector a bucket in every table, and only the vectors of a query's buckets are compared with it, exactly.

Equal vectors are one from the start (with their k + 1 smallest ids), so a vector that very many rows share is one entry. A bucket of more than BLOCK vectors is dealt over blocks, each of which meets the bucket's queries.
Base rows are shuffled once for each table, however many queries there are.

Defined cases: rows without a vector are left out; a query is not its own neighbour; ties of distance go to the smaller id; fewer than k rows give fewer neighbours; an empty side gives none.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise
from .batched import matrix_of

TABLES, PROBES, BUCKET, BLOCK = 12, 4, 256, 4096


def _buckets(centre: np.ndarray, planes: np.ndarray, probes: int):
    """(Arrow batches of id, v, ids) -> a row of each table and probed bucket."""
    tables, bits = planes.shape[0], planes.shape[1]
    out = pa.schema([("table", pa.int32()), ("bucket", pa.int64()), ("id", pa.int64()), ("v", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            x = matrix_of(b.column("v")) - centre if b.num_rows else np.zeros((0, len(centre)))
            for t in range(tables) if len(x) else ():
                side = x @ planes[t].T if bits else np.zeros((len(x), 0))
                own = (side > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(x), np.int64)
                near = np.argsort(np.abs(side), 1)[:, :probes]
                for flip in range(-1, near.shape[1]):  # the own bucket, and those behind the nearest planes
                    at = own if flip < 0 else own ^ (np.int64(1) << near[:, flip])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t), pa.int32()), pa.array(at), b.column("id"), b.column("v"), b.column("ids")], schema=out)

    return run


_ROW = "table int, bucket long, id long, v array<double>, ids array<long>"


def knn_by_buckets(queries: DataFrame, base: DataFrame, query_id: str, base_id: str, vec: str, k: int = 3, tables: int = TABLES, probes: int = PROBES, bucket: int = BUCKET, seed: int = 0) -> DataFrame:
    """query_id, rank, base_id, d2: nearest base rows by squared distance among those that share a bucket with the query."""
    own = lambda d, key: d.filter(F.col(vec).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    same = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    entries = own(base, base_id).withColumn("r", same).filter(F.col("r") <= k + 1)  # the limit is applied before the shuffle too
    entries = materialise(entries.groupBy("v").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids")).select("id", "v", "ids"))
    n, first = entries.count(), entries.first()
    if first is None:
        return base.sparkSession.createDataFrame([], "query_id long, rank int, base_id long, d2 double")
    bits, p = max(0, int(np.ceil(np.log2(max(1, n / bucket))))), len(first.v)
    rng = np.random.default_rng(seed)
    planes = rng.normal(size=(tables, bits, p))
    sums = entries.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).collect()  # one row a coordinate
    centre = np.array([r.m for r in sorted(sums, key=lambda r: r.i)])
    filed = entries.mapInArrow(_buckets(centre, planes, 0), _ROW)
    asked = own(queries, query_id).withColumn("ids", F.array("id")).mapInArrow(_buckets(centre, planes, min(probes, bits)), _ROW)
    # Filed rows are TABLES times the base and quickly made: they are made twice, for the counts and for the comparison, rather than kept.
    blocks = materialise(filed.groupBy("table", "bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1"))
    dealt = lambda d: d.join(blocks, ["table", "bucket"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    right = dealt(filed).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    left = dealt(asked).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            y, ids = np.stack(b["v"].to_numpy()), b["ids"].to_numpy()
            for i, x in zip(a["id"], a["v"]):
                d2 = ((y - np.asarray(x)) ** 2).sum(1)
                found = [(float(d2[j]), int(m)) for j in np.argpartition(d2, min(k, len(d2) - 1))[: k + 1] for m in ids[j] if m != i]
                # Ties at the border count as well.
                edge = max(d for d, _ in found) if found else np.inf
                found += [(float(d2[j]), int(m)) for j in np.flatnonzero(d2 == edge) for m in ids[j] if m != i]
                out += [(int(i), m, d) for d, m in sorted(set(found))[:k]]
        return pd.DataFrame(out, columns=["query_id", "base_id", "d2"])

    keys = ["table", "bucket", "block"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest, "query_id long, base_id long, d2 double").distinct()
    r = F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "base_id"))
    return near.withColumn("rank", r).filter(F.col("rank") <= k).select("query_id", "rank", "base_id", "d2")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of the exact neighbours that were found."""
    hit = exact.select("query_id", "base_id").join(found.select("query_id", "base_id", F.lit(1).alias("hit")), ["query_id", "base_id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))


def standardised(df: DataFrame, cols: Sequence[str], centre: Sequence[float], mean: Sequence[float], sd: Sequence[float], name: str = "v") -> DataFrame:
    """``name``: the columns as a vector, unknown values filled by ``centre``."""
    return df.withColumn(name, F.array(*((F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(float(f))) - float(m)) / float(s) for c, f, m, s in zip(cols, centre, mean, sd))))
