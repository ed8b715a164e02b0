"""Best-two-fit packing of token sequences.

Documents are cut into pieces of at most ``capacity`` tokens in one pass over the texts. Pieces are dealt evenly into groups of
about ``GROUP`` by a hash; inside a group each bin is filled greedily, largest piece first, and then its smallest
piece gives way to the two unpacked ones that fill the widened gap best. A group wastes about one bin.

Defined cases: null text is empty (one token, the final id 0); repeated rows are packed each on its own; ties go by crc, piece and id, so equal rows
are interchangeable; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32, map_text, materialise, pa_schema, texts_of
from .tokens import TokenCache, tokenizer_path

GROUP = 32_768
SPECIAL = {"<|endoftext|>": 50256}  # as the vocabulary's own file says (fixed value)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens; only the first may be shorter."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *((s, capacity) for s in range(first, n, capacity))]


def _pieces(path: str, capacity: int, keep_ids: bool):
    def setup():
        cache, dealt = TokenCache(path, SPECIAL), 0

        def f(batch: pa.RecordBatch) -> dict:
            nonlocal dealt
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "salt", *(["ids"] if keep_ids else []))}
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                ids = cache.encode(text) + b"\0\0\0\0"
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    for name, x in (("doc_id", doc), ("piece", k), ("start", start), ("length", length), ("ids_crc32", crc32(own)), ("salt", dealt)):
                        out[name].append(x)
                    if keep_ids:
                        out["ids"].append(np.frombuffer(own, "<u4").tolist())
                    dealt += 1
            return out

        return f

    return setup


def best_two_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins as lists of indices into ``lengths``."""
    stock: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        stock.setdefault(int(lengths[i]), []).append(i)
    sizes, bins = sorted(stock), []

    def take(size: int) -> int:
        i = stock[size].pop()
        if not stock[size]:
            del stock[size]
            sizes.remove(size)
        return i

    def give(size: int, i: int) -> None:
        if size not in stock:
            insort(sizes, size)
        stock.setdefault(size, []).append(i)

    while sizes:
        gap, own = capacity, []
        while sizes and (k := bisect_right(sizes, gap)):
            size = sizes[k - 1]
            own.append((size, take(size)))
            gap -= size
        if gap and len(own) > 1:
            smallest, i = own[-1]
            pair = _best_pair(sizes, stock, gap + smallest)
            if pair and sum(pair) > smallest:
                own.pop()
                own += [(s, take(s)) for s in pair]
                give(smallest, i)
        bins.append([i for _, i in own])
    return bins


def _best_pair(sizes: list[int], stock: dict[int, list[int]], room: int) -> tuple[int, int] | None:
    """The two pieces whose sum is largest within ``room``, by two pointers over the distinct sizes."""
    low, high, best, at = 0, bisect_right(sizes, room) - 1, 0, None
    while low <= high:
        a, b = sizes[low], sizes[high]
        if a + b > room:
            high -= 1
            continue
        if a + b > best and (low < high or len(stock[a]) > 1):
            best, at = a + b, (b, a)
            if best == room:
                break
        low += 1
    return at


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", capacity: int = 2048, group: int = GROUP, keep_ids: bool = False) -> DataFrame:
    """One row per piece with its sequence and place; ``keep_ids`` adds the ids themselves."""
    extra = ", ids array<long>" if keep_ids else ""
    pieces = materialise(map_text(docs.select("doc_id", "text"), None, PIECES + extra, _pieces(tokenizer_path(vocabulary), capacity, keep_ids)))
    groups = max(1, round(pieces.filter(F.col("length") < capacity).count() / group))
    full = pieces.filter(F.col("length") == capacity)
    rest = pieces.filter(F.col("length") < capacity).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "ids_crc32", "salt"), F.lit(groups)).cast("int"))
    names = [f.split()[0] for f in PACKED.split(", ")]

    def bins(key: tuple, t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.lexsort([*(t.column(c).fill_null(-1).to_numpy() for c in ("doc_id", "piece", "ids_crc32", "length"))])))
        length = t.column("length").to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for k, own in enumerate(best_two_fit(length, capacity)):
            sequence[own] = key[0].as_py() + groups * k
            offset[own] = np.concatenate([[0], np.cumsum(length[own])[:-1]])
        t = t.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        return t.select(out.names).cast(out)

    schema = PACKED + extra
    out = pa_schema(schema)
    packed = rest.groupBy("bucket").applyInArrow(bins, schema)
    # Full pieces have sequences of their own; negative numbers keep them apart from the packed ones.
    alone = full.select(*names[:5], (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *(["ids"] if keep_ids else []))
    return packed.unionByName(alone)
