"""Line dedup by the suffix order of all lines, with intervals of the longest common prefix.

All documents, in the order (doc_id, text hash), are one sequence of line numbers with a gap after each document. Prefix doubling sorts the suffixes:
round r ranks the blocks of 2^r lines by the pair of ranks of their halves. A rank is the place at which the block's suffixes begin in the
suffix order, so a rank and its number of copies are an interval of suffixes whose common prefix is 2^r lines or longer. Blocks that occur once
drop out, as in the construction with discarding. Going down from the largest blocks, every interval is then refined to the exact common prefixes: its
suffixes are split by the next smaller block behind the prefix. Suffixes that share that block with an earlier one of the interval move on
to the longer prefix; the first of each such class stays and stands for its class. So each suffix ends in the deepest interval that
holds an earlier one, which is its longest earlier copy. Copies of at least ``min_words`` words are deleted; the first copy stays.

A rank, class or row that is very frequent is dealt over SALTS tasks; only those (at most HOT of them) are broadcast. No group is collected.

Defined cases: null text has no lines and is unchanged; repeated rows with equal id and text are
one document and stay alike; a document of which nothing is left gets the text ''; extra columns are kept, whatever their names are, but an
``n_removed`` that is there already is replaced; very long texts are arrays of one row in the first pass only; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.shape import running_totals
from .common import map_text, materialise, slices, texts_of

MIN_WORDS = 20
MOST_ROUNDS = 40
HOT, SALTS, LEAST = 4096, 64, 1000


def _lines(batch: pa.RecordBatch) -> dict:
    """Per document the 128-bit numbers of its lines and the words up to the end of each."""
    high, low, words = [], [], []
    for text in texts_of(batch):
        lines = text.encode().split(b"\n")
        number = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), ">i8").reshape(-1, 2).astype(np.int64)
        high.append(number[:, 0])
        low.append(number[:, 1])
        words.append(np.cumsum([len(line.split()) for line in lines], dtype=np.int32))
    return {"k": batch.column("k"), "v": batch.column("v"), "high": high, "low": low, "words": words}


def _units(docs: DataFrame) -> DataFrame:
    """Distinct documents: k, v, rows, b (place of the first line in the whole sequence), their lines, and n_total places."""
    keyed = docs.select(_key().alias("k"), _text_hash().alias("v"), "text").filter("text IS NOT NULL")
    d = map_text(keyed, _lines, "k long, v long, high array<long>, low array<long>, words array<int>")
    d = d.groupBy("k", "v").agg(F.count("*").alias("rows"), *(F.first(c).alias(c) for c in ("high", "low", "words"))).withColumn("n", F.size("high").cast("long") + 1)
    return materialise(running_totals(d, ["k", "v"], ["n"]).select("k", "v", "rows", F.col("n_before").alias("b"), "n_total", "high", "low", "words"))


def _joined(rows: DataFrame, names: DataFrame, keys: list[str], copies: str, limit: int, how: str, hint: str | None = None) -> DataFrame:
    """``rows`` with the columns of ``names``. A key that more than ``limit`` rows have, or none, is dealt over SALTS tasks by ``id``."""
    hot = names.filter(F.col(copies) > limit).select(*keys, F.lit(True).alias("hot"))  # all copies together are rows, so at most HOT keys
    ways = F.when(F.col(copies) > limit, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = F.coalesce("hot", F.lit(False)) | F.col(keys[-1]).isNull()
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn("salt", F.when(dealt, F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    ways = names.withColumn("salt", F.explode(ways))
    return salted.join(ways.hint(hint) if hint else ways, [*keys, "salt"], how).drop("salt")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """k (doc_id, null as the smallest long), v (hash of the text), rows, runs: array<struct<s,e>> of the lines to delete (e exclusive)."""
    units = _units(docs)
    found = _longest_copies(*_suffix_order(units)).filter(F.col("c1") - F.col("c0") >= min_words)
    found = found.select("b", (F.col("id") - F.col("b")).cast("int").alias("s"), (F.col("id") - F.col("b") + F.col("n")).cast("int").alias("e"))
    chain = Window.partitionBy("b").orderBy("s", "e")
    before = F.max("e").over(chain.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("before", before).withColumn("run", F.sum(F.when(F.col("s") <= F.col("before"), 0).otherwise(1)).over(chain))
    runs = runs.groupBy("b", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    runs = runs.groupBy("b").agg(F.collect_list(F.struct("s", "e")).alias("runs"))  # of one document
    return units.select("b", "k", "v", "rows").join(runs, "b").select("k", "v", "rows", "runs")


def _suffix_order(units: DataFrame) -> tuple[list[DataFrame], int]:
    """For each r the suffixes whose block of 2^r lines occurs more than once: b, id, name (rank of the block), first, copies, c0 and c1 (words
    before and up to its end); ``longer``: whether the block of 2^(r + 1) has an earlier copy."""
    places = units.select("n_total").limit(1).collect()
    limit = max(LEAST, places[0][0] // HOT) if places else LEAST
    line = units.select("b", "words", F.posexplode(F.arrays_zip("high", "low")).alias("pos", "x"))
    before = F.coalesce(F.get("words", F.col("pos") - 1), F.lit(0))
    line = line.select("b", (F.col("b") + F.col("pos")).alias("id"), "x.*", before.alias("c0"), F.get("words", F.col("pos")).alias("c1"))
    level, levels = _ranked(line, ["high", "low"], limit, "inner"), []
    level = materialise(level.select("b", "id", "name", "first", "copies", "c0", "c1"))
    for r in range(MOST_ROUNDS):
        at = Window.partitionBy("b").orderBy("id").rangeBetween(1 << r, 1 << r)
        pair = level.withColumnsRenamed({"name": "half", "first": "first_", "copies": "copies_"}).withColumn("next", F.max("half").over(at)).withColumn("end", F.max("c1").over(at))
        d = materialise(_ranked(pair, ["half", "next"], limit, "left"))
        levels.append(d.select("b", "id", F.col("half").alias("name"), F.col("first_").alias("first"), F.col("copies_").alias("copies"), "c0", "c1", F.coalesce(F.col("first") < F.col("id"), F.lit(False)).alias("longer")))
        level = d.filter("name IS NOT NULL").select("b", "id", "name", "first", "copies", "c0", F.col("end").alias("c1"))
        if level.isEmpty():
            break
    return levels, limit


def _ranked(rows: DataFrame, keys: list[str], limit: int, how: str) -> DataFrame:
    """``rows`` with name, first and copies of their keys, where these are there more than once: name is the number of suffixes with smaller keys."""
    known = rows.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    n = known.groupBy(*keys).agg(F.min("id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    names = running_totals(n, keys, ["copies"]).select(*keys, "first", "copies", F.col("copies_before").alias("name"))
    return _joined(rows, names, keys, "copies", limit, how)


def _longest_copies(levels: list[DataFrame], limit: int) -> DataFrame:
    """b, id, n, c0, c1: the n lines from each place that some earlier place repeats, as many as possible.

    (g, n) names an interval of suffixes with n equal lines. ``searching`` suffixes look for a longer copy; the first of an interval is there for the
    others only. ``most`` bounds the size of the interval, to drop that one when nobody else is left.
    """
    state: DataFrame | None = None
    for r in range(len(levels) - 1, -1, -1):
        own = levels[r]
        earlier = F.col("first") < F.col("id")
        # A rank is a name too: lengths of one block are powers of two, those of the longer prefixes below are not.
        fresh = own.filter("NOT longer").select("b", "id", F.col("name").alias("g"), F.lit(1 << r).alias("n"), "c0", "c1", earlier.alias("searching"), F.col("copies").alias("most"))
        state = materialise(fresh if state is None else fresh.unionByName(_extended(state, own, r, limit)))
    return state.filter("searching")


def _extended(state: DataFrame, level: DataFrame, r: int, limit: int) -> DataFrame:
    block = level.select(F.col("id").alias("at"), "name", F.col("c1").alias("end"))
    d = state.withColumn("at", F.col("id") + F.col("n")).join(block, "at", "left").drop("at")
    first = d.filter("name IS NOT NULL").groupBy("g", "n", "name").agg(F.min("id").alias("first"), F.count("*").alias("size")).filter("size > 1")
    d = _joined(d, first, ["g", "n", "name"], "size", limit, "left")
    moves = F.coalesce(F.col("first") < F.col("id"), F.lit(False))
    size = F.coalesce("size", F.lit(1).cast("long"))
    # As it stays, if it does, and with the block added, if its class has others.
    stay = F.struct("g", "n", "c1", "searching", (F.col("most") - size + 1).alias("most"))
    longer = F.struct(F.col("first").alias("g"), (F.col("n") + (1 << r)).alias("n"), F.col("end").alias("c1"), moves.alias("searching"), size.alias("most"))
    d = d.select("b", "id", "c0", F.explode(F.array(F.when(~moves, stay), F.when(F.col("first").isNotNull(), longer))).alias("x")).filter("x IS NOT NULL")
    return d.select("b", "id", "x.g", "x.n", "c0", "x.c1", "x.searching", "x.most").filter("searching OR most > 1")


def _key():
    return F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))


def _text_hash():
    return F.xxhash64("text")


def _slices(batch: pa.RecordBatch):
    """Parts of the batch of about SLICE_BYTES of text."""
    text = pa.RecordBatch.from_arrays([batch.column("row").field("text"), pa.array(range(batch.num_rows))], ["text", "at"])
    for part in slices(text):
        yield batch.slice(part.column("at")[0].as_py(), part.num_rows)


def _rewrite(batches, out: pa.Schema):
    for b in (part for batch in batches for part in _slices(batch)):
        cols = dict(zip((f.name for f in b.schema.field("row").type), b.column("row").flatten()))
        texts, runs = cols["text"].to_pylist(), b.column("runs").to_pylist()
        new, dropped = [], []
        for t, r in zip(texts, runs):
            lines = t.split("\n") if t is not None and r else []
            gone = np.zeros(len(lines), bool)
            for x in r or ():
                gone[x["s"] : x["e"]] = True
            new.append("\n".join(line for line, g in zip(lines, gone) if not g) if lines else t)
            dropped.append(int(gone.sum()))
        cols["text"], cols["n_removed"] = new, dropped
        if "n_chars" in cols:
            cols["n_chars"] = [n if not d else len(t) for n, d, t in zip(cols["n_chars"].to_pylist(), dropped, new)]
        yield pa.RecordBatch.from_pydict({n: cols[n] for n in out.names}, schema=out)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs`` with later copies deleted from ``text`` (``n_chars`` follows, if it is there), and n_removed lines."""
    from pyspark.sql.pandas.types import to_arrow_schema

    runs = materialise(repeated_runs(docs, min_words))
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), _key().alias("k"), _text_hash().alias("v"), F.monotonically_increasing_id().alias("id"))
    rows = runs.agg(F.sum("rows")).first()[0] or 0
    d = _joined(keyed, runs, ["k", "v"], "rows", max(LEAST, rows // HOT), "left", "merge").select("row", "runs")
    schema = StructType([*(f for f in docs.schema.fields if f.name != "n_removed"), StructField("n_removed", LongType())])
    out = to_arrow_schema(schema)
    return d.mapInArrow(lambda batches: _rewrite(batches, out), schema)
