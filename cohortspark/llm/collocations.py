"""Collocations by weighted acyclic automata.

Each task builds automata from the sorted n-grams of its texts, language by language, and cuts them into fragments of FRAGMENT n-grams. A fragment tells some of its n-grams, evenly spaced from a place
of its own on, for fragments of shards that are alike begin at the same n-grams; from those keys come the borders of prefix ranges with about RANGE n-grams each. Fragments are cut at the borders, and those of one range are united and their
weights summed. With more than FAN shards that is done in several rounds, each of which unites groups of FAN shards, so pieces stay large however many shards there are. The last round
keeps what is frequent. Parts of candidates are looked up in the range that holds them, by composing an automaton of the parts asked for with the counts.

Counts are exact: nothing is sampled but, for the borders only, the keys of fragments, of which BORDER_KEYS are looked at.

Defined cases: a null language is ``und``; a null or empty text has no words; repeated rows count as often as they are there; a very long text is one text among others, for its words are cut into blocks
without losing the n-grams across; extra columns are ignored; an empty table gives no phrases; ties go by score, count and phrase.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, pa_schema, slices
from .count_automaton import EMPTY, ORDER, CountAutomaton, Loaded, decoded, union

LEAST, TOP, SHARE = 10, 2000, 50
SHARD_WORDS = 1_500_000  # the cube of one more is below 2^63
BLOCK = 1 << 20
FRAGMENT, RANGE = 1 << 16, 1 << 20
FAN = 256
BORDER_KEYS = 50_000
KEYS = 256  # of the n-grams of a range
SALTS = 64

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_CHARS = bytes(ord("\n") if c in _BREAKS else ord(" ") if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Words(dict):
    """Numbers of words from 1 on; 0 between pieces, -1 for what is no word."""

    def __missing__(self, w: bytes) -> int:
        self[w] = n = len(self) - 1
        return n


class _Shard:
    """Words of one language that a task has read."""

    def __init__(self):
        self.number, self.ids, self.size = _Words({b"\n": 0, b"": -1}), [], 0

    def add(self, texts: list[bytes]) -> None:
        data = b"\n".join([b"", *texts]).translate(_CHARS)
        at = 0
        while at < len(data):  # tokens of a block at a time, cut between words
            end = at + BLOCK if at + BLOCK < len(data) else len(data)
            end = max(at + 1, data.rfind(b" ", at, end) + 1, data.rfind(b"\n", at, end) + 1) if end < len(data) else end
            if end == at + 1 and end < len(data):  # one word of more than a block
                end = min((x for x in (data.find(b" ", at), data.find(b"\n", at + 1)) if x > at), default=len(data))
            tokens = data[at:end].replace(b"\n", b" \n ").split(b" ")
            ids = np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens))
            self.ids.append(ids[ids >= 0])
            self.size += len(self.ids[-1])
            at = end

    def automata(self, every: int, seed: bytes):
        """Rows of fragments()."""
        ids = np.concatenate([EMPTY, *self.ids]) - 1
        words = [w for w, n in self.number.items() if n > 0]
        for a in range(0, len(ids), SHARD_WORDS):  # of a very long text, block by block; n-grams belong to the block in which they begin
            block = ids[a : a + SHARD_WORDS + ORDER - 1]
            own = np.unique(block[block >= 0]).tolist()
            order = sorted(own, key=words.__getitem__)
            rank = np.full(len(words) + 1, -1, np.int64)
            rank[order] = np.arange(len(order))
            yield from fragments([words[i] for i in order], _counted(rank[block], min(SHARD_WORDS, len(ids) - a), len(order)), every, b"%s,%d" % (seed, a))


def _counted(x: np.ndarray, begins: int, words: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Codes of the n-grams of ``x`` (ids, -1 between pieces) that begin at the first ``begins`` places, sorted, and their counts; by the number of words."""
    x = np.concatenate([x, np.full(begins + ORDER - 1 - len(x), -1)])
    found, on, code = [], np.ones(begins, bool), np.zeros(begins, np.int64)
    for k in range(ORDER):
        on &= x[k : k + begins] >= 0
        code = code * (words + 1) + x[k : k + begins] + 1
        full = np.sort(code[on] * (words + 1) ** (ORDER - 1 - k))
        first = np.flatnonzero(np.concatenate([[True], full[1:] != full[:-1]])) if len(full) else EMPTY
        found.append((full[first], np.diff(np.append(first, len(full)))))
    return found


def fragments(words: list[bytes], counted: list[tuple[np.ndarray, np.ndarray]], every: int, seed: bytes):
    """The first n-gram, about one n-gram in ``every``, the number of n-grams, that of words read, and the automaton."""
    most = max((code for code, _ in counted), key=len)
    cuts = most[:: max(1, FRAGMENT * len(most) // max(1, sum(len(code) for code, _ in counted)))][1:]  # merged one fragment at a time
    edges = [np.concatenate([[0], np.searchsorted(code, cuts), [len(code)]]) for code, _ in counted]
    for a in range(len(cuts) + 1):
        code, count = (np.concatenate([x[i][e[a] : e[a + 1]] for x, e in zip(counted, edges)]) for i in (0, 1))
        if not len(code):
            continue
        order = np.argsort(code, kind="stable")
        own, count = decoded(code[order], len(words)), count[order]
        yield _key(words, own[:, 0]), _keys(words, own, every, b"%s,%d" % (seed, a)), len(count), int(count[own[1] < 0].sum()), CountAutomaton.of(words, own, count).dump()


def _key(words: list[bytes], row: np.ndarray) -> bytes:
    return b" ".join(words[i] for i in row.tolist() if i >= 0)


def _keys(words: list[bytes], cols: np.ndarray, every: int, seed: bytes) -> list[bytes]:
    return [_key(words, cols[:, i]) for i in range(zlib.crc32(seed) % every, cols.shape[1], every)]


_FRAGMENT = "lang string, shard long, key binary, keys array<binary>, n long, words long, automaton binary"


def _shards(docs: DataFrame) -> DataFrame:
    """_FRAGMENT of the texts' own automata; a task gives one shard after another."""
    out, every = pa_schema(_FRAGMENT), _every()

    def run(batches):
        part, made = TaskContext.get().partitionId() << 32, 0
        shards: dict[str, _Shard] = {}

        def flush():
            for lang, s in shards.items():
                for key, keys, n, words, data in s.automata(every, f"{lang},{part + made}".encode()):
                    yield pa.RecordBatch.from_pylist([{"lang": lang, "shard": part + made, "key": key, "keys": keys, "n": n, "words": words, "automaton": data}], schema=out)
            shards.clear()

        for batch in batches:
            for b in slices(batch):
                langs, texts = b.column("lang").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()
                for lang in dict.fromkeys(langs):
                    own = [t for t, x in zip(texts, langs) if x == lang and t]
                    shards.setdefault(lang, _Shard()).add(own)
                if sum(s.size for s in shards.values()) >= SHARD_WORDS:
                    yield from flush()
                    made += 1
        yield from flush()

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, _FRAGMENT)


def _every() -> int:
    return max(1, RANGE // KEYS)


def _borders(parts: DataFrame, ranges: int) -> list[tuple]:
    """Keys (language, words) that cut the n-grams of all fragments into about ``ranges`` equal ranges."""
    keys = parts.select("lang", F.explode("keys").alias("key"), "shard")
    if (count := keys.count()) > BORDER_KEYS:
        keys = keys.filter(F.pmod(F.xxhash64("lang", "key", "shard"), F.lit(count)) < BORDER_KEYS)
    keys = sorted((r[0], *bytes(r[1]).split(b" ")) for r in keys.collect())
    step = max(1, len(keys) // max(1, ranges))
    return sorted(set(keys[step::step]))


class _Cut:
    """Parts of an automaton by range."""

    def __init__(self, borders: list[tuple]):
        self.borders = borders

    def range_of(self, lang: str, ngram: list[bytes]) -> int:
        return bisect_right(self.borders, (lang, *ngram))

    def __call__(self, lang: str, data: bytes):
        a = CountAutomaton.load(data)
        cols, n = a.paths()
        if not len(n):
            return
        key = lambda i: (lang, *(a.words[w] for w in cols[:, i].tolist() if w >= 0))
        low, high = bisect_right(self.borders, key(0)), bisect_right(self.borders, key(len(n) - 1))
        if low == high:
            yield low, data
            return
        edges = [0, *(bisect_left(range(len(n)), b, key=key) for b in self.borders[low:high]), len(n)]
        for k, (x, y) in enumerate(zip(edges, edges[1:])):
            if y > x:
                yield low + k, CountAutomaton.of(a.words, cols[:, x:y], n[x:y]).dump()


def _united(parts: DataFrame, groups: int, least: int) -> tuple[DataFrame, list[tuple]]:
    """Fragments of the unions of shards: those of ``groups`` groups of them, without n-grams of fewer than ``least``. And the borders of the ranges."""
    total = parts.agg(F.sum("n")).first()[0] or 0
    cut, every = _Cut(_borders(parts, -(-total // (RANGE * groups)))), _every()
    piece, out = pa_schema("lang string, grp long, rng long, automaton binary"), pa_schema(_FRAGMENT)

    def deal(batches):
        for batch in batches:
            for lang, grp, data in zip(*(batch.column(c).to_pylist() for c in ("lang", "grp", "automaton"))):
                for rng, own in cut(lang, data):
                    yield pa.RecordBatch.from_pylist([{"lang": lang, "grp": grp, "rng": rng, "automaton": own}], schema=piece)

    def unite(table: pa.Table) -> pa.Table:
        lang, grp = table.column("lang")[0].as_py(), table.column("grp")[0].as_py()
        words, cols, n = union(Loaded(table.column("automaton").to_pylist()))
        read, keep = int(n[cols[1] < 0].sum()), np.flatnonzero(n >= least)
        rows = []
        for x in np.array_split(keep, max(1, -(-len(keep) // FRAGMENT))) if len(keep) else ():
            keys = _keys(words, cols[:, x], every, b"%d,%d,%s" % (grp, x[0], _key(words, cols[:, x[0]])))
            rows.append({"lang": lang, "shard": grp, "key": _key(words, cols[:, x[0]]), "keys": keys, "n": len(x), "words": 0, "automaton": CountAutomaton.of(words, cols[:, x], n[x]).dump()})
        if read:  # words that are not frequent are counted all the same
            rows = rows or [{"lang": lang, "shard": grp, "key": _key(words, cols[:, 0]), "keys": [], "n": 0, "words": 0, "automaton": CountAutomaton.of([], cols[:, :0], n[:0]).dump()}]
            rows[0]["words"] = read
        return pa.Table.from_pylist(rows, schema=out)

    grp = F.pmod(F.xxhash64("shard"), F.lit(groups))
    d = parts.select("lang", grp.alias("grp"), "automaton").mapInArrow(deal, "lang string, grp long, rng long, automaton binary")
    return materialise(d.groupBy("lang", "grp", "rng").applyInArrow(unite, _FRAGMENT)), cut.borders


def ngram_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, list[tuple]]:
    """lang, key, n, words, automaton: the counts of all n-grams found ``least`` times or more, in ranges of keys; ``words`` sums up to those of a language. And the borders."""
    parts = materialise(_shards(docs))
    shards = parts.select("shard").distinct().count()
    while (groups := -(-shards // FAN)) > 1:
        parts, _ = _united(parts, groups, 1)
        shards = groups
    return _united(parts, 1, least)


def _candidates(counts: DataFrame, borders: list[tuple]) -> DataFrame:
    """lang, phrase, a, k, side, part, rng: a row of each side of each cut (after k words) of each frequent phrase of two words or more."""
    schema = "lang string, phrase string, a long, k int, side int, part string, rng long"
    out, cut = pa_schema(schema), _Cut(borders)

    def run(batches):
        for batch in batches:
            for lang, data in zip(batch.column("lang").to_pylist(), batch.column("automaton").to_pylist()):
                a = CountAutomaton.load(data)
                cols, n = a.paths()
                many = cols[1] >= 0
                for block in np.array_split(np.flatnonzero(many), max(1, many.sum() // 5000)):
                    rows = []
                    for row, count in zip(cols[:, block].T.tolist(), n[block].tolist()):
                        w = [a.words[i] for i in row if i >= 0]
                        rows += [(lang, b" ".join(w).decode(), count, k, side, b" ".join(p).decode(), cut.range_of(lang, p)) for k in range(1, len(w)) for side, p in enumerate((w[:k], w[k:]))]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(out)], schema=out)

    return counts.select("lang", "automaton").mapInArrow(run, schema)


def _looked_up(asked: DataFrame, counts: DataFrame, borders: list[tuple]) -> DataFrame:
    """lang, part, f of the parts in ``asked`` (lang, part, rng), each once."""
    schema = pa_schema("lang string, part string, f long")
    key_range = pa_schema("lang string, rng long, automaton binary")
    cut = _Cut(borders)

    def deal(batches):  # a fragment of the last round lies in one range
        for batch in batches:
            for lang, key, data in zip(*(batch.column(c).to_pylist() for c in ("lang", "key", "automaton"))):
                yield pa.RecordBatch.from_pylist([{"lang": lang, "rng": cut.range_of(lang, key.split(b" ")), "automaton": data}], schema=key_range)

    def compose(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        grams = sorted(tuple(p.encode().split(b" ")) for p in left.column("part").to_pylist())
        words = sorted({w for g in grams for w in g})
        number = {w: i for i, w in enumerate(words)}
        cols = np.array([[number[w] for w in g] + [-1] * (ORDER - len(g)) for g in grams], np.int64).T
        asked_ = CountAutomaton.of(words, cols, np.ones(len(grams), np.int64))
        total = np.zeros(len(grams), np.int64)
        for data in right.column("automaton").to_pylist():
            rows, f = CountAutomaton.load(data).composed(asked_)
            total += f
        parts = [b" ".join(asked_.words[i] for i in r if i >= 0).decode() for r in rows.T.tolist()]
        return pa.Table.from_pydict({"lang": [left.column("lang")[0].as_py()] * len(parts), "part": parts, "f": total}, schema=schema)

    ranges = counts.select("lang", "key", "automaton").mapInArrow(deal, "lang string, rng long, automaton binary")
    return asked.groupBy("lang", "rng").cogroup(ranges.groupBy("lang", "rng")).applyInArrow(compose, "lang string, part string, f long")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first ``top`` phrases of each language.

    a, l, r: counts of the phrase and of the parts of its weakest cut; n: words of the language; score: floor(10^6 a a / (l r)). Phrases inside of a longer one that has ``share`` percent
    of their count are left out.
    """
    counts, borders = ngram_counts(docs, least)
    sides = materialise(_candidates(counts, borders))
    asked = sides.groupBy("lang", "part", "rng").agg(F.lit(1).alias("one")).drop("one")
    found = materialise(_looked_up(asked, counts, borders))
    d = sides.drop("rng").join(found, ["lang", "part"])
    inside = d.filter(F.col("part").contains(" ") & (F.col("a") * 100 >= F.col("f") * share)).select("lang", F.col("part").alias("phrase")).distinct()
    wide = F.struct("k", "side", "f")
    cuts = d.groupBy("lang", "phrase", "a").agg(F.sort_array(F.collect_list(wide)).alias("x"))  # four at most
    cuts = cuts.join(inside, ["lang", "phrase"], "left_anti").withColumn("i", F.explode(F.sequence(F.lit(0), F.size("x") - 2, F.lit(2))))
    cuts = cuts.select("lang", "phrase", "a", F.get("x", "i")["k"].alias("k"), F.get("x", "i")["f"].alias("l"), F.get("x", F.col("i") + 1)["f"].alias("r"))
    big = "CAST({} AS DECIMAL(15,0))".format  # of counts up to 10^15; products have 38 digits at most, for a is at most l and r
    score = F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * {big('a')} * {big('a')}) DIV ({big('l')} * {big('r')})")
    least_cut = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = least_cut.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)  # SALTS x top rows of a language
    words = counts.groupBy("lang").agg(F.sum("words").alias("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
