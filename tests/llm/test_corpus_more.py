"""Phrase mining, conversation trie, repeated strings, and what stages keep, each against a brute-force version."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohortspark.llm import collocations, count_automaton, decontaminate, fertility, prefix_join, prefix_trie, repeats, ring_shards, suffix_array, toxic_segments


def by_text(rows):
    return sorted(map(tuple, rows), key=str)


# ---- op11 ------------------------------------------------------------------------------------------------------------
def plain_collocations(rows, least=10, top=2000, share=50):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        own = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            own.update(tuple(w[i : i + m]) for m in (1, 2, 3) for i in range(len(w) - m + 1))
    out = []
    for lang, c in counts.items():
        known = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        inside = {s for g, a in known.items() if len(g) == 3 for s in (g[:2], g[1:]) if 100 * a >= share * c[s]}
        ranked = []
        for g, a in known.items():
            if g not in inside:
                score, k = min((10**6 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
                ranked.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(ranked)[:top], 1)]
    return by_text(out)


def spoken():
    r = random.Random(1)
    words = ["a", "B", "ça", "the", "\x00", "x y", "ж", "of", "in", " "]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", "  ", "\t", ". ", " ", " ", "\n", "!? "]) for _ in range(n))
    rows = [(r.choice(["en", "fr", None, ""]), text(r.randint(0, 60))) for _ in range(300)]
    hot = "the same line of words again"
    return rows + [("en", None), ("de", ""), ("und", "ж of ж of"), ("en", text(4000))] + [("en", hot)] * 150  # one text is a third of all rows


@pytest.mark.parametrize("shard_words,rng,fan", [(1_500_000, 1 << 19, 256), (300, 64, 3)])
def test_collocations(spark, monkeypatch, shard_words, rng, fan):
    for name, value in (("SHARD_WORDS", shard_words), ("RANGE", rng), ("FAN", fan), ("BORDER_KEYS", 50_000 if fan > 3 else 40), ("BLOCK", 4 << 20 if fan > 3 else 50)):
        monkeypatch.setattr(collocations, name, value)
    docs = spark.createDataFrame([(*x, 1, 2) for x in spoken()], "lang string, text string, key int, n int").repartition(5)
    assert by_text(collocations.collocations(docs).collect()) == plain_collocations(spoken())


def test_collocations_first_ones_only_and_empty(spark):
    docs = spark.createDataFrame(spoken(), "lang string, text string").repartition(3)
    assert by_text(collocations.collocations(docs, top=7).collect()) == plain_collocations(spoken(), top=7)
    assert collocations.collocations(docs.filter("false")).collect() == []


def test_ranges_of_shards_that_are_alike_hold_few_ngrams(spark, monkeypatch):
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([("en", " ".join(r.choice(words) for _ in range(1000))) for _ in range(60)], "lang string, text string").repartition(60)
    monkeypatch.setattr(collocations, "RANGE", 4096)  # a text has far less than a fragment, so all fragments begin at the first words
    parts = collocations._shards(docs).cache()
    total = parts.agg({"n": "sum"}).first()[0]
    cut, held = collocations._Cut(collocations._borders(parts, -(-total // 4096))), Counter()
    for x in parts.collect():
        for rng, own in cut("en", bytes(x.automaton)):
            held[rng] += len(count_automaton.CountAutomaton.load(own).paths()[1])
    assert sum(held.values()) == total and max(held.values()) < 2 * 4096


def test_count_automata_hold_sum_and_compose():
    r = random.Random(0)

    def some():
        return Counter({tuple(r.choice([b"a", b"b", b"cc", b"d\0"]) for _ in range(r.randint(1, 3))): r.choice([1, 1, 1, 5]) for _ in range(r.randint(0, 60))})

    def arrays(d):
        words = sorted({w for g in d for w in g})
        return words, np.array([[words.index(w) for w in g] + [-1] * (3 - len(g)) for g in sorted(d)], np.int64).reshape(-1, 3).T, np.array([d[g] for g in sorted(d)], np.int64)

    def back(words, rows, n):
        return {tuple(words[i] for i in row if i >= 0): x for row, x in zip(rows.T.tolist(), n.tolist())}

    for _ in range(100):
        dicts = [some() for _ in range(3)]
        own = [count_automaton.CountAutomaton.load(count_automaton.CountAutomaton.of(*arrays(d)).dump()) for d in dicts]
        assert [back(a.words, *a.paths()) for a in own] == list(map(dict, dicts))
        total = sum(dicts, Counter())
        assert back(*count_automaton.union(own)) == total
        both = count_automaton.CountAutomaton.of(*count_automaton.union(own))
        assert back(own[0].words, *both.composed(own[0])) == {g: total[g] for g in dicts[0]}
        assert back(own[0].words, *own[1].composed(own[0])) == {g: dicts[1][g] for g in dicts[0]}


def test_equal_continuations_share_a_state():
    words = [b"a", b"b", b"c", b"x", b"y"]
    rows = [[i, 3, 4] for i in range(3)] + [[i, 3, -1] for i in range(3)] + [[i, -1, -1] for i in range(3)]
    a = count_automaton.CountAutomaton.of(words, *count_automaton.summed(np.array(rows).T, np.ones(9, np.int64), 5))
    assert len(a.first) - 1 == 3 and len(a.label) == 5  # start, behind any first word, behind any two


# ---- op12 ------------------------------------------------------------------------------------------------------------
def plain_trie(rows):
    conv = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            conv[c].append(((t is not None, t or 0), role or "", text or ""))
    conv = {c: [(r, x) for _, r, x in sorted(v, key=lambda y: y[0])] for c, v in conv.items()}
    made = {}
    for c, v in conv.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = conv.get(c - c % 100, [])[:h] + v[h:]
    members, kids, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c, v in made.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, own in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(own) - 1) * len(k[-1][1]) if k else 0
    ends = lambda k: ",".join(str(c) for c in sorted(members[k]) if len(made[c]) == len(k))
    return by_text((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends(k).encode()).hexdigest()) for k, m in members.items())


def talks():
    r, rows = random.Random(1), []
    for c in [*range(230), 305, 1000, 1001]:  # 300 is not there
        rows += [(c, t or None, r.choice(["user", None]), r.choice(["a", "bé", None, "cc"]) if t < 3 else r.choice(["x", "y" * 30])) for t in range(r.choice([1, 2, 3, 5, 9, 14]))]
    rows += [(400, t, "u", "same") for t in range(160)] + [(401, t, "u", "same") for t in range(161)] + [(None, 1, "u", "x")]  # long ones, alike up to the end
    return rows + [(c, 0, "user", "hi") for c in range(2000, 2900)]  # one node at which very many end


@pytest.mark.parametrize("chunk", [1024, 7])
def test_prefix_trie(spark, monkeypatch, chunk):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    conversations = spark.createDataFrame([(*x, 1) for x in talks()], "conv_id long, turn long, role string, text string, k int").repartition(5)
    turns = prefix_trie.numbered(conversations)
    got = prefix_trie.prefix_trie(*prefix_trie.with_shared_openings(turns))
    assert by_text(got.collect()) == plain_trie(talks())


def test_prefix_trie_without_rows_and_with_ties(spark):
    none = spark.createDataFrame([(None, 1, "u", "x")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(*prefix_trie.with_shared_openings(prefix_trie.numbered(none))).collect() == []
    tied = spark.createDataFrame([(1, 0, "u", "a"), (1, 0, "u", "b"), (1, 0, "u", "a"), (2, 0, "u", "b"), (2, 0, "u", "a"), (2, 0, "u", "a")], none.schema)
    members = prefix_trie.numbered(tied).groupBy("conv_id").count().selectExpr("conv_id", "count AS turns")
    turns = prefix_trie.numbered(tied).join(members, "conv_id")
    depths = [(r.depth, r.n_convs) for r in prefix_trie.prefix_trie(turns, members).collect()]
    assert sorted(depths) == [(0, 2), (1, 2), (2, 2), (3, 2)]  # equal turns in any order are one path


# ---- op13 ------------------------------------------------------------------------------------------------------------
def plain_repeats(rows, length):
    data, seen, out = [(d, (t or "").encode()) for d, t in rows], Counter(), []
    for _, b in data:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return by_text(out)


def copied():
    r = random.Random(1)
    words = ["".join(r.choice("abcdé\0") for _ in range(r.randint(1, 4))) for _ in range(30)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    common, rows = text(60), []
    rows += [(i, text(r.randint(0, 80))) for i in range(60)]
    rows += [(100 + i, text(r.randint(0, 20)) + common[r.randint(0, 5) : len(common) - r.randint(0, 5)] + text(r.randint(0, 20))) for i in range(60)]
    rows += [(200, rows[70][1]), (201, rows[70][1]), (202, None), (None, ""), (None, common), (203, "a" * 300), (204, "ab" * 200), (205, "x" * 39), (206, "x" * 40), (207, "y" * 41)]
    rows += [(208, "z" * 30 + "é" * 40), (209, text(3000))] + [(210, common)] * 90  # copies of one text are a third of the rows
    base = rows[90][1]
    return rows + [(300 + i, base[:k] + "Z" + base[k + 1 :]) for i in range(40) for k in [r.randrange(len(base))]]


@pytest.mark.parametrize("most", [repeats.MOST, 3000, 0])
def test_repeats(spark, monkeypatch, most):
    """Also with every anchor dealt over parts and single strings."""
    monkeypatch.setattr(repeats, "MOST", most)
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in copied()], "doc_id long, text string, ka int, kept int").repartition(7)
    assert by_text(repeats.repeat_digest(docs, 40, 10).collect()) == plain_repeats(copied(), 40)


def test_repeats_texts_and_empty_table(spark):
    docs = spark.createDataFrame(copied(), "doc_id long, text string")
    for r in repeats.remove_repeats(docs, 40, 10).filter("doc_id < 200").collect():
        data = dict(copied())[r.doc_id].encode()
        gone = {i for s in r.spans for i in range(s["start"], s["end"])}
        assert r.n_bytes == len(data) and bytes(r.kept) == bytes(b for i, b in enumerate(data) if i not in gone)
    assert repeats.repeat_digest(docs.filter("false")).collect() == []


@pytest.mark.parametrize("few", [1024, 0])
def test_suffix_array_and_prefixes(monkeypatch, few):
    monkeypatch.setattr(suffix_array, "FEW", few)
    monkeypatch.setattr(suffix_array, "SIZE", 1)
    rng = np.random.default_rng(0)
    for case in range(150):
        t = rng.integers(1, rng.integers(2, 6), rng.integers(1, 60))
        t = np.append(np.repeat(t, rng.integers(1, 5)) if case % 3 == 0 else t, 0).astype(np.int64)
        sa = suffix_array.suffix_array(t, int(t.max()) + 1)
        text = t.tolist()
        assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        prefix = suffix_array.permuted_prefixes(t, sa)
        for a, b in zip(sa[1:].tolist(), sa[:-1].tolist()):
            n = next(k for k in range(len(text)) if text[a + k] != text[b + k])
            assert prefix[a] == n


# ---- what the stages keep ----------------------------------------------------------------------------------------------
def test_one_per_group_keeps_rows_that_differ_anywhere(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, "", {"a": 1}, [1, None], 5), (1, "", {"a": 2}, [1, None], 5), (1, "", {"a": 1}, [1], 5), (2, text, {"k": 1}, [1], 6), (3, text, {"k": 2}, [None], 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, `_row` array<int>, `row` long")
    out = prefix_join.one_per_group(docs)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(str(r) for r in docs.collect() if r.doc_id != 3)


def test_sets_that_share_64_bits_are_told_apart(spark, monkeypatch):
    a, b = ([f"{g}{i}" for i in range(40)] for g in "ab")
    rows = [(1, " ".join(a)), (2, " ".join(a + ["more"])), (3, " ".join(b)), (4, " ".join(b + ["tail"])), (5, None)]
    members, _ = prefix_join._groups(spark.createDataFrame(rows, "doc_id long, text string"), 80)
    same = members.selectExpr("doc_id", "n", "CASE WHEN n > 0 THEN 77L ELSE node END AS node", "other")
    found = prefix_join._clashes(same)
    assert len(found) == 4 and len(set(found.values())) == 4 and {x for x, _ in found} == {77}
    assert prefix_join._clashes(members) == {}


@pytest.mark.parametrize("parts", [1, 3])
def test_remove_spans_leaves_nothing(spark, parts):
    w = [f"w{i}" for i in range(10)]
    v = [f"v{i}" for i in range(10)]
    bench = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(v)), (3, " ".join(f"u{i}" for i in range(40)))], "item_id long, text string")
    inner = " ".join(w[:5] + v + w[5:])  # cutting one passage makes the other
    rows = [(1, "keep " + inner + " this", 7, "r"), (2, inner, 7, "r"), (3, "nothing here", 7, "r"), (4, None, 7, "r"), (5, "x " + " ".join(w[:5] + v[:5] + w + v[5:] + w[5:]) + " y", 7, "r")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, row_of_pass int, `_row_of_pass` string, n_chars long")
    out = decontaminate.remove_spans(docs, bench, part_words=100 if parts == 1 else 20)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and decontaminate.decontamination_report(out, bench).filter("contaminated").count() == 0
    assert sorted(got) == [1, 3, 4, 5] and got[1].text.split() == ["keep", "this"] and got[5].text.split() == ["x", "y"] and got[5].n_chars == len(got[5].text) and got[3].text == "nothing here"
    assert {r.row_of_pass for r in got.values()} == {7}


def test_fences_of_languages_are_drawn_towards_all(spark):
    """Languages of many, few and one documents, and none: quartiles by plain loops."""
    g = np.random.default_rng(4)
    rows = [(lang, i, int(v) + shift) for lang, n, shift in (("en", 300, 0), ("fr", 12, 400), (None, 40, -200), ("xx", 1, 5000)) for i, v in enumerate(g.integers(3000, 4000, n))]
    measured = spark.createDataFrame([(a, False, v, 7, v // 2) for a, _, v in rows] + [("en", True, 99999, 1, 1)], "lang string, base_failed boolean, chars_per_token int, byte_fallback int, entropy int")
    got = {(r.pooled, r.lang, r.metric): (r.low, r.high) for r in fertility.fences(measured, 2.5).collect()}

    def fence(values):
        v = sorted(values)
        at = lambda q: next(x for i, x in enumerate(v, 1) if i >= q * len(v))
        gap = max(at(0.75) - at(0.25), 10)
        return np.array([at(0.25) - 2.5 * gap, at(0.75) + 2.5 * gap])

    every = fence([v for _, _, v in rows])
    assert np.allclose(got[True, None, "chars_per_token"], every)
    for lang in ("en", "fr", None, "xx"):
        own = [v for a, _, v in rows if a == lang]
        want = (len(own) * fence(own) + fertility.WEIGHT * every) / (len(own) + fertility.WEIGHT)
        assert np.allclose(got[False, lang, "chars_per_token"], want)


def test_equal_rows_without_id_spread_over_the_ring(spark):
    docs = spark.createDataFrame([(None, "")] * 800 + [(i, f"text {i}") for i in range(400)], "doc_id long, text string").repartition(4)
    out = ring_shards.ring_shards(docs, shards=8)
    count = {r.shard: r["count"] for r in out.filter("doc_id IS NULL").groupBy("shard").count().collect()}
    assert sum(count.values()) == 800 and min(count.values()) > 50


def test_toxicity_trains_on_one_text_of_an_id(spark):
    """A third of all rows repeats one labelled id; the fit is that of one row."""
    r = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    bad = [f"bad{i}" for i in range(10)]
    text = lambda toxic: " ".join(r.choice(bad if toxic and r.random() < 0.3 else words) for _ in range(60))
    labels = [(i, int(i % 4 == 0)) for i in range(300)]
    rows = [(i, text(t)) for i, t in labels]
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    one, many = (toxic_segments.fit(spark.createDataFrame(x, "doc_id long, text string").repartition(3), lab) for x in (rows, rows + [rows[4]] * 150))
    assert one[0] == many[0] and one[1].curve == many[1].curve


def test_added_personal_data_is_found(spark, sf_dir):
    """Local phones, national ids and IBANs planted with words that tell: nine of ten at least are found."""
    from cohortspark.llm import pii

    r = random.Random(5)

    def iban():
        land, body = r.choice(sorted(pii.IBAN_LANDS)), "".join(r.choice("0123456789") for _ in range(18))
        return f"{land}{98 - int(''.join(str(int(c, 36)) for c in body + land + '00')) % 97:02d}{body}"

    make = {
        "local_phone": (lambda: f"{r.randint(200, 999)}-{r.randint(200, 999)}-{r.randint(1000, 9999)}", ["call {}", "phone: {}", "my mobile is {}"]),
        "national_id": (lambda: f"{r.randint(100, 665)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}", ["ssn {}", "social security {}"]),
        "iban": (iban, ["iban {}", "bank account {}", "konto {}"]),
    }
    rows, truth = [], set()
    for i, x in enumerate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()):
        words, kind = (x.text or "").split(" "), r.choice(sorted(make))
        value, at = make[kind][0](), r.randint(0, len(words))
        before, said = " ".join(words[:at]) + " ", r.choice(make[kind][1]).format(value)
        begin = len(before) + said.index(value)
        truth.add((i, kind, begin, begin + len(value)))
        rows.append((i, before + said + " " + " ".join(words[at:])))
    found = {(x.doc_id, k, int(a), int(b)) for x in pii.pii_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect() for k, a, b in (s.split(":") for s in x.spans.split(",") if s)}
    for kind in make:
        own = {x for x in truth if x[1] == kind}
        assert len(own & found) >= 0.9 * len(own)
