"""One query per corpus operator, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chat_format, collocations, decontaminate, fertility, line_runs, pii, prefix_join, prefix_trie, repeats, ring_shards, secret_scan, toxic_segments, two_fit
from .common import doc_table


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(doc_table(spark, sf_dir))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_removed (lines), n_lines left, text_sha256 of what is left, text."""
    d = line_runs.dedup_lines(doc_table(spark, sf_dir).select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return d.select("doc_id", "n_removed", F.length(text).cast("long").alias("left_chars"), F.sha2(text, 256).alias("text_sha256"), "text")


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = doc_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit("</s>[INST] ok [/INST]"))
    return chat_format.chat_digest(chat_format.format_chats(rows.union(own)))


def op4_fertility(spark, sf_dir: str) -> DataFrame:
    return fertility.fertility(doc_table(spark, sf_dir))


def op5_two_fit_packing(spark, sf_dir: str) -> DataFrame:
    return two_fit.pack(doc_table(spark, sf_dir))


def op6_prefix_join(spark, sf_dir: str) -> DataFrame:
    return prefix_join.near_duplicates(doc_table(spark, sf_dir))


def op7_toxic_segments(spark, sf_dir: str) -> DataFrame:
    return toxic_segments.toxicity(doc_table(spark, sf_dir), doc_table(spark, sf_dir, "labels"))


def op8_ring_shards(spark, sf_dir: str) -> DataFrame:
    return ring_shards.ring_shards(doc_table(spark, sf_dir))


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontaminate.decontamination_report(doc_table(spark, sf_dir), doc_table(spark, sf_dir, "benchmark")).drop("spans")


def op10_pii(spark, sf_dir: str) -> DataFrame:
    return pii.pii_spans(doc_table(spark, sf_dir))


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations.collocations(doc_table(spark, sf_dir))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    turns = prefix_trie.numbered(doc_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return prefix_trie.prefix_trie(*prefix_trie.with_shared_openings(turns))


def op13_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeats.repeat_digest(doc_table(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_line_dedup, op3_chat_format, op4_fertility, op5_two_fit_packing, op6_prefix_join, op7_toxic_segments, op8_ring_shards, op9_decontamination, op10_pii, op11_collocations, op12_prefix_trie, op13_suffix_dedup)}

_WORD10 = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Where SQL can express the result.
SQL: dict[str, str] = {
    "op9_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_WORD10}') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOWER}, '{_WORD10}') AS w FROM benchmark),
win AS (SELECT item, list_slice(w, i, i + 9) AS p FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(p) AS n FROM win),
occ AS (SELECT r, i, n, list_slice(w, i, i + n - 1) AS p FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT r, i, n, item FROM occ JOIN win USING (p)),
pos AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)""",
    "op11_collocations": r"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM piece),
gram AS (SELECT lang, m, list_slice(w, i, i + m - 1) AS g, count(*)::HUGEINT AS a FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (VALUES (1), (2), (3)) x(m)) GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM gram WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM gram WHERE m > 1 AND a >= 10),
cut AS (SELECT c.lang, c.m, c.g, c.a, k, x.a AS l, y.a AS r, 1000000 * c.a * c.a // (x.a * y.a) AS score FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
  JOIN gram x ON x.lang = c.lang AND x.m = k AND x.g = c.g[:k] JOIN gram y ON y.lang = c.lang AND y.m = c.m - k AND y.g = c.g[k + 1:]),
inside AS (SELECT DISTINCT s.lang, s.g FROM c s JOIN c t ON s.m = 2 AND t.m = 3 AND s.lang = t.lang AND (s.g = t.g[:2] OR s.g = t.g[2:]) AND 100 * t.a >= 50 * s.a),
best AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS q FROM cut ANTI JOIN inside USING (lang, g)) WHERE q = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
    "op12_prefix_trie": """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id AS c, count(*) AS n, conv_id - conv_id % 100 AS base,
  xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda x: x::UBIGINT)), lambda y, z: xor(y >> 1, 3988292384::UBIGINT * (y & 1)))), 4294967295::UBIGINT) % 6 AS h FROM t GROUP BY conv_id),
r AS (SELECT ids.c, t.i - ids.h + least(ids.h, coalesce(b.n, 0)) AS i, role, text FROM ids LEFT JOIN ids b ON b.c = ids.base JOIN t ON t.conv_id = ids.c AND t.i >= ids.h
  UNION ALL SELECT ids.c, t.i, role, text FROM ids JOIN t ON t.conv_id = ids.base AND t.i < ids.h),
p AS (SELECT c, i + 1 AS d, length(text) AS chars, md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY c ORDER BY i)) AS id FROM r UNION ALL SELECT c, 0, 0, '' FROM ids),
fin AS (SELECT c, max(d) AS e FROM p GROUP BY c),
node AS (SELECT id, d, min(c) AS m, count(*) AS n, any_value(chars) AS chars, sha256(coalesce(string_agg(CASE WHEN d = e THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS h FROM p JOIN fin USING (c) GROUP BY id, d),
up AS (SELECT DISTINCT a.id, b.id AS pid FROM p a JOIN p b ON a.c = b.c AND b.d = a.d - 1),
kids AS (SELECT pid AS id, count(*) AS k FROM up GROUP BY 1),
sub AS (SELECT DISTINCT a.id, b.id AS w FROM p a JOIN p b ON a.c = b.c AND b.d >= a.d),
tree AS (SELECT sub.id, count_if(kids.k IS NULL) AS leaves, sum((w.n - 1) * w.chars) AS saved FROM sub JOIN node w ON w.id = sub.w LEFT JOIN kids ON kids.id = sub.w GROUP BY sub.id)
SELECT node.m AS conv_id, CAST(node.d AS BIGINT) AS depth, q.m AS parent_conv_id, node.n AS n_convs, coalesce(k, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, node.h AS ends_sha256
FROM node JOIN tree USING (id) LEFT JOIN kids USING (id) LEFT JOIN up USING (id) LEFT JOIN node q ON q.id = up.pid""",
    "op6_prefix_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * m >= 80 * (x.n + y.n - m)),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, e.v FROM reach JOIN e ON e.u = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) c USING (doc_id)""",
}
