"""Registered queries of the cohort operators over the star-schema tables, each with the SQL that must agree.

Visits are ``events`` (a value in 17 is made NULL), participants are ``orders`` (a price in 13 is made NULL) and ``customer``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import evaluate as E
from .operators import models as M
from .operators import shape as H
from .operators import stats as S
from .plans import cohort as P
from .sources import io as IO

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TYPES = ("click", "error", "purchase", "signup", "view")
EV = "ev AS (SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value, props FROM events)"
OD = "od AS (SELECT o_orderkey AS id, o_custkey AS cust, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS t, round(o_totalprice / 600000.0, 3) AS score, o_orderpriority AS pri, o_orderstatus AS st, CAST(year(o_orderdate) AS INT) AS yr, o_orderdate AS d FROM orders)"


def ev(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").withColumn("value", F.when(F.col("event_id") % 17 != 0, F.col("value")))


def rounded(c: Column, places: int) -> Column:
    """Rounded as the SQL does it: the product with a power of ten to the nearest whole number, halves away from zero. Spark's own ``round`` goes by the shortest decimal, and halves such as 0.5005 end on the other side."""
    return F.round(c * 10.0**places) / 10.0**places


def od(spark: SparkSession, sf: str) -> DataFrame:
    o, c = spark.read.parquet(f"{sf}/orders.parquet"), F.col
    return o.select(c("o_orderkey").alias("id"), c("o_custkey").alias("cust"), F.when(c("o_orderkey") % 13 != 0, c("o_totalprice")).alias("price"), (c("o_orderstatus") == "F").cast("int").alias("y"), (c("o_orderstatus") == "P").cast("int").alias("t"), rounded(c("o_totalprice") / 600000.0, 3).alias("score"), c("o_orderpriority").alias("pri"), c("o_orderstatus").alias("st"), F.year("o_orderdate").alias("yr"), c("o_orderdate").alias("d"))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places: sums may differ in the last bits by their order."""
    return df.select(*(rounded(F.col(c), 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def add(name: str, f: Query, sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


# ---- columns ---------------------------------------------------------------------------------------------------------------------
add("d_flags", lambda s, d: r6(od(s, d).select("id", C.flag(F.col("price"), ">=", 250000.0).alias("high"), C.reciprocal(F.col("price"), 1000.0).alias("recip"), C.below(F.col("price"), 200000.0).alias("low"), C.between(F.col("price"), 1e5, 3e5).alias("mid"), C.product_ratio(F.col("price"), F.col("score"), 405.0).alias("ratio"))),
    f"WITH {OD} SELECT id, CASE WHEN price IS NOT NULL THEN CAST(price >= 250000 AS DOUBLE) END AS high, round(CASE WHEN price > 0 THEN 1000.0 / price END, 6) AS recip, round(CASE WHEN price < 200000 THEN price END, 6) AS low, round(CASE WHEN price BETWEEN 100000 AND 300000 THEN price END, 6) AS mid, round(price * score / 405.0, 6) AS ratio FROM od")
add("d_bands", lambda s, d: od(s, d).select("id", C.band(F.col("price"), [0.0, 1e5, 2e5, 3e5], ["a", "b", "c", "d"]).alias("band"), C.percentile_band(F.col("score") * 100).alias("pband"), C.digitize(F.col("price"), [1e5, 2e5, 2e5]).cast("long").alias("digit"), C.map_ordinal(F.substring("pri", 3, 20), {"urgent": 3, "high": 2, "medium": 1}).alias("ordinal")),
    f"WITH {OD} SELECT id, CASE WHEN price > 300000 THEN 'd' WHEN price > 200000 THEN 'c' WHEN price > 100000 THEN 'b' WHEN price > 0 THEN 'a' END AS band, CASE WHEN score * 100 >= 99 THEN '99+' WHEN score * 100 >= 95 THEN '95-99' WHEN score * 100 >= 90 THEN '90-95' ELSE '0-90' END AS pband, CAST(CASE WHEN price IS NOT NULL THEN (price >= 100000)::INT + (price >= 200000)::INT END AS BIGINT) AS digit, CASE substr(pri, 3) WHEN 'URGENT' THEN 3.0::DOUBLE WHEN 'HIGH' THEN 2.0 WHEN 'MEDIUM' THEN 1.0 END AS ordinal FROM od")
add("d_status_rules", lambda s, d: od(s, d).select("id", C.ordered_status([(F.col("price") > 1e5, 1.0), (F.col("price") > 3e5, 2.0), (F.col("y") == 1, 3.0)]).alias("status"), C.subtype_proxy(F.col("y").cast("double"), F.col("price") / 10000, F.col("t").cast("double")).alias("subtype"), C.horizon_event(F.col("y"), F.col("score") * 1000, 365.0).alias("event_1y")),
    f"WITH {OD} SELECT id, CASE WHEN y = 1 THEN 3.0::DOUBLE WHEN price > 300000 THEN 2.0 WHEN price > 100000 THEN 1.0 END AS status, CASE WHEN y = 0 THEN 0.0::DOUBLE WHEN y = 1 AND price / 10000 < 25 AND t = 1 THEN 1.0 WHEN y = 1 THEN 2.0 END AS subtype, CASE WHEN y = 1 AND score * 1000 <= 365 THEN 1.0::DOUBLE WHEN score * 1000 >= 365 THEN 0.0 END AS event_1y FROM od")
add("d_text", lambda s, d: od(s, d).select("id", C.composite_key("yr", "id").alias("key"), C.availability(["price", "cust"]).alias("pattern"), C.scrub_paths(F.concat(F.lit("see /data/in/"), F.col("id").cast("string"), F.lit(".csv now"))).alias("text")),
    f"WITH {OD} SELECT id, yr || ':' || id AS key, CASE WHEN price IS NULL THEN '01' ELSE '11' END AS pattern, 'see <path> now' AS text FROM od")
add("d_confidence", lambda s, d: r6(od(s, d).select("id", C.sigmoid(F.col("score") * 4 - 2).alias("p"), C.logit(F.col("score")).alias("z"), C.confidence(F.col("score"), F.col("t"), 2).alias("confidence"), C.confidence_label(C.confidence(F.col("score"), F.col("t"), 2)).alias("label"))),
    f"WITH {OD} SELECT id, round(1 / (1 + exp(-(score * 4 - 2))), 6) AS p, round(ln(least(greatest(score, 1e-6), 1 - 1e-6) / (1 - least(greatest(score, 1e-6), 1 - 1e-6))), 6) AS z, round(1.2 * abs(score - 0.5) + 0.4 * (1 - t / 2.0), 6) AS confidence, CASE WHEN 1.2 * abs(score - 0.5) + 0.4 * (1 - t / 2.0) >= 0.78 THEN 'high' WHEN 1.2 * abs(score - 0.5) + 0.4 * (1 - t / 2.0) >= 0.62 THEN 'moderate' ELSE 'low' END AS label FROM od")
add("d_range_review", lambda s, d: od(s, d).select("id", F.size(C.out_of_range({"price": (1e5, 3e5), "score": (0.1, 0.9)})).cast("long").alias("n_bad"), F.size(C.readiness(["price"], ["cust"])).cast("long").alias("n_missing"), C.missing_count(["price", "cust"]).cast("long").alias("missing")),
    f"WITH {OD} SELECT id, CAST(coalesce((price NOT BETWEEN 100000 AND 300000)::INT, 0) + (score NOT BETWEEN 0.1 AND 0.9)::INT AS BIGINT) AS n_bad, CAST((price IS NULL)::INT AS BIGINT) AS n_missing, CAST((price IS NULL)::INT AS BIGINT) AS missing FROM od")
add("d_slots", lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(*(F.max(F.when(F.col("l_linenumber") == i, F.col("l_quantity"))).alias(f"s{i}") for i in (1, 2, 3))).select("l_orderkey", C.any_slot(["s1", "s2", "s3"], 25.0).alias("has")),
    "WITH w AS (SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_quantity END) a, max(CASE WHEN l_linenumber = 2 THEN l_quantity END) b, max(CASE WHEN l_linenumber = 3 THEN l_quantity END) c FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN coalesce(a = 25, false) OR coalesce(b = 25, false) OR coalesce(c = 25, false) THEN 1.0::DOUBLE WHEN a IS NOT NULL OR b IS NOT NULL OR c IS NOT NULL THEN 0.0 END AS has FROM w")
add("d_json_props", lambda s, d: ev(s, d).select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.array_join(F.map_keys(F.from_json("props", "map<string,string>")), ",").alias("keys")),
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'k' AS keys FROM events")

# ---- joins -----------------------------------------------------------------------------------------------------------------------
add("j_full_chain", lambda s, d: H.full_join_chain([od(s, d).filter("yr < 1998").groupBy("cust").agg(F.count("*").alias("a")), od(s, d).filter("yr > 1998").groupBy("cust").agg(F.count("*").alias("b")), od(s, d).filter("t = 1").groupBy("cust").agg(F.count("*").alias("c"))], "cust"),
    f"WITH {OD} SELECT cust, a, b, c FROM (SELECT cust, count(*) a FROM od WHERE yr < 1998 GROUP BY 1) FULL JOIN (SELECT cust, count(*) b FROM od WHERE yr > 1998 GROUP BY 1) USING (cust) FULL JOIN (SELECT cust, count(*) c FROM od WHERE t = 1 GROUP BY 1) USING (cust)")
add("j_before_index", lambda s, d: H.before_index(ev(s, d), "user_id", "ts", ev(s, d).filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("index_date"))).groupBy("user_id").agg(F.count("*").alias("n"), F.count("value").alias("observed")),
    f"WITH {EV}, ix AS (SELECT user_id, max(ts) m FROM ev WHERE event_type = 'purchase' GROUP BY 1) SELECT user_id, count(*) AS n, count(value) AS observed FROM ev JOIN ix USING (user_id) WHERE ts <= m GROUP BY 1")
add("j_first_batch", lambda s, d: H.first_seen_batch(od(s, d), "cust", "yr").select("id", "cust", "yr"),
    f"WITH {OD}, f AS (SELECT *, min(yr) OVER (PARTITION BY cust) m FROM od) SELECT id, cust, yr FROM f WHERE yr = m")
add("j_as_of", lambda s, d: H.as_of(ev(s, d).filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), ev(s, d).filter("event_type = 'view' AND value IS NOT NULL").select("user_id", "ts", "value"), "user_id", "ts", "ts", "value").select("event_id", "as_of_value"),
    f"WITH {EV} SELECT a.event_id, b.value AS as_of_value FROM (SELECT * FROM ev WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT user_id, ts, value FROM ev WHERE event_type = 'view' AND value IS NOT NULL) b ON a.user_id = b.user_id AND a.ts >= b.ts")
add("j_parity", lambda s, d: r6(H.parity(od(s, d).filter("id % 100 <> 0").select("id", "score"), od(s, d).select("id", (F.col("score") + 0.001).alias("score")), ["id"], "score", 0.01)),
    f"WITH {OD}, j AS (SELECT a.score x, b.score + 0.001 z FROM (SELECT * FROM od WHERE id % 100 <> 0) a FULL JOIN od b USING (id)) SELECT count(*) AS compared, count_if(x IS NULL OR z IS NULL) AS missing, round(max(abs(x - z)), 6) AS max_abs_difference, count_if(x IS NULL OR z IS NULL) = 0 AND max(abs(x - z)) <= 0.01 AS passed FROM j".replace("count_if(x IS NULL OR z IS NULL) AS missing", "CAST(count_if(x IS NULL OR z IS NULL) AS BIGINT) AS missing"))
add("j_index_visit", lambda s, d: H.pick_index_visit(ev(s, d), "user_id", "ts", F.lit("2024-01-31").cast("timestamp"), 5.0, 3.0, 2),
    "WITH v AS (SELECT DISTINCT user_id, ts FROM events), w AS (SELECT *, min(ts) OVER (PARTITION BY user_id) f, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 p FROM v) SELECT user_id, max(ts) AS index_date FROM w WHERE epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts) >= 5 * 86400000000 AND epoch_us(ts) - epoch_us(f) >= 3 * 86400000000 AND p >= 2 GROUP BY 1")
add("j_knn", lambda s, d: r6(H.knn(table(s, d, "embeddings").filter("vec_id % 50 = 0"), table(s, d, "embeddings"), "vec_id", "vec_id", "embedding", 3).select("query_id", F.col("rank").cast("long").alias("rank"), "base_id", "d2")),
    "WITH p AS (SELECT a.vec_id q, b.vec_id b, list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) d2 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, b) k FROM p) SELECT q AS query_id, CAST(k AS BIGINT) AS rank, b AS base_id, round(d2, 6) AS d2 FROM r WHERE k <= 3")

# ---- windows, sets, reshaping -------------------------------------------------------------------------------------------------------
add("w_zscore", lambda s, d: r6(H.group_zscore(od(s, d), "price", ["yr", "pri"]).select("id", "price_z")),
    f"WITH {OD} SELECT id, round((price - avg(price) OVER w) / nullif(stddev_samp(price) OVER w, 0), 6) AS price_z FROM od WINDOW w AS (PARTITION BY yr, pri)")
add("w_visits", lambda s, d: r6(H.visit_index(H.gap_since_previous(ev(s, d), "user_id", "ts"), "user_id", "ts").select("event_id", "gap_days", F.col("visit_index").cast("long").alias("visit_index"))),
    "SELECT event_id, round(coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 86400000000.0, 0.0), 6) AS gap_days, CAST(dense_rank() OVER w - 1 AS BIGINT) AS visit_index FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
add("w_last_k", lambda s, d: H.reverse_index(H.last_k(ev(s, d), "user_id", "ts", 5), "user_id", "visit_index").select("event_id", F.col("visit_index").cast("long").alias("visit_index")),
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) k FROM events) SELECT event_id, CAST(k - 1 AS BIGINT) AS visit_index FROM r WHERE k <= 5")
add("w_keep_last", lambda s, d: H.keep_last(ev(s, d), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value"),
    f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) k FROM ev) SELECT user_id, event_type, event_id, value FROM r WHERE k = 1")
add("w_order_violations", lambda s, d: H.order_violations(od(s, d), "cust", "d", "id"),
    f"WITH {OD}, l AS (SELECT cust, d < lag(d) OVER (PARTITION BY cust ORDER BY id) b FROM od) SELECT cust, CAST(coalesce(count_if(b), 0) AS BIGINT) AS violations FROM l GROUP BY 1")
add("w_pct_rank", lambda s, d: r6(H.average_pct_rank(od(s, d).select("id", "score"), "score").select("id", "score_pct")),
    f"WITH {OD} SELECT id, round((rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0) / count(*) OVER (), 6) AS score_pct FROM od")
add("w_reference_percentile", lambda s, d: r6(H.reference_percentile(od(s, d).filter("yr >= 2000").select("id", "score"), "score", od(s, d).filter("yr < 2000"), "score").select("id", "percentile")),
    f"WITH {OD}, r AS (SELECT score FROM od WHERE yr < 2000), q AS (SELECT DISTINCT score FROM od WHERE yr >= 2000), c AS (SELECT q.score, count(r.score) * 100.0 / (SELECT count(*) FROM r) p FROM q LEFT JOIN r ON r.score <= q.score GROUP BY 1) SELECT id, round(p, 6) AS percentile FROM od JOIN c USING (score) WHERE yr >= 2000")
add("w_tertile", lambda s, d: H.tertile(od(s, d).select("id", "price"), "price", "id").select("id", "tertile"),
    f"WITH {OD}, r AS (SELECT id, row_number() OVER (ORDER BY price, id) k, count(*) OVER () n FROM od WHERE price IS NOT NULL) SELECT id, CASE WHEN k <= 1 + (n - 1) / 3.0 THEN 'low' WHEN k <= 1 + 2 * (n - 1) / 3.0 THEN 'mid' ELSE 'high' END AS tertile FROM r")
add("t_drop_top", lambda s, d: H.drop_top_share(table(s, d, "events").select("event_id", (F.col("value") * 1000 + F.col("event_id") / 100000.0).alias("v")), "v", 0.01).select("event_id"),
    "WITH r AS (SELECT event_id, row_number() OVER (ORDER BY value * 1000 + event_id / 100000.0 DESC) k, count(*) OVER () n FROM events) SELECT event_id FROM r WHERE k > floor(n * 0.01)")
add("t_topk", lambda s, d: od(s, d).filter("price IS NOT NULL").orderBy(F.desc("price"), "id").limit(25).select("id", "price"),
    f"WITH {OD} SELECT id, price FROM od WHERE price IS NOT NULL ORDER BY price DESC, id LIMIT 25")
add("u_overlap", lambda s, d: H.overlap(od(s, d), "cust", "st"),
    f"WITH {OD} SELECT cust, count(DISTINCT st) AS splits FROM od GROUP BY 1 HAVING count(DISTINCT st) > 1")
add("u_union_loose", lambda s, d: H.union_loose([od(s, d).filter("y = 1").select("id", "price"), od(s, d).filter("t = 1").select("id", "score")]),
    f"WITH {OD} SELECT id, price, NULL::DOUBLE AS score FROM od WHERE y = 1 UNION ALL SELECT id, NULL, score FROM od WHERE t = 1")
add("n_visit_matrix", lambda s, d: r6(H.visit_matrix(ev(s, d).withColumn("day", F.date_trunc("day", "ts")), "user_id", "day", "event_type", "value", TYPES, "event_id").withColumn("visit_index", F.col("visit_index").cast("long")).withColumn("observed_feature_count", F.col("observed_feature_count").cast("long")).drop(*(f"mask_{t}" for t in TYPES))),
    f"WITH {EV}, a AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, event_type, arg_min({{'v': value}}, event_id).v AS v FROM ev GROUP BY 1, 2, 3), m AS (SELECT user_id, day, " + ", ".join(f"max(CASE WHEN event_type = '{t}' THEN v END) AS feature_{t}" for t in TYPES) + " FROM a GROUP BY 1, 2) SELECT user_id, day, " + ", ".join(f"round(feature_{t}, 6) AS feature_{t}" for t in TYPES) + ", round(coalesce((epoch_us(day) - epoch_us(lag(day) OVER w)) / 86400000000.0, 0.0), 6) AS gap_days, CAST(dense_rank() OVER w - 1 AS BIGINT) AS visit_index, round(count(*) OVER p / (greatest((epoch_us(max(day) OVER p) - epoch_us(min(day) OVER p)) / 86400000000.0, 1.0) / 365.25), 4) AS visit_density_per_year, CAST(" + " + ".join(f"(feature_{t} IS NOT NULL)::INT" for t in TYPES) + " AS BIGINT) AS observed_feature_count FROM m WINDOW w AS (PARTITION BY user_id ORDER BY day), p AS (PARTITION BY user_id)")
add("n_intervals", lambda s, d: H.person_intervals(od(s, d).withColumn("time", F.col("score") * 2000).withColumn("event", F.col("y") + 2 * F.col("t")), "time", "event", 1825.0, 182.625).select("id", F.col("interval").cast("long").alias("interval"), F.col("event_here").cast("long").alias("event_here"), F.col("competing_here").cast("long").alias("competing_here")),
    f"WITH {OD}, a AS (SELECT id, score * 2000 AS time, y + 2 * t AS event FROM od), b AS (SELECT *, CAST(ceil(least(greatest(time, 1.0), 1825.0) / 182.625) AS INT) n FROM a), c AS (SELECT *, unnest(range(n)) AS interval FROM b) SELECT id, CAST(interval AS BIGINT) AS interval, CAST(interval = n - 1 AND time <= 1825 AND event = 1 AS BIGINT) AS event_here, CAST(interval = n - 1 AND time <= 1825 AND event = 2 AS BIGINT) AS competing_here FROM c")
add("n_sequences", lambda s, d: H.sequences(ev(s, d), "user_id", "ts", ["value"], 4).select("user_id", F.col("length").cast("long").alias("length"), rounded(F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x[0]), 6).alias("total"), F.size("sequence").cast("long").alias("padded")),
    f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) k FROM ev) SELECT user_id, count(*) AS length, round(sum(coalesce(value, 0.0)), 6) AS total, CAST(4 AS BIGINT) AS padded FROM r WHERE k <= 4 GROUP BY 1")
add("d_one_hot", lambda s, d: H.one_hot(od(s, d), "st", ["F", "O"]).select("id", "st_F", "st_O"),
    f"WITH {OD} SELECT id, CAST(st = 'F' AS DOUBLE) AS \"st_F\", CAST(st = 'O' AS DOUBLE) AS \"st_O\" FROM od")

# ---- aggregations -----------------------------------------------------------------------------------------------------------------
OUT = "SELECT user_id, ts, CASE event_type WHEN 'purchase' THEN 'disease' WHEN 'error' THEN 'competing' ELSE 'none' END AS outcome_type, CASE WHEN event_type IN ('purchase', 'error') AND event_id % 29 = 0 THEN ts END AS event_date FROM events"


def outcomes(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "disease").when(F.col("event_type") == "error", "competing").otherwise("none")
    return e.select("user_id", "ts", kind.alias("outcome_type"), F.when(F.col("event_type").isin("purchase", "error") & (F.col("event_id") % 29 == 0), F.col("ts")).alias("event_date"))


add("a_outcome_table", lambda s, d: S.outcome_table(outcomes(s, d), "user_id", ["disease", "competing"]),
    f"WITH o AS ({OUT}) SELECT user_id, min(ts) AS first_observation, max(ts) AS last_record, count(DISTINCT ts) AS visits, min(CASE WHEN outcome_type = 'disease' THEN event_date END) AS disease_date, min(CASE WHEN outcome_type = 'competing' THEN event_date END) AS competing_date FROM o GROUP BY 1")
add("a_first_by", lambda s, d: S.first_by(ev(s, d), "user_id", "value", "ts"),
    f"WITH {EV}, r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) k FROM ev WHERE value IS NOT NULL) SELECT user_id, value AS first_value FROM r WHERE k = 1")
add("a_coverage", lambda s, d: r6(S.coverage(od(s, d), ["price", "score"], ["yr", "st"])),
    f"WITH {OD}, l AS (SELECT yr, st, 'price' AS feature, price AS v FROM od UNION ALL SELECT yr, st, 'score', score FROM od) SELECT feature, yr, st, round(avg((v IS NOT NULL)::INT), 6) AS coverage, count(*) AS n FROM l GROUP BY GROUPING SETS ((feature), (feature, yr), (feature, st))")
add("a_quantiles", lambda s, d: r6(S.quantiles(od(s, d), ["price", "score"], [0.1, 0.5, 0.9], ["yr"])),
    f"WITH {OD}, l AS (SELECT yr, 'price' AS feature, price AS v FROM od UNION ALL SELECT yr, 'score', score FROM od) SELECT yr, feature, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90 FROM l GROUP BY 1, 2")
add("a_distribution", lambda s, d: r6(S.distribution(ev(s, d), "value", ["event_type"])),
    f"WITH {EV} SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS p{round(100 * q)}" for q in (0.5, 0.9, 0.95, 0.99)) + " FROM ev GROUP BY 1")
# A value that is not a number, one that moves with the year, one of three years, one that is there in exactly half of the rows.
odd_features = lambda s, d: od(s, d).withColumn("score", F.when(F.col("id") % 37 == 0, float("nan")).otherwise(F.col("score"))).withColumn("moving", F.col("price") + (F.col("yr") - 1995) * 60000).withColumn("gappy", F.when(F.col("yr") < 1995, F.col("price"))).withColumn("half", F.col("price"))
odd_twice = lambda s, d: odd_features(s, d).filter("price IS NOT NULL").transform(lambda x: x.unionByName(x.withColumn("half", F.lit(None).cast("double"))))
ODDS = f"{OD}, odd AS (SELECT *, CASE WHEN id % 37 = 0 THEN NULL ELSE score END AS s2, price + (yr - 1995) * 60000 AS moving, CASE WHEN yr < 1995 THEN price END AS gappy FROM od), odd2 AS (SELECT *, price AS half FROM odd WHERE price IS NOT NULL UNION ALL SELECT *, NULL FROM odd WHERE price IS NOT NULL)"
FEATURE_ROWS = lambda t, cols: " UNION ALL ".join(f"SELECT yr, '{n}' AS feature, {e} AS v FROM {t}" for n, e in cols.items())
DRIFT = "m AS (SELECT feature, quantile_cont(v, 0.5) m, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) iqr FROM l GROUP BY 1), cy AS (SELECT feature, yr, quantile_cont(v, 0.5) cm, avg((v IS NOT NULL)::INT) s FROM l WHERE yr IS NOT NULL GROUP BY 1, 2), dr AS (SELECT feature, coalesce(max(abs(cm - m) / iqr), 0) AS x, CAST(count_if(s > 0.01) AS BIGINT) AS k, count_if(s > 0.01) / count(*) AS av FROM cy JOIN m USING (feature) WHERE iqr > 0 GROUP BY 1)"
FOUR = {"price": "price", "score": "s2", "moving": "moving", "gappy": "gappy"}
add("a_drift", lambda s, d: r6(S.cycle_drift(odd_features(s, d), list(FOUR), "yr")),
    f"WITH {ODDS}, l AS ({FEATURE_ROWS('odd', FOUR)}), {DRIFT} SELECT feature, round(x, 6) AS max_shift, k AS cycles, round(av, 6) AS availability, x > 1.0 AS drift, av < 0.6 AS gap FROM dr")
add("a_plausibility", lambda s, d: r6(S.plausibility(od(s, d), {"price": (2e4, 4.5e5), "score": (0.0, 0.7)})),
    f"WITH {OD}, l AS (SELECT 'price' AS feature, price AS v, 20000.0 a, 450000.0 b FROM od UNION ALL SELECT 'score', score, 0.0, 0.7 FROM od), g AS (SELECT feature, count(*) AS observed, CAST(count_if(v < a OR v > b) AS BIGINT) AS out_of_range, min(v) AS least, max(v) AS most FROM l WHERE v IS NOT NULL GROUP BY 1) SELECT feature, observed, out_of_range, round(least, 6) AS least, round(most, 6) AS most, out_of_range / observed > 0.01 AS flagged, out_of_range / observed > 0.1 AS hard FROM g")
add("a_duplicates", lambda s, d: S.duplicate_report(ev(s, d).select("user_id", "event_type"), "user_id"),
    "WITH g AS (SELECT user_id, event_type, count(*) n FROM events GROUP BY 1, 2), u AS (SELECT user_id, sum(n) r, count(*) k FROM g GROUP BY 1) SELECT CAST(sum(r) AS BIGINT) AS rows, CAST(sum(r) - sum(k) AS BIGINT) AS duplicate_rows, count(user_id) AS ids, CAST(count_if(r > 1) AS BIGINT) AS repeated_ids FROM u")
add("a_label_counts", lambda s, d: S.label_counts(od(s, d), ["y", "t"]),
    f"WITH {OD}, l AS (SELECT 'y' AS label, y v FROM od UNION ALL SELECT 't', t FROM od) SELECT label, CAST(count_if(v = 1) AS BIGINT) AS positive, CAST(count_if(v = 0) AS BIGINT) AS negative, CAST(count_if(v IS NULL) AS BIGINT) AS missing FROM l GROUP BY 1")
add("a_horizon_gate", lambda s, d: S.horizon_gate(od(s, d).withColumn("time", F.col("score") * 2000), "time", "y", [365.0, 1095.0, 1825.0]),
    f"WITH {OD}, h AS (SELECT unnest([365.0, 1095.0, 1825.0])::DOUBLE AS horizon) SELECT horizon, CAST(count_if(y = 1 AND score * 2000 <= horizon) AS BIGINT) AS events, CAST(count_if(score * 2000 >= horizon) AS BIGINT) AS non_events, count_if(y = 1 AND score * 2000 <= horizon) >= 50 AND count_if(score * 2000 >= horizon) >= 50 AS open FROM od, h GROUP BY 1")
add("a_class_balance", lambda s, d: r6(S.class_balance(od(s, d).withColumn("time", F.col("score") * 2000).withColumn("cause", F.col("y") + 2 * F.col("t")), [365, 1095], "time", "cause").withColumn("horizon", F.col("horizon").cast("long"))),
    f"WITH {OD}, h AS (SELECT unnest([365, 1095]) AS horizon), a AS (SELECT horizon, score * 2000 AS time, y + 2 * t AS cause FROM od, h), g AS (SELECT horizon, count_if(cause = 1 AND time <= horizon) c, count_if(cause = 2 AND time <= horizon) k, count_if(cause = 0 AND time < horizon) z, count_if(NOT (cause = 0 AND time < horizon) AND NOT (cause = 2 AND time <= horizon)) e FROM a GROUP BY 1) SELECT CAST(horizon AS BIGINT) AS horizon, CAST(c AS BIGINT) AS cases, CAST(k AS BIGINT) AS competing, CAST(z AS BIGINT) AS censored, CAST(e AS BIGINT) AS eligible, round(c / e, 6) AS prevalence FROM g")
add("a_trajectory", lambda s, d: r6(S.trajectory_features(ev(s, d), "user_id", "ts", ["value"])),
    f"WITH {EV}, a AS (SELECT *, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 86400000000.0 / 365.25 AS yt, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 86400000000.0 AS gap FROM ev) SELECT user_id, count(*) AS visit_count, round(max(yt) * 365.25, 6) AS history_days, round(count(*) / (greatest(max(yt) * 365.25, 1.0) / 365.25), 4) AS visit_density_per_year, round(coalesce(quantile_cont(gap, 0.5), 0.0), 6) AS median_visit_gap_days, round(1 - count(value) / count(*), 6) AS missingness_burden, count(value) AS value_observed_count, round(arg_max(value, CASE WHEN value IS NOT NULL THEN yt END), 6) AS value_last, round(avg(value), 6) AS value_mean, round(CASE WHEN count(value) >= 2 THEN arg_max(value, CASE WHEN value IS NOT NULL THEN yt END) - arg_min(value, CASE WHEN value IS NOT NULL THEN yt END) WHEN count(value) = 1 THEN 0.0 END, 6) AS value_delta, round(CASE WHEN count(value) >= 2 THEN coalesce(covar_pop(value, yt) FILTER (value IS NOT NULL) / nullif(var_pop(yt) FILTER (value IS NOT NULL), 0), 0.0) WHEN count(value) = 1 THEN 0.0 END, 6) AS value_slope_per_year FROM a GROUP BY 1")
add("a_cramers_v", lambda s, d: r6(S.cramers_v(od(s, d), "pri", "st")),
    f"WITH {OD}, c AS (SELECT pri, st, count(*)::DOUBLE n FROM od GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY pri) a, sum(n) OVER (PARTITION BY st) b FROM c), s AS (SELECT sum(n) n, sum(n * n / (a * b)) q, count(DISTINCT pri) r, count(DISTINCT st) k FROM m) SELECT round(n * (q - 1), 6) AS chi2, round(sqrt(greatest(0, (q - 1) - (k - 1) * (r - 1) / (n - 1)) / least(r - (r - 1) * (r - 1) / (n - 1) - 1, k - (k - 1) * (k - 1) / (n - 1) - 1)), 6) AS cramers_v FROM s")
add("a_correlation_ratio", lambda s, d: r6(S.correlation_ratio(od(s, d), "pri", "price")),
    f"WITH {OD}, g AS (SELECT pri, avg(price) m, count(*) n FROM od WHERE price IS NOT NULL GROUP BY 1), t AS (SELECT avg(price) g, var_pop(price) * count(price) v FROM od) SELECT round(sqrt(sum(n * (m - g) * (m - g)) / max(v)), 6) AS eta FROM g, t")
add("a_robust", lambda s, d: r6(S.robust_location_scale(ev(s, d), "value", ["event_type"])),
    f"WITH {EV}, m AS (SELECT event_type, quantile_cont(value, 0.5) med FROM ev GROUP BY 1) SELECT event_type, round(med, 6) AS median, round(greatest(1.4826 * quantile_cont(abs(value - med), 0.5), 1e-8), 6) AS scale FROM ev JOIN m USING (event_type) GROUP BY event_type, med")
add("a_robust_smd", lambda s, d: r6(S.robust_smd(od(s, d), "y", "price")),
    f"WITH {OD}, m AS (SELECT quantile_cont(price, 0.5) med FROM od WHERE y = 0), k AS (SELECT med, 1.4826 * quantile_cont(abs(price - med), 0.5) sc FROM od, m WHERE y = 0 GROUP BY med) SELECT round((quantile_cont(price, 0.5) - max(med)) / max(sc), 6) AS robust_smd FROM od, k WHERE y = 1")
add("a_spearman", lambda s, d: r6(S.spearman(od(s, d), "price", "yr")),
    f"WITH {OD}, r AS (SELECT rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0 a, rank() OVER (ORDER BY yr) + (count(*) OVER (PARTITION BY yr) - 1) / 2.0 b FROM od WHERE price IS NOT NULL) SELECT round(corr(a, b), 6) AS spearman FROM r")
add("a_top_jaccard", lambda s, d: r6(S.top_flag_jaccard(od(s, d), "price", "score")),
    f"WITH {OD}, q AS (SELECT quantile_cont(price, 0.95) a, quantile_cont(score, 0.95) b FROM od) SELECT round(count_if(price >= a AND score >= b) / count_if(price >= a OR score >= b), 6) AS jaccard FROM od, q")
add("a_effects", lambda s, d: r6(S.difference_in_means(od(s, d), "y", "price").crossJoin(S.stratified_effect(od(s, d), "y", "price", "pri").withColumnRenamed("effect", "stratified"))),
    f"WITH {OD}, g AS (SELECT pri, avg(price) FILTER (y = 1) - avg(price) FILTER (y = 0) e, count(*) n FROM od GROUP BY 1) SELECT round((SELECT avg(price) FILTER (y = 1) - avg(price) FILTER (y = 0) FROM od), 6) AS effect, round(sum(e * n) / sum(n), 6) AS stratified FROM g")
add("a_adjusted_rand", lambda s, d: r6(S.adjusted_rand(od(s, d), "pri", "st")),
    f"WITH {OD}, c AS (SELECT pri, st, count(*)::DOUBLE n FROM od GROUP BY 1, 2), x AS (SELECT sum(n * (n - 1) / 2) s, sum(n) n FROM c), a AS (SELECT sum(m * (m - 1) / 2) s FROM (SELECT sum(n) m FROM c GROUP BY pri)), b AS (SELECT sum(m * (m - 1) / 2) s FROM (SELECT sum(n) m FROM c GROUP BY st)) SELECT round((x.s - a.s * b.s / (x.n * (x.n - 1) / 2)) / ((a.s + b.s) / 2 - a.s * b.s / (x.n * (x.n - 1) / 2)), 6) AS ari FROM x, a, b")
add("a_clusterwise_jaccard", lambda s, d: r6(S.clusterwise_jaccard(od(s, d), "pri", "st")),
    f"WITH {OD}, c AS (SELECT pri, st, count(*) n FROM od GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY pri) a, sum(n) OVER (PARTITION BY st) b FROM c) SELECT pri AS cluster, round(max(n / (a + b - n)), 6) AS jaccard FROM m GROUP BY 1")
add("a_suppressed", lambda s, d: r6(S.suppressed_prevalence(od(s, d), "cust", "y", 12)),
    f"WITH {OD} SELECT cust, CASE WHEN count(y) >= 12 THEN count(y) END AS n, round(CASE WHEN count(y) >= 12 THEN avg(y) END, 6) AS prevalence, count(y) < 12 AS suppressed FROM od GROUP BY 1")
add("a_mean_shift", lambda s, d: r6(S.mean_shift(od(s, d), "y", ["price", "score"])),
    f"WITH {OD}, l AS (SELECT y, 'price' AS feature, price v FROM od UNION ALL SELECT y, 'score', score FROM od), g AS (SELECT feature, avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0) x FROM l GROUP BY 1) SELECT feature, round(x, 6) AS shift, CASE WHEN x > 0 THEN 'higher' ELSE 'lower' END AS direction FROM g")
add("a_size_profile", lambda s, d: r6(S.size_profile(table(s, d, "embeddings").withColumn("label", F.when(F.col("vec_id") % 9 == 0, -1).when(F.col("vec_id") % 31 > 0, F.col("label"))), "label")),
    "WITH e AS (SELECT CASE WHEN vec_id % 9 = 0 THEN -1 WHEN vec_id % 31 > 0 THEN label ELSE -1 END AS l FROM embeddings), g AS (SELECT l, count(*) n FROM e GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (l <> -1) AS clusters, round(sum(n) FILTER (l = -1) / sum(n), 6) AS noise_share, round(min(n) FILTER (l <> -1) / sum(n), 6) AS smallest_share FROM g")
add("a_cluster_deviation", lambda s, d: r6(S.deviation_by_cluster(table(s, d, "embeddings").select(F.col("label").cast("long").alias("label"), F.col("embedding")[0].cast("double").alias("dev")), "label", "dev")),
    "SELECT CAST(label AS BIGINT) AS label, count(*) AS n, round(quantile_cont(embedding[1]::DOUBLE, 0.5), 6) AS deviation_median, round(quantile_cont(embedding[1]::DOUBLE, 0.9), 6) AS deviation_p90 FROM embeddings GROUP BY 1")
add("a_cluster_sizes", lambda s, d: r6(S.cluster_sizes(table(s, d, "embeddings"), "label")),
    "SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM embeddings GROUP BY 1")
add("a_count_gate", lambda s, d: S.count_gate(od(s, d), "cust", 10).select("cust", F.col("count").alias("n"), "open"),
    f"WITH {OD} SELECT cust, count(*) AS n, count(*) >= 10 AS open FROM od GROUP BY 1")

# ---- metrics ----------------------------------------------------------------------------------------------------------------------
RK = "r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 k FROM od)"
add("m_auroc", lambda s, d: r6(S.auroc(od(s, d), "y", "score")),
    f"WITH {OD}, {RK} SELECT round((sum(k) FILTER (y = 1) - count_if(y = 1) * (count_if(y = 1) + 1) / 2) / (count_if(y = 1) * count_if(y = 0)), 6) AS auroc FROM r")
add("m_average_precision", lambda s, d: r6(S.average_precision(od(s, d), "y", "score")),
    f"WITH {OD}, g AS (SELECT score, sum(y)::DOUBLE p, count(*)::DOUBLE n FROM od GROUP BY 1), c AS (SELECT p, sum(p) OVER w tp, sum(n) OVER w a, sum(p) OVER () t FROM g WINDOW w AS (ORDER BY score DESC)) SELECT round(sum(p / t * tp / a), 6) AS average_precision FROM c")
add("m_threshold", lambda s, d: r6(S.threshold_metrics(od(s, d), "y", "score")),
    f"WITH {OD}, c AS (SELECT count_if(score >= 0.5 AND y = 1)::DOUBLE tp, count_if(score >= 0.5 AND y = 0)::DOUBLE fp, count_if(score < 0.5 AND y = 1)::DOUBLE fn, count_if(score < 0.5 AND y = 0)::DOUBLE tn FROM od), m AS (SELECT (tp + tn) / (tp + fp + fn + tn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, tn / (tn + fp) AS specificity, (tp + fp) / (tp + fp + fn + tn) AS positive_rate FROM c) SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(specificity, 6) AS specificity, round(positive_rate, 6) AS positive_rate, round((recall + specificity) / 2, 6) AS balanced_accuracy, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM m")
add("m_brier", lambda s, d: r6(S.brier(od(s, d), "y", "score", ["pri"])),
    f"WITH {OD} SELECT pri, round(avg((score - y) * (score - y)), 6) AS brier FROM od GROUP BY 1")
add("m_calibration_curve", lambda s, d: r6(S.calibration_curve(od(s, d), "y", "score", "id").withColumn("chunk", F.col("chunk").cast("long"))),
    f"WITH {OD}, c AS (SELECT y, score, ntile(10) OVER (ORDER BY score, id) - 1 AS chunk FROM od) SELECT CAST(chunk AS BIGINT) AS chunk, round(avg(score), 6) AS mean_score, round(avg(y), 6) AS observed, count(*) AS n FROM c GROUP BY 1")
add("m_decision_curve", lambda s, d: r6(S.decision_curve(od(s, d), "y", "score", [0.1, 0.3, 0.5])),
    f"WITH {OD}, h AS (SELECT unnest([0.1, 0.3, 0.5])::DOUBLE AS threshold) SELECT threshold, CAST(count_if(score >= threshold) AS BIGINT) AS flagged, round(count_if(score >= threshold) / count(*), 6) AS flagged_share, round(100 * count_if(score >= threshold AND y = 0) / count(*), 6) AS false_alerts_per_100, CAST(count_if(score >= threshold AND y = 1) AS BIGINT) AS tp, CAST(count_if(score >= threshold AND y = 0) AS BIGINT) AS fp, round(count_if(score >= threshold AND y = 1) / count(*) - count_if(score >= threshold AND y = 0) / count(*) * threshold / (1 - threshold), 6) AS net_benefit, round(avg(y) - (1 - avg(y)) * threshold / (1 - threshold), 6) AS treat_all FROM od, h GROUP BY threshold")
add("m_subgroups", lambda s, d: r6(S.subgroup_metrics(od(s, d), "y", "score", ["pri"]).withColumn("events", F.col("events").cast("long"))),
    f"WITH {OD}, r AS (SELECT pri, y, score, rank() OVER (PARTITION BY pri ORDER BY score) + (count(*) OVER (PARTITION BY pri, score) - 1) / 2.0 k FROM od) SELECT 'pri' AS subgroup, pri AS level, count(*) AS n, CAST(sum(y) AS BIGINT) AS events, round(CASE WHEN sum(y) >= 10 THEN avg((score - y) * (score - y)) END, 6) AS brier, round(CASE WHEN sum(y) >= 10 THEN (sum(k) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) END, 6) AS auroc FROM r GROUP BY pri")
add("m_select_model", lambda s, d: P.select_model(r6(od(s, d).groupBy("yr", F.col("pri").alias("model")).agg((F.avg("price") / 250000).alias("slope"), (F.avg("y") + 0.3).alias("auroc"))), ["yr"]).select("yr", "model", "abstains"),
    f"WITH {OD}, c AS (SELECT yr, pri AS model, round(avg(price) / 250000, 6) slope, round(avg(y) + 0.3, 6) auroc FROM od GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY yr ORDER BY abs(slope - 1), auroc DESC, model) k FROM c WHERE slope >= 0.2 AND auroc >= 0.6) SELECT y.yr, model, model IS NULL AS abstains FROM (SELECT DISTINCT yr FROM c) y LEFT JOIN (SELECT * FROM r WHERE k = 1) USING (yr)")
add("m_c_index", lambda s, d: r6(S.c_index(od(s, d), "score", "y", "price")),
    f"WITH {OD} SELECT round(avg(CASE WHEN a.price > b.price THEN 1.0::DOUBLE WHEN a.price = b.price THEN 0.5 ELSE 0.0 END), 6) AS c_index FROM od a JOIN od b ON a.score < b.score WHERE a.y = 1")

# ---- pipelines --------------------------------------------------------------------------------------------------------------------
add("q_cohort", lambda s, d: r6(P.build_cohort(outcomes(s, d), "user_id", "disease", 5.0, [10, 20]).select("user_id", "time_days", F.col("cause").cast("long").alias("cause"), F.col("label_10").cast("long").alias("label_10"), F.col("label_20").cast("long").alias("label_20"))),
    f"WITH o AS ({OUT}), a AS (SELECT user_id, min(ts) f, max(ts) l, min(CASE WHEN outcome_type = 'disease' THEN event_date END) e, min(CASE WHEN outcome_type = 'competing' THEN event_date END) c FROM o GROUP BY 1), b AS (SELECT user_id, (epoch_us(l) - epoch_us(f)) / 86400000000.0 - 5 fu, (epoch_us(e) - epoch_us(f)) / 86400000000.0 - 5 ed, (epoch_us(c) - epoch_us(f)) / 86400000000.0 - 5 cd FROM a), k AS (SELECT *, least(ed, cd, fu) AS t FROM b WHERE NOT coalesce(ed <= 0, false) AND fu > 0), z AS (SELECT user_id, t, CASE WHEN ed = t THEN 1 WHEN cd = t THEN 2 ELSE 0 END AS cause FROM k) SELECT user_id, round(t, 6) AS time_days, CAST(cause AS BIGINT) AS cause, " + ", ".join(f"CAST(CASE WHEN cause = 1 AND t <= {h} THEN 1 WHEN t >= {h} THEN 0 WHEN cause = 2 THEN 0 END AS BIGINT) AS label_{h}" for h in (10, 20)) + " FROM z")
RULES = {"negative": "value < 1", "late": "ts > TIMESTAMP '2024-01-25'", "odd_type": "event_type NOT IN ('click', 'view', 'purchase', 'signup', 'error')"}
add("q_event_findings", lambda s, d: P.validate_events(ev(s, d), ["user_id", "event_type", "ts"], "ts", "event_id", {k: F.expr(v) for k, v in RULES.items()})[1],
    f"WITH {EV} SELECT code, CAST(sum(n) AS BIGINT) AS rows FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS code, count(*) n FROM ev WHERE {v}" for k, v in RULES.items() if k != "odd_type") + " UNION ALL SELECT 'duplicate_key', sum(c - 1) FROM (SELECT count(*) c FROM ev GROUP BY user_id, event_type, ts)) GROUP BY 1 HAVING sum(n) > 0 OR code = 'duplicate_key'")
TIERED = ["price", "score", "moving", "gappy", "half", "absent", "y"]
add("q_eligibility", lambda s, d: r6(P.eligibility(odd_twice(s, d), TIERED, "yr", {"price": (2e4, 4.5e5), "score": (0.0, 0.7), "half": (0.0, 1e9)}, denied=["y", "t"], weak_evidence=["score"])),
    f"WITH {ODDS}, l AS ({FEATURE_ROWS('odd2', FOUR | {'half': 'half'})}), {DRIFT}, g AS (SELECT feature, avg((v IS NOT NULL)::INT) c, count_if(feature = 'price' AND v NOT BETWEEN 20000 AND 450000 OR feature = 'score' AND v NOT BETWEEN 0 AND 0.7) / count(v) b FROM l GROUP BY 1), "
    "w AS (SELECT feature, c, concat_ws(',', CASE WHEN c < 0.5 THEN 'coverage' END, CASE WHEN av < 0.6 THEN 'gap' END, CASE WHEN x > 1 THEN 'drift' END, CASE WHEN b > 0.01 THEN 'range' END, CASE WHEN feature = 'score' THEN 'weak_evidence' END) AS r FROM g LEFT JOIN dr USING (feature)) "
    "SELECT feature, round(c, 6) AS coverage, CASE WHEN c < 0.05 THEN 'unavailable' WHEN r = '' THEN 'usable_now' ELSE 'qualified_use' END AS tier, CASE WHEN c < 0.05 THEN 'coverage' ELSE r END AS reasons FROM w UNION ALL SELECT 'absent', NULL, 'unavailable', 'absent' UNION ALL SELECT unnest(['y', 't']), NULL, 'prohibited', 'denied'")
add("q_units", lambda s, d: r6(P.harmonise_units(ev(s, d).withColumn("unit", F.when(F.col("event_id") % 2 == 0, "a").otherwise("b")), "event_type", "unit", "value", s.createDataFrame([("view", "a", "z", 18.0, 1.5), ("click", "b", "z", 0.5, 0.0)], "event_type string, unit string, target_unit string, slope double, intercept double")).select("event_id", "value", "unit", "unit_known")),
    f"WITH {EV}, u AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END unit FROM ev) SELECT event_id, round(CASE WHEN event_type = 'view' AND unit = 'a' THEN value * 18 + 1.5 WHEN event_type = 'click' AND unit = 'b' THEN value * 0.5 ELSE value END, 6) AS value, CASE WHEN (event_type = 'view' AND unit = 'a') OR (event_type = 'click' AND unit = 'b') THEN 'z' ELSE unit END AS unit, (event_type = 'view' AND unit = 'a') OR (event_type = 'click' AND unit = 'b') AS unit_known FROM u")
add("q_implausible", lambda s, d: P.null_implausible(ev(s, d).withColumn("reason", F.lit("none")), "event_type", "value", "reason", {"view": (1.0, 100.0), "error": (5.0, 200.0)}).groupBy("event_type", "reason").agg(F.count("value").alias("n_values"), F.count("*").alias("n")),
    f"WITH {EV}, b AS (SELECT event_type, value, coalesce(event_type = 'view' AND value NOT BETWEEN 1 AND 100, false) OR coalesce(event_type = 'error' AND value NOT BETWEEN 5 AND 200, false) bad FROM ev) SELECT event_type, CASE WHEN bad THEN 'implausible' ELSE 'none' END AS reason, CAST(count_if(value IS NOT NULL AND NOT bad) AS BIGINT) AS n_values, count(*) AS n FROM b GROUP BY 1, 2")
add("s_fixture", lambda s, d: IO.fixture_extract(ev(s, d), "user_id", 10).groupBy("user_id").count().withColumnRenamed("count", "n"),
    "SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT DISTINCT user_id FROM events ORDER BY 1 LIMIT 10) GROUP BY 1")
add("s_preview", lambda s, d: IO.preview(od(s, d).orderBy("id").select("id", "pri", "st"), 5),
    f"WITH {OD} SELECT CAST(id AS VARCHAR) AS id, pri, st FROM od ORDER BY od.id LIMIT 5")
add("l_cumulative_incidence", lambda s, d: r6(M.cumulative_incidence(ev(s, d).filter("value IS NOT NULL").select("user_id", F.col("event_id").alias("interval"), (F.col("value") / 10000).alias("h"), F.lit(0.001).alias("c")), "user_id")),
    f"WITH {EV}, a AS (SELECT user_id, value / 10000 h, coalesce(exp(sum(ln(1 - value / 10000 - 0.001)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1.0) s FROM ev WHERE value IS NOT NULL) SELECT user_id, round(sum(s * h), 6) AS cumulative_incidence FROM a GROUP BY 1")
add("l_latent_distance", lambda s, d: r6(M.latent_distance(table(s, d, "embeddings"), "vec_id", "embedding")),
    "WITH l AS (SELECT vec_id, unnest(embedding::DOUBLE[]) v, unnest(range(len(embedding))) i FROM embeddings), m AS (SELECT i, avg(v) a, stddev_pop(v) sd FROM l GROUP BY 1) SELECT vec_id, round(avg((v - a) / sd * (v - a) / sd), 6) AS latent_distance FROM l JOIN m USING (i) GROUP BY 1")

# ---- without a SQL equivalent --------------------------------------------------------------------------------------------------------
EMB = lambda s, d: table(s, d, "embeddings")
RISK = ["score", "yr"]
add("x_group_split", lambda s, d: H.group_split(od(s, d), "cust", [("train", 0.7), ("validation", 0.15), ("test", 0.15)]).select("id", "cust", "split"))
add("x_stratified_folds", lambda s, d: H.stratified_folds(od(s, d).select("id", "y"), "y", "id", 5))
add("x_permutation", lambda s, d: H.permute_column(od(s, d).select("id", "y"), "y", "id"))
add("m_bootstrap", lambda s, d: E.bootstrap(od(s, d), "y", "score"))
add("l_logistic", lambda s, d: M.logistic(od(s, d).filter("yr < 2000"), od(s, d).filter("yr >= 2000"), "y", RISK).select("id", "y", "score"))
add("l_boosted", lambda s, d: M.boosted(od(s, d).filter("yr < 2000"), od(s, d).filter("yr >= 2000"), "y", ["yr", "t"], rounds=5).select("id", "y", "score"))
add("l_calibrate", lambda s, d: M.calibrate(od(s, d).filter("yr < 2000"), od(s, d).filter("yr >= 2000"), "score", "y").select("id", "y", "calibrated"))
add("l_pca_deviation", lambda s, d: M.pca_deviation(EMB(s, d), "vec_id", "embedding"))
add("l_isolation_forest", lambda s, d: M.isolation_forest(EMB(s, d), "vec_id", "embedding", trees=50))
add("l_kmeans", lambda s, d: (lambda fit: M.margin_confidence(fit[0], "embedding", fit[1]).select("vec_id", "cluster", "margin"))(M.kmeans(EMB(s, d), "embedding", 4)))
add("l_mixture", lambda s, d: M.mixture(EMB(s, d), "embedding", 3).select("vec_id", "cluster", "confidence"))
add("s_fingerprint", lambda s, d: IO.frame_fingerprint(od(s, d)))

from . import queries_jobs, queries_more  # noqa: E402, F401  register the rest
