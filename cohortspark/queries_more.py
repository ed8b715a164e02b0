"""More registered queries: predicates, screens, joins, reports, evaluation controls, quality plans; each with SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions import columns as C
from .operators import evaluate as E
from .operators import models as M
from .operators import screen as R
from .operators import shape as H
from .operators import stats as S
from .plans import catalogue as G
from .plans import cohort as P
from .plans import events as V
from .plans import incident as K
from .plans import quality as Q
from .plans import steps as T
from .queries import EV, OD, add, ev, od, r6, rounded, table
from .scratch import shared_dir
from .sources import io as IO

L = lambda c: F.col(c).cast("long").alias(c)

# ---- projections, filters, predicates
#: Events with index dates, outcomes, censoring dates, visits and sites.
FOLLOWED = "fo AS (SELECT user_id, ts, date_trunc('day', ts)::TIMESTAMP AS visit, TIMESTAMP '2024-01-06' + INTERVAL 1 DAY * (user_id % 9)::INT AS index_date, CASE WHEN event_type = 'purchase' AND event_id % 29 = 0 THEN 'disease' WHEN event_type = 'error' AND event_id % 31 = 0 THEN 'death' WHEN event_type = 'signup' AND event_id % 23 = 0 THEN 'cancer' ELSE 'none' END AS outcome_type, ts AS event_date, CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 9 DAY END AS censoring_date, CASE event_id % 3 WHEN 0 THEN 'lung' WHEN 1 THEN 'colon' END AS site FROM events)"


def followed(s, d):
    e, c = table(s, d, "events"), F.col
    kind = F.when((c("event_type") == "purchase") & (c("event_id") % 29 == 0), "disease").when((c("event_type") == "error") & (c("event_id") % 31 == 0), "death").when((c("event_type") == "signup") & (c("event_id") % 23 == 0), "cancer").otherwise("none")
    start = F.timestamp_micros(F.unix_micros(F.lit("2024-01-06 00:00:00").cast("timestamp")) + (c("user_id") % 9) * 86_400_000_000).cast(dict(e.dtypes)["ts"])
    later = F.timestamp_micros(F.unix_micros(c("ts").cast("timestamp")) + 9 * 86_400_000_000).cast(dict(e.dtypes)["ts"])
    return e.select("user_id", "ts", F.date_trunc("day", "ts").alias("visit"), start.alias("index_date"), kind.alias("outcome_type"), c("ts").alias("event_date"), F.when(c("event_id") % 2 == 0, later).alias("censoring_date"), F.when(c("event_id") % 3 == 0, "lung").when(c("event_id") % 3 == 1, "colon").alias("site"))


def summed_place(i):
    return F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x[i])


def typed(df):
    return df.select(*(F.col(c).cast("long").alias(c) if k == "int" else F.col(c) for c, k in df.dtypes))


def incident_report(s, d):
    cohort, counts = K.incident_cohort(followed(s, d), "user_id", PROTOCOL)
    return K.cohort_report(cohort, counts, PROTOCOL)


DAYS = "(epoch_us({}) - epoch_us({})) / 86400000000.0".format
INCIDENT = (
    "tab0 AS (SELECT user_id, max(index_date) AS index_date, max(ts) AS last_record, min(ts) FILTER (outcome_type = 'none') AS first_observation, count(DISTINCT visit) FILTER (outcome_type = 'none') AS visits, "
    + ", ".join(f"min(event_date) FILTER (outcome_type = '{o}') AS {o}_date" for o in ("disease", "cancer", "death"))
    + ", arg_min(site, (event_date, site)) FILTER (outcome_type = 'cancer' AND site IS NOT NULL) AS site, max(censoring_date) FILTER (outcome_type <> 'none') AS censoring_date FROM fo GROUP BY 1), "
    f"tab1 AS (SELECT *, coalesce(censoring_date, last_record) AS follow_up_end, {DAYS('index_date', 'first_observation')} AS history_days FROM tab0), "
    f"tab AS (SELECT *, coalesce(disease_date <= index_date, false) AS p1, coalesce(cancer_date <= index_date, false) AS p2, coalesce(history_days, -1) < 1 AS p3, visits < 3 AS p4, {DAYS('follow_up_end', 'index_date')} AS fu FROM tab1), "
    f"coh0 AS (SELECT *, {DAYS('death_date', 'index_date')} AS xd, {DAYS('disease_date', 'index_date')} AS e_disease, {DAYS('cancer_date', 'index_date')} AS e_cancer FROM tab WHERE NOT (p1 OR p2 OR p3 OR p4)), "
    "coh AS (SELECT *, " + ", ".join(f"CASE WHEN coalesce(e_{o} <= fu, false) THEN 1 WHEN coalesce(xd <= fu, false) AND (NOT coalesce(e_{o} <= fu, false) OR coalesce(xd < e_{o}, false)) THEN 2 ELSE 0 END AS c_{o}" for o in ("disease", "cancer")) + " FROM coh0)"
)
TIME = {o: f"(CASE c_{o} WHEN 1 THEN e_{o} WHEN 2 THEN xd ELSE fu END)" for o in ("disease", "cancer")}
COHORT_COLUMNS = ", ".join(
    f"round(e_{o}, 6) AS {o}_event_days, round({TIME[o]}, 6) AS {o}_time_days, CAST(c_{o} AS BIGINT) AS {o}_cause, "
    + ", ".join(f"CAST(c_{o} = 1 AND e_{o} <= {h} AS BIGINT) AS {o}_{h}_label, CAST((c_{o} = 1 AND e_{o} <= {h}) OR ({TIME[o]} >= {h} AND c_{o} <> 1) AS BIGINT) AS {o}_{h}_eligible, CAST(c_{o} = 0 AND {TIME[o]} < {h} AS BIGINT) AS {o}_{h}_censored_before, CAST(c_{o} = 2 AND {TIME[o]} < {h} AS BIGINT) AS {o}_{h}_competing_before" for h in (5, 10))
    for o in ("disease", "cancer")
)

add("p_keep_list", lambda s, d: H.keep_list(od(s, d), ["price", "pri", "absent"], "O", "id"), f"WITH {OD} SELECT id, price AS \"O_price\", pri AS \"O_pri\" FROM od")
add("p_cast_recode", lambda s, d: od(s, d).select("id", C.col_or_null(od(s, d), "st").alias("num"), C.col_or_null(od(s, d), "absent").alias("none"), C.yes_no(F.col("id") % 4).alias("yn"), C.drop_codes((F.col("id") % 100).cast("double")).alias("kept")),
    f"WITH {OD} SELECT id, TRY_CAST(st AS DOUBLE) AS num, NULL::DOUBLE AS none, CASE id % 4 WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.0 END AS yn, CASE WHEN id % 100 NOT IN (7, 9, 77, 99, 777, 999, 6666, 7777, 9999, 99999) THEN (id % 100)::DOUBLE END AS kept FROM od")
add("p_legacy", lambda s, d: H.coalesce_legacy(od(s, d), {"price": "score"}).select("id", "price"), f"WITH {OD} SELECT id, coalesce(price, score) AS price FROM od")
add("p_adults", lambda s, d: R.adults(od(s, d).withColumn("age", F.col("id") % 90), "age").select("id", L("age")), f"WITH {OD} SELECT id, CAST(id % 90 AS BIGINT) AS age FROM od WHERE id % 90 >= 18")
add("p_named_filter", lambda s, d: R.named_filter(od(s, d), {"finished": F.col("y") == 1, "dear": F.col("price") > 3e5}, "dear").select("id"), f"WITH {OD} SELECT id FROM od WHERE price > 300000")
add("p_training_frame", lambda s, d: R.training_frame(od(s, d).withColumn("t3", F.col("id") % 3), "t3", ["price", "score"]).select("id", "price", L("t3")), f"WITH {OD} SELECT id, price, CAST(id % 3 AS BIGINT) AS t3 FROM od WHERE id % 3 IN (0, 1) AND price IS NOT NULL")
add("p_complete_cases", lambda s, d: R.complete_cases(od(s, d), ["price", "yr"]).select("id"), f"WITH {OD} SELECT id FROM od WHERE price IS NOT NULL")
add("p_any_target", lambda s, d: R.any_target(od(s, d).withColumn("b", F.when(F.col("id") % 2 == 0, F.col("score"))), ["price", "b"]).select("id"), f"WITH {OD} SELECT id FROM od WHERE price IS NOT NULL OR id % 2 = 0")
add("p_finite", lambda s, d: H.finite_vectors(od(s, d).select("id", F.array("price", "score").alias("v")), "v").select("id"), f"WITH {OD} SELECT id FROM od WHERE price IS NOT NULL")
add("p_feature_columns", lambda s, d: s.createDataFrame([(n, n in R.allowed_features(od(s, d).withColumn("void", F.lit(None).cast("double")), ["price", "void", "score", "absent"], ["y"], ["secret_"]), n in R.model_columns(["price", "void", "score"], ["e"], ["vo"])) for n in ("price", "void", "score")], "name string, allowed boolean, model boolean"),
    "SELECT * FROM (VALUES ('price', true, true), ('void', false, false), ('score', true, true)) v(name, allowed, model)")
add("p_scoreable", lambda s, d: od(s, d).withColumn("age", F.col("id") % 150).select("id", C.scoreable(["price", "score", "yr"], ["price", "score"], "age").alias("ok")), f"WITH {OD} SELECT id, price IS NOT NULL AND id % 150 BETWEEN 18 AND 120 AS ok FROM od")
add("p_unknown_keys", lambda s, d: table(s, d, "events").select("event_id", F.size(R.unknown_keys(F.col("props"), ["a"])).cast("long").alias("unknown"), F.size(R.unknown_keys(F.col("props"), ["k"])).cast("long").alias("known")), "SELECT event_id, CAST(len(list_filter(json_keys(props), lambda x: x <> 'a')) AS BIGINT) AS unknown, CAST(len(list_filter(json_keys(props), lambda x: x <> 'k')) AS BIGINT) AS known FROM events")
add("p_derive", lambda s, d: R.derive_if_absent(od(s, d), {"double_price": F.col("price") * 2, "score": F.lit(0.0)}).select("id", "score", "double_price"), f"WITH {OD} SELECT id, score, price * 2 AS double_price FROM od")
add("p_usable", lambda s, d: s.createDataFrame([(c,) for c in H.usable_columns(od(s, d).withColumn("one", F.lit(1)), ["price", "one", "y"])], "name string"), "SELECT * FROM (VALUES ('price'), ('y')) v(name)")

# ---- columns
add("d_changes", lambda s, d: r6(od(s, d).select("id", C.bounded_difference(F.col("price") / 1000, F.col("score") * 100, 0, 90).alias("duration"), C.square(F.col("score")).alias("sq"), C.change(F.col("score"), F.col("price") / 97e3).alias("change"), C.interaction(F.col("price"), F.col("score")).alias("both"), L("yr"), C.year_of(F.col("d")).cast("long").alias("year"), C.missing_burden(["price", "cust"]).alias("burden"))),
    f"WITH {OD} SELECT id, round(CASE WHEN price / 1000 - score * 100 BETWEEN 0 AND 90 THEN price / 1000 - score * 100 END, 6) AS duration, round(score * score, 6) AS sq, round(price / 97000 - score, 6) AS change, round(price * score, 6) AS both, CAST(yr AS BIGINT) AS yr, CAST(year(d) AS BIGINT) AS year, CASE WHEN price IS NULL THEN 0.5::DOUBLE ELSE 0.0 END AS burden FROM od")
add("d_age_gap", lambda s, d: od(s, d).select("id", *(c.alias(n) for n, c in C.age_gap((F.col("id") % 7).cast("double"), (F.col("id") % 11).cast("double"), F.col("y"), F.col("id") % 2).items())),
    f"WITH {OD}, g AS (SELECT id, y, id % 2 AS b, CASE WHEN y = 1 AND id % 2 = 1 THEN (id % 11 - id % 7)::DOUBLE END AS gap FROM od) SELECT id, gap, (gap = 0)::DOUBLE AS same_year, CASE WHEN gap BETWEEN 0 AND 3 THEN 1.0::DOUBLE WHEN y = 1 AND b = 0 THEN 0.0 END AS within FROM g")
add("d_ever_now", lambda s, d: od(s, d).select("id", C.ever_now(F.col("id") % 3, F.col("id") % 5).alias("status"), C.current_status(F.col("id") % 3, F.col("id") % 5).alias("current")),
    f"WITH {OD} SELECT id, CASE WHEN id % 3 = 2 THEN 0.0::DOUBLE WHEN id % 3 = 1 AND id % 5 = 3 THEN 1.0 WHEN id % 3 = 1 AND id % 5 IN (1, 2) THEN 2.0 END AS status, CASE WHEN id % 3 = 2 THEN 0.0::DOUBLE WHEN id % 5 IN (1, 2) THEN 1.0 WHEN id % 5 = 3 THEN 0.0 END AS current FROM od")
add("d_cycle_weight", lambda s, d: r6(od(s, d).select("id", C.cycle_weight(F.col("st"), {"F": F.col("score"), "O": F.col("price")}, {"F": 4 / 21.2, "O": 2 / 21.2}).alias("w"))), f"WITH {OD} SELECT id, round(CASE st WHEN 'F' THEN score * 4 / 21.2 WHEN 'O' THEN price * 2 / 21.2 END, 6) AS w FROM od")
add("d_parse_utc", lambda s, d: table(s, d, "events").select("event_id", C.parse_utc(F.when(F.col("event_id") % 5 == 0, "no time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))).alias("t")), "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN date_trunc('second', ts)::TIMESTAMP END AS t FROM events")
add("d_profiles", lambda s, d: od(s, d).select("id", *(c.alias(n) for n, c in C.profile_masks({"a": F.col("price") > 3e5, "b": F.col("y") == 1, "c": F.col("price") < 1e5}).items())),
    f"WITH {OD}, m AS (SELECT id, coalesce(price > 300000, false) a, y = 1 b, coalesce(price < 100000, false) c FROM od) SELECT id, a, b AND NOT a AS b, c AND NOT a AND NOT b AS c FROM m")
add("d_case_document", lambda s, d: od(s, d).select("id", C.case_document(["score", "price"], 8).alias("doc")).select("id", F.regexp_count("doc", F.lit("=")).cast("long").alias("fields"), F.col("doc").startswith("score=").alias("first")), f"WITH {OD} SELECT id, CAST(1 + (price IS NOT NULL)::INT AS BIGINT) AS fields, true AS first FROM od")
add("d_name_screen", lambda s, d: table(s, d, "nation").select("n_name", C.name_screen(F.col("n_name"), ["^u", "an$"], ["japan"]).alias("hit")), "SELECT n_name, (regexp_matches(x, '^u') OR regexp_matches(x, 'an$')) AND x <> 'japan' AS hit FROM (SELECT n_name, regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g') x FROM nation)")
add("d_direction", lambda s, d: od(s, d).select("id", C.direction(F.col("price") - 200000).alias("dir")), f"WITH {OD} SELECT id, CASE WHEN price > 200000 THEN 'higher' WHEN price < 200000 THEN 'lower' WHEN price = 200000 THEN 'equal' END AS dir FROM od")
add("d_range_items", lambda s, d: od(s, d).select("id", F.array_join(F.transform(C.out_of_range({"price": (1e5, 3e5), "score": (0.1, 0.9)}), lambda x: x["name"]), ",").alias("bad"), F.array_join(F.transform(C.readiness(["price"], ["cust"]), lambda x: F.concat(x["name"], F.lit(":"), x["level"])), ",").alias("missing")),
    f"WITH {OD} SELECT id, concat_ws(',', CASE WHEN price NOT BETWEEN 100000 AND 300000 THEN 'price' END, CASE WHEN score NOT BETWEEN 0.1 AND 0.9 THEN 'score' END) AS bad, CASE WHEN price IS NULL THEN 'price:high' ELSE '' END AS missing FROM od")
add("d_sequential_id", lambda s, d: R.sequential_id(od(s, d).select("id", "d"), ["d", "id"]).select("id", L("row_id")), f"WITH {OD} SELECT id, row_number() OVER (ORDER BY d, id) AS row_id FROM od")
add("d_value_screen", lambda s, d: r6(R.value_screen(table(s, d, "customer"), ["c_name", "c_mktsegment"], {"digits": "[0-9]{6}", "b": "^B"})),
    "WITH c AS (SELECT avg(regexp_matches(c_name, '[0-9]{6}')::INT) a, avg(regexp_matches(c_name, '^B')::INT) b, avg(regexp_matches(c_mktsegment, '[0-9]{6}')::INT) e, avg(regexp_matches(c_mktsegment, '^B')::INT) f FROM customer) SELECT 'c_name' AS \"column\", 'digits' AS pattern, round(a, 6) AS share, a >= 0.2 AS flagged FROM c UNION ALL SELECT 'c_name', 'b', round(b, 6), b >= 0.2 FROM c UNION ALL SELECT 'c_mktsegment', 'digits', round(e, 6), e >= 0.2 FROM c UNION ALL SELECT 'c_mktsegment', 'b', round(f, 6), f >= 0.2 FROM c")
add("d_accept_history", lambda s, d: R.accept_history(ev(s, d), "user_id", "ts", ["value"], 2, 12).select("user_id", "visits", "reason", "accepted"),
    f"WITH {EV}, g AS (SELECT user_id, count(*) n, count(DISTINCT ts) t, count(value) f FROM ev GROUP BY 1), r AS (SELECT user_id, n AS visits, CASE WHEN n < 2 THEN 'too few visits' WHEN n > 12 THEN 'too many visits' WHEN t < 2 THEN 'too few times' WHEN f < 2 THEN 'too few values' END AS reason FROM g) SELECT *, reason IS NULL AS accepted FROM r")
add("d_profile_problems", lambda s, d: od(s, d).select("id", F.array_join(R.profile_problems({"price": {"required": True, "low": 5e4, "high": 4e5}, "st": {"values": ["F", "O"]}, "score": {"decimals": 2}}), ";").alias("problems")),
    f"WITH {OD} SELECT id, concat_ws(';', CASE WHEN price IS NULL THEN 'price: blank' END, CASE WHEN price NOT BETWEEN 50000 AND 400000 THEN 'price: range' END, CASE WHEN st NOT IN ('F', 'O') THEN 'st: category' END, CASE WHEN round(score, 2) <> score THEN 'score: decimals' END) AS problems FROM od")
add("d_horizon_rows", lambda s, d: R.horizon_rows(od(s, d), od(s, d).filter("yr >= 1996").groupBy("cust").agg(F.max("score").alias("estimate")).withColumn("horizon", F.lit(3)), "cust", [1, 3]).select("cust", L("horizon"), "estimate", "status"),
    f"WITH {OD}, e AS (SELECT cust, max(score) AS estimate FROM od WHERE yr >= 1996 GROUP BY 1), g AS (SELECT DISTINCT cust, h FROM od, (VALUES (1), (3)) v(h)) SELECT cust, CAST(h AS BIGINT) AS horizon, CASE WHEN h = 3 THEN estimate END AS estimate, CASE WHEN h = 3 AND estimate IS NOT NULL THEN 'estimated' ELSE 'abstained' END AS status FROM g LEFT JOIN e USING (cust)")

# ---- joins, sets, orders
CU = "cu AS (SELECT c_custkey AS cust, c_mktsegment AS seg, c_acctbal AS bal, c_nationkey AS nat FROM customer)"
cu = lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("cust"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"), F.col("c_nationkey").alias("nat"))
add("j_left_lookup", lambda s, d: R.left_lookup(od(s, d), cu(s, d).filter("bal > 0"), "cust").select("id", "seg"), f"WITH {OD}, {CU} SELECT id, seg FROM od LEFT JOIN (SELECT * FROM cu WHERE bal > 0) USING (cust)")
add("j_inner", lambda s, d: R.inner_on(od(s, d), cu(s, d).filter("bal > 0"), "cust").select("id", "seg"), f"WITH {OD}, {CU} SELECT id, seg FROM od JOIN cu USING (cust) WHERE bal > 0")
add("j_attach", lambda s, d: R.attach_features(H.person_intervals(od(s, d).withColumn("time", F.col("score") * 900), "time", "y", 730.0, 365.0).select("id", "cust", "interval"), cu(s, d), "cust").select("id", L("interval"), "bal"),
    f"WITH {OD}, {CU}, i AS (SELECT id, cust, unnest(range(CAST(ceil(least(greatest(score * 900, 1.0), 730.0) / 365.0) AS INT))) AS interval FROM od) SELECT id, CAST(interval AS BIGINT) AS interval, bal FROM i LEFT JOIN cu USING (cust)")
add("j_keep_ids", lambda s, d: R.keep_ids(od(s, d), cu(s, d).filter("nat < 5"), "cust").select("id"), f"WITH {OD}, {CU} SELECT id FROM od WHERE cust IN (SELECT cust FROM cu WHERE nat < 5)")
add("j_map_codes", lambda s, d: H.map_codes(cu(s, d), "nat", table(s, d, "nation").select(F.col("n_nationkey").alias("nat"), "n_name")).select("cust", "n_name"), f"WITH {CU} SELECT cust, n_name FROM cu JOIN nation ON n_nationkey = nat")
add("j_reattach", lambda s, d: R.reattach(od(s, d).filter("price IS NOT NULL").select("id", "cust"), od(s, d), "cust", ["pri"], "id").select("id", "pri"), f"WITH {OD}, f AS (SELECT cust, arg_min(pri, id) AS pri FROM od GROUP BY 1) SELECT id, f.pri FROM od JOIN f USING (cust) WHERE price IS NOT NULL")
add("j_score_external", lambda s, d: r6(S.brier(R.inner_on(od(s, d).select("id", "score"), od(s, d).filter("yr < 1997").select("id", "y"), "id"), "y", "score")), f"WITH {OD} SELECT round(avg((score - y) * (score - y)), 6) AS brier FROM od WHERE yr < 1997")
add("j_flag_members", lambda s, d: R.flag_members(cu(s, d), "seg", {"gap": ["BUILDING", "MACHINERY"], "weak": ["AUTOMOBILE"]}).select("cust", "gap", "weak"), f"WITH {CU} SELECT cust, seg IN ('BUILDING', 'MACHINERY') AS gap, seg = 'AUTOMOBILE' AS weak FROM cu")
add("j_collect_matches", lambda s, d: R.collect_matches(table(s, d, "nation").select("n_nationkey"), cu(s, d).select(F.col("nat").alias("n_nationkey"), "seg"), "n_nationkey", "seg").select("n_nationkey", F.array_join("matches", ",").alias("matches")), f"WITH {CU}, g AS (SELECT nat, string_agg(DISTINCT seg, ',' ORDER BY seg) m FROM cu GROUP BY 1) SELECT n_nationkey, coalesce(m, '') AS matches FROM nation LEFT JOIN g ON nat = n_nationkey")
add("u_difference", lambda s, d: R.difference(cu(s, d), od(s, d), "cust").select("cust"), f"WITH {OD}, {CU} SELECT cust FROM cu WHERE cust NOT IN (SELECT cust FROM od)")
add("u_distinct_ids", lambda s, d: R.distinct_ids(od(s, d), "cust"), f"WITH {OD} SELECT DISTINCT cust FROM od")
add("t_cap", lambda s, d: R.cap(od(s, d).filter("y = 1"), 600, ["id"]).select("id"), f"WITH {OD} SELECT id FROM od WHERE y = 1 ORDER BY id LIMIT 600")
add("t_sorted", lambda s, d: R.sorted_output(ev(s, d).select("user_id", "ts", "event_id"), ["user_id", "ts", "event_id"]), "SELECT user_id, ts, event_id FROM events ORDER BY 1, 2, 3")
add("t_standout", lambda s, d: R.top_per_group(cu(s, d), "seg", [F.desc("bal"), "cust"], 3).select("seg", "cust", L("rank")), f"WITH {CU}, r AS (SELECT seg, cust, row_number() OVER (PARTITION BY seg ORDER BY bal DESC, cust) AS rank FROM cu) SELECT * FROM r WHERE rank <= 3")
add("w_days_since_first", lambda s, d: r6(R.days_since_first(ev(s, d), "user_id", "ts").select("event_id", "days_since_first")), "SELECT event_id, round((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 86400000000.0, 6) AS days_since_first FROM events")
add("w_row_topk", lambda s, d: table(s, d, "embeddings").select("vec_id", H.row_topk("embedding", 3).alias("top")).select("vec_id", F.size("top").cast("long").alias("n"), rounded(F.col("top")[0].cast("double"), 6).alias("first"), rounded(F.col("top")[2].cast("double"), 6).alias("third")), "SELECT vec_id, CAST(3 AS BIGINT) AS n, round(list_reverse_sort(embedding)[1]::DOUBLE, 6) AS first, round(list_reverse_sort(embedding)[3]::DOUBLE, 6) AS third FROM embeddings")
add("w_cumulative", lambda s, d: H.running_totals(od(s, d).select("id", "score", "y", (1 - F.col("y")).alias("n")), ["score", "id"], ["y", "n"], descending=True).select("id", (F.col("y_before") + F.col("y")).alias("tp"), (F.col("n_before") + F.col("n")).alias("fp")), f"WITH {OD} SELECT id, CAST(sum(y) OVER w AS BIGINT) AS tp, CAST(sum(1 - y) OVER w AS BIGINT) AS fp FROM od WINDOW w AS (ORDER BY score DESC, id DESC ROWS UNBOUNDED PRECEDING)")
add("n_group_means", lambda s, d: r6(table(s, d, "embeddings").select("vec_id", *(c.alias(g) for g, c in R.group_means(F.col("embedding").cast("array<double>"), {"a": [0, 1, 2], "b": [3, 4]}).items()))), "SELECT vec_id, round((embedding[1]::DOUBLE + embedding[2]::DOUBLE + embedding[3]::DOUBLE) / 3, 6) AS a, round((embedding[4]::DOUBLE + embedding[5]::DOUBLE) / 2, 6) AS b FROM embeddings")
add("n_outcome_rows", lambda s, d: R.outcome_rows(table(s, d, "events").filter("event_type = 'error'"), "user_id", "ts", F.lit("death"), {"value": "double", "unit": "string"}), "SELECT user_id, ts AS event_date, 'death' AS outcome_type, 'outcome:death' AS feature_code, NULL::DOUBLE AS value, NULL::VARCHAR AS unit FROM events WHERE event_type = 'error'")
add("n_normaliser", lambda s, d: r6(s.createDataFrame([(c, m, v) for c, (m, v) in M.fit_normaliser(od(s, d).filter("yr < 1997").withColumn("flat", F.lit(2.0)).withColumn("none", F.lit(None).cast("double")), ["price", "score", "flat", "none"]).items()], "feature string, centre double, spread double")),
    f"WITH {OD}, o AS (SELECT * FROM od WHERE yr < 1997) SELECT 'price' AS feature, round(quantile_cont(price, 0.5), 6) AS centre, round(stddev_samp(price), 6) AS spread FROM o UNION ALL SELECT 'score', round(quantile_cont(score, 0.5), 6), round(stddev_samp(score), 6) FROM o UNION ALL SELECT 'flat', 2.0, 1.0 UNION ALL SELECT 'none', 0.0, 1.0")
add("l_impute", lambda s, d: r6(M.apply_impute(od(s, d), M.fit_impute(od(s, d).filter("yr < 1997"), ["price", "score"])).select("id", "price", "score", "price_missing")), f"WITH {OD}, m AS (SELECT quantile_cont(price, 0.5) q FROM od WHERE yr < 1997) SELECT id, round(coalesce(price, q), 6) AS price, score, (price IS NULL)::DOUBLE AS price_missing FROM od, m")
add("l_onehot", lambda s, d: M.apply_onehot(od(s, d).withColumn("st", F.when(F.col("id") % 5 != 0, F.col("st"))), M.fit_onehot(od(s, d).filter("st <> 'P'"), ["st"])).select("id", F.col("st=F").alias("st_f"), F.col("st=O").alias("st_o")),
    f"WITH {OD}, m AS (SELECT st FROM od WHERE st <> 'P' GROUP BY 1 ORDER BY count(*) DESC, st LIMIT 1), x AS (SELECT id, coalesce(CASE WHEN id % 5 <> 0 THEN od.st END, m.st) z FROM od, m) SELECT id, (z = 'F')::DOUBLE AS st_f, (z = 'O')::DOUBLE AS st_o FROM x")
add("l_robust_scale", lambda s, d: r6(M.apply_scale(od(s, d), M.fit_robust_scale(od(s, d), ["price"])).select("id", "price")), f"WITH {OD}, q AS (SELECT quantile_cont(price, 0.5) m, quantile_cont(price, 0.9) - quantile_cont(price, 0.1) r FROM od) SELECT id, CASE WHEN round((price - m) / r, 6) = 0 THEN 0.0 ELSE round((price - m) / r, 6) END AS price FROM od, q")
add("l_standard_scale", lambda s, d: r6(M.apply_scale(od(s, d), M.fit_standard_scale(od(s, d), ["price"])).select("id", "price")), f"WITH {OD}, q AS (SELECT avg(price) m, stddev_pop(price) r FROM od) SELECT id, CASE WHEN round((price - m) / r, 6) = 0 THEN 0.0 ELSE round((price - m) / r, 6) END AS price FROM od, q")
add("l_batch_scores", lambda s, d: r6(E.batch_scores(od(s, d).filter("yr >= 1997").select("id", "score"), "id", F.col("score") * 1.0, od(s, d).filter("yr < 1997"), "score")), f"WITH {OD}, r AS (SELECT score FROM od WHERE yr < 1997), q AS (SELECT DISTINCT score FROM od WHERE yr >= 1997), c AS (SELECT q.score, count(r.score) * 100.0 / (SELECT count(*) FROM r) p FROM q LEFT JOIN r ON r.score <= q.score GROUP BY 1) SELECT id, score, round(p, 6) AS percentile, CASE WHEN p >= 99 THEN '99+' WHEN p >= 95 THEN '95-99' WHEN p >= 90 THEN '90-95' ELSE '0-90' END AS band FROM od JOIN c USING (score) WHERE yr >= 1997")
add("l_effect", lambda s, d: r6(E.effect_with_fallback(od(s, d).filter("price IS NOT NULL"), "y", "price", ["score"]).select("effect", "execution_mode")),
    f"WITH {OD}, m AS (SELECT avg(y) ay, avg(score) az, avg(price) ap FROM od WHERE price IS NOT NULL), k AS (SELECT sum((y - ay) * (y - ay)) tt, sum((score - az) * (score - az)) zz, sum((y - ay) * (score - az)) tz, sum((y - ay) * (price - ap)) tp, sum((score - az) * (price - ap)) zp FROM od, m WHERE price IS NOT NULL) SELECT round((zz * tp - tz * zp) / (tt * zz - tz * tz), 6) AS effect, 'adjusted' AS execution_mode FROM k")

# ---- aggregates, reports
add("a_first_row", lambda s, d: R.first_row(od(s, d).select("cust", "id", "pri", "price"), "cust", ["id"]), f"WITH {OD} SELECT cust, id, pri, price FROM od QUALIFY row_number() OVER (PARTITION BY cust ORDER BY id) = 1")
add("a_event_counts", lambda s, d: R.event_counts(ev(s, d), "user_id", "ts", "value"), f"WITH {EV} SELECT count(*) AS rows, count(DISTINCT user_id) AS entities, (SELECT count(*) FROM (SELECT DISTINCT user_id, ts FROM ev)) AS visits, count(value) AS observations FROM ev")
add("a_slot_audit", lambda s, d: R.slot_audit(od(s, d), F.when(F.col("price").isNotNull(), (F.col("price") > 2e5).cast("double")), "y"), f"WITH {OD}, r AS (SELECT y, price > 200000 r FROM od) SELECT CAST(count_if(y = 1) AS BIGINT) AS stored, CAST(count_if(r) AS BIGINT) AS recomputed, CAST(count_if(y = 1 AND coalesce(NOT r, false)) AS BIGINT) AS only_stored, CAST(count_if(r AND y <> 1) AS BIGINT) AS only_recomputed FROM r")
add("a_gate_labels", lambda s, d: R.horizon_gate_labels(od(s, d).withColumn("e", (F.col("id") % 4 > 0).cast("int")), {1: ("y", "e"), 3: ("t", "e")}), f"WITH {OD}, l AS (SELECT 1 AS horizon, y AS v FROM od WHERE id % 4 > 0 UNION ALL SELECT 3, t FROM od WHERE id % 4 > 0) SELECT CAST(horizon AS BIGINT) AS horizon, CAST(count_if(v = 1) AS BIGINT) AS events, CAST(count_if(v = 0) AS BIGINT) AS non_events, count_if(v = 1) >= 50 AND count_if(v = 0) >= 50 AS open FROM l GROUP BY 1")
add("a_exclusions", lambda s, d: R.exclusions(od(s, d).withColumn("old", F.col("yr") < 1994).withColumn("cheap", F.col("price") < 1e5), ["old", "cheap"]), f"WITH {OD}, f AS (SELECT yr < 1994 o, price < 100000 c FROM od) SELECT count(*) AS before, CAST(count_if(o) AS BIGINT) AS old, CAST(count_if(c) AS BIGINT) AS cheap, CAST(count_if(o OR coalesce(c, false)) AS BIGINT) AS excluded, CAST(count_if(NOT (o OR coalesce(c, false))) AS BIGINT) AS after FROM f")
add("a_category_distribution", lambda s, d: r6(R.category_distribution(od(s, d).filter("id < 40"), "pri", od(s, d))), f"WITH {OD}, n AS (SELECT count(*) n FROM od WHERE id < 40), a AS (SELECT pri, count(*) FILTER (id < 40) x, count(*) z FROM od GROUP BY 1) SELECT pri, round(CASE WHEN n >= 50 THEN CASE WHEN x > 0 THEN x / n END ELSE z / sum(z) OVER () END, 6) AS share, CASE WHEN n >= 50 THEN 'own' ELSE 'fallback' END AS source FROM a, n")
add("a_band_histogram", lambda s, d: R.band_histogram(od(s, d).withColumn("p", F.col("score") * 100), "p", [0.0, 50.0, 75.0, 90.0, 99.0]), f"WITH {OD}, e AS (SELECT unnest([0.0, 50.0, 75.0, 90.0, 99.0])::DOUBLE AS f, unnest([50.0, 75.0, 90.0, 99.0, 1e9])::DOUBLE AS u) SELECT f AS band_from, count(id) AS n FROM e LEFT JOIN od ON score * 100 >= f AND score * 100 < u GROUP BY 1")
add("a_catalogue", lambda s, d: R.catalogue_summary(cu(s, d), ["seg", "nat"]), f"WITH {CU} SELECT 'seg' AS cut, seg AS level, count(*) AS n FROM cu GROUP BY 2 UNION ALL SELECT 'nat', CAST(nat AS VARCHAR), count(*) FROM cu GROUP BY 2")
add("a_follow_up", lambda s, d: r6(R.follow_up_summary(ev(s, d), "user_id", "ts")), "WITH g AS (SELECT user_id, count(DISTINCT ts) v, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0 f FROM events GROUP BY 1) SELECT min(v) AS visits_min, max(v) AS visits_max, round(avg(v), 6) AS visits_mean, round(min(f), 6) AS follow_up_min, round(max(f), 6) AS follow_up_max, round(avg(f), 6) AS follow_up_mean, " + ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {n}_{p}" for c, n in (("v", "visits"), ("f", "follow_up")) for p, q in (("p10", 0.1), ("median", 0.5), ("p90", 0.9))) + " FROM g")
add("a_outcome_counts", lambda s, d: R.outcome_counts(followed(s, d), "user_id", "outcome_type"), f"WITH {FOLLOWED} SELECT outcome_type AS outcome, count(*) AS rows, count(DISTINCT user_id) AS entities FROM fo WHERE outcome_type <> 'none' GROUP BY 1")
PROTOCOL = K.Protocol(["disease", "cancer"], "death", "cancer", (5, 10), 1.0, 3, 50)
add("q_incident_cohort", lambda s, d: r6(typed(K.incident_cohort(followed(s, d), "user_id", PROTOCOL)[0])), f"WITH {FOLLOWED}, {INCIDENT} SELECT user_id, index_date, last_record, first_observation, CAST(visits AS BIGINT) AS visits, disease_date, cancer_date, death_date, site, censoring_date, follow_up_end, round(history_days, 6) AS history_days, round(fu, 6) AS follow_up_days, CAST(year(index_date) AS BIGINT) AS index_year, {COHORT_COLUMNS} FROM coh")
add("q_incident_report", lambda s, d: r6(incident_report(s, d)), f"""WITH {FOLLOWED}, {INCIDENT}, lab AS (SELECT user_id, site, index_date, fu, {COHORT_COLUMNS} FROM coh),
o(section, item, value) AS (SELECT 'entities', 'before', count(*)::DOUBLE FROM tab UNION ALL SELECT 'entities', 'after', count(*) FROM coh
UNION ALL SELECT 'exclusions', 'prevalent_disease', count_if(p1) FROM tab UNION ALL SELECT 'exclusions', 'prevalent_cancer', count_if(p2) FROM tab UNION ALL SELECT 'exclusions', 'short_history', count_if(p3) FROM tab UNION ALL SELECT 'exclusions', 'insufficient_visits', count_if(p4) FROM tab
UNION ALL SELECT 'follow_up_days', n, quantile_cont(fu, q) FROM coh, (VALUES ('p10', 0.1)) t(n, q) GROUP BY n, q UNION ALL SELECT 'follow_up_days', 'median', quantile_cont(fu, 0.5) FROM coh UNION ALL SELECT 'follow_up_days', 'p90', quantile_cont(fu, 0.9) FROM coh UNION ALL SELECT 'follow_up_days', 'max', max(fu) FROM coh
UNION ALL SELECT 'index_year', CAST(year(index_date) AS VARCHAR), count(*) FROM coh GROUP BY 2 UNION ALL SELECT 'site_events', site, count(*) FROM coh WHERE site IS NOT NULL GROUP BY 2 UNION ALL SELECT 'site_open', site, (count(*) >= 50)::INT FROM coh WHERE site IS NOT NULL GROUP BY 2
""".replace("SELECT 'follow_up_days', n, quantile_cont(fu, q) FROM coh, (VALUES ('p10', 0.1)) t(n, q) GROUP BY n, q", "SELECT 'follow_up_days', 'p10', quantile_cont(fu, 0.1) FROM coh") + "".join(f" UNION ALL SELECT 'events', '{o}/{h}', count_if({o}_{h}_label = 1) FROM lab UNION ALL SELECT 'non_events', '{o}/{h}', count_if({o}_{h}_label = 0 AND {o}_{h}_eligible = 1) FROM lab UNION ALL SELECT 'gate_open', '{o}/{h}', (count_if({o}_{h}_label = 1) >= 50 AND count_if({o}_{h}_label = 0 AND {o}_{h}_eligible = 1) >= 50)::INT FROM lab" for o in ("disease", "cancer") for h in (5, 10)) + ") SELECT section, item, round(value::DOUBLE, 6) AS value FROM o")


def cohort_risk(s, d):
    """The whole way from events to metrics, in kept steps."""
    f = table(s, d, "events").join(followed(s, d).select("user_id", "ts", "visit", "index_date", "outcome_type", "event_date", "censoring_date", "site").distinct(), ["user_id", "ts"])
    protocol = K.Protocol(["disease"], "death", None, (5, 10), 0.0, 2, 50)
    path = f"{shared_dir(s)}/risk-{uuid.uuid4().hex}"
    IO.write_table(f, f"{path}/events")  # the fingerprint and several steps read the joined rows
    f = s.read.parquet(f"{path}/events")
    steps = T.Steps(s, path, f, "registered")
    return T.cohort_risk(steps, f, "user_id", "event_type", "value", "event_id", ["click", "view"], "disease", protocol, 2030, 1.0)


add("q_cohort_risk", lambda s, d: r6(cohort_risk(s, d)))
add("n_normal_sequences", lambda s, d: H.sequences(H.gap_since_previous(ev(s, d), "user_id", "ts"), "user_id", "ts", ["value"], 4, {"value": (20.0, 4.0)}, "gap_days").select("user_id", F.col("length").cast("long").alias("length"), *(rounded(summed_place(i), 6).alias(n) for i, n in enumerate(("values", "masks", "years")))),
    f"WITH {EV}, g AS (SELECT *, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 86400000000.0, 0.0) AS gap, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) k FROM ev) SELECT user_id, count(*) AS length, round(sum(coalesce((value - 20.0) / 4.0, 0.0)), 6) AS values, round(count(value), 6)::DOUBLE AS masks, round(sum(gap) / 365.25, 6) AS years FROM g WHERE k <= 4 GROUP BY 1")
add("a_share_measured", lambda s, d: r6(R.share_measured(od(s, d), ["price", "score"])), f"WITH {OD} SELECT 'price' AS feature, count(price) AS measured, round(avg((price IS NOT NULL)::INT), 6) AS share FROM od UNION ALL SELECT 'score', count(score), 1.0 FROM od")
add("a_distinct_values", lambda s, d: R.distinct_values(od(s, d), "yr").select(L("yr"), "n"), f"WITH {OD} SELECT CAST(yr AS BIGINT) AS yr, count(*) AS n FROM od GROUP BY 1")
add("a_topk_frequency", lambda s, d: S.array_topk_frequency(table(s, d, "documents").select(F.split(F.lower("text"), " ").alias("w")), "w", 3, 10).select("item", F.col("count").alias("n")), "WITH w AS (SELECT unnest(string_split(lower(text), ' ')[1:3]) AS item FROM documents) SELECT item, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, item LIMIT 10")
add("a_score_summary", lambda s, d: r6(S.distribution(od(s, d), "score")), f"WITH {OD} SELECT round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS sd, " + ", ".join(f"round(quantile_cont(score, {q}), 6) AS p{round(100 * q)}" for q in (0.5, 0.9, 0.95, 0.99)) + " FROM od")
add("a_negative_controls", lambda s, d: r6(E.negative_controls(od(s, d), "st", {"pri": "category", "price": "number"})).select("control", "dominates"), "SELECT * FROM (VALUES ('pri', false), ('price', false)) v(control, dominates)")

# ---- evaluation
RNK = "SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 k FROM od"
add("m_lift", lambda s, d: r6(E.auprc_lift(od(s, d), "y", "score")), f"WITH {OD}, g AS (SELECT score, sum(y)::DOUBLE p, count(*)::DOUBLE n FROM od GROUP BY 1), c AS (SELECT p, sum(p) OVER w tp, sum(n) OVER w a, sum(p) OVER () t FROM g WINDOW w AS (ORDER BY score DESC)), v AS (SELECT sum(p / t * tp / a) ap FROM c) SELECT round(ap, 6) AS average_precision, round((SELECT avg(y) FROM od), 6) AS prevalence, round(ap / (SELECT avg(y) FROM od), 6) AS lift FROM v")
add("m_calibration_line", lambda s, d: r6(E.calibration_line(od(s, d), "y", "score")))
add("m_constant", lambda s, d: r6(E.constant_baseline(od(s, d).filter("yr < 1997"), od(s, d).filter("yr >= 1997"), "y").select("accuracy", "recall", "rate")), f"WITH {OD}, r AS (SELECT avg(y) r FROM od WHERE yr < 1997) SELECT round(avg(((r >= 0.5) = (y = 1))::INT), 6) AS accuracy, CASE WHEN max(r) >= 0.5 THEN 1.0::DOUBLE ELSE 0.0 END AS recall, round(max(r), 6) AS rate FROM od, r WHERE yr >= 1997")
add("m_best", lambda s, d: E.best_by(r6(od(s, d).groupBy(F.col("pri").alias("model")).agg(F.avg("score").alias("auprc"), F.avg("y").alias("auroc"))), ["auprc", "auroc"]).select("model"), f"WITH {OD} SELECT model FROM (SELECT pri AS model, round(avg(score), 6) a, round(avg(y), 6) b FROM od GROUP BY 1) ORDER BY a DESC, b DESC, model LIMIT 1")
add("m_error_by_split", lambda s, d: r6(E.error_by_split(od(s, d).withColumn("e", F.col("score") * F.col("score")), "st", "e")), f"WITH {OD} SELECT st, round(avg(score * score), 6) AS mse, count(*) AS n FROM od GROUP BY 1")
add("m_promotion", lambda s, d: r6(E.promotion_gates(od(s, d).withColumn("old", F.col("score") * 1.0).withColumn("new", F.col("score") * 0.9).withColumn("s2", F.col("score") * 2), "old", "new", "score", "s2")), f"WITH {OD} SELECT round(avg(score), 6) AS old_mse, round(avg(score * 0.9), 6) AS new_mse, CAST(0 AS BIGINT) AS unmatched, 1.0::DOUBLE AS spearman, true AS improved, true AS agrees, true AS same_rows, true AS promoted FROM od")
add("m_leave_one_out", lambda s, d: r6(E.leave_one_group_out(od(s, d), "yr", "y", "score").withColumn("events", F.col("events").cast("long"))), f"WITH {OD}, r AS (SELECT yr, y, rank() OVER (PARTITION BY yr ORDER BY score) + (count(*) OVER (PARTITION BY yr, score) - 1) / 2.0 k FROM od), a AS ({RNK}) SELECT CAST(yr AS VARCHAR) AS fold, count(*) AS n, CAST(sum(y) AS BIGINT) AS events, round(CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN (sum(k) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) END, 6) AS auroc FROM r GROUP BY 1 UNION ALL SELECT 'pooled', count(*), CAST(sum(y) AS BIGINT), round((sum(k) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) FROM a")
add("m_stratified_bootstrap", lambda s, d: E.bootstrap(od(s, d), "y", "score"))
add("m_cluster_bootstrap", lambda s, d: E.bootstrap(od(s, d), "y", "score", cluster="yr"))
add("m_shuffled_labels", lambda s, d: E.shuffled_label_control(od(s, d), "y", "score", "id"))
add("m_time_reversal", lambda s, d: r6(E.time_reversal_control(ev(s, d), "user_id", "ts", "value", ev(s, d).groupBy("user_id").agg((F.max("value") > 90).cast("int").alias("y")), "y")))
add("l_davies_bouldin", lambda s, d: r6(E.davies_bouldin(table(s, d, "embeddings"), "embedding", "label")),
    "WITH l AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) v, unnest(range(len(embedding))) i FROM embeddings), c AS (SELECT label, i, avg(v) m FROM l GROUP BY 1, 2), o AS (SELECT label, vec_id, sqrt(sum((v - m) * (v - m))) d FROM l JOIN c USING (label, i) GROUP BY 1, 2), s AS (SELECT label, avg(d) s FROM o GROUP BY 1), p AS (SELECT a.label x, b.label z, sqrt(sum((a.m - b.m) * (a.m - b.m))) d FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2), r AS (SELECT x, max((sa.s + sb.s) / d) r FROM p JOIN s sa ON sa.label = x JOIN s sb ON sb.label = z GROUP BY 1) SELECT round(avg(r), 6) AS davies_bouldin FROM r")

# ---- quality plans
add("q_integrity", lambda s, d: r6(Q.integrity_report(od(s, d), "cust", ["price", "score"], ["y", "t"], {"price": (2e4, 4.5e5)}).select("section", "item", "value", "level")),
    f"WITH {OD}, g AS (SELECT cust, price, score, count(*) n FROM od GROUP BY ALL), u AS (SELECT cust, sum(n) r, count(*) k FROM g GROUP BY 1), z AS (SELECT sum(r)::DOUBLE a, (sum(r) - sum(k))::DOUBLE b, count_if(r > 1)::DOUBLE c FROM u), pl AS (SELECT count_if(price NOT BETWEEN 20000 AND 450000) / count(price) x FROM od), o(section, item, value, level) AS (SELECT 'rows', 'rows', a, CASE WHEN a < 500 THEN 'blocking' ELSE 'info' END FROM z UNION ALL SELECT 'rows', 'duplicate_rows', b, CASE WHEN b > 0 THEN 'warning' ELSE 'info' END FROM z UNION ALL SELECT 'rows', 'repeated_ids', c, CASE WHEN c > 0 THEN 'warning' ELSE 'info' END FROM z UNION ALL SELECT 'labels', 'y', sum(y)::DOUBLE, CASE WHEN sum(y) IN (0, count(*)) THEN 'blocking' ELSE 'info' END FROM od UNION ALL SELECT 'labels', 't', sum(t)::DOUBLE, CASE WHEN sum(t) IN (0, count(*)) THEN 'blocking' ELSE 'info' END FROM od UNION ALL SELECT 'coverage', 'price', round(avg((price IS NOT NULL)::INT), 6), CASE WHEN avg((price IS NOT NULL)::INT) < 0.05 THEN 'warning' ELSE 'info' END FROM od UNION ALL SELECT 'coverage', 'score', 1.0, 'info' UNION ALL SELECT 'plausibility', 'price', round(x, 6), CASE WHEN x > 0.1 THEN 'blocking' WHEN x > 0.01 THEN 'warning' ELSE 'info' END FROM pl) SELECT * FROM o")
add("q_capabilities", lambda s, d: Q.capabilities(ev(s, d).withColumn("y", (F.col("event_type") == "view").cast("int")), "user_id", ["ts", "visit"], ["y"]), "SELECT max(n) > 1 AS repeated_ids, CAST(1 AS BIGINT) AS usable_labels, CAST(1 AS BIGINT) AS time_columns, CASE WHEN max(n) > 1 THEN 'trajectories' ELSE 'association' END AS supports FROM (SELECT count(*) n FROM events GROUP BY user_id)")
add("q_timeline", lambda s, d: Q.timeline_checks(ev(s, d).withColumn("ix", F.lit("2024-01-15").cast("timestamp")).withColumn("time", F.col("value") - 50), "ts", "ix", "time"), f"WITH {EV} SELECT count(*) AS rows, CAST(count_if(ts > TIMESTAMP '2024-01-15') AS BIGINT) AS after_index, CAST(coalesce(count_if(value - 50 < 0), 0) AS BIGINT) AS negative_times FROM ev")
add("q_visit_rows", lambda s, d: ev(s, d).withColumn("ix", F.lit("2024-01-15").cast("timestamp")).select("event_id", F.array_join(Q.visit_row_problems(["secret"], ["user_id", "ts"], "ts", "ix", "value"), ",").alias("problems")), f"WITH {EV} SELECT event_id, concat_ws(',', CASE WHEN value IS NULL THEN 'no key' END, CASE WHEN ts > TIMESTAMP '2024-01-15' THEN 'after index' END) AS problems FROM ev")
PHRASES = {"causal": "cause|because", "denial": "never"}
CI = "w AS (SELECT doc_id, trim(coalesce(source, '')) = '' AS m, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\t\\n\\v\\f\\r ]+'), lambda x: x <> '')) < 60 AS s, coalesce(regexp_matches(lower(text), 'cause|because'), false) AS c, coalesce(regexp_matches(lower(text), 'never'), false) AS n FROM documents), iss AS (SELECT doc_id, 'missing source' AS issue FROM w WHERE m UNION ALL SELECT doc_id, 'short' FROM w WHERE s UNION ALL SELECT doc_id, 'causal' FROM w WHERE c UNION ALL SELECT doc_id, 'denial' FROM w WHERE n UNION ALL SELECT doc_id, 'repeated key' FROM documents GROUP BY 1 HAVING count(*) > 1)"
issues = lambda s, d: Q.catalogue_issues(table(s, d, "documents"), "doc_id", "text", ["source"], PHRASES, 60)
add("q_catalogue_issues", issues, f"WITH {CI} SELECT doc_id, issue FROM iss")
add("q_routing", lambda s, d: Q.routing(table(s, d, "documents"), "doc_id", issues(s, d), ["short"]), f"WITH {CI}, g AS (SELECT doc_id, max((issue = 'short')::INT) b FROM iss GROUP BY 1) SELECT DISTINCT doc_id, CASE WHEN b IS NULL THEN 'presentable' WHEN b = 0 THEN 'research' ELSE 'held' END AS route FROM documents LEFT JOIN g USING (doc_id)")
CAUSE = [G.Phrase("causal", [["the", "la"], ["of", "the", "in", "que"]], ["and", "en"], 3, ["trial"]), G.Phrase("denial", [["and"], ["the"], ["of"]])]
CATALOGUE = G.Rules("doc_id", ["source", "lang"], ["text"], "url", "doi", "related", ["allow", "deny"], "allow", "design", "unknown", CAUSE)


def entries(s, d):
    """Documents as entries of a catalogue, some of them with wrong fields."""
    c, e = F.col("doc_id"), table(s, d, "documents")
    say = lambda *x: F.array(*(F.lit(v) for v in x))
    return e.select(
        "doc_id", "source", F.when(c % 41 > 0, F.col("lang")).alias("lang"), "text", F.when(c % 7 == 0, "unknown").when(c % 11 == 0, "ftp://x").otherwise("https://a.b/c").alias("url"), F.when(c % 5 == 0, "10.1234/ab").when(c % 13 == 0, "11.1/x").otherwise("n.a.").alias("doi"),
        F.when(c % 17 == 0, say("https://a.b", "nowhere")).otherwise(say("http://c.d")).alias("related"), F.when(c % 3 == 0, say("may say", "must not say")).alias("allow"), F.when(c % 19 == 0, say(" ")).otherwise(say("must not say")).alias("deny"), F.when(c % 4 == 0, "Trial").otherwise("cohort").alias("design"), F.when(c % 23 == 0, say("extra")).alias("unknown"),
    )


ENTRY_SQL = r"""e AS (SELECT doc_id, source, CASE WHEN doc_id % 41 > 0 THEN lang END AS lang, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '') AS w,
CASE WHEN doc_id % 7 = 0 THEN 'unknown' WHEN doc_id % 11 = 0 THEN 'ftp' ELSE 'url' END AS url, CASE WHEN doc_id % 5 = 0 THEN 'doi' WHEN doc_id % 13 = 0 THEN 'bad' ELSE 'n.a.' END AS doi FROM documents),
f AS (SELECT *, list_filter(range(1, len(w)), lambda i: list_contains(['the', 'la'], w[i]) AND list_contains(['of', 'the', 'in', 'que'], w[i + 1]) AND NOT list_has_any(w[greatest(i - 3, 1):i - 1], ['and', 'en'])) AS c, list_filter(range(1, len(w) - 1), lambda i: w[i] = 'and' AND w[i + 1] = 'the' AND w[i + 2] = 'of') AS n FROM e),
iss2 AS (SELECT doc_id, 'source' AS field, 'hard' AS severity, 'empty' AS issue FROM f WHERE trim(coalesce(source, '')) = '' UNION ALL SELECT doc_id, 'lang', 'hard', 'empty' FROM f WHERE trim(coalesce(lang, '')) = '' UNION ALL SELECT doc_id, 'url', 'hard', 'no URL' FROM f WHERE url = 'ftp' UNION ALL SELECT doc_id, 'doi', 'hard', 'no DOI' FROM f WHERE doi = 'bad'
UNION ALL SELECT doc_id, 'url', 'soft', 'no source' FROM f WHERE url = 'unknown' AND doi = 'n.a.' UNION ALL SELECT doc_id, 'allow', 'hard', 'statements need a source' FROM f WHERE doc_id % 3 = 0 AND url <> 'url' AND doi <> 'doi'
UNION ALL SELECT doc_id, 'related', 'hard', 'related source is no URL' FROM f WHERE doc_id % 17 = 0 UNION ALL SELECT doc_id, 'deny', 'hard', 'empty statement' FROM f WHERE doc_id % 19 = 0 UNION ALL SELECT doc_id, 'unknown', 'hard', 'unknown keys' FROM f WHERE doc_id % 23 = 0
UNION ALL SELECT doc_id, 'text', 'hard', 'causal' FROM f WHERE len(c) > 0 AND doc_id % 4 <> 0 UNION ALL SELECT doc_id, 'text', 'hard', 'denial' FROM f WHERE len(n) > 0 UNION ALL SELECT doc_id, 'doc_id', 'hard', 'repeated key' FROM f WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING count(*) > 1)"""
add("q_catalogue_rules", lambda s, d: G.issues(entries(s, d), CATALOGUE), f"WITH {ENTRY_SQL} SELECT doc_id, field, severity, issue FROM iss2")
add("q_catalogue_shown", lambda s, d: entries(s, d).transform(lambda e: G.shown(e, G.issues(e, CATALOGUE), "doc_id", "allow", "deny")).select("doc_id", "route", F.array_join("statements", "|").alias("statements"), F.array_join("denied", "|").alias("denied")),
    f"WITH {ENTRY_SQL}, g AS (SELECT doc_id, bool_or(severity = 'hard') AS h FROM iss2 GROUP BY 1) SELECT f.doc_id, CASE WHEN h IS NULL THEN 'presentable' WHEN NOT h THEN 'research' ELSE 'held' END AS route, CASE WHEN h IS NULL AND f.doc_id % 3 = 0 THEN 'may say' ELSE '' END AS statements, CASE WHEN f.doc_id % 19 = 0 THEN ' ' ELSE 'must not say' END AS denied FROM f LEFT JOIN g USING (doc_id)")
UNITS = {("view", "a"): ("z", 18.0, 1.5), ("view", "z"): ("z", 1.0, 0.0), ("click", "b"): ("z", 0.5, 0.0)}
EVENT_RULES = V.EventRules("user_id", "ts", "code", "value", "event_id", reasons=("observed", "not measured", "invalid_value_removed"), outcomes=("none", "disease", "death", "cancer"), site_outcomes=("cancer",), units=UNITS, ranges={"view": (10.0, 900.0), "error": (0.5, 60.0)})


def dirty_events(s, d):
    """The events with units, reasons, outcomes and dates, some of them wrong, and repeated rows."""
    c, e = F.col, table(s, d, "events")
    k, text = c("event_id"), lambda x: F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.when((c("event_type") == "purchase") & (k % 29 == 0), "disease").when((c("event_type") == "error") & (k % 31 == 0), "odd").when((c("event_type") == "signup") & (k % 23 == 0), "cancer").otherwise("none")
    e = e.select(
        "event_id", "user_id", F.when(k % 101 == 0, "no time").otherwise(text(c("ts"))).alias("ts"), c("event_type").alias("code"), F.when(k % 37 == 0, "x").when(k % 17 > 0, c("value").cast("string")).alias("value"), F.when(k % 3 == 0, "a").when(k % 3 == 1, "b").alias("unit"),
        F.when(k % 17 == 0, "not measured").when(k % 53 == 0, "who knows").otherwise("observed").alias("missingness_reason"), kind.alias("outcome_type"), F.when((kind != "none") & (k % 2 == 0), text(c("ts"))).alias("event_date"), F.lit("2024-01-10T00:00:00").alias("index_date"), F.when(k % 47 == 0, "2024-01-09T00:00:00").alias("censoring_date"),
        F.when(k % 43 == 0, "lung").alias("site"), F.when(k % 61 > 0, "generator").alias("provenance"),
    )
    return e.unionByName(e.filter("event_id % 10 = 0").withColumn("event_id", k + 10_000_000))


DIRTY = """raw AS (SELECT event_id, user_id, event_type AS code, CASE WHEN event_id % 101 > 0 THEN date_trunc('second', ts)::TIMESTAMP END AS ts, CASE WHEN event_id % 37 > 0 AND event_id % 17 > 0 THEN value END AS v0, CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS unit,
CASE WHEN event_id % 17 = 0 THEN 'not measured' WHEN event_id % 53 = 0 THEN 'who knows' ELSE 'observed' END AS why, CASE WHEN event_type = 'purchase' AND event_id % 29 = 0 THEN 'disease' WHEN event_type = 'error' AND event_id % 31 = 0 THEN 'odd' WHEN event_type = 'signup' AND event_id % 23 = 0 THEN 'cancer' ELSE 'none' END AS o,
CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts)::TIMESTAMP END AS ed, event_id % 47 = 0 AS cens, CASE WHEN event_id % 43 = 0 THEN 'lung' END AS site, event_id % 61 > 0 AS prov FROM events),
dd AS (SELECT * FROM raw UNION ALL SELECT event_id + 10000000, * EXCLUDE (event_id) FROM raw WHERE event_id % 10 = 0),
u AS (SELECT *, CASE WHEN code = 'view' AND unit = 'a' THEN v0 * 18 + 1.5 WHEN code = 'click' AND unit = 'b' THEN v0 * 0.5 ELSE v0 END AS v, coalesce((code = 'view' AND unit = 'a') OR (code = 'click' AND unit = 'b'), false) AS conv FROM dd),
k1 AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY user_id, ts, code, o ORDER BY event_id DESC) = 1),
k AS (SELECT *, coalesce(code = 'view' AND (v < 10 OR v > 900) OR code = 'error' AND (v < 0.5 OR v > 60), false) AS bad FROM k1),
w AS (SELECT *, CASE WHEN NOT bad THEN v END AS x, CASE WHEN bad THEN 'invalid_value_removed' ELSE why END AS why2 FROM k)"""
ISSUE = lambda name, cond: f"SELECT 'issues', '{name}', count_if({cond}), CASE WHEN count_if({cond}) > 0 THEN 'hard' ELSE 'info' END FROM u"
ROWRULE = lambda name, cond: f"SELECT 'row rules', '{name}', count_if(coalesce({cond}, false)), CASE WHEN count_if(coalesce({cond}, false)) > 0 THEN 'hard' ELSE 'info' END FROM u"
add("q_validate_events", lambda s, d: r6(V.validate(dirty_events(s, d), EVENT_RULES)[1]), f"WITH {DIRTY}, o(section, item, value, level) AS (" + " UNION ALL ".join([
    "SELECT 'rows', 'rows', count(*)::DOUBLE, 'info' FROM u", "SELECT 'rows', 'entities', count(DISTINCT user_id), 'info' FROM u", "SELECT 'rows', 'observations', count_if(o = 'none'), 'info' FROM u", "SELECT 'rows', 'outcomes', count_if(o <> 'none'), 'info' FROM u", "SELECT 'rows', 'converted units', count_if(conv), 'info' FROM u",
    ISSUE("unreadable time", "ts IS NULL"), ISSUE("unknown reason", "why = 'who knows'"), ISSUE("unknown outcome", "o = 'odd'"), ISSUE("no provenance", "NOT prov"), ISSUE("unknown unit", "code IN ('view', 'click') AND unit IS NOT NULL AND v0 IS NOT NULL AND NOT conv"),
    ROWRULE("missing value without a reason", "v IS NULL AND why = 'observed' AND o = 'none'"), ROWRULE("outcome without a date", "o <> 'none' AND ed IS NULL"), ROWRULE("event before index", "o <> 'none' AND ed < TIMESTAMP '2024-01-10'"), ROWRULE("censoring before index", "cens"), ROWRULE("site without cancer", "site IS NOT NULL AND o <> 'cancer'"),
    "SELECT 'duplicates', 'removed', (SELECT count(*) FROM u) - (SELECT count(*) FROM k), 'info'", "SELECT 'missing', 'rows without value', count_if(o = 'none' AND x IS NULL), 'info' FROM w",
    "SELECT 'order', 'arrived out of order', count_if(b), 'info' FROM (SELECT ts < lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM k)",
    "SELECT 'impossible', code, count_if(bad), CASE WHEN count_if(bad) > 0.1 * count(v) THEN 'hard' ELSE 'info' END FROM k WHERE code IN ('view', 'error') GROUP BY code", "SELECT 'missing/reason', why2, count(*), 'info' FROM w WHERE o = 'none' GROUP BY 2", "SELECT 'coverage', code, avg((x IS NOT NULL)::INT), 'info' FROM w WHERE o = 'none' GROUP BY 2",
    "SELECT 'outcomes', o, count(*), 'info' FROM w WHERE o <> 'none' GROUP BY 2", "SELECT 'outcomes', 'entities with any', count(DISTINCT user_id) FILTER (o <> 'none'), 'info' FROM w", "SELECT 'sites', site, count(*), 'info' FROM w WHERE o <> 'none' AND site IS NOT NULL GROUP BY 2",
]) + ") SELECT section, item, round(value::DOUBLE, 6) AS value, level FROM o")
add("q_registry", lambda s, d: Q.registry_frame(od(s, d).withColumn("time", F.col("score") * 2000), {"st": {"f": 1, "o": 2}}, "y", "time", 1825.0, ["id"]).select("id", "st_ordinal", "label", L("row_id")), f"WITH {OD}, l AS (SELECT id, CASE st WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 2.0 END AS st_ordinal, CASE WHEN y = 1 AND score * 2000 <= 1825 THEN 1.0::DOUBLE WHEN score * 2000 >= 1825 THEN 0.0 END AS label FROM od) SELECT *, row_number() OVER (ORDER BY id) AS row_id FROM l WHERE label IS NOT NULL")
add("q_merge_batches", lambda s, d: Q.merge_batches([od(s, d).filter("yr <= 1995"), od(s, d).filter("yr > 1995")], "cust", ["cust", "pri"], "id").select("id", "cust", "source_batch").withColumn("source_batch", F.col("source_batch").cast("long")), f"WITH {OD}, b AS (SELECT *, CAST(yr > 1995 AS BIGINT) AS source_batch FROM od), f AS (SELECT *, min(source_batch) OVER (PARTITION BY cust) m FROM b) SELECT id, cust, source_batch FROM f WHERE source_batch = m QUALIFY row_number() OVER (PARTITION BY cust, pri ORDER BY id DESC) = 1")
