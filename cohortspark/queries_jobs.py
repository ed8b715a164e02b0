"""Registered queries of the whole jobs, each with SQL where SQL can say it."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from .operators import batched as B
from .operators import evaluate as E
from .operators import models as M
from .operators import neighbours as N
from .operators import shape as H
from .operators import stability as ST
from .plans import association as A
from .plans import intake as I
from .plans import jobs as J
from .plans import quality as Q
from .queries import OD, SQL, add, od, r6, rounded, table
from .queries_more import CU, L, cu, issues
from .scratch import shared_dir
from .sources import io as IO

# ---- reports -----------------------------------------------------------------------------------------------------------------------
RNG = {"price": (2e4, 4.5e5), "score": (0.0, 2.0)}
person = lambda s, d: od(s, d).withColumn("age", F.col("id") % 90)
reliable = lambda s, d: J.reliability_report(person(s, d), "cust", "age", "yr", "st", ["price", "score"], ["price", "score", "secret", "absent"], RNG, ["y", "t"], ["secret"], ["score", "price"])
LEVEL = "CASE WHEN {} THEN '{}' ELSE 'info' END"
REL = f"""WITH {OD}, p AS (SELECT *, id % 90 AS age FROM od), a AS (SELECT * FROM p WHERE age >= 18), l AS (SELECT yr, st, 'price' AS f, price AS v FROM a UNION ALL SELECT yr, st, 'score', score FROM a),
g AS (SELECT cust, price, score, count(*) n FROM od GROUP BY ALL), u AS (SELECT cust, sum(n) r, count(*) k FROM g GROUP BY 1), z AS (SELECT (sum(r) - sum(k))::DOUBLE b, count_if(r > 1)::DOUBLE c FROM u),
pl AS (SELECT f, count_if(v NOT BETWEEN 20000 AND 450000 AND f = 'price' OR v NOT BETWEEN 0 AND 2 AND f = 'score') / count(v) x, avg((v IS NOT NULL)::INT) c FROM l GROUP BY 1),
m AS (SELECT f, quantile_cont(v, 0.5) m, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) iqr FROM l GROUP BY 1), cy AS (SELECT f, yr, quantile_cont(v, 0.5) cm, avg((v IS NOT NULL)::INT) s FROM l GROUP BY 1, 2), dr AS (SELECT f, max(abs(cm - m) / iqr) x, count_if(s > 0.01) / count(*) av FROM cy JOIN m USING (f) WHERE iqr > 0 GROUP BY 1),
t AS (SELECT f, c, CASE WHEN c < 0.05 THEN 'unavailable' WHEN c < 0.5 OR pl.x > 0.01 OR coalesce(dr.x > 1 OR dr.av < 0.6, false) THEN 'qualified_use' ELSE 'usable_now' END AS tier FROM (SELECT f, x, c FROM pl) pl LEFT JOIN dr USING (f) UNION ALL SELECT 'secret', NULL, 'prohibited' UNION ALL SELECT 'absent', NULL, 'unavailable'),
o(section, item, value, level) AS (SELECT 'provenance', 'rows', count(*)::DOUBLE, 'info' FROM od UNION ALL SELECT 'provenance', 'columns', 11.0, 'info'
UNION ALL SELECT 'schema', n, e, CASE WHEN e = 0 THEN 'warning' ELSE 'info' END FROM (VALUES ('price', 1.0), ('score', 1.0), ('secret', 0.0), ('absent', 0.0)) w(n, e)
UNION ALL SELECT 'plausibility', f, x, CASE WHEN x > 0.1 THEN 'blocking' WHEN x > 0.01 THEN 'warning' ELSE 'info' END FROM pl
UNION ALL SELECT 'duplicates', 'duplicate_rows', b, {LEVEL.format('b > 0', 'warning')} FROM z UNION ALL SELECT 'duplicates', 'repeated_ids', c, {LEVEL.format('c > 0', 'warning')} FROM z
UNION ALL SELECT 'coverage', f || coalesce('/' || st, ''), avg((v IS NOT NULL)::INT), 'info' FROM l GROUP BY GROUPING SETS ((f), (f, st)), f, st HAVING f IS NOT NULL
UNION ALL SELECT 'drift', f, x, {LEVEL.format('x > 1', 'warning')} FROM dr UNION ALL SELECT 'availability', f, av, {LEVEL.format('av < 0.6', 'warning')} FROM dr
UNION ALL SELECT 'labels', 'y', sum(y)::DOUBLE, 'info' FROM od UNION ALL SELECT 'labels', 't', sum(t)::DOUBLE, 'info' FROM od UNION ALL SELECT 'leakage', 'secret', 0.0, 'blocking'
UNION ALL SELECT 'weights', 'score', avg(coalesce(score > 0, false)::INT), 'info' FROM od UNION ALL SELECT 'weights', 'price', avg(coalesce(price > 0, false)::INT), 'info' FROM od
UNION ALL SELECT 'capability', CASE WHEN max(r) > 1 THEN 'trajectories' ELSE 'association' END, (SELECT (count_if(q = 1) > 0 AND count_if(q = 0) > 0)::INT FROM (SELECT y q FROM od)) + (SELECT (count_if(t = 1) > 0 AND count_if(t = 0) > 0)::INT FROM od), 'info' FROM u
UNION ALL SELECT 'row_counts', 'rows', count(*), 'info' FROM od UNION ALL SELECT 'row_counts', 'adults', count(*), 'info' FROM a UNION ALL SELECT 'row_counts', st, count(*), 'info' FROM a GROUP BY st
UNION ALL SELECT 'tier', f || '/' || tier, c, 'info' FROM t UNION ALL SELECT 'tier', 'usable features', count_if(tier = 'usable_now'), {LEVEL.format("count_if(tier = 'usable_now') = 0", 'blocking')} FROM t)
SELECT section, item, round(value::DOUBLE, 6) AS value, level FROM o""".replace("GROUP BY GROUPING SETS ((f), (f, st)), f, st HAVING f IS NOT NULL", "GROUP BY GROUPING SETS ((f), (f, st))")
add("q_reliability", lambda s, d: r6(reliable(s, d)), REL)
integrity = lambda s, d: Q.integrity_report(od(s, d), "cust", ["price", "score"], ["y", "t"], {"price": (2e4, 4.5e5)}).select("section", "item", "value", "level")
add("q_research_pass", lambda s, d: r6(J.research_pass({"integrity": integrity(s, d), "reliability": reliable(s, d), "catalogue": issues(s, d).select("issue")})),
    f"SELECT 'integrity' AS step, section, item, value, level FROM ({SQL['q_integrity']}) UNION ALL SELECT 'reliability', section, item, value, level FROM ({REL}) UNION ALL SELECT 'catalogue', 'catalogue', issue, count(*)::DOUBLE, 'info' FROM ({SQL['q_catalogue_issues']}) GROUP BY issue")
add("q_build_report", lambda s, d: J.build_report(od(s, d), ["y", "t"], IO.first_readable(s, [f"{d}/absent.parquet", f"{d}/orders.parquet"])[1].select(F.regexp_extract("path", "[a-z]+.parquet", 0).alias("path"), "status")),
    f"WITH {OD} SELECT 'labelled' AS section, 'y' AS item, count(y)::DOUBLE AS value, 'info' AS level FROM od UNION ALL SELECT 'labelled', 't', count(t), 'info' FROM od UNION ALL SELECT 'positive', 'y', sum(y), 'info' FROM od UNION ALL SELECT 'positive', 't', sum(t), 'info' FROM od UNION ALL SELECT 'negative', 'y', count_if(y = 0), 'info' FROM od UNION ALL SELECT 'negative', 't', count_if(t = 0), 'info' FROM od UNION ALL SELECT 'source', 'absent.parquet', 0, 'warning' UNION ALL SELECT 'source', 'orders.parquet', 1, 'info'")

# ---- preparation ---------------------------------------------------------------------------------------------------------------------
PREP_FEATURES = ("click", "view")


def prepared(s, d):
    e = table(s, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "disease").when(F.col("event_type") == "error", "competing").otherwise("none")
    dated = F.when(F.col("event_type").isin("purchase", "error") & (F.col("event_id") % 29 == 0), F.col("ts"))
    v = e.select("event_id", "user_id", "ts", F.col("event_type").alias("code"), F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("value"), kind.alias("outcome_type"), dated.alias("event_date"))
    return J.prepare(v, "user_id", "code", "value", PREP_FEATURES, "disease", 5.0, [10, 20], "event_id", {"negative": F.col("value") < 1})


PREP = ("WITH e AS (SELECT event_id, user_id, ts, event_type, CASE WHEN event_id % 17 <> 0 THEN value END AS value, CASE WHEN event_type IN ('purchase', 'error') AND event_id % 29 = 0 THEN ts END AS ed FROM events), "
        "g AS (SELECT * FROM e WHERE coalesce(value >= 1, true) QUALIFY row_number() OVER (PARTITION BY user_id, ts, event_type ORDER BY event_id DESC) = 1), "
        "a AS (SELECT user_id, min(ts) f, max(ts) l, min(ed) FILTER (event_type = 'purchase') e, min(ed) FILTER (event_type = 'error') c FROM g GROUP BY 1), b AS (SELECT user_id, f, (epoch_us(l) - epoch_us(f)) / 86400000000.0 - 5 fu, (epoch_us(e) - epoch_us(f)) / 86400000000.0 - 5 ed, (epoch_us(c) - epoch_us(f)) / 86400000000.0 - 5 cd FROM a), "
        "k AS (SELECT *, least(ed, cd, fu) AS t FROM b WHERE NOT coalesce(ed <= 0, false) AND fu > 0), z AS (SELECT user_id, f, t, CASE WHEN ed = t THEN 1 WHEN cd = t THEN 2 ELSE 0 END AS cause FROM k), "
        "m AS (SELECT user_id, ts, f, " + ", ".join(f"(arg_min({{'v': value}}, event_id) FILTER (event_type = '{t}')).v AS {t}" for t in PREP_FEATURES) + " FROM g JOIN z USING (user_id) WHERE ts <= f + INTERVAL 5 DAY GROUP BY 1, 2, 3), "
        "y AS (SELECT *, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 86400000000.0 / 365.25 AS yt FROM m), "
        "q AS (SELECT user_id, count(*) AS visit_count, " + ", ".join(f"count({t}) AS {t}_n, round(arg_max({t}, yt) FILTER ({t} IS NOT NULL), 6) AS {t}_last, round(avg({t}), 6) AS {t}_mean" for t in PREP_FEATURES) + " FROM y GROUP BY 1) "
        "SELECT q.*, round(t, 6) AS time_days, CAST(cause AS BIGINT) AS cause, CAST(CASE WHEN cause = 1 AND t <= 10 THEN 1 WHEN t >= 10 THEN 0 WHEN cause = 2 THEN 0 END AS BIGINT) AS label_10 FROM q JOIN z USING (user_id)")
add("q_prepare", lambda s, d: r6(prepared(s, d)["features"].select("user_id", "visit_count", *(F.col(f"feature_{t}_{a}").alias(f"{t}_{b}") for t in PREP_FEATURES for a, b in (("observed_count", "n"), ("last", "last"), ("mean", "mean"))), "time_days", L("cause"), L("label_10"))), PREP)
add("q_splits", lambda s, d: J.build_splits(od(s, d), "cust", "yr", 2001)[1])
add("q_pool_cycles", lambda s, d: H.group_zscore(J.pool_cycles([(n, [od(s, d).filter(f).select("id", "price"), od(s, d).filter(f).filter("id % 3 > 0").select("id", "score")]) for n, f in (("early", "yr <= 1997"), ("late", "yr > 1997"))], "id"), "price", ["survey_cycle_index"]).select("global_id", L("survey_cycle_index"), "score", rounded(F.col("price_z"), 6).alias("price_z")),
    f"WITH {OD}, p AS (SELECT CASE WHEN yr <= 1997 THEN 'early' ELSE 'late' END AS n, (yr > 1997)::BIGINT AS i, id, price, CASE WHEN id % 3 > 0 THEN score END AS score FROM od) SELECT n || ':' || id AS global_id, i AS survey_cycle_index, score, round((price - avg(price) OVER w) / nullif(stddev_samp(price) OVER w, 0), 6) AS price_z FROM p WINDOW w AS (PARTITION BY i)")
add("s_code_filter", lambda s, d: IO.code_filter(table(s, d, "events"), "event_type", ["click", "view"]).select("event_id"), "SELECT event_id FROM events WHERE event_type IN ('click', 'view')")

# ---- scoring ---------------------------------------------------------------------------------------------------------------------------
add("q_score_dataset", lambda s, d: r6(J.score_dataset(od(s, d).filter("yr >= 1998"), "id", F.col("score") + F.col("price") / 1234567.0, ["price", "score"], od(s, d).filter("yr < 1998"), "score")),
    f"WITH {OD}, r AS (SELECT score v, 1 n FROM od WHERE yr < 1998), q AS (SELECT id, CASE WHEN price IS NOT NULL THEN score + price / 1234567.0::DOUBLE END v, price IS NULL m FROM od WHERE yr >= 1998), u AS (SELECT v, 1 n, NULL id FROM r UNION ALL SELECT v, 0, id FROM q WHERE NOT m), c AS (SELECT id, 100.0 * sum(n) OVER (ORDER BY v) / sum(n) OVER () p FROM u), z AS (SELECT q.*, p FROM q LEFT JOIN (SELECT * FROM c WHERE id IS NOT NULL) c USING (id)) SELECT id, CASE WHEN m THEN 'rejected' ELSE 'scored' END AS status, CASE WHEN m THEN 'price' ELSE '' END AS missing, round(v, 6) AS score, round(p, 6) AS percentile, CASE WHEN p >= 99 THEN '99+' WHEN p >= 95 THEN '95-99' WHEN p >= 90 THEN '90-95' WHEN p IS NOT NULL THEN '0-90' END AS band FROM z")
add("q_assess", lambda s, d: r6(J.assess(od(s, d).withColumn("extra", F.when(F.col("id") % 5 > 0, F.col("yr"))), "id", ["price"], ["extra", "score"], F.col("price") / 612347.0, [(0.0, "low"), (0.3, "medium"), (0.6, "high")])),
    f"WITH {OD}, p AS (SELECT id, price / 612347.0::DOUBLE p FROM od) SELECT id, CASE WHEN p IS NULL THEN 'incomplete' ELSE 'assessed' END AS status, CASE WHEN p IS NULL THEN 'price' ELSE '' END AS missing, round(p, 6) AS probability, CASE WHEN p >= 0.6 THEN 'high' WHEN p >= 0.3 THEN 'medium' WHEN p >= 0 THEN 'low' END AS band, CASE WHEN id % 5 = 0 THEN 'extra' ELSE '' END AS follow_ups FROM p")
add("q_pathways", lambda s, d: J.pathways(cu(s, d).select(F.col("nat").alias("feature"), F.col("bal")).groupBy("feature").agg(F.max("bal").alias("strength")), table(s, d, "nation").select(F.col("n_regionkey").alias("pathway"), F.col("n_nationkey").alias("feature")), "strength").select(L("pathway"), L("feature"), "strength", L("rank")),
    f"WITH {CU}, g AS (SELECT nat, max(bal) b FROM cu GROUP BY 1), r AS (SELECT CAST(n_regionkey AS BIGINT) AS pathway, CAST(nat AS BIGINT) AS feature, b AS strength, row_number() OVER (PARTITION BY n_regionkey ORDER BY b DESC, nat) AS rank FROM g JOIN nation ON n_nationkey = nat) SELECT * FROM r WHERE rank <= 3")
TREES = [(0, 0, 0, 2e5, 1, 2, True, 0.0), (0, 1, -1, 0.0, -1, -1, False, -0.4), (0, 2, 1, 1998.0, 3, 4, False, 0.0), (0, 3, -1, 0.0, -1, -1, False, 0.1), (0, 4, -1, 0.0, -1, -1, False, 0.7), (1, 0, 2, 0.5, 1, 2, False, 0.0), (1, 1, -1, 0.0, -1, -1, False, 0.25), (1, 2, -1, 0.0, -1, -1, False, -0.25)]
add("l_replay_trees", lambda s, d: r6(J.replay_trees(od(s, d), "id", ["price", "yr", "score"], s.createDataFrame(TREES, "tree int, node int, feature int, threshold double, left int, right int, missing_left boolean, value double"), 0.05)),
    f"WITH {OD} SELECT id, round(0.05::DOUBLE + CASE WHEN price IS NULL OR price <= 200000 THEN -0.4 WHEN yr <= 1998 THEN 0.1 ELSE 0.7 END + CASE WHEN score <= 0.5 THEN 0.25 ELSE -0.25 END, 6) AS raw FROM od")
COORDS = [f"x{i}" for i in range(8)]
wide = lambda s, d, n=8: table(s, d, "embeddings").select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(n)))
add("l_score_records", lambda s, d: r6(J.score_records(wide(s, d).filter("vec_id % 2 = 0"), wide(s, d).filter("vec_id % 2 = 1"), "vec_id", COORDS, 3)))
add("q_reload", lambda s, d: J.reload_parity(od(s, d).filter("yr < 2000"), od(s, d).filter("yr >= 2000"), "id", "y", ["score", "yr"], f"{shared_dir(s)}/reload-{s.sparkContext.applicationId}"),
    f"WITH {OD} SELECT count(*) AS compared, CAST(0 AS BIGINT) AS missing, 0.0::DOUBLE AS max_abs_difference, true AS passed FROM od WHERE yr >= 2000")

# ---- models ----------------------------------------------------------------------------------------------------------------------------
add("l_silhouette", lambda s, d: r6(E.silhouette(table(s, d, "embeddings").filter("vec_id % 50 = 0"), table(s, d, "embeddings"), "vec_id", "embedding", "label")),
    "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] v FROM embeddings), m AS (SELECT q.vec_id, q.label, b.label o, avg(list_distance(q.v, b.v)) m FROM e q JOIN e b ON q.vec_id <> b.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL), s AS (SELECT vec_id, max(m) FILTER (label = o) a, min(m) FILTER (label <> o) b FROM m GROUP BY 1) SELECT vec_id, round((b - a) / greatest(a, b), 6) AS silhouette FROM s")
add("l_prototypes", lambda s, d: r6(J.prototypes(wide(s, d), "label", COORDS, 3).withColumn("label", F.col("label").cast("long"))),
    "WITH l AS (SELECT CAST(label AS BIGINT) AS label, 'x' || i AS feature, embedding[i + 1]::DOUBLE v FROM embeddings, range(8) r(i)), a AS (SELECT feature, quantile_cont(v, 0.5) m FROM l GROUP BY 1), k AS (SELECT feature, m, 1.4826 * quantile_cont(abs(v - m), 0.5) sc FROM l JOIN a USING (feature) GROUP BY 1, 2), g AS (SELECT label, feature, count(*) n, quantile_cont(v, 0.5) med FROM l GROUP BY 1, 2), z AS (SELECT *, CASE WHEN n >= 5 THEN (med - m) / sc END smd FROM g JOIN k USING (feature)), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY abs(smd) DESC, feature) p FROM z) SELECT label, feature, n, round(med, 6) AS median, round(smd, 6) AS smd, CASE WHEN smd > 0 THEN 'higher' ELSE 'lower' END AS direction, CASE WHEN p <= 3 THEN p END AS panel FROM r")
GRID = (0.01, 0.25, 0.5, 0.75, 0.99)
add("q_profile_model", lambda s, d: r6(J.profile_model(od(s, d), {"finished": F.col("y") == 1, "rest": F.col("y") == 0}, ["price", "score"], ["pri"], GRID, factors=False)),
    f"WITH {OD}, p AS (SELECT *, CASE y WHEN 1 THEN 'finished' ELSE 'rest' END AS profile FROM od), l AS (SELECT profile, 'price' AS field, price v FROM p UNION ALL SELECT profile, 'score', score FROM p), w AS (SELECT count(*) n FROM od), c AS (SELECT profile, pri, count(*) n FROM p GROUP BY 1, 2) SELECT profile, 'weight' AS kind, NULL AS field, NULL AS item, round(count(*) / max(n), 6) AS value FROM p, w GROUP BY 1 UNION ALL SELECT profile, 'missing', field, NULL, round(avg((v IS NULL)::INT), 6) FROM l GROUP BY 1, 3 UNION ALL SELECT profile, 'category', 'pri', pri, round(n / sum(n) OVER (PARTITION BY profile), 6) FROM c"
    + "".join(f" UNION ALL SELECT profile, 'quantile', field, '{q}', round(quantile_cont(v, {q}), 6) FROM l GROUP BY 1, 3" for q in GRID))
add("q_profile_factors", lambda s, d: r6(J.profile_model(od(s, d).withColumn("wd", F.dayofweek("d")), {"finished": F.col("y") == 1, "rest": F.col("y") == 0}, ["price", "score", "wd"], ["pri"], GRID).filter("kind = 'factor'")))
add("d_normal_scores", lambda s, d: r6(M.normal_scores(od(s, d).select("id", "price"), ["price"]).select("id", "price_normal")))
add("q_predictive", lambda s, d: r6(J.predictive_baseline(od(s, d).withColumn("rare", F.when(F.col("id") < 100, F.col("y"))), "id", ["y", "t", "rare", "absent"], ["score", "yr"])))
split_of = lambda: F.when(F.col("yr") >= 2001, "temporal").when(F.col("id") % 10 < 6, "train").when(F.col("id") % 10 < 8, "validation").otherwise("test")
RISK_FITS = {"logistic": lambda a, b: M.logistic(a, b, "y", ["score", "yr"]), "forest": lambda a, b: M.forest(a, b, "y", ["score", "yr"], trees=20, depth=4)}
add("q_risk_pipeline", lambda s, d: r6(J.risk_pipeline(od(s, d).withColumn("part", split_of()), "id", "y", "part", RISK_FITS).withColumnRenamed("part", "split")))


def importance(s, d):
    """A logistic model of the orders of other years, its columns dealt anew among those from 2000 on."""
    cols = ["score", "yr", "price"]
    f = od(s, d).withColumn("late", F.col("yr") >= 2000)
    x = f.select(F.array(*(F.col(c).cast("double") for c in cols)).alias("x"), F.array(F.col("y").cast("double")).alias("y"), F.array(F.when(F.col("late"), 0).otherwise(-1)).alias("fold"))
    fit = B.Folds(x, 1, 1, len(cols), centres=np.array([[0.3, 1996.0, 150000.0]]))
    design, beta = fit.design, fit.coefficients[0]
    predict = lambda v: 1 / (1 + np.exp(-(design(0, v) @ beta)))
    return B.permutation_importance(f.filter("late"), "y", cols, "id", predict)


add("m_permutation_importance", lambda s, d: r6(importance(s, d)))
add("m_refit_groups", lambda s, d: r6(B.refit_leave_one_group_out(od(s, d).withColumn("wd", F.dayofweek("d")), "yr", "y", ["score", "price", "wd"])))
PROBED = {"class 0": "CAST(label = 0 AS INT)", "class 1": "CAST(label = 1 AS INT)", "rare": "CASE WHEN vec_id % 3 = 0 THEN CAST(vec_id < 40 AS INT) END"}
add("m_linear_probe", lambda s, d: r6(B.linear_probe(table(s, d, "embeddings"), "vec_id", "embedding", {k: F.expr(v) for k, v in PROBED.items()})))
add("q_baselines", lambda s, d: r6(J.baseline_report(table(s, d, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 10 < 7)))
add("q_cluster_stability", lambda s, d: r6(ST.cluster_stability(table(s, d, "embeddings").withColumn("odd", F.col("vec_id") % 3), "vec_id", "embedding", controls={"odd": "category", "vec_id": "number"})[0]))
add("q_clustering", lambda s, d: r6(J.cluster_pipeline(table(s, d, "embeddings"), "vec_id", "embedding", ["kmeans"], [2, 3])).drop("error", "failed"))


def neighbours_found(s, d):
    """Neighbours of every row whose id is divisible by 50, with the share of the exact ones that the index finds."""
    e = table(s, d, "embeddings")
    asked = e.filter("vec_id % 50 = 0")
    found = N.knn_by_buckets(asked, e, "vec_id", "vec_id", "embedding")
    return found.crossJoin(F.broadcast(N.recall(found, H.knn(asked, e, "vec_id", "vec_id", "embedding"))))  # one row


add("j_knn_buckets", lambda s, d: r6(neighbours_found(s, d)))
add("q_association", lambda s, d: r6(A.associate(od(s, d).withColumn("wd", F.dayofweek("d")).withColumn("urgent", F.col("pri").startswith("1").cast("int")), "id", "y", ["score", "price", "wd", "urgent", "absent"], required=["score"], similar_to=F.col("id") % 50 == 0)["report"]))

# ---- intake ----------------------------------------------------------------------------------------------------------------------------
UPLOAD = I.Intake(numeric=["age", "price", "score", "absent"], categories=["status"], age="age", key="cust", labels=["y"], denied=["y", "secret"], identifier_names={"e-mail": "e_?mail"}, identifier_values={"e-mail": "[^@ ]+@[^@ ]+"}, ranges={"price": (0.0, 1e6), "score": (0.0, 0.7), "age": (0.0, 120.0)})


def intake(s, d):
    """The orders as an upload with wrong values, written as CSV and taken in."""
    c, f = F.col, od(s, d)
    at = f"{shared_dir(s)}/upload-{uuid.uuid4().hex}"
    age = F.when(c("id") % 23 == 0, "n/a").when(c("id") % 31 == 0, "").otherwise((c("id") % 110).cast("string"))
    price = F.when(c("id") % 3 == 0, None).otherwise(F.when(c("id") % 29 == 0, c("price") * 100).otherwise(c("price")))
    f.select("id", "cust", age.alias("age"), price.alias("price"), F.when(c("id") % 7 > 0, c("score")).alias("score"), c("st").alias("status"), "y", c("pri").alias("note")).write.option("header", True).csv(f"{at}/orders.csv")
    return I.take_in(s, f"{at}/orders.csv", UPLOAD, f"{at}/rows")[1]


add("q_intake", lambda s, d: r6(intake(s, d)),
    f"""WITH {OD}, f AS (SELECT id, cust, id % 23 = 0 AS corrupt, CASE WHEN id % 23 > 0 AND id % 31 > 0 THEN id % 110 END AS age, CASE WHEN id % 3 > 0 THEN CASE WHEN id % 29 = 0 THEN price * 100 ELSE price END END AS price, CASE WHEN id % 7 > 0 THEN score END AS score, st FROM od),
r AS (SELECT *, CASE WHEN corrupt THEN 'corrupt' WHEN NOT coalesce(age BETWEEN 18 AND 120, false) THEN 'age' WHEN (age IS NOT NULL)::INT + (price IS NOT NULL)::INT + (score IS NOT NULL)::INT + (st IS NOT NULL)::INT < 3 THEN 'features' WHEN (age IS NOT NULL)::INT + (price IS NOT NULL)::INT + (score IS NOT NULL)::INT < 2 THEN 'numeric' END AS why FROM f),
g AS (SELECT feature, count(v) / count(*) AS c, count_if(v < lo OR v > hi) / count(v) AS b FROM (SELECT 'age' AS feature, age::DOUBLE AS v, 0 AS lo, 120.0 AS hi FROM r UNION ALL SELECT 'price', price, 0, 1e6 FROM r UNION ALL SELECT 'score', score, 0, 0.7 FROM r UNION ALL SELECT 'status', CASE WHEN st IS NOT NULL THEN 0 END, NULL, NULL FROM r) GROUP BY 1),
o(section, item, value, level) AS (SELECT 'file', 'rows', count(*)::DOUBLE, 'info' FROM r UNION ALL SELECT 'file', 'columns', 8, 'info'
UNION ALL SELECT 'schema', x, 1, l FROM (VALUES ('mapped/age', 'info'), ('mapped/price', 'info'), ('mapped/score', 'info'), ('mapped/status', 'info'), ('missing/absent', 'warning'), ('prohibited/y', 'warning'), ('unmapped/id', 'info'), ('unmapped/cust', 'info'), ('unmapped/note', 'info')) t(x, l)
UNION ALL SELECT 'coverage', feature, c, CASE WHEN c < 0.5 THEN 'warning' ELSE 'info' END FROM g UNION ALL SELECT 'missing', feature, 1 - c, 'info' FROM g UNION ALL SELECT 'range', feature, b, CASE WHEN b > 0.01 THEN 'warning' ELSE 'info' END FROM g WHERE b > 0
UNION ALL SELECT 'tier', feature || '/' || CASE WHEN c < 0.05 THEN 'unavailable' WHEN c < 0.5 OR b > 0.01 THEN 'qualified_use' ELSE 'usable_now' END || '/' || coalesce(nullif(concat_ws(',', CASE WHEN c < 0.5 THEN 'coverage' END, CASE WHEN b > 0.01 THEN 'implausible' END, CASE WHEN b > 0 AND b <= 0.01 THEN 'few implausible' END), ''), 'none'), 1, 'info' FROM g
UNION ALL SELECT 'tier', 'absent/unavailable/absent', 1, 'info' UNION ALL SELECT 'tier', 'y/prohibited/denied', 1, 'info'
UNION ALL SELECT 'rejected', x, (SELECT count_if(why = x) FROM r), 'info' FROM (VALUES ('corrupt'), ('age'), ('features'), ('numeric')) t(x)
UNION ALL SELECT 'rows', 'accepted', count_if(why IS NULL), 'info' FROM r UNION ALL SELECT 'rows', 'rejected', count(why), 'info' FROM r UNION ALL SELECT 'rows', 'will be scored', least(count_if(why IS NULL), 2000), 'info' FROM r UNION ALL SELECT 'rows', 'cap applied', (count_if(why IS NULL) > 2000)::INT, 'info' FROM r
UNION ALL SELECT 'ready', CASE WHEN count_if(why IS NULL) > 0 THEN 'ready' ELSE 'no accepted row' END, (count_if(why IS NULL) > 0)::INT, CASE WHEN count_if(why IS NULL) > 0 THEN 'info' ELSE 'blocking' END FROM r
UNION ALL SELECT 'capability', 'association', (max(n) > 1)::INT, 'info' FROM (SELECT count(*) n FROM r GROUP BY cust))
SELECT section, item, round(value::DOUBLE, 6) AS value, level FROM o""")
