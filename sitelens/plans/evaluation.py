"""Queries of evaluation and repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import repair as K
from .inputs import PREDICTIONS, predictions, table
from .registry import query

W = "WITH " + PREDICTIONS
RATIO = "round(coalesce({}::DOUBLE / nullif({}, 0), 0), 6)"


@query(W + "SELECT domain, outcome, correct FROM judged")
def j3_binary_outcome(spark, d):
    return E.judged(predictions(spark, d)).select("domain", "outcome", "correct")


@query(W + f""", g AS (SELECT CASE WHEN grouping(dataset_split) = 1 THEN 'overall' ELSE dataset_split END AS scope, count(*) AS total,
  count(*) FILTER (predicted_status = 'verified') AS n_verified, count(*) FILTER (predicted_status = 'rejected') AS n_rejected, count(*) FILTER (predicted_status = 'uncertain') AS n_uncertain, count(*) FILTER (predicted_status = 'fetch_failed') AS n_fetch_failed,
  count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'FP') AS fp, count(*) FILTER (outcome = 'FN') AS fn, count(*) FILTER (outcome = 'TN') AS tn, count(*) FILTER (outcome = 'ABSTAIN') AS ab, count(*) FILTER (correct) AS c
  FROM judged GROUP BY ROLLUP (dataset_split))
SELECT scope, total, n_verified, n_rejected, n_uncertain, n_fetch_failed, tp, fp, fn, tn, {RATIO.format('(tp+fp+fn+tn)', 'tp+fp+fn+tn+ab')} AS coverage, {RATIO.format('tp', 'tp+fp')} AS precision, {RATIO.format('tp', 'tp+fn')} AS recall,
  {RATIO.format('(2*tp)', '2*tp+fp+fn')} AS f1, {RATIO.format('tn', 'tn+fp')} AS specificity, {RATIO.format('(tp+tn)', 'tp+fp+fn+tn')} AS accuracy, {RATIO.format('fp', 'fp+tn')} AS fpr, {RATIO.format('fn', 'fn+tp')} AS fnr, {RATIO.format('c', 'total')} AS strict_accuracy FROM g""")
def j5_eval_metrics(spark, d):
    return E.eval_metrics(predictions(spark, d))


@query(W + """SELECT count(*) AS total, count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'FP') AS fp, count(*) FILTER (outcome = 'FN') AS fn, count(*) FILTER (outcome = 'TN') AS tn, count(*) FILTER (outcome = 'ABSTAIN') AS abstain,
  round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round(tp::DOUBLE / nullif(count(*) FILTER (expected_label = 'gaming_media'), 0), 6) AS operational_recall, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS decided_recall,
  round((tp + tn)::DOUBLE / nullif(tp + fp + fn + tn, 0), 6) AS relevance_accuracy FROM judged""")
def j6_review_aware_metrics(spark, d):
    return E.review_aware_metrics(predictions(spark, d))


@query(W + "SELECT expected_label, predicted_status, count(*) AS n FROM preds GROUP BY ALL")
def j7_confusion_matrix(spark, d):
    return E.confusion_matrix(predictions(spark, d))


GRID_SQL = """, grid AS (SELECT row_number() OVER (ORDER BY v, u, g) AS config_id, v AS verified_threshold, u AS uncertain_threshold, g AS gaming_minimum, 4 AS media_minimum, 2 AS market_minimum, 1 AS technical_minimum, g = 8 AS high_conf_neg
  FROM (VALUES (50), (58), (70)) a(v), (VALUES (30), (40)) b(u), (VALUES (0), (8), (14)) c(g)),
sw AS (SELECT config_id, expected_label, CASE WHEN high_conf_neg AND hard_rejection_confidence >= 0.8 THEN 'rejected'
  WHEN total_score >= verified_threshold AND gaming_score >= gaming_minimum AND media_score >= media_minimum AND market_score >= market_minimum AND technical_score >= technical_minimum THEN 'verified' WHEN total_score < uncertain_threshold THEN 'rejected' ELSE 'uncertain' END AS s
  FROM preds CROSS JOIN grid),
agg AS (SELECT config_id, count(*) FILTER (s = 'verified' AND expected_label = 'gaming_media') AS tp, count(*) FILTER (s = 'verified' AND expected_label = 'not_gaming_media') AS fp, count(*) FILTER (s = 'rejected' AND expected_label = 'gaming_media') AS fn,
  count(*) FILTER (s = 'rejected' AND expected_label = 'not_gaming_media') AS tn, count(*) FILTER (s <> 'uncertain') AS decided, count(*) AS total FROM sw GROUP BY config_id),
met AS (SELECT config_id, tp, fp, fn, tn, """ + f"{RATIO.format('tp', 'tp+fp')} AS precision, {RATIO.format('tp', 'tp+fn')} AS recall, {RATIO.format('(2*tp)', '2*tp+fp+fn')} AS f1, {RATIO.format('decided', 'total')} AS coverage FROM agg)"


def grid(spark):
    rows = [(v, u, g) for v in (50, 58, 70) for u in (30, 40) for g in (0, 8, 14)]
    names = "config_id int, verified_threshold int, uncertain_threshold int, gaming_minimum int, media_minimum int, market_minimum int, technical_minimum int, high_conf_neg boolean"
    return spark.createDataFrame([(i + 1, v, u, g, 4, 2, 1, g == 8) for i, (v, u, g) in enumerate(rows)], names)


@query(W + GRID_SQL + " SELECT * FROM met")
def j8_threshold_sweep(spark, d):
    return E.threshold_sweep(predictions(spark, d), grid(spark))


def ruled(spark, d):
    """Predictions with hard rules and confidences of negative identity."""
    k = F.col("domain").cast("long")
    rule = F.when(k % 19 == 0, "dominant_ecommerce_store").when(k % 7 == 0, E.IDENTITY_RULE)
    return predictions(spark, d).withColumn("hard_rule", rule).withColumn("hard_rejection_confidence", F.when(k % 3 == 0, 1.0).otherwise(0.4))


NAMES = ("verified_threshold", "uncertain_threshold", "gaming_minimum", "media_minimum", "market_minimum", "technical_minimum")


def _sweep_sql(policy: str) -> str:
    rows = ", ".join(f"({i + 1}, {', '.join(str(x[n]) for n in NAMES)}, {str(x['high_conf_neg']).lower()})" for i, x in enumerate(E.GRIDS[policy]))
    reach = "total_score >= v AND gaming_score >= g AND media_score >= m AND technical_score >= t"
    if policy == "5C":
        status = f"CASE WHEN rule = 'dominant_ecommerce_store' OR (neg AND conf = 1.0 AND gaming_score <= 20 AND media_score <= 15) THEN 'rejected' WHEN {reach} THEN 'verified' WHEN total_score < u AND technical_score >= t THEN 'rejected' ELSE 'uncertain' END"
        counts = """count(*) FILTER (s = 'verified' AND pos) AS tp, count(*) FILTER (s = 'verified' AND NOT pos) AS fp, count(*) FILTER (s = 'rejected' AND pos) AS fn, count(*) FILTER (s = 'rejected' AND NOT pos) AS tn,
          count(*) FILTER (s <> 'uncertain') AS decided, count(*) AS total FROM st WHERE expected_label <> 'uncertain'"""
    else:
        status = f"CASE WHEN rule IS NOT NULL THEN 'rejected' WHEN total_score >= v THEN CASE WHEN {reach} AND market_score >= k THEN 'verified' ELSE 'uncertain' END WHEN total_score >= u OR technical_score < t THEN 'uncertain' ELSE 'rejected' END"
        hit = "s = 'verified'" if policy == "5" else "hit"
        counts = f"""count(*) FILTER (pos AND {hit}) AS tp, count(*) FILTER (NOT pos AND {hit}) AS fp, count(*) FILTER (pos AND NOT ({hit})) AS fn, count(*) FILTER (NOT pos AND NOT ({hit})) AS tn, count(*) FILTER (s <> 'uncertain') AS decided, count(*) AS total FROM st"""
    ratio = {"precision": ("tp", "tp+fp"), "recall": ("tp", "tp+fn"), "f1": ("(2*tp)", "2*tp+fp+fn"), "coverage": ("decided", "total"), "accuracy": ("(tp+tn)", "total")}
    return W + f""", grid(config_id, v, u, g, m, k, t, neg) AS (VALUES {rows}),
p AS (SELECT *, domain::BIGINT AS id, CASE WHEN domain::BIGINT % 19 = 0 THEN 'dominant_ecommerce_store' WHEN domain::BIGINT % 7 = 0 THEN '{E.IDENTITY_RULE}' END AS rule, CASE WHEN domain::BIGINT % 3 = 0 THEN 1.0 ELSE 0.4 END AS conf, expected_label = 'gaming_media' AS pos FROM preds),
st AS (SELECT *, {status} AS s, rule IS NULL AND {reach} AS hit FROM p CROSS JOIN grid), a AS (SELECT config_id, {counts} GROUP BY config_id)
SELECT config_id, tp, fp, fn, tn, total - decided AS abstentions, {', '.join(f'{RATIO.format(*x)} AS {n}' for n, x in ratio.items())} FROM a"""


@query(_sweep_sql("5"))
def j8_sweep_5(spark, d):
    return E.grid_sweep(ruled(spark, d), E.GRIDS["5"], "5")


@query(_sweep_sql("5B"))
def j8_sweep_5b(spark, d):
    return E.grid_sweep(ruled(spark, d), E.GRIDS["5B"], "5B")


@query(_sweep_sql("5C"))
def j8_sweep_5c(spark, d):
    return E.grid_sweep(ruled(spark, d), E.GRIDS["5C"], "5C")


SUMS = "met.*, verified_threshold + gaming_minimum + media_minimum + technical_minimum AS s FROM met JOIN grid USING (config_id)"


@query(W + GRID_SQL + f""" SELECT * FROM (
  (SELECT '5' AS policy, met.* FROM met ORDER BY fp, recall DESC, f1 DESC, coverage DESC, config_id LIMIT 1)
  UNION ALL (SELECT * EXCLUDE (s) FROM (SELECT '5B' AS policy, {SUMS}) ORDER BY (fp = 0 AND recall >= 0.5 AND coverage >= 0.6) DESC, (fp <= 1) DESC, recall DESC, f1 DESC, coverage DESC, s, config_id LIMIT 1)
  UNION ALL (SELECT * EXCLUDE (s) FROM (SELECT '5C' AS policy, {SUMS}) ORDER BY (fp <= 1) DESC, (recall >= 0.5) DESC, (coverage >= 0.6) DESC, fp, recall DESC, coverage DESC, f1 DESC, s, config_id LIMIT 1))""")
def j9_select_config(spark, d):
    out, g = None, grid(spark)
    for policy in ("5", "5B", "5C"):
        best = E.select_config(E.threshold_sweep(predictions(spark, d), g), policy, g).withColumn("policy", F.lit(policy))
        out = best if out is None else out.unionByName(best)
    return out


@query(W + """SELECT domain, expected_label, predicted_status, unnest(list_filter([CASE WHEN outcome = 'FP' THEN 'false_positive' WHEN outcome = 'FN' THEN 'false_negative' WHEN outcome = 'ABSTAIN' AND expected_label = 'gaming_media' THEN 'abstained_positive' WHEN outcome = 'ABSTAIN' THEN 'abstained_negative' END,
  CASE WHEN decision_override IS NOT NULL THEN 'gate_override' END], lambda x: x IS NOT NULL)) AS slice FROM judged""")
def j10_error_slices(spark, d):
    return E.error_slices(predictions(spark, d))


LOG = "log AS (SELECT event_type AS scope0, value > 20 AS success, value > 60 AS usable, event_id % 4 + 1 AS attempts, 'c' || event_id % 3 AS category FROM events)"


def fetch_log(spark, d):
    c = F.col
    return table(spark, d, "events").select(c("event_type").alias("scope0"), (c("value") > 20).alias("success"), (c("value") > 60).alias("usable"), (c("event_id") % 4 + 1).alias("attempts"), F.concat(F.lit("c"), (c("event_id") % 3).cast("string")).alias("category"))


@query("WITH " + LOG + " SELECT CASE WHEN grouping(scope0) = 1 THEN 'overall' ELSE scope0 END AS scope, count(*) AS total, count(*) FILTER (success) AS n_success, count(*) FILTER (usable) AS n_usable, round(avg(attempts), 6) AS mean_attempts FROM log GROUP BY ROLLUP (scope0)")
def j11_fetch_reliability(spark, d):
    return E.fetch_reliability(fetch_log(spark, d), "scope0")


@query("WITH " + LOG + " SELECT scope0, category, count(*) AS n FROM log WHERE NOT success GROUP BY ALL")
def j11_failure_histogram(spark, d):
    return E.failure_histogram(fetch_log(spark, d), "scope0")


@query("SELECT DISTINCT source AS domain FROM documents WHERE doc_id % 10 < 7 AND source IN (SELECT source FROM documents WHERE doc_id % 10 >= 7)")
def j12_leakage(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.col("source").alias("domain"))
    return E.leakage(t.where("doc_id % 10 < 7"), t.where("doc_id % 10 >= 7"))


@query("SELECT doc_id FROM documents WHERE doc_id % 10 < 7 AND n_chars NOT IN (SELECT n_chars FROM documents WHERE doc_id % 10 >= 7)")
def j12_tuning_rows(spark, d):
    """Development rows whose text is as long as no test row's."""
    split = F.when(F.col("doc_id") % 10 < 7, "development").otherwise("test")
    return E.tuning_rows(table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("domain"), split.alias("dataset_split"))).select("doc_id")


@query(W + """, u AS (SELECT domain, 58 - total_score AS distance, list_filter([CASE WHEN gaming_score < 14 THEN 'gaming_score' END, CASE WHEN media_score < 10 THEN 'media_score' END], lambda x: x IS NOT NULL) AS unmet FROM preds WHERE predicted_status = 'uncertain')
SELECT domain, array_to_string(unmet, ',') AS unmet, distance, coalesce(unmet[1], 'below_threshold') AS cause FROM u""")
def j13_abstention_audit(spark, d):
    a = E.abstention_audit(predictions(spark, d), {"gaming_score": 14, "media_score": 10}, 58)
    return a.withColumn("unmet", F.array_join("unmet", ","))


@query(W + """SELECT count(*) FILTER (predicted_status IN ('verified', 'rejected') AND NOT usable) AS decided_without_evidence, count(*) FILTER (predicted_status IN ('verified', 'rejected') AND technical_score = 0) AS decided_without_technical,
  count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'FP') AS fp FROM judged""")
def j14_decision_audit(spark, d):
    return E.decision_audit(predictions(spark, d))


@query("SELECT count(*) AS n, sum(('0x' || left(md5(concat_ws('|', coalesce(doc_id::VARCHAR, '~'), coalesce(text, '~'), coalesce(lang, '~'), coalesce(source, '~'), coalesce(n_chars::VARCHAR, '~'))), 12))::BIGINT)::VARCHAR AS content FROM documents")
def j15_table_fingerprint(spark, d):
    f = E.table_fingerprint(table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars"))
    return f.withColumn("content", F.col("content").cast("string"))


@query("""WITH a AS (SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE doc_id % 2 = 0 GROUP BY lang), b AS (SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE doc_id % 2 = 1 GROUP BY lang),
la AS (SELECT lang, 'n' AS metric, n AS v FROM a UNION ALL SELECT lang, 'chars', chars FROM a), lb AS (SELECT lang, 'n' AS metric, n AS v FROM b UNION ALL SELECT lang, 'chars', chars FROM b)
SELECT coalesce(la.lang, lb.lang) AS lang, coalesce(la.metric, lb.metric) AS metric, la.v AS a, lb.v AS b, lb.v - la.v AS change FROM la FULL JOIN lb ON la.lang = lb.lang AND la.metric = lb.metric""")
def j16_compare_runs(spark, d):
    t = table(spark, d, "documents")
    run = lambda k: t.where(F.col("doc_id") % 2 == k).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    return E.compare_runs(run(0), run(1), "lang", ["n", "chars"])


@query("""SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source UNION ALL SELECT 'total', 'all', count(*) FROM documents""")
def j2_label_summary(spark, d):
    return E.label_summary(table(spark, d, "documents"), ["lang", "source"])


@query("""WITH l AS (SELECT doc_id AS k, CASE WHEN doc_id % 50 = 0 THEN 'bad domain' WHEN doc_id % 50 = 1 THEN 'WWW.Example.com' ELSE 'd' || doc_id % 300 || '.org' END AS domain,
  CASE WHEN doc_id % 40 = 0 THEN 'odd' WHEN quality = 1 THEN 'gaming_media' ELSE 'not_gaming_media' END AS label, CASE WHEN doc_id % 29 = 0 THEN 'other' WHEN doc_id % 3 = 0 THEN 'test' ELSE 'development' END AS split FROM labels),
c AS (SELECT *, regexp_replace(lower(domain), '^www[.]', '') AS canon FROM l)
SELECT domain, 'domain_syntax' AS violation FROM l WHERE k % 50 = 0 UNION ALL SELECT domain, 'fictitious_domain' FROM l WHERE k % 50 = 1 UNION ALL SELECT domain, 'unknown_expected_label' FROM l WHERE label = 'odd'
UNION ALL SELECT domain, 'unknown_website_type' FROM l WHERE k % 7 = 0 UNION ALL SELECT domain, 'evidence_summary_too_short' FROM l WHERE k % 11 = 0 UNION ALL SELECT domain, 'evidence_url_1_scheme' FROM l WHERE k % 13 < 2
UNION ALL SELECT domain, 'blank_evidence_url_1' FROM l WHERE k % 13 = 0 UNION ALL SELECT domain, 'unknown_activity_status' FROM l WHERE k % 17 = 0 UNION ALL SELECT domain, 'unknown_review_method' FROM l WHERE k % 19 = 0
UNION ALL SELECT domain, 'blank_reviewed_at' FROM l WHERE k % 23 = 0 UNION ALL SELECT domain, 'unknown_dataset_split' FROM l WHERE split = 'other' UNION ALL SELECT canon, 'duplicate_domain' FROM c GROUP BY canon HAVING count(*) > 1
UNION ALL SELECT NULL, 'no_difficult_type_in_split_' || split FROM l WHERE split <> 'other' GROUP BY split HAVING NOT bool_or(k % 7 = 1) UNION ALL SELECT NULL, 'size_of_split_test' FROM l WHERE split = 'test' HAVING count(*) <> 15""")
def j1_validate_labels(spark, d):
    k = F.col("doc_id")
    t = table(spark, d, "labels").select(
        F.when(k % 50 == 0, "bad domain").when(k % 50 == 1, "WWW.Example.com").otherwise(F.concat(F.lit("d"), (k % 300).cast("string"), F.lit(".org"))).alias("domain"),
        F.when(k % 40 == 0, "odd").when(F.col("quality") == 1, "gaming_media").otherwise("not_gaming_media").alias("expected_label"),
        F.when(k % 29 == 0, "other").when(k % 3 == 0, "test").otherwise("development").alias("dataset_split"),
        F.when(k % 7 == 0, "odd_type").when(k % 7 == 1, "game_developer").otherwise("gaming_publication").alias("website_type"),
        F.when(k % 11 == 0, "short").otherwise("long enough evidence").alias("evidence_summary"),
        F.when(k % 13 == 0, " ").when(k % 13 == 1, "ftp://x.org").otherwise("https://x.org").alias("evidence_url_1"),
        F.when(k % 17 == 0, "gone").otherwise("active").alias("activity_status"),
        F.when(k % 19 == 0, "guess").otherwise("manual_public_web_review").alias("review_method"),
        F.when(k % 23 != 0, "2024-01-01").alias("reviewed_at"),
        F.lit("https://x.com").alias("homepage_url"),
        F.lit("long enough a reason").alias("label_reason"),
    )
    return E.validate_labels(t, {"test": 15})


@query("SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def k1_key_collisions(spark, d):
    return K.key_collisions(table(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"])


@query("SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS attempt FROM events")
def k2_renumber_attempts(spark, d):
    return K.renumber_attempts(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type", "attempt")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC NULLS LAST, ts, event_id) AS n FROM events) WHERE n = 1")
def k3_keep_best_duplicate(spark, d):
    return K.keep_best_duplicate(table(spark, d, "events"), ["user_id", "event_type"], "value", "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query("SELECT c_custkey, 'balance' AS rule FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'segment' FROM customer WHERE c_mktsegment = 'BUILDING'")
def k4_violations(spark, d):
    return K.violations(table(spark, d, "customer"), {"balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment") != "BUILDING"}, "c_custkey")


@query("SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def k5_backfill_counters(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return K.backfill_counters(table(spark, d, "customer").select("c_custkey"), o, "c_custkey", "o_orderkey", "n_orders")
