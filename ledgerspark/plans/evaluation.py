"""Queries of evaluation, ranking, splitting and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as K
from ..operators import evaluation as E
from ..operators import gates as G
from ..operators import marts as M
from ..operators import sampling as S
from ..operators import tables as P
from ..sources.adapter import loans
from .portfolio import FACT, TIER, fact
from .registry import T, query

HIST = """h AS (SELECT predicted_pd AS pd, CAST(sum(target) AS BIGINT) AS pos, CAST(sum(1 - target) AS BIGINT) AS neg FROM loans WHERE target IS NOT NULL GROUP BY 1),
c AS (SELECT pd, pos, neg, CAST(sum(pos) OVER (ORDER BY pd DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY pd DESC) AS BIGINT) AS fp, CAST(sum(pos) OVER () AS BIGINT) AS p, CAST(sum(neg) OVER () AS BIGINT) AS n FROM h)"""
RATES = "coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) AS precision, coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0) AS recall, coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0) AS f1, coalesce((tp + tn) / CAST(nullif(tp + tn + fp + fn, 0) AS DOUBLE), 0) AS accuracy"
COUNTS = "count(*) FILTER (WHERE {p} >= {t} AND target = 1) AS tp, count(*) FILTER (WHERE {p} >= {t} AND target = 0) AS fp, count(*) FILTER (WHERE {p} < {t} AND target = 1) AS fn, count(*) FILTER (WHERE {p} < {t} AND target = 0) AS tn"
ROUNDED = "tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy"


def hist(s, d):
    return E.score_histogram(loans(s, d))


@query("confusion_metrics", f"SELECT {ROUNDED} FROM (SELECT *, {RATES} FROM (SELECT {COUNTS.format(p='predicted_pd', t=T)} FROM loans WHERE target IS NOT NULL))", "loans")
def _(s, d):
    return M.rounded(E.confusion_metrics(loans(s, d), T))


@query("roc_curve", "SELECT threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, kept FROM (SELECT pd AS threshold, fp / CAST(n AS DOUBLE) AS fpr, tp / CAST(p AS DOUBLE) AS tpr, lag(pd) OVER w IS NULL OR lead(pd) OVER w IS NULL OR lead(pos) OVER w <> pos OR lead(neg) OVER w <> neg AS kept FROM c WINDOW w AS (ORDER BY pd DESC)) UNION ALL SELECT CAST('inf' AS DOUBLE), 0e0, 0e0, true", "loans", more=HIST)
def _(s, d):
    return E.roc_curve(hist(s, d)).select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"), "kept")


AUC = "sum(pos * ((n - fp) + neg / 2e0)) / CAST(max(p) * max(n) AS DOUBLE)"
AP = "sum(pos / CAST(p AS DOUBLE) * tp / CAST(tp + fp AS DOUBLE))"


@query("roc_auc", f"SELECT round({AUC}, 9) AS roc_auc FROM c", "loans", more=HIST)
def _(s, d):
    return E.ranking_metrics(hist(s, d)).select(F.round("roc_auc", 9).alias("roc_auc"))


@query("pr_curve", "SELECT pd AS threshold, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(p AS DOUBLE), 6) AS recall FROM c UNION ALL SELECT NULL, 1e0, 0e0", "loans", more=HIST)
def _(s, d):
    return E.pr_curve(hist(s, d)).select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("average_precision", f"SELECT round({AP}, 9) AS average_precision FROM c", "loans", more=HIST)
def _(s, d):
    return E.ranking_metrics(hist(s, d)).select(F.round("average_precision", 9).alias("average_precision"))


LL = "-avg(target * ln(greatest(least({p}, 1 - 2.220446049250313e-16), 2.220446049250313e-16)) + (1 - target) * ln(1 - greatest(least({p}, 1 - 2.220446049250313e-16), 2.220446049250313e-16)))"


@query("log_loss", f"SELECT round({LL.format(p='predicted_pd')}, 6) AS log_loss FROM loans WHERE target IS NOT NULL", "loans")
def _(s, d):
    return loans(s, d).filter("target is not null").agg(F.round(E.log_loss(F.col("predicted_pd"), F.col("target")), 6).alias("log_loss"))


@query("brier_score", "SELECT round(avg((predicted_pd - target) * (predicted_pd - target)), 9) AS brier FROM loans WHERE target IS NOT NULL", "loans")
def _(s, d):
    return loans(s, d).filter("target is not null").agg(F.round(E.brier(F.col("predicted_pd"), F.col("target")), 9).alias("brier"))


THRESHOLDS = [0.1, 0.2, 0.3, 0.35, 0.4, 0.5, 0.6, 0.8]
TABLE = " UNION ALL ".join(f"SELECT CAST({t} AS DOUBLE) AS threshold, {ROUNDED} FROM (SELECT *, {RATES} FROM (SELECT {COUNTS.format(p='predicted_pd', t=t)} FROM loans WHERE target IS NOT NULL))" for t in THRESHOLDS)


@query("threshold_table", TABLE, "loans")
def _(s, d):
    return M.rounded(E.threshold_table(loans(s, d), THRESHOLDS))


@query("threshold_metrics_lookup", TABLE, "loans")
def _(s, d):
    return M.rounded(E.at_thresholds(hist(s, d), THRESHOLDS))


SCORED = f"s AS (SELECT *, {RATES} FROM (SELECT pd AS threshold, tp, fp, p - tp AS fn, n - fp AS tn, pos, neg FROM c))"


@query("best_threshold", "SELECT threshold, pos, neg, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy FROM s WHERE f1 >= (SELECT max(f1) FROM s) - 1e-12 ORDER BY s.recall DESC, s.precision DESC, threshold DESC LIMIT 1", "loans", more=HIST + "," + SCORED)
def _(s, d):
    got = E.best_threshold(hist(s, d))
    return got.select("threshold", *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in got.dtypes if c != "threshold"])


@query("oof_threshold", "SELECT threshold, round(f1, 6) AS f1 FROM s ORDER BY s.f1 DESC, recall DESC, precision DESC, threshold DESC LIMIT 1", "loans", more=HIST + "," + SCORED)
def _(s, d):
    return E.best_threshold(hist(s, d), 0.0).select("threshold", F.round("f1", 6).alias("f1"))


MARKED = "h2 AS (SELECT pd, CAST(sum(pos) AS BIGINT) AS pos, CAST(sum(neg) AS BIGINT) AS neg FROM (SELECT * FROM h UNION ALL SELECT * FROM (VALUES " + ", ".join(f"(CAST({t} AS DOUBLE), 0, 0)" for t in E.DIAGNOSTIC) + ")) GROUP BY 1), c2 AS (SELECT pd, CAST(sum(pos) OVER (ORDER BY pd DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY pd DESC) AS BIGINT) AS fp, CAST(sum(pos) OVER () AS BIGINT) AS p, CAST(sum(neg) OVER () AS BIGINT) AS n FROM h2)"


@query("full_threshold_table", f"SELECT threshold, {ROUNDED}, round(coalesce(tn / CAST(nullif(tn + fp, 0) AS DOUBLE), 0), 6) AS specificity, threshold = (SELECT threshold FROM s WHERE f1 >= (SELECT max(f1) FROM s) - 1e-12 ORDER BY recall DESC, precision DESC, threshold DESC LIMIT 1) AS selected FROM (SELECT *, {RATES} FROM (SELECT pd AS threshold, tp, fp, p - tp AS fn, n - fp AS tn FROM c2))", "loans", more=HIST + "," + SCORED + "," + MARKED)
def _(s, d):
    got = E.full_threshold_table(hist(s, d))
    return got.select("threshold", *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in got.dtypes if c != "threshold"])


MODELS = {"logistic_baseline": "predicted_pd", "logistic_weighted": "pd_weighted", "xgboost_candidate": "pd_trees"}


def long(s, d, where=None):
    df = loans(s, d).filter("target is not null")
    df = df.filter(where) if where is not None else df
    return df.select("loan_id", "target", *[F.col(c).alias(m) for m, c in MODELS.items()]).unpivot(["loan_id", "target"], list(MODELS), "model", "pd")


LONG = "l AS (" + " UNION ALL ".join(f"SELECT '{m}' AS model, loan_id, target, {c} AS pd FROM loans WHERE target IS NOT NULL" for m, c in MODELS.items()) + ")"
BY_MODEL = f"""hm AS (SELECT model, pd, CAST(sum(target) AS BIGINT) AS pos, CAST(sum(1 - target) AS BIGINT) AS neg FROM l GROUP BY 1, 2),
cm AS (SELECT model, pd, pos, neg, CAST(sum(pos) OVER (PARTITION BY model ORDER BY pd DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (PARTITION BY model ORDER BY pd DESC) AS BIGINT) AS fp, CAST(sum(pos) OVER (PARTITION BY model) AS BIGINT) AS p, CAST(sum(neg) OVER (PARTITION BY model) AS BIGINT) AS n FROM hm),
m AS (SELECT model, roc_auc, average_precision, log_loss, brier FROM (SELECT model, {AUC} AS roc_auc, {AP} AS average_precision FROM cm GROUP BY 1) JOIN (SELECT model, {LL.format(p='pd')} AS log_loss, avg((pd - target) * (pd - target)) AS brier FROM l GROUP BY 1) USING (model))"""
ALL_METRICS = "round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision, round(log_loss, 6) AS log_loss, round(brier, 6) AS brier"


@query("compare_models", f"SELECT m.model, {', '.join(f'round(m.{c}, 6) AS {c}' for c in ('roc_auc', 'average_precision', 'log_loss', 'brier'))}, round(m.roc_auc - b.roc_auc, 6) AS auc_delta FROM m, (SELECT roc_auc FROM m WHERE model = 'logistic_baseline') b", "loans", more=LONG + "," + BY_MODEL)
def _(s, d):
    got = E.model_metrics(long(s, d))
    base = got.filter("model = 'logistic_baseline'").select(F.col("roc_auc").alias("base"))
    return M.rounded(got.crossJoin(F.broadcast(base)).withColumn("auc_delta", F.col("roc_auc") - F.col("base")).drop("base"))


@query("select_candidate", "SELECT model FROM m WHERE roc_auc >= (SELECT max(roc_auc) FROM m) - 0.002 AND average_precision >= (SELECT max(average_precision) FROM m WHERE roc_auc >= (SELECT max(roc_auc) FROM m) - 0.002) - 0.005 ORDER BY CASE model WHEN 'xgboost_candidate' THEN 1 ELSE 0 END, log_loss, brier, model LIMIT 1", "loans", more=LONG + "," + BY_MODEL)
def _(s, d):
    return E.select_candidate(E.model_metrics(long(s, d)))


@query("align_predictions", "SELECT loan_id, target, predicted_pd AS logistic_baseline, pd_weighted AS logistic_weighted, pd_trees AS xgboost_candidate FROM loans WHERE target IS NOT NULL", "loans")
def _(s, d):
    df = loans(s, d).filter("target is not null")
    return P.align_predictions({m: df.select("loan_id", "target", F.col(c).alias("predicted_pd")) for m, c in MODELS.items()}, df.select("loan_id", "target"))


@query("calibration_quantile", "SELECT CAST((SELECT count(*) FROM e WHERE e.edge > (SELECT min(edge) FROM e) AND e.edge < (SELECT max(edge) FROM e) AND e.edge < l.predicted_pd) AS INTEGER) AS bin, count(*) AS n, round(avg(predicted_pd), 6) AS mean_pd, round(avg(target), 6) AS observed_rate FROM loans l WHERE target IS NOT NULL GROUP BY 1", "loans", more="e AS (SELECT DISTINCT unnest(quantile_cont(predicted_pd, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS edge FROM loans WHERE target IS NOT NULL)")
def _(s, d):
    return M.rounded(E.calibration_quantile(loans(s, d)))


@query("calibration_uniform", "SELECT CAST(least(floor(predicted_pd * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(predicted_pd), 6) AS mean_pd, round(avg(target), 6) AS observed_rate, count(*) < 500 AS sparse FROM loans WHERE target IS NOT NULL GROUP BY 1", "loans")
def _(s, d):
    return M.rounded(E.calibration_uniform(loans(s, d)))


@query("confusion_row_rates", f"SELECT target AS actual, CASE WHEN predicted_pd >= {T} THEN 1 ELSE 0 END AS predicted, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY target) AS DOUBLE), 6) AS row_rate FROM loans WHERE target IS NOT NULL GROUP BY 1, 2", "loans")
def _(s, d):
    return M.rounded(E.confusion_row_rates(loans(s, d), T))


LOT = "md5('42:' || loan_id)"
RANKED = f"k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {LOT}, loan_id) AS rank, count(*) OVER (PARTITION BY target) AS n FROM loans WHERE target IS NOT NULL), sp AS (SELECT *, CASE WHEN rank <= floor(n * 0.6e0) THEN 'train' WHEN rank <= floor(n * (0.6e0 + 0.2e0)) THEN 'validation' ELSE 'test' END AS split FROM k)"


@query("stratified_split", "SELECT loan_id, target, split FROM sp", "loans", more=RANKED)
def _(s, d):
    return S.stratified_split(loans(s, d))


@query("split_audit", "SELECT split, count(*) AS rows, CAST(sum(target) AS BIGINT) AS positives, round(avg(target), 6) AS rate, round(count(*) / CAST((SELECT count(*) FROM sp) AS DOUBLE), 6) AS coverage, abs(avg(target) - (SELECT avg(target) FROM sp)) <= 0.005 AS within_tolerance, CAST(0 AS BIGINT) AS overlap, CAST(count(*) FILTER (WHERE loan_id NOT IN (SELECT loan_id FROM loans WHERE target IS NOT NULL)) AS BIGINT) AS unknown, (SELECT count(*) FROM loans WHERE target IS NOT NULL AND loan_id NOT IN (SELECT loan_id FROM sp)) AS lost FROM sp GROUP BY 1", "loans", more=RANKED)
def _(s, d):
    df = loans(s, d)
    return M.rounded(S.split_audit(S.stratified_split(df), df.filter("target is not null").select("loan_id")))


@query("class_counts", "SELECT split, target, count(*) AS n FROM sp GROUP BY 1, 2", "loans", more=RANKED)
def _(s, d):
    return S.class_counts(S.stratified_split(loans(s, d)))


@query("stratified_sample", "SELECT loan_id, target FROM k WHERE rank <= floor(n * 500 / CAST((SELECT count(*) FROM k) AS DOUBLE))", "loans", more=RANKED)
def _(s, d):
    return S.stratified_sample(loans(s, d), 500).select("loan_id", "target")


@query("stratified_kfold", "SELECT loan_id, target, CAST(rank % 5 AS INTEGER) AS fold FROM k", "loans", more=RANKED)
def _(s, d):
    return S.stratified_folds(loans(s, d)).select("loan_id", "target", "fold")


@query("first_n", "SELECT loan_id, loan_amnt FROM loans ORDER BY CAST(loan_id AS BIGINT) LIMIT 200", "loans")
def _(s, d):
    return S.first_n(loans(s, d), 200).select("loan_id", "loan_amnt")


@query("fold_metrics", f"SELECT fold, {ROUNDED}, round((tp + fn) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS positive_rate FROM (SELECT *, {RATES} FROM (SELECT CAST(rank % 5 AS INTEGER) AS fold, {COUNTS.format(p='predicted_pd', t=T)} FROM k GROUP BY 1))", "loans", more=RANKED)
def _(s, d):
    got = E.confusion_metrics(S.stratified_folds(loans(s, d)), T, ["fold"])
    return M.rounded(got.withColumn("positive_rate", (F.col("tp") + F.col("fn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))))


EIGHT = ("precision", "recall", "f1", "accuracy", "roc_auc", "average_precision", "log_loss", "brier")


@query("generalization_delta", "SELECT " + ", ".join(f"round(t.{c} - v.{c}, 6) AS {c}" for c in EIGHT) + " FROM e t, e v WHERE t.split = 'test' AND v.split = 'validation'", "loans", more=RANKED + ", l AS (SELECT split AS model, loan_id, target, predicted_pd AS pd FROM sp), " + BY_MODEL + f", r AS (SELECT *, {RATES} FROM (SELECT split, {COUNTS.format(p='predicted_pd', t=T)} FROM sp GROUP BY 1)), e AS (SELECT * FROM r JOIN m ON m.model = r.split)")
def _(s, d):
    df = loans(s, d)
    return M.rounded(E.generalization_delta(df, S.stratified_split(df), T))


@query("ordered_prefix_sum", "SELECT pd, CAST(sum(pos) OVER (ORDER BY pd) AS BIGINT) AS cum_pos, CAST(sum(neg) OVER (ORDER BY pd) AS BIGINT) AS cum_neg FROM h", "loans", more=HIST)
def _(s, d):
    return E.prefix_sums(hist(s, d), "pd", ["pos", "neg"]).select("pd", "cum_pos", "cum_neg")


@query("percentile_index", "SELECT loan_id, predicted_pd, round(q, 6) AS percentile, CAST(round_even(q, 0) AS INTEGER) AS shown FROM (SELECT loan_id, predicted_pd, 100 * (SELECT count(*) FROM v WHERE v.predicted_pd <= l.predicted_pd) / CAST((SELECT count(*) FROM v) AS DOUBLE) AS q FROM loans l WHERE target IS NOT NULL)", "loans", more=RANKED + ", v AS (SELECT predicted_pd FROM sp WHERE split = 'validation')")
def _(s, d):
    df = loans(s, d).filter("target is not null")
    ref = df.join(S.stratified_split(df).filter("split = 'validation'").select("loan_id"), "loan_id", "left_semi")
    return E.percentile_index(df, ref).select("loan_id", "predicted_pd", F.round("percentile", 6).alias("percentile"), "shown")


VALID = RANKED + ", " + LONG + ", lv AS (SELECT l.* FROM l JOIN sp ON l.loan_id = sp.loan_id WHERE sp.split = 'validation')"


def reference(s, d):
    """The validation split's scores, which may hold none of the test split."""
    split = S.stratified_split(loans(s, d))
    rows = long(s, d).join(split.filter("split = 'validation'").select("loan_id"), "loan_id", "left_semi")
    return E.reference_distribution(rows, split.filter("split = 'test'"))


@query("reference_distribution", "SELECT model, pd, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY model ORDER BY pd) AS BIGINT) AS cumulative, CAST(sum(count(*)) OVER (PARTITION BY model) AS BIGINT) AS rows FROM lv GROUP BY 1, 2", "loans", more=VALID)
def _(s, d):
    return reference(s, d)


@query("reference_summary", "SELECT model, count(*) AS rows, round(min(pd), 9) AS least, round(median(pd), 9) AS median, round(max(pd), 9) AS most FROM lv GROUP BY 1", "loans", more=VALID)
def _(s, d):
    return M.rounded(E.reference_summary(reference(s, d)), 9)


@query("percentile_by_model", "SELECT l.model, l.loan_id, round(100 * (SELECT count(*) FROM lv WHERE lv.model = l.model AND lv.pd <= l.pd) / CAST((SELECT count(*) FROM lv WHERE lv.model = l.model) AS DOUBLE), 6) AS percentile FROM l", "loans", more=VALID)
def _(s, d):
    return M.rounded(E.percentile_by_model(long(s, d), reference(s, d)))


@query("nearest_to_quantiles", "SELECT q, loan_id, predicted_pd FROM (SELECT 0.1e0 AS q, loan_id, predicted_pd FROM a UNION ALL SELECT 0.5e0, loan_id, predicted_pd FROM b UNION ALL SELECT 0.9e0, loan_id, predicted_pd FROM z)", "loans", more="lab AS (SELECT loan_id, predicted_pd FROM loans WHERE target IS NOT NULL), a AS (SELECT * FROM lab ORDER BY abs(predicted_pd - (SELECT quantile_cont(predicted_pd, 0.1) FROM lab)), loan_id LIMIT 1), b AS (SELECT * FROM lab WHERE loan_id NOT IN (SELECT loan_id FROM a) ORDER BY abs(predicted_pd - (SELECT quantile_cont(predicted_pd, 0.5) FROM lab)), loan_id LIMIT 1), z AS (SELECT * FROM lab WHERE loan_id NOT IN (SELECT loan_id FROM a UNION SELECT loan_id FROM b) ORDER BY abs(predicted_pd - (SELECT quantile_cont(predicted_pd, 0.9) FROM lab)), loan_id LIMIT 1)")
def _(s, d):
    return E.nearest_to_quantiles(loans(s, d).filter("target is not null"), "predicted_pd", (0.1, 0.5, 0.9))


@query("rank_importance", "SELECT feature, round(v, 6) AS v, CAST(row_number() OVER (ORDER BY v DESC, feature) AS INTEGER) AS rank FROM (SELECT 'dti' AS feature, avg(abs(dti)) AS v FROM loans UNION ALL SELECT 'int_rate', avg(abs(int_rate)) FROM loans UNION ALL SELECT 'loan_amnt', avg(abs(loan_amnt)) FROM loans) ORDER BY rank LIMIT 2", "loans")
def _(s, d):
    rows = loans(s, d).unpivot([], ["dti", "int_rate", "loan_amnt"], "feature", "x").groupBy("feature").agg(F.avg(F.abs("x")).alias("v"))
    return M.rounded(E.rank_importance(rows, 2))


# A score that is no function of the probability alone has breaks; they are counted against the score before.
MONO = ", mono AS (SELECT predicted_pd, min(score) AS lo, max(score) AS hi FROM (SELECT predicted_pd, round_even(1000 * (1 - predicted_pd), 0) + CAST(loan_id AS BIGINT) % 3 AS score FROM loans WHERE target IS NOT NULL) GROUP BY 1)"


@query("monotonic_check", "SELECT count(*) AS scores, CAST(count(*) FILTER (WHERE hi > before) AS BIGINT) AS breaks FROM (SELECT *, lag(lo) OVER (ORDER BY predicted_pd) AS before FROM mono)", "loans", more=HIST + MONO)
def _(s, d):
    df = loans(s, d).filter("target is not null").withColumn("credit_score", K.credit_score(F.col("predicted_pd")) + F.col("loan_id").cast("long") % 3)
    return E.monotonic_check(df, "predicted_pd", "credit_score", rising=False)


DIRECTION = """d AS (SELECT loan_id, dti, predicted_pd, ntile(3) OVER (ORDER BY dti, loan_id) AS third FROM loans WHERE target IS NOT NULL AND dti IS NOT NULL),
m AS (SELECT median(predicted_pd) FILTER (WHERE third = 1) AS low, median(predicted_pd) FILTER (WHERE third = 2) AS middle, median(predicted_pd) FILTER (WHERE third = 3) AS high FROM d),
r AS (SELECT count(*) AS n, corr(ra, rb) AS rho FROM (SELECT rank() OVER (ORDER BY dti) + (count(*) OVER (PARTITION BY dti) - 1) / 2e0 AS ra, rank() OVER (ORDER BY predicted_pd) + (count(*) OVER (PARTITION BY predicted_pd) - 1) / 2e0 AS rb FROM d))"""


@query("direction_summary", "SELECT n, round(rho, 6) AS rho, round(low, 6) AS low, round(middle, 6) AS middle, round(high, 6) AS high, CASE WHEN low < middle AND middle < high THEN 'rising' WHEN low > middle AND middle > high THEN 'falling' ELSE 'mixed' END AS direction FROM r, m", "loans", more=DIRECTION)
def _(s, d):
    return M.rounded(E.direction_summary(loans(s, d).filter("target is not null"), "dti", "predicted_pd"))


@query("fixed_order_sort", "SELECT tier, count(*) AS n, CAST(CASE tier WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 ELSE 4 END AS INTEGER) AS tier_order FROM fact GROUP BY 1 ORDER BY tier_order", "loans", more=FACT)
def _(s, d):
    return fact(s, d).groupBy("tier", "tier_order").agg(F.count("*").alias("n")).orderBy("tier_order")


# Gates, each held against a table with faults, so that checks fail as well as pass.
@query("grain_gate", "SELECT 'null keys' AS \"check\", count(*) = count(k) AS passed, CAST(count(*) - count(k) AS DOUBLE) AS observed, 0e0 AS expected FROM b UNION ALL SELECT 'duplicate keys', count(k) = count(DISTINCT k), CAST(count(k) - count(DISTINCT k) AS DOUBLE), 0e0 FROM b", more="b AS (SELECT CASE WHEN l_orderkey % 7 <> 0 THEN l_orderkey END AS k FROM lineitem)")
def _(s, d):
    from ..sources.adapter import table

    return G.grain_gate(table(s, d, "lineitem").select(F.when(F.col("l_orderkey") % 7 != 0, F.col("l_orderkey")).alias("k")), "k")


BROKEN = """x AS (SELECT CASE WHEN CAST(loan_id AS BIGINT) % 11 = 0 THEN NULL WHEN CAST(loan_id AS BIGINT) % 13 = 0 THEN '-1' ELSE loan_id END AS loan_id, CASE WHEN CAST(loan_id AS BIGINT) % 5 = 0 THEN 2 ELSE target END AS target, CASE WHEN CAST(loan_id AS BIGINT) % 17 = 0 THEN CAST('inf' AS DOUBLE) ELSE dti END AS dti, annual_inc, state_code, int_rate FROM loans),
one AS (SELECT count(*) - count(loan_id) AS nulls, count(loan_id) - count(DISTINCT loan_id) AS twice, count(*) FILTER (WHERE target IS NULL OR target NOT IN (0, 1)) AS bad, count(*) FILTER (WHERE isinf(dti)) AS inf FROM x)"""
RULES = {"features missing": 1, "features not eligible": 4, "features of class POST_LOAN": 0, "features of class POLICY_DERIVED": 1, "features of class GEOGRAPHY_ANALYTICS": 1, "features of class TEXT_HIGH_CARDINALITY": 0, "features of class UNKNOWN_REVIEW_REQUIRED": 1, "features that are ids or targets": 1}


@query("canonical_gate", "SELECT 'null keys' AS \"check\", nulls = 0 AS passed, CAST(nulls AS DOUBLE) AS observed, 0e0 AS expected FROM one UNION ALL SELECT 'duplicate keys', twice = 0, CAST(twice AS DOUBLE), 0e0 FROM one UNION ALL SELECT 'targets not 0 or 1', bad = 0, CAST(bad AS DOUBLE), 0e0 FROM one UNION ALL SELECT 'infinite values', inf = 0, CAST(inf AS DOUBLE), 0e0 FROM one" + "".join(f" UNION ALL SELECT '{k}', {str(not n).lower()}, {n}e0, 0e0" for k, n in RULES.items()), "loans", more=BROKEN)
def _(s, d):
    k = F.col("loan_id").cast("long")
    df = loans(s, d).select(
        F.when(k % 11 == 0, None).when(k % 13 == 0, "-1").otherwise(F.col("loan_id")).alias("loan_id"), F.when(k % 5 == 0, 2).otherwise(F.col("target")).alias("target"),
        F.when(k % 17 == 0, float("inf")).otherwise(F.col("dti")).alias("dti"), "annual_inc", "state_code", "int_rate",
    )
    return G.canonical_gate(df, features=["dti", "annual_inc", "state_code", "int_rate", "target", "no_such_column"])


WRONG = "w AS (SELECT *, CASE WHEN CAST(loan_id AS BIGINT) % 7 = 0 THEN expected_loss + 1 WHEN CAST(loan_id AS BIGINT) % 19 = 0 THEN -1e0 WHEN CAST(loan_id AS BIGINT) % 29 = 0 THEN NULL ELSE expected_loss END AS el, predicted_pd * CASE WHEN CAST(loan_id AS BIGINT) % 23 = 0 THEN 0.9e0 ELSE 0.3e0 END * loan_amnt AS el30 FROM fact), g AS (SELECT count(*) AS n, sum(loan_amnt) AS ead, sum(el) AS el, sum(loan_amnt) FILTER (WHERE tier <> 'D') AS t_ead, sum(el) FILTER (WHERE tier <> 'D') AS t_el, count(*) FILTER (WHERE tier <> 'D') AS t_n, count(*) FILTER (WHERE NOT coalesce(abs(el - predicted_pd * 0.45e0 * loan_amnt) <= greatest(1, loan_amnt) * 1e-9, false)) AS wrong, count(*) FILTER (WHERE NOT coalesce(el >= 0 AND el - loan_amnt <= 1e-9, false)) AS outside, count(*) FILTER (WHERE el30 > predicted_pd * 0.45e0 * loan_amnt + 1e-10) AS down FROM w)"


@query("el_reconciliation", "SELECT 'EL = PD x LGD x EAD' AS \"check\", wrong = 0 AS passed, CAST(wrong AS DOUBLE) AS observed, 0e0 AS expected FROM g UNION ALL SELECT '0 <= EL <= EAD', outside = 0, CAST(outside AS DOUBLE), 0e0 FROM g UNION ALL SELECT 'monotone in LGD', down = 0, CAST(down AS DOUBLE), 0e0 FROM g UNION ALL SELECT 'tiers'' loans = rows', t_n = n, CAST(t_n AS DOUBLE), CAST(n AS DOUBLE) FROM g UNION ALL SELECT 'tiers'' EAD off', t_ead = ead, CASE WHEN t_ead = ead THEN 0e0 ELSE 1e0 END, 0e0 FROM g UNION ALL SELECT 'tiers'' EL off', t_el = el, CASE WHEN t_el = el THEN 0e0 ELSE 1e0 END, 0e0 FROM g UNION ALL SELECT 'portfolio''s EL off', true, 0e0, 0e0 FROM g WHERE el = el", "loans", more=FACT + "," + WRONG)
def _(s, d):
    k, el = F.col("loan_id").cast("long"), F.col("expected_loss")
    df = fact(s, d).withColumns({"expected_loss": F.when(k % 7 == 0, el + 1).when(k % 19 == 0, -1.0).when(k % 29 == 0, None).otherwise(el), "el_lgd_30": F.col("predicted_pd") * F.when(k % 23 == 0, 0.9).otherwise(0.3) * F.col("loan_amnt")})
    return G.el_reconciliation(df, tiers=M.el_by(df.filter("tier <> 'D'"), "tier"), portfolio=M.el_portfolio(df))


@query("control_totals", "SELECT 'rows of ' || coalesce(a.tier, e.tier) AS \"check\", coalesce(a.n, -1) = coalesce(e.n, -1) AS passed, CAST(a.n AS DOUBLE) AS observed, CAST(e.n AS DOUBLE) AS expected FROM (SELECT tier, count(*) n FROM fact GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM fact) a FULL JOIN (SELECT tier, count(*) n FROM (SELECT " + TIER + " AS tier FROM loans) GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM loans) e ON a.tier = e.tier UNION ALL SELECT 'total expected loss', true, round(sum(expected_loss), 2), round(sum(expected_loss), 2) FROM fact", "loans", more=FACT)
def _(s, d):
    expected = loans(s, d).groupBy(K.pd_tier(F.col("predicted_pd"), T).alias("label")).agg(F.count("*").alias("n"))
    df = fact(s, d)
    return M.rounded(G.control_totals(df, "tier", expected, el=M.el_portfolio(df).first()["el"]), 2)


ODD = f"o AS (SELECT CASE WHEN CAST(loan_id AS BIGINT) % 9 = 0 THEN NULL WHEN CAST(loan_id AS BIGINT) % 10 = 0 THEN predicted_pd + 1 ELSE predicted_pd END AS p, CASE WHEN CAST(loan_id AS BIGINT) % 4 = 0 THEN 1 WHEN predicted_pd >= {T} THEN 1 ELSE 0 END AS c FROM loans WHERE target IS NOT NULL), n AS (SELECT count(*) FILTER (WHERE p IS NULL OR p < 0 OR p > 1) AS bad, count(*) FILTER (WHERE CASE WHEN p >= {T} THEN 1 ELSE 0 END <> c OR p IS NULL) AS off FROM o)"


@query("probability_gate", "SELECT 'probabilities in [0, 1]' AS \"check\", bad = 0 AS passed, CAST(bad AS DOUBLE) AS observed, 0e0 AS expected FROM n UNION ALL SELECT 'class matches threshold', off = 0, CAST(off AS DOUBLE), 0e0 FROM n", "loans", more=ODD)
def _(s, d):
    k, p = F.col("loan_id").cast("long"), F.col("predicted_pd")
    df = fact(s, d).withColumns({"predicted_pd": F.when(k % 9 == 0, None).when(k % 10 == 0, p + 1).otherwise(p), "predicted_class": F.when(k % 4 == 0, 1).otherwise(F.col("predicted_class"))})
    return G.probability_gate(df, T)


@query("metric_match", f"SELECT 'roc_auc' AS \"check\", abs(a.x - b.x) <= 1e-8 AS passed, round(a.x, 6) AS observed, round(b.x, 6) AS expected FROM (SELECT {AUC} AS x FROM c) a, (SELECT roc_auc AS x FROM m WHERE model = 'logistic_baseline') b UNION ALL SELECT 'average_precision', abs(a.x - b.x) <= 1e-8, round(a.x, 6), round(b.x, 6) FROM (SELECT {AP} AS x FROM c) a, (SELECT average_precision + 0.001e0 AS x FROM m WHERE model = 'logistic_baseline') b", "loans", more=HIST + "," + LONG + "," + BY_MODEL)
def _(s, d):
    stored = E.model_metrics(long(s, d)).filter("model = 'logistic_baseline'").withColumn("average_precision", F.col("average_precision") + 0.001)
    return M.rounded(G.metric_match(E.ranking_metrics(hist(s, d)), stored, ["roc_auc", "average_precision"]))


@query("handoff_manifest", "SELECT 'accepted = labeled + unresolved' AS \"check\", count(*) = count(target) + count(*) FILTER (WHERE target IS NULL) AS passed, CAST(count(*) AS DOUBLE) AS observed, CAST(count(target) + count(*) FILTER (WHERE target IS NULL) AS DOUBLE) AS expected FROM x UNION ALL SELECT 'labeled = paid + defaulted', count(target) = count(*) FILTER (WHERE target IN (0, 1)), CAST(count(target) AS DOUBLE), CAST(count(*) FILTER (WHERE target IN (0, 1)) AS DOUBLE) FROM x UNION ALL SELECT 'state for every row', count(s) = count(*), CAST(count(s) AS DOUBLE), CAST(count(*) AS DOUBLE) FROM x", "loans", more="x AS (SELECT CASE WHEN CAST(loan_id AS BIGINT) % 5 = 0 THEN 2 ELSE target END AS target, CASE WHEN CAST(loan_id AS BIGINT) % 3 <> 0 THEN state_code END AS s FROM loans)")
def _(s, d):
    k = F.col("loan_id").cast("long")
    return G.handoff_manifest(loans(s, d).withColumns({"target": F.when(k % 5 == 0, 2).otherwise(F.col("target")), "state_code": F.when(k % 3 != 0, F.col("state_code"))}))
