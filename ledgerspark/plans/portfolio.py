"""Queries of aggregates, scores, losses and dashboard measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import features as X
from ..functions import scoring as K
from ..operators import marts as M
from ..operators import tables as P
from ..sources.adapter import loans, raw_accepted, rejected
from .data import BAND, FUNNEL_SQL, RATIO, STATE, STATUS, ZIP
from .registry import T, query

FEAT = f"feat AS (SELECT *, {RATIO} AS lti, " + ", ".join(f"{v} AS {k}" for k, v in BAND.items()) + " FROM loans)"
TIER = f"CASE WHEN predicted_pd < {T / 2} THEN 'A' WHEN predicted_pd < {T} THEN 'B' WHEN predicted_pd < {2 * T} THEN 'C' ELSE 'D' END"
PD_BIN = "least(20, " + " + ".join(f"CAST(predicted_pd >= CAST({i / 20} AS DOUBLE) AS INTEGER)" for i in range(20)) + ")"
FACT = FEAT + f""", fact AS (SELECT *, predicted_pd * 0.45e0 * loan_amnt AS expected_loss, {TIER} AS tier, {PD_BIN} AS pd_bin,
  CASE WHEN fico_band IS NULL THEN 5 WHEN fico_band = '<650' THEN 1 WHEN fico_band = '650-699' THEN 2 WHEN fico_band = '700-749' THEN 3 ELSE 4 END AS fico_order FROM feat WHERE target IS NOT NULL)"""


def labeled(s, d):
    return P.labeled_only(X.engineer_features(loans(s, d)))


def fact(s, d):
    return M.scored_fact(labeled(s, d), T)


# Counts and rates
@query("status_counts", "SELECT coalesce(loan_status, '<NA>') AS loan_status, count(*) AS n FROM loans GROUP BY 1", "loans")
def _(s, d):
    return M.status_counts(loans(s, d))


@query("target_audit", "SELECT loan_status, CASE WHEN loan_status = 'Fully Paid' THEN 0 WHEN loan_status IN ('Charged Off', 'Default') THEN 1 END AS mapped_target, count(*) AS n FROM loans GROUP BY 1, 2", "loans")
def _(s, d):
    return M.target_audit(loans(s, d))


@query("cleaning_audit", f"""SELECT count(*) AS rows, CAST(count(*) FILTER (WHERE {STATUS} NOT IN ('Fully Paid', 'Charged Off', 'Default')) AS BIGINT) AS unresolved,
  count({STATE.format('addr_state')}) AS states, count({ZIP.format('zip_code')}) AS zips, round(count({STATE.format('addr_state')}) / CAST(count(*) AS DOUBLE), 6) AS state_coverage FROM raw_accepted""", "raw_accepted")  # fmt: skip
def _(s, d):
    return M.rounded(M.cleaning_audit(C.clean_accepted(raw_accepted(s, d))))


@query("canonical_audit", "SELECT count(*) AS joined, count(target) AS labeled, count(*) - count(target) AS unresolved, count(DISTINCT loan_id) AS unique_ids, count(*) - count(DISTINCT loan_id) AS duplicate_ids, count(*) - count(loan_id) AS null_ids, count(*) FILTER (WHERE target = 0) AS paid, count(*) FILTER (WHERE target = 1) AS defaulted FROM loans", "loans")
def _(s, d):
    return M.canonical_audit(loans(s, d))


@query("default_rate_by", "SELECT purpose, count(*) AS loans, round(avg(target), 6) AS default_rate FROM loans WHERE target IS NOT NULL AND purpose IS NOT NULL GROUP BY 1", "loans")
def _(s, d):
    return M.rounded(M.default_rate_by(loans(s, d), "purpose"))


@query("loan_trend", "SELECT strftime(issue_d, '%Y-%m') AS month, count(*) AS loans, round(sum(loan_amnt), 2) AS amount FROM loans GROUP BY 1", "loans")
def _(s, d):
    return M.rounded(M.loan_trend(loans(s, d)), 2)


@query("accepted_volume", "SELECT CAST(date_trunc('month', issue_d) AS DATE) AS month, count(*) AS loans FROM loans WHERE issue_d IS NOT NULL GROUP BY 1", "loans")
def _(s, d):
    return M.accepted_volume(loans(s, d))


@query("time_metrics", "SELECT CAST(date_trunc('month', issue_d) AS DATE) AS month, count(*) AS loans, CAST(sum(target) AS BIGINT) AS defaults, round(avg(target), 6) AS default_rate FROM loans WHERE target IN (0, 1) GROUP BY 1", "loans")
def _(s, d):
    return M.rounded(M.time_metrics(loans(s, d)))


FICO_LABELS = X.FICO_BANDS[1]
VALUES = ", ".join(f"({i}, '{b}')" for i, b in enumerate(FICO_LABELS, 1))


@query("fico_band_metrics", f"SELECT sort_order, b.fico_band, coalesce(n, 0) AS loans, CAST(coalesce(d, 0) AS BIGINT) AS defaults, CASE WHEN n >= 100 THEN round(d / CAST(n AS DOUBLE), 6) END AS default_rate, coalesce(n > 0 AND n < 100, false) AS masked FROM (VALUES {VALUES}) b(sort_order, fico_band) LEFT JOIN (SELECT fico_band, count(*) n, sum(target) d FROM feat WHERE target IS NOT NULL GROUP BY 1) m ON b.fico_band = m.fico_band", "loans", more=FEAT)
def _(s, d):
    return M.rounded(M.band_metrics(labeled(s, d), "fico_band", FICO_LABELS))


DTI_VALUES = ", ".join(f"({i}, '{b}')" for i, b in enumerate(X.DTI_BANDS[1], 1))


@query("fico_dti_heatmap", f"SELECT f.fico_band, d.dti_band, row_order, col_order, coalesce(n, 0) AS loans, CASE WHEN n >= 100 THEN round(r, 6) END AS default_rate FROM (VALUES {VALUES}) f(row_order, fico_band) CROSS JOIN (VALUES {DTI_VALUES}) d(col_order, dti_band) LEFT JOIN (SELECT fico_band, dti_band, count(*) n, avg(target) r FROM feat WHERE target IS NOT NULL GROUP BY 1, 2) m ON f.fico_band = m.fico_band AND d.dti_band = m.dti_band", "loans", more=FEAT)
def _(s, d):
    cells = labeled(s, d).groupBy("fico_band", "dti_band").agg(F.count("*").alias("n"), F.avg("target").alias("r"))
    got = P.ordered_matrix(cells, ("fico_band", FICO_LABELS), ("dti_band", X.DTI_BANDS[1]))
    return got.select("fico_band", "dti_band", "row_order", "col_order", F.coalesce("n", F.lit(0)).alias("loans"), F.when(F.col("n") >= M.SPARSE, F.round("r", 6)).alias("default_rate"))


@query("dti_box", """SELECT q.target, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(q.cap, 6) AS cap, round(min(dti), 6) AS low_whisker, round(max(dti), 6) AS high_whisker
  FROM (SELECT target, count(*) n, quantile_cont(dti, 0.25) q1, quantile_cont(dti, 0.5) median, quantile_cont(dti, 0.75) q3, max(cap) cap FROM v GROUP BY 1) q JOIN v ON q.target = v.target AND dti BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1) GROUP BY ALL""", "loans", more="c AS (SELECT quantile_cont(dti, 0.99) cap FROM loans WHERE dti >= 0), v AS (SELECT target, dti, cap FROM loans, c WHERE dti >= 0 AND target IS NOT NULL AND dti <= cap)")  # fmt: skip
def _(s, d):
    return M.rounded(M.box_stats(loans(s, d), "target", "dti"))


@query("histogram", "SELECT CAST(least(floor((loan_amnt - lo) / ((hi - lo) / 40)), 39) AS INTEGER) AS bin, count(*) AS n, round(min(lo + least(floor((loan_amnt - lo) / ((hi - lo) / 40)), 39) * ((hi - lo) / 40)), 6) AS \"left\" FROM loans, (SELECT min(loan_amnt) lo, max(loan_amnt) hi FROM loans) GROUP BY 1", "loans")
def _(s, d):
    return M.rounded(M.histogram(loans(s, d), "loan_amnt"))


@query("funnel_counts", "SELECT decision, count(*) AS applications, CASE decision WHEN 'accepted' THEN (SELECT count(*) FROM loans) ELSE (SELECT count(*) FROM rejected) END AS expected FROM funnel GROUP BY 1", "loans", "rejected", more=FUNNEL_SQL)
def _(s, d):
    a, r = loans(s, d), rejected(s, d)
    return M.funnel_counts(P.application_funnel(a, r), {"accepted": a, "rejected": r})


@query("funnel_monthly", "SELECT CAST(date_trunc('month', application_date) AS DATE) AS application_month, state_code, decision, count(*) AS application_count, round(sum(requested_amount), 2) AS requested_amount, count(requested_amount) AS amount_known_count FROM funnel GROUP BY 1, 2, 3", "loans", "rejected", more=FUNNEL_SQL)
def _(s, d):
    return M.rounded(M.funnel_monthly(P.application_funnel(loans(s, d), rejected(s, d))), 2)


@query("accepted_share", "SELECT decision, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM funnel GROUP BY 1", "loans", "rejected", more=FUNNEL_SQL)
def _(s, d):
    return M.rounded(M.counts_and_share(P.application_funnel(loans(s, d), rejected(s, d)), "decision"))


@query("scan_audit", "SELECT count(*) AS rows, count(*) - count(loan_id) AS null_ids, count(*) - count(DISTINCT loan_id) AS duplicate_ids, count(*) FILTER (WHERE target = 1) AS defaulted, round(count(state_code) / CAST(count(*) AS DOUBLE), 6) AS state_coverage, round(count(issue_d) / CAST(count(*) AS DOUBLE), 6) AS date_coverage, count(*) FILTER (WHERE isinf(loan_amnt) OR isinf(annual_inc) OR isinf(dti)) AS infinite FROM loans WHERE target IS NOT NULL", "loans")
def _(s, d):
    return M.rounded(M.scan_audit(P.labeled_only(loans(s, d))))


# Scores and losses
def _score(name, sql, columns):
    @query(name, f"SELECT loan_id, {sql} FROM loans", "loans")
    def _(s, d):
        return M.rounded(loans(s, d).select("loan_id", *columns(F.col("predicted_pd"))))


CLIP = "greatest(least(predicted_pd, 1 - 1e-6), 1e-6)"
LOGODDS = f"ln({CLIP} / (1 - {CLIP}))"
_score("pd_to_log_odds", f"round({LOGODDS}, 6) AS z", lambda p: [K.pd_to_log_odds(p).alias("z")])
_score("log_odds_to_pd", f"round(1 / (1 + exp(-({LOGODDS}))), 6) AS p", lambda p: [K.log_odds_to_pd(K.pd_to_log_odds(p)).alias("p")])
PDO = f"greatest(least(600 - 50 / ln(2e0) * ({LOGODDS} - ln(0.05e0)), 850e0), 300e0)"
_score("pdo_score", f"round({PDO}, 6) AS score", lambda p: [K.pdo_score(p, least=300, most=850).alias("score")])
_score("score_tier", f"CASE WHEN {PDO} <= 450 THEN 'low' WHEN {PDO} <= 550 THEN 'middle' ELSE 'high' END AS tier", lambda p: [K.score_tier(K.pdo_score(p, least=300, most=850), [450, 550], ["low", "middle", "high"]).alias("tier")])
_score("risk_score", "round(100 * predicted_pd, 6) AS risk_score", lambda p: [K.risk_score(p).alias("risk_score")])
_score("credit_score", "CAST(round_even(1000 * (1 - predicted_pd), 0) AS INTEGER) AS credit_score", lambda p: [K.credit_score(p).alias("credit_score")])
_score("pd_tier", f"{TIER} AS tier", lambda p: [K.pd_tier(p, T).alias("tier")])
_score("flag_default", f"CASE WHEN predicted_pd >= {T} THEN 1 ELSE 0 END AS flag, CASE WHEN target IS NULL THEN NULL WHEN predicted_pd >= {T} THEN CASE target WHEN 1 THEN 'TP' ELSE 'FP' END ELSE CASE target WHEN 1 THEN 'FN' ELSE 'TN' END END AS code", lambda p: [K.flag_default(p, T).alias("flag"), K.outcome_code(p, F.col("target"), T).alias("code")])
PD_LABEL = f"CASE WHEN {PD_BIN} = 20 THEN '0.95–1.00 (inclusive)' ELSE printf('%.2f–<%.2f', ({PD_BIN} - 1) / 20e0, {PD_BIN} / 20e0) END"
_score("pd_bin", f"{PD_BIN} AS pd_bin, {PD_LABEL} AS pd_bin_label", lambda p: [K.pd_bin(p).alias("pd_bin"), K.pd_bin_label(K.pd_bin(p)).alias("pd_bin_label")])
_score("expected_loss", "round(predicted_pd * 0.45e0 * loan_amnt, 6) AS expected_loss", lambda p: [K.expected_loss(p, 0.45, F.col("loan_amnt")).alias("expected_loss")])
LTI = "CASE WHEN {0} IS NULL OR {0} < 0 THEN NULL " + " ".join(f"WHEN {{0}} < {e} THEN {i}" for i, e in enumerate((0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0), 1)) + " ELSE 9 END"
LTI_X = "CASE {0} WHEN 1 THEN 0.05e0 WHEN 2 THEN 0.15e0 WHEN 3 THEN 0.25e0 WHEN 4 THEN 0.35e0 WHEN 5 THEN 0.45e0 WHEN 6 THEN 0.55e0 WHEN 7 THEN 0.7e0 WHEN 8 THEN 0.9e0 WHEN 9 THEN 1.333333e0 END"
_score("loan_to_income_bin", f"{LTI.format('(' + RATIO + ')')} AS lti_bin, {LTI_X.format('(' + LTI.format('(' + RATIO + ')') + ')')} AS lti_x", lambda p: [(b := K.lti_bin(X.safe_ratio(F.col("loan_amnt"), F.col("annual_inc")))).alias("lti_bin"), K.lti_bin_x(b).alias("lti_x")])


@query("expected_loss_dataset", "SELECT loan_id, round(predicted_pd * 0.45e0 * loan_amnt, 6) AS expected_loss, round(CASE WHEN loan_amnt <> 0 THEN predicted_pd * 0.45e0 * loan_amnt / loan_amnt END, 6) AS el_rate, round(predicted_pd * 0.3e0 * loan_amnt, 6) AS el_lgd_30, round(predicted_pd * 0.45e0 * loan_amnt, 6) AS el_lgd_45, round(predicted_pd * 0.6e0 * loan_amnt, 6) AS el_lgd_60 FROM loans", "loans")
def _(s, d):
    K.require_loss_inputs(loans(s, d))
    return M.rounded(K.expected_loss_dataset(loans(s, d)).select("loan_id", "expected_loss", "el_rate", "el_lgd_30", "el_lgd_45", "el_lgd_60"))


@query("tier_parts", "SELECT loan_id, tier, CAST(CASE tier WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 ELSE 4 END AS INTEGER) AS tier_order, CASE tier WHEN 'A' THEN 'Tier A — Low' WHEN 'B' THEN 'Tier B — Moderate' WHEN 'C' THEN 'Tier C — High' ELSE 'Tier D — Very High' END AS tier_label, tier AS tier_code, coalesce(fico_band, 'Missing') AS fico_label, fico_order FROM fact", "loans", more=FACT)
def _(s, d):
    label = K.tier_label(F.col("tier"))
    return fact(s, d).select("loan_id", "tier", "tier_order", label.alias("tier_label"), K.tier_code(label).alias("tier_code"), "fico_label", "fico_order")


@query("scenario_id")
def _(s, d):
    return loans(s, d).select("loan_id", K.scenario_id("loan_id", "loan_amnt", "term_months").alias("scenario_id"))


LABEL = "CASE tier WHEN 'A' THEN 'Tier A — Low' WHEN 'B' THEN 'Tier B — Moderate' WHEN 'C' THEN 'Tier C — High' ELSE 'Tier D — Very High' END"


def scores(s, d):
    """Predictions of labeled loans with their context, under the join's guards."""
    df = labeled(s, d)
    predictions = df.select("loan_id", "target", "predicted_pd", K.flag_default(F.col("predicted_pd"), T).alias("predicted_class"))
    return P.scored_context_join(predictions, df.select("loan_id", "purpose", "home_ownership", "fico_avg", "loan_amnt", "annual_inc", "dti", "loan_to_income_ratio"), T)


@query("scored_context_join", f"SELECT loan_id, target, predicted_pd, CASE WHEN predicted_pd >= {T} THEN 1 ELSE 0 END AS predicted_class, purpose, (fico_range_low + fico_range_high) / 2 AS fico_avg, {T}e0 AS decision_threshold, {LABEL} AS risk_tier, round(100 * predicted_pd, 6) AS risk_score FROM fact", "loans", more=FACT)
def _(s, d):
    return scores(s, d).select("loan_id", "target", "predicted_pd", "predicted_class", "purpose", "fico_avg", "decision_threshold", "risk_tier", F.round("risk_score", 6).alias("risk_score"))


@query("evaluated_fact", f"""SELECT loan_id, target, round(predicted_pd, 6) AS predicted_pd, CASE WHEN predicted_pd >= {T} THEN 1 ELSE 0 END AS predicted_class, round(100 * predicted_pd, 6) AS risk_score, CAST(round_even(1000 * (1 - predicted_pd), 0) AS INTEGER) AS credit_score,
  tier AS risk_tier, {LABEL} AS risk_tier_label, CAST(CASE tier WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 ELSE 4 END AS INTEGER) AS tier_sort_order, (fico_range_low + fico_range_high) / 2 AS fico_avg, coalesce(fico_band, 'Missing') AS fico_band, fico_order AS fico_band_sort_order,
  round(loan_amnt, 6) AS loan_amnt, round(annual_inc, 6) AS annual_inc, round(dti, 6) AS dti, round(lti, 6) AS loan_to_income_ratio, home_ownership, purpose, round(loan_amnt, 6) AS ead_proxy, round(expected_loss, 6) AS expected_loss, round(expected_loss / loan_amnt, 6) AS expected_loss_rate,
  round(predicted_pd * 0.3e0 * loan_amnt, 6) AS expected_loss_lgd_30, round(predicted_pd * 0.45e0 * loan_amnt, 6) AS expected_loss_lgd_45, round(predicted_pd * 0.6e0 * loan_amnt, 6) AS expected_loss_lgd_60,
  round((pd_bin - 1) / 20e0, 6) AS pd_bin, {PD_LABEL} AS pd_bin_label, pd_bin AS pd_bin_sort_order FROM fact""", "loans", more=FACT)  # fmt: skip
def _(s, d):
    scored = scores(s, d)
    return M.rounded(M.evaluated_fact(scored, M.losses(scored), labeled(s, d).select("loan_id", "fico_band")))


TIER_VALUES = "(VALUES (1, 'A'), (2, 'B'), (3, 'C'), (4, 'D')) t(sort_order, tier)"


@query("risk_tier_summary", f"SELECT sort_order, t.tier, coalesce(loans, 0) AS loans, round(min_pd, 6) AS min_pd, round(max_pd, 6) AS max_pd, round(mean_pd, 6) AS mean_pd, round(median_pd, 6) AS median_pd, coalesce(defaults, 0) AS defaults, round(observed_rate, 6) AS observed_rate, round(coalesce(loans / CAST((SELECT count(*) FROM fact) AS DOUBLE), 0), 6) AS share FROM {TIER_VALUES} LEFT JOIN (SELECT tier, count(*) loans, min(predicted_pd) min_pd, max(predicted_pd) max_pd, avg(predicted_pd) mean_pd, median(predicted_pd) median_pd, CAST(sum(target) AS BIGINT) defaults, avg(target) observed_rate FROM fact GROUP BY 1) g ON t.tier = g.tier", "loans", more=FACT)
def _(s, d):
    return M.rounded(M.risk_tier_summary(labeled(s, d), T))


SUMMARY = "SELECT '{0}' AS variable, count({1}) AS n, round(avg({1}), 6) AS mean, round(stddev_samp({1}), 6) AS std, round(min({1}), 6) AS min, round(quantile_cont({1}, 0.1), 6) AS p10, round(quantile_cont({1}, 0.25), 6) AS p25, round(quantile_cont({1}, 0.5), 6) AS median, round(quantile_cont({1}, 0.75), 6) AS p75, round(quantile_cont({1}, 0.9), 6) AS p90, round(max({1}), 6) AS max FROM fact"


@query("score_summary", " UNION ALL ".join(SUMMARY.format(a, b) for a, b in (("predicted_pd", "predicted_pd"), ("risk_score", "(100 * predicted_pd)"), ("credit_score", "round_even(1000 * (1 - predicted_pd), 0)"))), "loans", more=FACT)
def _(s, d):
    return M.rounded(M.score_summary(fact(s, d), ["predicted_pd", "risk_score", "credit_score"]))


@query("el_portfolio", "SELECT count(*) AS loans, round(sum(loan_amnt), 2) AS ead, round(sum(expected_loss), 2) AS el, round(avg(expected_loss), 2) AS mean_el, round(median(expected_loss), 2) AS median_el, round(sum(expected_loss) / sum(loan_amnt), 2) AS el_rate, round(sum(predicted_pd * loan_amnt) / sum(loan_amnt), 2) AS weighted_pd FROM fact", "loans", more=FACT)
def _(s, d):
    return M.rounded(M.el_portfolio(fact(s, d)), 2)


BY = "SELECT {0}, count(*) AS loans, round(sum(loan_amnt), 3) AS ead, round(sum(expected_loss), 3) AS el, round(avg(predicted_pd), 3) AS mean_pd, round(avg(expected_loss), 3) AS mean_el, round(avg(target), 3) AS observed_rate, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 3) AS loans_share, round(sum(loan_amnt) / sum(sum(loan_amnt)) OVER (), 3) AS ead_share, round(sum(expected_loss) / sum(sum(expected_loss)) OVER (), 3) AS el_share FROM fact GROUP BY 1"


@query("el_by_tier", BY.format("tier"), "loans", more=FACT)
def _(s, d):
    return M.rounded(M.el_by(fact(s, d), "tier"), 3)


@query("el_sensitivity", "SELECT lgd, round(lgd * x, 2) AS total_el FROM (SELECT sum(predicted_pd * loan_amnt) x FROM fact), (VALUES (0.3e0), (0.45e0), (0.6e0)) v(lgd)", "loans", more=FACT)
def _(s, d):
    return M.rounded(M.el_sensitivity(fact(s, d)), 2)


@query("threshold_policy", f"SELECT count(*) FILTER (WHERE predicted_pd < {T}) AS approved, count(*) FILTER (WHERE predicted_pd >= {T}) AS rejected, CAST(sum(target) FILTER (WHERE predicted_pd < {T}) AS BIGINT) AS defaults_approved, round(sum(expected_loss) FILTER (WHERE predicted_pd < {T}), 2) AS el_approved FROM fact", "loans", more=FACT)
def _(s, d):
    return M.rounded(M.threshold_policy(fact(s, d), T), 2)


@query("pd_histogram", "SELECT pd_bin, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM fact GROUP BY 1", "loans", more=FACT)
def _(s, d):
    return M.rounded(M.counts_and_share(fact(s, d), "pd_bin"))


@query("fact_measures", "SELECT purpose, count(*) AS loans, round(avg(predicted_pd), 3) AS mean_pd, round(median(predicted_pd), 3) AS median_pd, CAST(sum(target) AS BIGINT) AS defaults, round(avg(target), 3) AS default_rate, round(sum(loan_amnt), 3) AS ead, round(sum(expected_loss), 3) AS el, round(avg(expected_loss), 3) AS mean_el, count(*) FILTER (WHERE tier IN ('C', 'D')) AS high_risk, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 3) AS loan_share, round(sum(expected_loss) / sum(loan_amnt), 3) AS el_rate, round(sum(expected_loss) / sum(sum(expected_loss)) OVER (), 3) AS el_contribution, round(count(*) FILTER (WHERE tier IN ('C', 'D')) / CAST(count(*) AS DOUBLE), 3) AS high_risk_share FROM fact GROUP BY 1", "loans", more=FACT)
def _(s, d):
    return M.rounded(M.fact_measures(fact(s, d), "purpose"), 3)


@query("pd_quartiles_by_fico", "SELECT fico_order, count(*) AS n, round(quantile_cont(predicted_pd, 0.25), 6) AS q1, round(quantile_cont(predicted_pd, 0.5), 6) AS median, round(quantile_cont(predicted_pd, 0.75), 6) AS q3, round(avg(predicted_pd), 6) AS mean FROM fact GROUP BY 1", "loans", more=FACT)
def _(s, d):
    return M.rounded(M.quartiles_by(fact(s, d), "fico_order", "predicted_pd"))


@query("lti_risk_line", f"SELECT *, {LTI_X.format('lti_bin')} AS lti_x, CASE lti_bin WHEN 9 THEN '≥ 1,0 (nhóm đuôi)' WHEN 1 THEN '0 – <0,1' WHEN 7 THEN '0,6 – <0,8' WHEN 8 THEN '0,8 – <1,0' ELSE '0,' || (lti_bin - 1) || ' – <0,' || lti_bin END AS lti_label FROM (SELECT {LTI.format('lti')} AS lti_bin, count(*) AS n, round(avg(predicted_pd), 6) AS mean_pd, round(avg(target), 6) AS observed_rate, round(avg(target) - avg(predicted_pd), 6) AS gap, count(*) < 100 AS sparse FROM fact WHERE lti IS NOT NULL GROUP BY 1)", "loans", more=FACT)
def _(s, d):
    return M.rounded(M.lti_risk_line(fact(s, d)))


@query("state_risk_map", "SELECT s.state_code, coalesce(n, 0) AS loans, coalesce(defaults, 0) AS defaults, round(rate, 6) AS default_rate, round(mean_pd, 6) AS mean_pd FROM (SELECT state_code FROM loans UNION SELECT state_code FROM rejected) s LEFT JOIN (SELECT state_code, count(*) n, CAST(sum(target) AS BIGINT) defaults, avg(target) rate, avg(predicted_pd) mean_pd FROM fact GROUP BY 1) f ON s.state_code = f.state_code", "loans", "rejected", more=FACT)
def _(s, d):
    states = P.dim_state((loans(s, d), "state_code"), (rejected(s, d), "state_code")).select("state_code")
    return M.rounded(M.state_risk_map(fact(s, d), states))


@query("portfolio_kpis", "SELECT count(*) AS loans, round(sum(loan_amnt), 2) AS funded, round(avg((fico_range_low + fico_range_high) / 2), 2) AS mean_fico, round(avg(loan_amnt), 2) AS mean_loan, round(CASE WHEN count(target) >= 100 THEN avg(target) END, 2) AS default_rate FROM loans", "loans")
def _(s, d):
    return M.rounded(M.portfolio_kpis(X.engineer_features(loans(s, d))), 2)


@query("top_category", "SELECT purpose, count(*) AS n FROM loans GROUP BY 1 ORDER BY n DESC, purpose LIMIT 1", "loans")
def _(s, d):
    return M.top_by_count(loans(s, d), "purpose")


@query("peak_year", "SELECT year(issue_d) AS year, count(*) AS n FROM loans GROUP BY 1 ORDER BY n DESC, year LIMIT 1", "loans")
def _(s, d):
    return M.top_by_count(loans(s, d).select(F.year("issue_d").alias("year")), "year")


@query("category_mix", "SELECT home_ownership, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM loans GROUP BY 1", "loans")
def _(s, d):
    return M.rounded(M.counts_and_share(loans(s, d), "home_ownership"))


@query("numeric_bounds", "SELECT 'loan_amnt' AS feature, min(loan_amnt) AS low, max(loan_amnt) AS high FROM loans WHERE target IS NOT NULL UNION ALL SELECT 'dti', min(dti), max(dti) FROM loans WHERE target IS NOT NULL UNION ALL SELECT 'annual_inc', min(annual_inc), max(annual_inc) FROM loans WHERE target IS NOT NULL", "loans")
def _(s, d):
    return M.numeric_bounds(P.labeled_only(loans(s, d)), ["loan_amnt", "dti", "annual_inc"])


@query("category_counts", "SELECT 'purpose' AS feature, purpose AS value, count(*) AS n FROM loans WHERE target IS NOT NULL GROUP BY 2 UNION ALL SELECT 'home_ownership', home_ownership, count(*) FROM loans WHERE target IS NOT NULL GROUP BY 2", "loans")
def _(s, d):
    return M.category_counts(P.labeled_only(loans(s, d)), ["purpose", "home_ownership"])
