"""Queries of models, attributions and what-if scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import marts as M
from ..operators import models as D
from ..operators import sampling as S
from ..sources.adapter import loans
from .data import BAND, RATIO
from .registry import T, query


def labeled(s, d):
    return loans(s, d).filter("target is not null").drop("predicted_pd")


@query("preprocess_linear")
def _(s, d):
    m = D.fit(labeled(s, d), "logistic")
    return m.transform(labeled(s, d)).select("loan_id", "features")


@query("preprocess_tree")
def _(s, d):
    df = labeled(s, d)
    return D.Filling.of(df, D.NUMBERS, D.CATEGORIES).encoded(df).select("loan_id", "features")


@query("fit_logistic")
def _(s, d):
    return D.score_batch(D.fit(labeled(s, d), "logistic", balanced=True), labeled(s, d), T)


@query("fit_gbt")
def _(s, d):
    return D.score_batch(D.fit(labeled(s, d), "trees"), labeled(s, d), T)


@query("score_batch")
def _(s, d):
    df = labeled(s, d)
    train = df.join(S.stratified_split(df).filter("split = 'train'").select("loan_id"), "loan_id", "left_semi")
    return D.score_batch(D.fit(train), df, T)


@query("compact_model")
def _(s, d):
    df = labeled(s, d)
    got = None
    for inputs in (5, 6):
        for kind in ("logistic", "trees"):
            one = D.score_batch(D.compact_model(df, inputs, kind), df, T).withColumns({"inputs": F.lit(inputs), "kind": F.lit(kind)})
            got = one if got is None else got.unionByName(one)
    return got


@query("out_of_fold_scores")
def _(s, d):
    return D.out_of_fold_scores(S.stratified_folds(labeled(s, d)))


@query("full_refit")
def _(s, d):
    df = labeled(s, d)
    return D.full_refit(df, df.select("loan_id", "purpose", "fico_range_low"), T)


@query("linear_contributions")
def _(s, d):
    return D.linear_contributions(D.fit(labeled(s, d)), labeled(s, d))


@query("tree_contributions")
def _(s, d):
    df = labeled(s, d)
    return D.tree_contributions(D.fit(df, "trees"), df)


@query("importance_join")
def _(s, d):
    df = labeled(s, d)
    m = D.fit(df, "trees")
    values = df.select("loan_id", *[F.col(c).cast("double").alias(c) for c in D.NUMBERS]).unpivot("loan_id", list(D.NUMBERS), "feature", "value")
    return D.global_importance(D.group_contributions(D.tree_contributions(m, df), m.feature_names()), D.gain_importance(m), values)


@query("gain_importance")
def _(s, d):
    return D.gain_importance(D.fit(labeled(s, d), "trees"))


def linear_parts(s, d):
    """Fixed coefficients, so that SQL has the same contributions."""
    df = loans(s, d).filter("target is not null")
    parts = F.array(*[F.struct(F.lit(n).alias("feature"), F.coalesce(c, F.lit(0.0)).alias("contribution")) for n, c in (("dti", (F.col("dti") - 22) / 50), ("int_rate", (F.col("int_rate") - 16) / 20), ("loan_amnt", (F.col("loan_amnt") - 15000) / 90000))])
    return df.select("loan_id", F.explode(parts).alias("c")).select("loan_id", "c.*")


PARTS = "parts AS (SELECT loan_id, 'dti' AS feature, coalesce((dti - 22) / 50, 0) AS contribution FROM loans WHERE target IS NOT NULL UNION ALL SELECT loan_id, 'int_rate', coalesce((int_rate - 16) / 20, 0) FROM loans WHERE target IS NOT NULL UNION ALL SELECT loan_id, 'loan_amnt', coalesce((loan_amnt - 15000) / 90000, 0) FROM loans WHERE target IS NOT NULL)"


@query("top_contributors", "SELECT loan_id, sign, feature, round(contribution, 6) AS contribution, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY loan_id, sign ORDER BY abs(contribution) DESC, feature) AS INTEGER) AS rank FROM (SELECT *, CASE WHEN contribution > 0 THEN 'raises' ELSE 'lowers' END AS sign FROM parts WHERE contribution <> 0)) WHERE rank <= 2", "loans", more=PARTS)
def _(s, d):
    return M.rounded(D.top_contributors(linear_parts(s, d), 2)).select("loan_id", "sign", "feature", "contribution", "rank")


@query("group_contributions", "SELECT loan_id, CASE feature WHEN 'loan_amnt' THEN 'amount' ELSE 'risk' END AS feature, round(sum(contribution), 6) AS contribution FROM parts GROUP BY 1, 2", "loans", more=PARTS)
def _(s, d):
    phi = linear_parts(s, d).groupBy("loan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "contribution"))), lambda x: x["contribution"]).alias("phi"))
    return M.rounded(D.group_contributions(phi, [("dti", "risk"), ("int_rate", "risk"), ("loan_amnt", "amount")]))


@query("global_importance", "SELECT feature, round(avg(abs(contribution)), 6) AS mean_abs, CAST(row_number() OVER (ORDER BY avg(abs(contribution)) DESC, feature) AS INTEGER) AS rank FROM parts GROUP BY 1", "loans", more=PARTS)
def _(s, d):
    return M.rounded(D.global_importance(linear_parts(s, d)))


IMPORTANCE = """v AS (SELECT loan_id, 'dti' AS feature, dti AS value FROM loans WHERE target IS NOT NULL UNION ALL SELECT loan_id, 'loan_amnt', annual_inc FROM loans WHERE target IS NOT NULL),
d AS (SELECT feature, loan_id, value, contribution, ntile(3) OVER (PARTITION BY feature ORDER BY value, loan_id) AS third FROM parts JOIN v USING (loan_id, feature) WHERE value IS NOT NULL),
m AS (SELECT feature, median(contribution) FILTER (WHERE third = 1) AS low, median(contribution) FILTER (WHERE third = 2) AS middle, median(contribution) FILTER (WHERE third = 3) AS high FROM d GROUP BY 1),
r AS (SELECT feature, corr(ra, rb) AS rho FROM (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2e0 AS ra, rank() OVER (PARTITION BY feature ORDER BY contribution) + (count(*) OVER (PARTITION BY feature, contribution) - 1) / 2e0 AS rb FROM d) GROUP BY 1),
i AS (SELECT feature, avg(abs(contribution)) AS mean_abs, sum(abs(contribution)) / 1000 AS gain FROM parts GROUP BY 1)"""


@query("importance_with_direction", "SELECT feature, round(mean_abs, 6) AS mean_abs, round(CASE feature WHEN 'int_rate' THEN 0 ELSE gain END, 6) AS gain, CAST(CASE feature WHEN 'int_rate' THEN 0 WHEN 'dti' THEN 2 ELSE 1 END AS BIGINT) AS encoded, round(rho, 6) AS rho, CASE WHEN rho IS NULL THEN 'category' WHEN low < middle AND middle < high THEN 'rising' WHEN low > middle AND middle > high THEN 'falling' ELSE 'mixed' END AS direction, CAST(row_number() OVER (ORDER BY mean_abs DESC, feature) AS INTEGER) AS rank FROM i LEFT JOIN m USING (feature) LEFT JOIN r USING (feature)", "loans", more=PARTS + ", " + IMPORTANCE)
def _(s, d):
    """dti is encoded in two columns that share its gain, int_rate in none; loan_amnt is held against another column's values."""
    parts = linear_parts(s, d)
    gain = parts.filter("feature <> 'int_rate'").groupBy("feature").agg((F.sum(F.abs("contribution")) / 1000).alias("all"))
    gain = gain.withColumn("of", F.when(F.col("feature") == "dti", 2).otherwise(1)).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("of")))).select("feature", F.concat("feature", F.col("k").cast("string")).alias("encoded"), (F.col("all") / F.col("of")).alias("gain"))
    values = labeled(s, d).select("loan_id", "dti", F.col("annual_inc").alias("loan_amnt")).unpivot("loan_id", ["dti", "loan_amnt"], "feature", "value")
    return M.rounded(D.global_importance(parts, gain, values))


def scenarios(s, d):
    """For every loan: a larger amount, a lower income, a ratio out of range, or a term that isn't offered, by its id."""
    k = F.col("loan_id").cast("long")
    return loans(s, d).select(
        F.concat(F.lit("s"), "loan_id").alias("scenario"), "loan_id", F.when(k % 3 == 0, F.col("loan_amnt") * 1.5 + 500).alias("loan_amnt"), F.when(k % 3 == 1, F.lit(50000.0)).alias("annual_inc"),
        F.when(k % 4 == 0, F.lit(1200.0)).when(k % 8 == 1, F.lit(15.0)).alias("dti"), F.when(k % 12 == 2, F.lit(48)).when(k % 12 == 5, F.lit(60)).alias("term_months"),
    )


ID = "CAST(loan_id AS BIGINT)"
SCEN = f"sc AS (SELECT 's' || loan_id AS scenario, loan_id, CASE WHEN {ID} % 3 = 0 THEN loan_amnt * 1.5e0 + 500 END AS loan_amnt, CASE WHEN {ID} % 3 = 1 THEN 50000e0 END AS annual_inc, CASE WHEN {ID} % 4 = 0 THEN 1200e0 WHEN {ID} % 8 = 1 THEN 15e0 END AS dti, CASE WHEN {ID} % 12 = 2 THEN 48 WHEN {ID} % 12 = 5 THEN 60 END AS term_months FROM loans), ok AS (SELECT * FROM sc WHERE coalesce(loan_amnt BETWEEN 500 AND 40000, true) AND coalesce(annual_inc > 0 AND annual_inc <= 10999200, true) AND coalesce(dti BETWEEN 0 AND 999, true) AND coalesce(term_months IN (36, 60), true))"


@query("validate_overrides", "SELECT scenario, loan_id, CASE WHEN loan_amnt NOT BETWEEN 500 AND 40000 THEN 'loan_amnt out of range;' ELSE '' END || CASE WHEN dti NOT BETWEEN 0 AND 999 THEN 'dti out of range;' ELSE '' END || CASE WHEN term_months NOT IN (36, 60) THEN 'term not 36 or 60;' ELSE '' END AS reasons, scenario IN (SELECT scenario FROM ok) AS accepted FROM sc", "loans", more=SCEN)
def _(s, d):
    said = F.array_join(F.transform("reasons", lambda r: F.concat(r, F.lit(";"))), "")
    return D.validate_overrides(scenarios(s, d)).select("scenario", "loan_id", said.alias("reasons"), "accepted")


@query("validate_inputs", "SELECT loan_id, CASE WHEN dti NOT BETWEEN (SELECT min(dti) FROM t) AND (SELECT max(dti) FROM t) THEN 'dti out of the training range;' ELSE '' END || CASE WHEN loan_amnt NOT BETWEEN (SELECT min(loan_amnt) FROM t) AND (SELECT max(loan_amnt) FROM t) THEN 'loan_amnt out of the training range;' ELSE '' END || CASE WHEN purpose NOT IN (SELECT purpose FROM t) THEN 'purpose not seen in training;' ELSE '' END AS reasons FROM loans", "loans", more="t AS (SELECT * FROM loans WHERE target IS NOT NULL AND purpose <> '1-URGENT' AND loan_amnt < 20000)")
def _(s, d):
    df = loans(s, d)
    train = df.filter("target is not null and purpose <> '1-URGENT' and loan_amnt < 20000")
    got = D.validate_inputs(df, M.numeric_bounds(train, ["loan_amnt", "dti"]), M.category_counts(train, ["purpose"]))
    return got.select("loan_id", F.array_join(F.transform("reasons", lambda r: F.concat(r, F.lit(";"))), "").alias("reasons"))


WHAT_IF = "x AS (SELECT l.loan_id, ok.scenario, true AS is_what_if, coalesce(ok.loan_amnt, l.loan_amnt) AS loan_amnt, coalesce(ok.annual_inc, l.annual_inc) AS annual_inc, coalesce(ok.dti, l.dti) AS dti, coalesce(ok.term_months, l.term_months) AS term_months FROM loans l JOIN ok ON l.loan_id = ok.loan_id UNION ALL SELECT loan_id, NULL, false, loan_amnt, annual_inc, dti, term_months FROM loans WHERE loan_id IN (SELECT loan_id FROM ok)), y AS (SELECT *, coalesce(least(dti, 45), 20) / 100 + CASE term_months WHEN 60 THEN 0.1e0 ELSE 0e0 END AS predicted_pd FROM x)"
DEPENDENT = f"round({RATIO}, 6) AS loan_to_income_ratio, {BAND['loan_amount_band']} AS loan_amount_band, {BAND['income_band']} AS income_band, {BAND['dti_band']} AS dti_band"


@query("what_if_scenarios", f"SELECT loan_id, scenario, is_what_if, round(loan_amnt, 6) AS loan_amnt, round(annual_inc, 6) AS annual_inc, round(dti, 6) AS dti, term_months, {DEPENDENT}, round(predicted_pd, 6) AS predicted_pd, CASE WHEN predicted_pd >= {T} THEN 1 ELSE 0 END AS predicted_class, CASE WHEN predicted_pd < {T / 2} THEN 'Tier A — Low' WHEN predicted_pd < {T} THEN 'Tier B — Moderate' WHEN predicted_pd < {2 * T} THEN 'Tier C — High' ELSE 'Tier D — Very High' END AS risk_tier, round(predicted_pd * 0.3e0 * loan_amnt, 8) AS el_lgd_30, round(predicted_pd * 0.45e0 * loan_amnt, 8) AS el_lgd_45, round(predicted_pd * 0.6e0 * loan_amnt, 8) AS el_lgd_60 FROM y", "loans", more=SCEN + "," + WHAT_IF)
def _(s, d):
    score = F.coalesce(F.least("dti", F.lit(45.0)), F.lit(20.0)) / 100 + F.when(F.col("term_months") == 60, 0.1).otherwise(0.0)
    got = D.what_if(loans(s, d), scenarios(s, d), score, T).drop("risk_score", "credit_score", "expected_loss")
    return got.select("loan_id", "scenario", "is_what_if", "term_months", *D.DEPENDENT[1:], "predicted_class", "risk_tier", *[F.round(c, 8 if c.startswith("el_") else 6).alias(c) for c, t in got.dtypes if t == "double"])


@query("what_if_inputs", f"SELECT scenario, loan_id, 'current' AS input_role, round(loan_amnt, 6) AS loan_amnt, round(annual_inc, 6) AS annual_inc, round(dti, 6) AS dti, term_months, {DEPENDENT} FROM y WHERE is_what_if UNION ALL SELECT ok.scenario, y.loan_id, 'baseline', round(y.loan_amnt, 6), round(y.annual_inc, 6), round(y.dti, 6), y.term_months, {DEPENDENT} FROM (SELECT scenario AS of, * EXCLUDE (scenario) FROM y WHERE NOT is_what_if) y JOIN (SELECT scenario, loan_id FROM ok) ok ON ok.loan_id = y.loan_id", "loans", more=SCEN + "," + WHAT_IF)
def _(s, d):
    return M.rounded(D.what_if_inputs(loans(s, d), scenarios(s, d)))


@query("what_if_attributions")
def _(s, d):
    return D.what_if_attributions(D.fit(labeled(s, d)), loans(s, d), scenarios(s, d))
