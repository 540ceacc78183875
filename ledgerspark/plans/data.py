"""Queries of sources, cleaning, features, tables and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import features as X
from ..operators import policy as Y
from ..operators import tables as P
from ..sources import io as IO
from ..sources.adapter import loans, raw_accepted, raw_rejected, rejected, table
from .registry import query

R6 = lambda c: F.round(c, 6)


# Sources
@query("read_table", "SELECT o_orderkey, o_totalprice FROM orders")
def _(s, d):
    return IO.read_table(s, f"{d}/orders.parquet", ["o_orderkey", "o_totalprice"])


@query("table_row_count", "SELECT count(*) AS rows FROM lineitem")
def _(s, d):
    return P.row_count(table(s, d, "lineitem"))


@query("read_partition_rows", "SELECT loan_id, target, loan_amnt, dti FROM loans WHERE target IS NOT NULL", "loans")
def _(s, d):
    df = loans(s, d)
    return P.partition_rows(df, P.labeled_only(df).select("loan_id", "target"), ["target", "loan_amnt", "dti"])


@query("lookup", "SELECT loan_id, loan_status, loan_amnt FROM loans WHERE loan_id = (SELECT CAST(min(o_orderkey) AS VARCHAR) FROM orders)", "loans")
def _(s, d):
    df = loans(s, d).select("loan_id", "loan_status", "loan_amnt")
    row = IO.lookup(df, "loan_id", table(s, d, "orders").agg(F.min("o_orderkey").cast("string")).first()[0])
    return s.createDataFrame([row], df.schema)


@query("fingerprint")
def _(s, d):
    return IO.fingerprint(loans(s, d))


# Cleaning
BLANKS = " || ".join(f"chr({ord(c)})" for c in C.BLANKS)
TRIM = f"trim({{0}}, {BLANKS})"
RAW = ("raw_accepted",)


@query("clean_strings", "SELECT id, " + ", ".join(f"CASE WHEN {TRIM.format(c)} NOT IN ('','null','NULL','n/a') THEN {TRIM.format(c)} END AS {c}" for c in ("loan_status", "annual_inc", "emp_length")) + " FROM raw_accepted", *RAW)
def _(s, d):
    return C.clean_strings(raw_accepted(s, d)).select("id", "loan_status", "annual_inc", "emp_length")


NUM = f"CASE WHEN regexp_full_match({TRIM}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast({TRIM} AS DOUBLE) END"
PERCENT = NUM.format("replace(int_rate, '%', '')")
TERM = "try_cast(nullif(regexp_extract(term, '(\\d+)', 1), '') AS INTEGER)"
EMP = f"CASE WHEN lower({TRIM}) LIKE '%10+%' THEN 10e0 WHEN lower({TRIM}) LIKE '< 1%' THEN 0.5e0 ELSE try_cast(nullif(regexp_extract(lower({TRIM}), '(\\d+)', 1), '') AS DOUBLE) END"
STATE = f"CASE WHEN regexp_full_match(upper({TRIM}), '[A-Z]{{{{2}}}}') THEN upper({TRIM}) END"
ZIP = f"CASE WHEN regexp_full_match(lower({TRIM}), '[0-9]{{{{3,5}}}}x{{{{0,2}}}}') THEN lower({TRIM}) END"
MONTH = "CASE WHEN regexp_full_match({0}, '[A-Z][a-z]{{2}}-[0-9]{{4}}') THEN CAST(try_strptime({0}, '%b-%Y') AS DATE) END"
STATUS = TRIM.format("loan_status")
TARGET = f"CASE WHEN {STATUS} = 'Fully Paid' THEN 0 WHEN {STATUS} IN ('Charged Off', 'Default') THEN 1 END"
ID = "regexp_replace(id, '\\.0$', '')"


def _scalar(name, sql, column):
    @query(name, f"SELECT id, {sql} AS value FROM raw_accepted", *RAW)
    def _(s, d):
        return raw_accepted(s, d).select("id", column().alias("value"))


_scalar("parse_percent", PERCENT, lambda: C.parse_percent(F.col("int_rate")))
_scalar("parse_term_months", TERM, lambda: C.parse_term_months(F.col("term")))
_scalar("parse_employment_years", EMP.format("emp_length"), lambda: C.parse_employment_years(F.col("emp_length")))
_scalar("normalize_state", STATE.format("addr_state"), lambda: C.normalize_state(F.col("addr_state")))
_scalar("normalize_zip", ZIP.format("zip_code"), lambda: C.normalize_zip(F.col("zip_code")))
_scalar("normalize_id", ID, lambda: C.normalize_id(F.col("id")))
_scalar("to_number", NUM.format("dti"), lambda: C.to_number(F.col("dti")))
_scalar("parse_month", MONTH.format("issue_d"), lambda: C.parse_month(F.col("issue_d")))
_scalar("inf_to_null", "CASE WHEN isfinite(try_cast(replace(dti, 'd', '') AS DOUBLE)) THEN try_cast(replace(dti, 'd', '') AS DOUBLE) END", lambda: C.inf_to_null(F.replace(F.col("dti"), F.lit("d"), F.lit("")).try_cast("double")))
_scalar("derive_target", TARGET, lambda: C.derive_target(C.stripped(F.col("loan_status"))))

ACCEPTED_SQL = f"""SELECT {ID} AS loan_id, {STATUS} AS loan_status, {TARGET} AS target, {NUM.format('loan_amnt')} AS loan_amnt, {NUM.format('annual_inc')} AS annual_inc, {NUM.format('dti')} AS dti,
 {TERM} AS term_months, {TRIM.format('term')} AS term, CASE WHEN {TRIM.format('emp_length')} <> 'n/a' THEN {TRIM.format('emp_length')} END AS emp_length, {TRIM.format('addr_state')} AS addr_state, {PERCENT} AS int_rate, {EMP.format('emp_length')} AS emp_length_years, {STATE.format('addr_state')} AS state_code, {ZIP.format('zip_code')} AS zip_code, {MONTH.format('issue_d')} AS issue_d,
 {MONTH.format('earliest_cr_line')} AS earliest_cr_line, purpose, total_pymnt, 'United States' AS country FROM raw_accepted"""
ACCEPTED = ["loan_id", "loan_status", "target", "loan_amnt", "annual_inc", "dti", "term_months", "term", "emp_length", "addr_state", "int_rate", "emp_length_years", "state_code", "zip_code", "issue_d", "earliest_cr_line", "purpose", "total_pymnt", "country"]


@query("clean_accepted", ACCEPTED_SQL, *RAW)
def _(s, d):
    got = C.clean_accepted(raw_accepted(s, d)).select(*ACCEPTED)
    P.require_grain(got, "loan_id")
    return got


REJECTED_CLEAN = f"""SELECT {NUM.format('amount')} AS requested_amount, CAST(adate AS DATE) AS application_date, {TRIM.format('title')} AS loan_title, {NUM.format('score')} AS risk_score, {NUM.format("replace(ratio, '%', '')")} AS dti,
 {ZIP.format('zip')} AS zip_code, {STATE.format('state')} AS state_code, {EMP.format('emp')} AS emp_length_years, {NUM.format('policy')} AS policy_code, 'United States' AS country FROM raw_rejected"""


@query("clean_rejected", REJECTED_CLEAN, "raw_rejected")
def _(s, d):
    return C.clean_rejected(raw_rejected(s, d))


@query("rename", "SELECT amount AS requested_amount, adate AS application_date, title AS loan_title, score AS risk_score, ratio AS dti, zip AS zip_code, state AS state_code, emp AS emp_length, policy AS policy_code FROM raw_rejected", "raw_rejected")
def _(s, d):
    return C.rename_rejected(raw_rejected(s, d))


# Features
RATIO = "CASE WHEN annual_inc > 0 AND isfinite(annual_inc) AND isfinite(loan_amnt) THEN loan_amnt / annual_inc END"
FICO = "(fico_range_low + fico_range_high) / 2"
MONTHS = "(year(issue_d) - year(earliest_cr_line)) * 12 + month(issue_d) - month(earliest_cr_line)"
MONTHS = f"CASE WHEN {MONTHS} >= 0 THEN CAST({MONTHS} AS DOUBLE) END"


def _bands(x, bands, op):
    return f"CASE WHEN {x} IS NULL THEN NULL " + " ".join(f"WHEN {x} {op} {float(e)} THEN '{b}'" for e, b in zip(bands[0], bands[1], strict=False)) + f" ELSE '{bands[1][-1]}' END"


BAND = {"loan_amount_band": _bands("loan_amnt", X.LOAN_BANDS, "<="), "income_band": _bands("annual_inc", X.INCOME_BANDS, "<="), "dti_band": _bands("dti", X.DTI_BANDS, "<="), "fico_band": _bands(f"({FICO})", X.FICO_BANDS, "<")}


def _feature(name, sql, *columns):
    @query(name, f"SELECT loan_id, {sql} FROM loans", "loans")
    def _(s, d):
        return X.engineer_features(loans(s, d)).select("loan_id", *columns)


_feature("safe_ratio", f"{RATIO} AS loan_to_income_ratio", "loan_to_income_ratio")
_feature("fico_avg", f"{FICO} AS fico_avg", "fico_avg")
_feature("credit_history_months", f"{MONTHS} AS credit_history_months", "credit_history_months")
_feature("issue_parts", "year(issue_d) AS issue_year, 'Q' || quarter(issue_d) AS issue_quarter, month(issue_d) AS issue_month", "issue_year", "issue_quarter", "issue_month")
_feature("amount_bands", ", ".join(f"{BAND[b]} AS {b}" for b in ("loan_amount_band", "income_band", "dti_band")), "loan_amount_band", "income_band", "dti_band")
_feature("fico_band", f"{BAND['fico_band']} AS fico_band", "fico_band")
_feature("engineer_features", f"{RATIO} AS loan_to_income_ratio, {FICO} AS fico_avg, {MONTHS} AS credit_history_months, year(issue_d) AS issue_year, 'Q' || quarter(issue_d) AS issue_quarter, month(issue_d) AS issue_month, " + ", ".join(f"{v} AS {k}" for k, v in BAND.items()), "loan_to_income_ratio", "fico_avg", "credit_history_months", "issue_year", "issue_quarter", "issue_month", *BAND)


@query("sanitize_inputs", "SELECT loan_id, CASE WHEN annual_inc > 0 THEN annual_inc END AS annual_inc, CASE WHEN dti >= 0 THEN dti END AS dti FROM loans", "loans")
def _(s, d):
    return X.sanitize_inputs(loans(s, d)).select("loan_id", "annual_inc", "dti")


# Tables
def _table(name, columns, have):
    @query(name, f"SELECT {', '.join(have)} FROM loans", "loans")
    def _(s, d):
        return P.project(loans(s, d), columns, strict=True)


_table("loan_application", Y.APPLICATION, ["loan_id", "loan_amnt", "issue_d", "purpose", "term_months"])
_table("borrower_profile", Y.BORROWER, ["loan_id", "emp_length_years", "home_ownership", "annual_inc", "state_code", "zip_code"])
_table("credit_profile", Y.CREDIT, ["loan_id", "dti", "earliest_cr_line", "fico_range_low", "fico_range_high"])
_table("loan_pricing", Y.PRICING, ["loan_id", "int_rate", "installment"])


@query("loan_outcome", "SELECT loan_id, loan_status, target, total_pymnt FROM loans", "loans")
def _(s, d):
    return P.loan_outcome(loans(s, d), strict=True)


@query("rejected_applications", "SELECT * FROM rejected", "rejected")
def _(s, d):
    return rejected(s, d)


@query("labeled_only", "SELECT loan_id, target FROM loans WHERE target IS NOT NULL", "loans")
def _(s, d):
    return P.labeled_only(loans(s, d)).select("loan_id", "target")


# Fixed classes of these columns, for the SQL side; the library works them out.
DICT = {
    "loan_id": "IDENTIFIER", "loan_status": "TARGET_SOURCE", "target": "ANALYTICS_ONLY", "loan_amnt": "APPLICATION_TIME", "annual_inc": "APPLICATION_TIME", "dti": "CREDIT_SNAPSHOT",
    "term_months": "APPLICATION_TIME", "purpose": "APPLICATION_TIME", "total_pymnt": "POST_LOAN", "int_rate": "POLICY_DERIVED", "state_code": "GEOGRAPHY_ANALYTICS", "zip_code": "GEOGRAPHY_ANALYTICS",
    "pd_trees": "UNKNOWN_REVIEW_REQUIRED",
}
TYPES = {"loan_id": "string", "loan_status": "string", "purpose": "string", "state_code": "string", "zip_code": "string", "target": "int", "term_months": "int"}
FEEDS = ("APPLICATION_TIME", "CREDIT_SNAPSHOT")


@query("data_dictionary", " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{TYPES.get(c, 'double')}' AS dtype, '{k}' AS policy_class, {str(k in FEEDS).lower()} AS model_eligible, 'loan_id' AS grain, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values FROM loans" for c, k in DICT.items()), "loans")
def _(s, d):
    return P.data_dictionary(loans(s, d).select(*DICT))


AUDIT = ["loan_amnt", "annual_inc", "dti", "purpose", "home_ownership", "zip_code", "issue_d", "int_rate", "total_pymnt"]
KIND = {"purpose": "category", "home_ownership": "category", "zip_code": "category", "issue_d": "date"}
WHY = "CASE WHEN feature_name = 'zip_code' THEN 'class GEOGRAPHY_ANALYTICS' WHEN feature_name = 'int_rate' THEN 'class POLICY_DERIVED' WHEN feature_name = 'total_pymnt' THEN 'class POST_LOAN' WHEN kind = 'date' THEN 'date' END"


@query("feature_audit", f"SELECT *, CASE WHEN why IS NOT NULL THEN 'exclude' WHEN kind = 'category' THEN 'mode + one-hot' ELSE 'median + scale' END AS preprocessing, why IS NULL AS used, kind = 'category' AND distinct_values > 50 AS cardinality_concern FROM (SELECT *, {WHY} AS why FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature_name, '{KIND.get(c, 'number')}' AS kind, count(*) - count({c}) AS missing, round((count(*) - count({c})) / CAST(count(*) AS DOUBLE), 6) AS missing_rate, count(DISTINCT {c}) AS distinct_values FROM loans WHERE target IS NOT NULL" for c in AUDIT) + "))", "loans")
def _(s, d):
    return P.feature_audit(P.labeled_only(loans(s, d)).select(*AUDIT)).withColumn("missing_rate", R6("missing_rate"))


# Joins and unions
@query("canonical_join", "SELECT loan_id, loan_amnt, issue_d, purpose, term_months, emp_length_years, home_ownership, annual_inc, state_code, zip_code, dti, earliest_cr_line, fico_range_low, fico_range_high, target FROM loans", "loans")
def _(s, d):
    df = loans(s, d)
    return P.canonical_join(P.project(df, Y.APPLICATION), P.project(df, Y.BORROWER), P.project(df, Y.CREDIT), P.loan_outcome(df), strict=True)


@query("accepted_rejected_by_state", "SELECT coalesce(a.state_code, r.state_code) AS state_code, coalesce(a.n, 0) AS accepted, coalesce(r.n, 0) AS rejected FROM (SELECT state_code, count(*) n FROM loans GROUP BY 1) a FULL JOIN (SELECT state_code, count(*) n FROM rejected GROUP BY 1) r ON a.state_code = r.state_code", "loans", "rejected")
def _(s, d):
    return P.accepted_rejected_by(loans(s, d), rejected(s, d))


@query("missing_ids", "SELECT DISTINCT loan_id FROM loans WHERE target IS NULL", "loans")
def _(s, d):
    return P.missing_ids(loans(s, d), P.labeled_only(loans(s, d)))


@query("star_join", "SELECT year(issue_d) AS year, state_code, 'United States' AS country, count(*) AS loans, round(sum(loan_amnt), 2) AS amount FROM loans GROUP BY 1, 2", "loans")
def _(s, d):
    df = loans(s, d)
    dates, states = P.dim_date((df, "issue_d")).select("date", "year"), P.dim_state((df, "state_code"))
    got = P.star_join(df, dates, states)
    return got.groupBy("year", "state_code", "country").agg(F.count("*").alias("loans"), F.round(F.sum("loan_amnt"), 2).alias("amount"))


@query("reconcile_values", "SELECT count(*) AS compared, 'dti' AS \"column\", CAST(count(*) FILTER (WHERE dti > 40 OR dti IS NULL) AS BIGINT) AS mismatches FROM loans UNION ALL SELECT count(*), 'annual_inc', CAST(sum(CASE WHEN annual_inc IS DISTINCT FROM abs(annual_inc) THEN 1 ELSE 0 END) AS BIGINT) FROM loans", "loans")
def _(s, d):
    df = loans(s, d)
    other = df.withColumns({"annual_inc": F.abs("annual_inc"), "dti": F.when(F.col("dti").isNull(), -1.0).when(F.col("dti") <= 40, F.col("dti"))})
    return P.reconcile(df, other, "loan_id", ["dti", "annual_inc"])


FUNNEL_SQL = """funnel AS (SELECT issue_d AS application_date, loan_amnt AS requested_amount, state_code, zip_code, purpose, 'accepted' AS decision FROM loans
  UNION ALL SELECT application_date, requested_amount, state_code, zip_code, loan_title, 'rejected' FROM rejected)"""


@query("application_funnel", "SELECT * FROM funnel", "loans", "rejected", more=FUNNEL_SQL)
def _(s, d):
    return P.application_funnel(loans(s, d), rejected(s, d)).drop("application_id")


@query("dim_date", "SELECT DISTINCT date, year(date) AS year, 'Q' || quarter(date) AS quarter, month(date) AS month, monthname(date) AS month_name, strftime(date, '%Y-%m') AS year_month FROM (SELECT issue_d AS date FROM loans UNION SELECT application_date FROM rejected)", "loans", "rejected")
def _(s, d):
    return P.dim_date((loans(s, d), "issue_d"), (rejected(s, d), "application_date"))


@query("dim_state", "SELECT DISTINCT state_code, 'United States' AS country FROM (SELECT state_code FROM loans UNION SELECT state_code FROM rejected)", "loans", "rejected")
def _(s, d):
    return P.dim_state((loans(s, d), "state_code"), (rejected(s, d), "state_code"))


@query("set_diff", "SELECT state_code, 'accepted only' AS side FROM (SELECT state_code FROM loans EXCEPT SELECT state_code FROM rejected) UNION ALL SELECT state_code, 'rejected only' FROM (SELECT state_code FROM rejected EXCEPT SELECT state_code FROM loans)", "loans", "rejected")
def _(s, d):
    return P.set_difference(loans(s, d).select("state_code"), rejected(s, d).select("state_code"), ("accepted only", "rejected only"))


@query("wide_to_long", "SELECT loan_id, 'dti' AS feature, dti AS value FROM loans UNION ALL SELECT loan_id, 'int_rate', int_rate FROM loans UNION ALL SELECT loan_id, 'loan_amnt', loan_amnt FROM loans", "loans")
def _(s, d):
    return loans(s, d).unpivot("loan_id", ["dti", "int_rate", "loan_amnt"], "feature", "value")
