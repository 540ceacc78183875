"""Which columns there are, when each is known, and which may feed a model."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns of the business tables, in the order of the tables.
APPLICATION = ("loan_id", "loan_amnt", "issue_d", "purpose", "term_months", "application_type")
BORROWER = (
    "loan_id", "emp_title", "emp_length", "emp_length_years", "home_ownership", "annual_inc", "verification_status", "addr_state", "state_code", "zip_code", "country",
    "annual_inc_joint", "verification_status_joint",
)
CREDIT = (
    "loan_id", "dti", "dti_joint", "delinq_2yrs", "earliest_cr_line", "fico_range_low", "fico_range_high", "inq_last_6mths", "mths_since_last_delinq", "mths_since_last_record",
    "open_acc", "pub_rec", "revol_bal", "revol_util", "total_acc", "collections_12_mths_ex_med", "mths_since_last_major_derog", "acc_now_delinq", "tot_coll_amt", "tot_cur_bal",
    "open_acc_6m", "open_act_il", "open_il_12m", "open_il_24m", "mths_since_rcnt_il", "total_bal_il", "il_util", "open_rv_12m", "open_rv_24m", "max_bal_bc", "all_util",
    "total_rev_hi_lim", "inq_fi", "total_cu_tl", "inq_last_12m", "acc_open_past_24mths", "avg_cur_bal", "bc_open_to_buy", "bc_util", "chargeoff_within_12_mths", "delinq_amnt",
    "mo_sin_old_il_acct", "mo_sin_old_rev_tl_op", "mo_sin_rcnt_rev_tl_op", "mo_sin_rcnt_tl", "mort_acc", "mths_since_recent_bc", "mths_since_recent_bc_dlq",
    "mths_since_recent_inq", "mths_since_recent_revol_delinq", "num_accts_ever_120_pd", "num_actv_bc_tl", "num_actv_rev_tl", "num_bc_sats", "num_bc_tl", "num_il_tl",
    "num_op_rev_tl", "num_rev_accts", "num_rev_tl_bal_gt_0", "num_sats", "num_tl_120dpd_2m", "num_tl_30dpd", "num_tl_90g_dpd_24m", "num_tl_op_past_12m", "pct_tl_nvr_dlq",
    "percent_bc_gt_75", "pub_rec_bankruptcies", "tax_liens", "tot_hi_cred_lim", "total_bal_ex_mort", "total_bc_limit", "total_il_high_credit_limit", "revol_bal_joint",
    "sec_app_fico_range_low", "sec_app_fico_range_high", "sec_app_earliest_cr_line", "sec_app_inq_last_6mths", "sec_app_mort_acc", "sec_app_open_acc", "sec_app_revol_util",
    "sec_app_open_act_il", "sec_app_num_rev_accts", "sec_app_chargeoff_within_12_mths", "sec_app_collections_12_mths_ex_med", "sec_app_mths_since_last_major_derog",
)
PRICING = ("loan_id", "funded_amnt", "funded_amnt_inv", "int_rate", "installment", "grade", "sub_grade", "initial_list_status")
POST_LOAN = (
    "out_prncp", "out_prncp_inv", "total_pymnt", "total_pymnt_inv", "total_rec_prncp", "total_rec_int", "total_rec_late_fee", "recoveries", "collection_recovery_fee", "last_pymnt_d",
    "last_pymnt_amnt", "next_pymnt_d", "last_credit_pull_d", "last_fico_range_high", "last_fico_range_low", "debt_settlement_flag", "deferral_term", "payment_plan_start_date",
    "orig_projected_additional_accrued_interest",
)
POST_LOAN_PREFIXES = ("hardship_", "settlement_", "debt_settlement_")
# The classes of columns, and what belongs to each but for the tables above.
IDENTIFIERS = ("id", "loan_id", "member_id", "url", "rejected_application_id")
GEOGRAPHY = ("addr_state", "state", "state_code", "zip_code", "country")
TEXT = ("emp_title", "title", "desc", "loan_title")
POLICY_DERIVED = (*PRICING[1:], "policy_code", "risk_score")
APPLICATION_TIME = (
    "loan_amnt", "requested_amount", "term", "term_months", "emp_length", "emp_length_years", "home_ownership", "annual_inc", "verification_status", "issue_d", "application_date",
    "purpose", "application_type", "annual_inc_joint", "verification_status_joint", "issue_year", "issue_quarter", "issue_month", "loan_to_income_ratio", "loan_amount_band", "income_band",
)
CREDIT_SNAPSHOT = (*CREDIT[1:], "fico_avg", "credit_history_months", "fico_band", "dti_band")
ANALYTICS_ONLY = ("pymnt_plan", "disbursement_method", "target")
ELIGIBLE = ("APPLICATION_TIME", "CREDIT_SNAPSHOT")
UNKNOWN = "UNKNOWN_REVIEW_REQUIRED"

_CLASS = {name: kind for kind, names in (
    ("ANALYTICS_ONLY", ANALYTICS_ONLY), ("CREDIT_SNAPSHOT", CREDIT_SNAPSHOT), ("APPLICATION_TIME", APPLICATION_TIME), ("TEXT_HIGH_CARDINALITY", TEXT), ("GEOGRAPHY_ANALYTICS", GEOGRAPHY),
    ("POLICY_DERIVED", POLICY_DERIVED), ("POST_LOAN", POST_LOAN), ("TARGET_SOURCE", ("loan_status",)), ("IDENTIFIER", IDENTIFIERS),
) for name in names}


def policy_class(column: str) -> str:
    """The one class of a column; a name that isn't known has one that needs a review and feeds no model."""
    name = column.strip().lower()
    return _CLASS.get(name) or ("POST_LOAN" if name.startswith(POST_LOAN_PREFIXES) else UNKNOWN)


def eligible(column: str) -> bool:
    return policy_class(column) in ELIGIBLE


def post_loan(columns: Iterable[str]) -> list[str]:
    return [c for c in columns if policy_class(c) == "POST_LOAN"]


def policy_table(df: DataFrame, grain: str = "loan_id") -> DataFrame:
    """A row a column: column_name, dtype, policy_class, model_eligible, grain."""
    rows = [(c, t, policy_class(c), eligible(c), grain) for c, t in df.dtypes]
    return df.sparkSession.createDataFrame(rows, "column_name string, dtype string, policy_class string, model_eligible boolean, grain string")


def leakage_gate(df: DataFrame, features: Iterable[str]) -> DataFrame:
    """A check a rule: how many of the features break it, none expected."""
    features, have = list(features), set(df.columns)
    rules = {"features missing": [c for c in features if c not in have], "features not eligible": [c for c in features if not eligible(c)]}
    rules |= {f"features of class {k}": [c for c in features if policy_class(c) == k] for k in ("POST_LOAN", "POLICY_DERIVED", "GEOGRAPHY_ANALYTICS", "TEXT_HIGH_CARDINALITY", UNKNOWN)}
    rules["features that are ids or targets"] = [c for c in features if policy_class(c) in ("IDENTIFIER", "TARGET_SOURCE", "ANALYTICS_ONLY")]
    rows = [(rule, not bad, float(len(bad)), 0.0) for rule, bad in rules.items()]
    return df.sparkSession.createDataFrame(rows, "check string, passed boolean, observed double, expected double").withColumn("check", F.col("check"))
