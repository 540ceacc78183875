"""Cleaning of raw application files, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the source files: tokens that stand for null, and the labels of resolved loans.
NULL_TOKENS = ("", "null", "NULL", "n/a")
#: What is stripped from both ends: all characters that Unicode counts as white space.
BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)))
COUNTRY = "United States"
# Fixed column names of the accepted file, by how they are read.
PERCENT_COLUMNS = ("int_rate", "revol_util")
NUMERIC_COLUMNS = ("loan_amnt", "funded_amnt", "funded_amnt_inv", "installment", "annual_inc", "dti", "fico_range_low", "fico_range_high", "inq_last_6mths", "open_acc", "pub_rec", "revol_bal", "total_acc", "annual_inc_joint", "dti_joint")
DATE_COLUMNS = ("issue_d", "earliest_cr_line", "last_pymnt_d", "next_pymnt_d", "last_credit_pull_d", "hardship_start_date", "hardship_end_date", "payment_plan_start_date", "debt_settlement_flag_date", "settlement_date", "sec_app_earliest_cr_line")
GOOD, BAD = ("Fully Paid",), ("Charged Off", "Default")
REJECTED_NAMES = {
    "Amount Requested": "requested_amount", "Application Date": "application_date", "Loan Title": "loan_title", "Risk_Score": "risk_score", "Debt-To-Income Ratio": "dti",
    "Zip Code": "zip_code", "State": "state_code", "Employment Length": "emp_length", "Policy Code": "policy_code",
}


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def clean_string(c: Column) -> Column:
    t = stripped(c)
    return F.when(~t.isin(*NULL_TOKENS), t)


def clean_strings(df: DataFrame) -> DataFrame:
    """Trims headers and every string value; null tokens become null."""
    kinds = dict(df.dtypes)
    return df.select(*[(clean_string(F.col(f"`{n}`")) if kinds[n] == "string" else F.col(f"`{n}`")).alias(n.strip()) for n in df.columns])


def to_number(c: Column) -> Column:
    """Numbers in plain or scientific notation; all else, infinity and NaN included, is null."""
    t = stripped(c)
    return inf_to_null(F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double")))


def parse_percent(c: Column) -> Column:
    return to_number(F.replace(c, F.lit("%"), F.lit("")))


def parse_term_months(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit("")).try_cast("int")


def parse_employment_years(c: Column) -> Column:
    t = F.lower(stripped(c))
    return F.when(t.contains("10+"), 10.0).when(t.startswith("< 1"), 0.5).otherwise(F.nullif(F.regexp_extract(t, r"(\d+)", 1), F.lit("")).try_cast("double"))


def normalize_state(c: Column) -> Column:
    t = F.upper(stripped(c))
    return F.when(t.rlike("^[A-Z]{2}$"), t)


def normalize_zip(c: Column) -> Column:
    t = F.lower(stripped(c))
    return F.when(t.rlike(r"^[0-9]{3,5}x{0,2}$"), t)


def normalize_id(c: Column) -> Column:
    return F.regexp_replace(c, r"\.0$", "")


def parse_month(c: Column) -> Column:
    return F.try_to_date(F.when(c.rlike("^[A-Z][a-z]{2}-[0-9]{4}$"), c), "MMM-yyyy")


def inf_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def derive_target(c: Column) -> Column:
    return F.when(c.isin(*GOOD), 0).when(c.isin(*BAD), 1)


def clean_accepted(raw: DataFrame) -> DataFrame:
    """The whole cleaning of the accepted file in one projection. Columns are read by their kind where the file has them; what term, employment length and state are made from stays beside what is made. Infinities become null. Whether loan_id is a key is for require_grain() to say."""
    df = clean_strings(raw)
    if "id" in df.columns:
        df = df.withColumnRenamed("id", "loan_id")
    if missing := [c for c in ("loan_id", "loan_status") if c not in df.columns]:
        raise ValueError(f"accepted file lacks {missing}")
    made = {"loan_id": normalize_id(F.col("loan_id")), "target": derive_target(F.col("loan_status"))}
    made |= {c: parse_percent(F.col(c)) for c in PERCENT_COLUMNS} | {c: to_number(F.col(c)) for c in NUMERIC_COLUMNS} | {c: parse_month(F.col(c)) for c in DATE_COLUMNS}
    made |= {c: inf_to_null(F.col(c)) for c, t in df.dtypes if t in ("double", "float") and c not in made}
    made = {c: x for c, x in made.items() if c in df.columns or c == "target"}
    if "term" in df.columns:
        made["term_months"] = parse_term_months(F.col("term"))
    if "emp_length" in df.columns:
        made["emp_length_years"] = parse_employment_years(F.col("emp_length"))
    if "addr_state" in df.columns:
        made |= {"state_code": normalize_state(F.col("addr_state")), "country": F.lit(COUNTRY)}
    if "zip_code" in df.columns:
        made["zip_code"] = normalize_zip(F.col("zip_code"))
    return df.withColumns(made)


def rename_rejected(raw: DataFrame) -> DataFrame:
    return raw.withColumnsRenamed(REJECTED_NAMES)


def clean_rejected(raw: DataFrame) -> DataFrame:
    """Needs all nine columns of the rejected file."""
    if missing := sorted(set(REJECTED_NAMES).difference(c.strip() for c in raw.columns)):
        raise ValueError(f"rejected file lacks {missing}")
    df = rename_rejected(clean_strings(raw))
    return df.select(
        to_number(F.col("requested_amount")).alias("requested_amount"), F.try_to_date("application_date", "yyyy-MM-dd").alias("application_date"), "loan_title", to_number(F.col("risk_score")).alias("risk_score"),
        parse_percent(F.col("dti")).alias("dti"), normalize_zip(F.col("zip_code")).alias("zip_code"), normalize_state(F.col("state_code")).alias("state_code"),
        parse_employment_years(F.col("emp_length")).alias("emp_length_years"), to_number(F.col("policy_code")).alias("policy_code"), F.lit(COUNTRY).alias("country"),
    )
