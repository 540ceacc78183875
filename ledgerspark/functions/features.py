"""Features of an application, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cleaning import inf_to_null

# Fixed edges and labels of the bands: right-closed for amounts, left-closed for FICO.
LOAN_BANDS = ([5_000, 10_000, 20_000], ["<=5k", "5k-10k", "10k-20k", ">20k"])
INCOME_BANDS = ([40_000, 80_000, 150_000], ["<=40k", "40k-80k", "80k-150k", ">150k"])
DTI_BANDS = ([10, 20, 30], ["<=10", "10-20", "20-30", ">30"])
FICO_BANDS = ([650, 700, 750], ["<650", "650-699", "700-749", "750+"])


def band(c: Column, bands: tuple[list, list], *, right: bool) -> Column:
    """The label of the bin that holds a value; null and NaN have none."""
    edges, labels = bands
    x = c.cast("double")
    out = F.when(x.isNull() | F.isnan(x), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels, strict=False):
        out = out.when((x <= float(edge)) if right else (x < float(edge)), label)
    return out.otherwise(labels[-1])


def safe_ratio(a: Column, b: Column) -> Column:
    a, b = inf_to_null(a), inf_to_null(b)
    return F.when(b > 0, a / F.nullif(b, F.lit(0.0)))


def fico_avg(low: Column, high: Column) -> Column:
    return (low + high) / 2


def credit_history_months(issued: Column, earliest: Column) -> Column:
    months = (F.year(issued) - F.year(earliest)) * 12 + F.month(issued) - F.month(earliest)
    return F.when(months >= 0, months.cast("double"))


def quarter_label(d: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(d).cast("string"))


def engineer_features(df: DataFrame) -> DataFrame:
    """All features. dti may be missing: then its band is null. An infinite amount, income, score or ratio is refused, by an error of the query, as it would end up in a band."""
    needed = ["loan_amnt", "annual_inc", "fico_range_low", "fico_range_high", "issue_d", "earliest_cr_line"]
    if missing := [c for c in needed if c not in df.columns]:
        raise ValueError(f"features need {missing}")
    finite = lambda c: F.when(F.abs(F.col(c).cast("double")) == float("inf"), F.raise_error(F.lit(f"{c} is infinite")).cast("double")).otherwise(F.col(c).cast("double"))
    number = {c: finite(c) for c in (*needed[:4], "dti") if c in df.columns}
    df = df.withColumns({
        "loan_to_income_ratio": safe_ratio(number["loan_amnt"], number["annual_inc"]), "fico_avg": fico_avg(number["fico_range_low"], number["fico_range_high"]),
        "credit_history_months": credit_history_months(F.col("issue_d"), F.col("earliest_cr_line")), "issue_year": F.year("issue_d"), "issue_quarter": quarter_label(F.col("issue_d")), "issue_month": F.month("issue_d"),
        "loan_amount_band": band(number["loan_amnt"], LOAN_BANDS, right=True), "income_band": band(number["annual_inc"], INCOME_BANDS, right=True),
        "dti_band": band(number.get("dti", F.lit(None)), DTI_BANDS, right=True),
    })
    return df.withColumn("fico_band", band(F.col("fico_avg"), FICO_BANDS, right=False))


def sanitize_inputs(df: DataFrame) -> DataFrame:
    return df.withColumns({"annual_inc": F.when(F.col("annual_inc") > 0, F.col("annual_inc")), "dti": F.when(F.col("dti") >= 0, F.col("dti"))})
