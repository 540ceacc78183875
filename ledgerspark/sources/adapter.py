"""The driver's tables read as a loan book, in Spark and as the same SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import COUNTRY

#: Customers up to which Spark may broadcast them: some 100 bytes each go through the driver, for every pass that joins them.
FEW = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers. Spark broadcasts a table by the size of its files, of which compressed columns may be a
    twentieth of what the driver then sees; so the rows are counted (from the files' footers), and more than FEW are shuffled."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c if c.count() <= FEW else c.hint("merge"), F.col("o_custkey") == F.col("c_custkey"))


def _states(key):
    return F.concat(F.chr(65 + key % 26), F.chr(65 + (key * 7) % 26))


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per accepted loan, typed, with three models' scores."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    d = F.col("o_orderdate").cast("date")
    default = F.when(F.col("o_orderstatus") == "O", 1.0).otherwise(0.0)
    score = lambda a, b, m, w, x: w * (((key * a + cust * b) % m) / F.lit(float(m))) + x * default
    fico = F.when(cust % 97 != 0, F.lit(600.0) + (cust % 41) * 5)
    return _with_customers(spark, sf_dir).select(
        key.cast("string").alias("loan_id"),
        F.when(F.col("o_orderstatus") == "F", "Fully Paid").when(F.col("o_orderstatus") == "O", "Charged Off").otherwise("Current").alias("loan_status"),
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).alias("target"),
        (F.col("o_totalprice") / 12.5).alias("loan_amnt"), (F.col("c_acctbal") * 16.0).alias("annual_inc"),
        d.alias("issue_d"), F.add_months(d, (20 - cust % 300).cast("int")).alias("earliest_cr_line"),
        fico.alias("fico_range_low"), (fico + 4).alias("fico_range_high"),
        F.when(key % 89 != 0, (key % 450) / F.lit(10.0)).alias("dti"),
        F.when(key % 3 == 0, 60).otherwise(36).alias("term_months"),
        F.col("o_orderpriority").alias("purpose"), F.col("c_mktsegment").alias("home_ownership"),
        _states(F.col("c_nationkey")).alias("state_code"), F.concat(F.lpad((cust % 1000).cast("string"), 3, "0"), F.lit("xx")).alias("zip_code"),
        ((key % 12).cast("double")).alias("emp_length_years"), (F.col("o_totalprice") / 25.0).alias("total_pymnt"),
        ((key % 23) + 5.0).alias("int_rate"), (F.col("o_totalprice") / 400.0).alias("installment"),
        score(7919, 104729, 10007, 0.75, 0.2).alias("predicted_pd"), score(6007, 7727, 9973, 0.8, 0.15).alias("pd_weighted"), score(3571, 2741, 10009, 0.7, 0.25).alias("pd_trees"),
    )


LOANS_SQL = """
loans AS (SELECT CAST(o_orderkey AS VARCHAR) AS loan_id,
  CASE o_orderstatus WHEN 'F' THEN 'Fully Paid' WHEN 'O' THEN 'Charged Off' ELSE 'Current' END AS loan_status,
  CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS target,
  o_totalprice / 12.5e0 AS loan_amnt, c_acctbal * 16e0 AS annual_inc, CAST(o_orderdate AS DATE) AS issue_d,
  CAST(CAST(o_orderdate AS DATE) + to_months(CAST(20 - (o_custkey % 300) AS INTEGER)) AS DATE) AS earliest_cr_line,
  CASE WHEN o_custkey % 97 <> 0 THEN 600e0 + (o_custkey % 41) * 5 END AS fico_range_low,
  CASE WHEN o_custkey % 97 <> 0 THEN 600e0 + (o_custkey % 41) * 5 + 4 END AS fico_range_high,
  CASE WHEN o_orderkey % 89 <> 0 THEN (o_orderkey % 450) / 10e0 END AS dti,
  CASE WHEN o_orderkey % 3 = 0 THEN 60 ELSE 36 END AS term_months,
  o_orderpriority AS purpose, c_mktsegment AS home_ownership,
  chr(65 + c_nationkey % 26) || chr(65 + (c_nationkey * 7) % 26) AS state_code,
  lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || 'xx' AS zip_code,
  CAST(o_orderkey % 12 AS DOUBLE) AS emp_length_years, o_totalprice / 25e0 AS total_pymnt,
  (o_orderkey % 23) + 5e0 AS int_rate, o_totalprice / 400e0 AS installment,
  0.75e0 * (((o_orderkey * 7919 + o_custkey * 104729) % 10007) / 10007e0) + 0.2e0 * CASE WHEN o_orderstatus = 'O' THEN 1e0 ELSE 0e0 END AS predicted_pd,
  0.8e0 * (((o_orderkey * 6007 + o_custkey * 7727) % 9973) / 9973e0) + 0.15e0 * CASE WHEN o_orderstatus = 'O' THEN 1e0 ELSE 0e0 END AS pd_weighted,
  0.7e0 * (((o_orderkey * 3571 + o_custkey * 2741) % 10009) / 10009e0) + 0.25e0 * CASE WHEN o_orderstatus = 'O' THEN 1e0 ELSE 0e0 END AS pd_trees
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per rejected application; it has no key."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(
        F.col("l_extendedprice").alias("requested_amount"), F.col("l_shipdate").cast("date").alias("application_date"), F.col("l_returnflag").alias("loan_title"),
        ((F.col("l_orderkey") % 300) + 500.0).alias("risk_score"), F.col("l_quantity").alias("dti"), F.concat(F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0"), F.lit("xx")).alias("zip_code"),
        _states(F.col("l_suppkey")).alias("state_code"), F.col("l_linenumber").cast("double").alias("emp_length_years"), F.lit(0.0).alias("policy_code"), F.lit(COUNTRY).alias("country"),
    )


REJECTED_SQL = """
rejected AS (SELECT l_extendedprice AS requested_amount, CAST(l_shipdate AS DATE) AS application_date, l_returnflag AS loan_title,
  (l_orderkey % 300) + 500e0 AS risk_score, l_quantity AS dti, lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') || 'xx' AS zip_code,
  chr(CAST(65 + l_suppkey % 26 AS INTEGER)) || chr(CAST(65 + (l_suppkey * 7) % 26 AS INTEGER)) AS state_code,
  CAST(l_linenumber AS DOUBLE) AS emp_length_years, 0e0 AS policy_code, 'United States' AS country FROM lineitem)"""


def raw_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted file before cleaning: all strings, with blanks, null tokens and values that don't parse."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda x: x.cast("string")
    emp = F.when(cust % 13 == 0, "< 1 year").when(cust % 13 == 10, "10+ years").when(cust % 13 == 11, "n/a").when(cust % 13 == 12, None).otherwise(F.concat(s(cust % 13), F.lit(" years")))
    return _with_customers(spark, sf_dir).select(
        F.when(key % 5 == 0, F.concat(s(key), F.lit(".0"))).otherwise(s(key)).alias("id"),
        F.when(F.col("o_orderstatus") == "F", "Fully Paid\t").when(F.col("o_orderstatus") == "O", " Charged Off").when(key % 7 == 0, "Default").otherwise("Current").alias("loan_status"),
        s(key % 40000).alias("loan_amnt"), F.when(cust % 19 == 0, "NULL").otherwise(s((cust * 37) % 90000)).alias("annual_inc"),
        F.when(key % 31 == 0, "12d").when(key % 37 == 0, "inf").otherwise(F.concat(s((key % 450 / 10).cast("int")), F.lit("."), s(key % 10))).alias("dti"),
        F.when(key % 3 == 0, " 60 months").when(key % 41 == 0, "months").otherwise(" 36 months").alias("term"),
        F.when(key % 43 == 0, "bad%").otherwise(F.concat(s(key % 30), F.lit("."), s(key % 10), F.lit("%"))).alias("int_rate"),
        emp.alias("emp_length"), F.when(cust % 50 == 0, "bad").otherwise(F.lower(_states(F.col("c_nationkey")))).alias("addr_state"),
        F.when(cust % 29 == 0, "9").otherwise(F.concat(F.lpad(s(cust % 1000), 3, "0"), F.lit("XX\t\u00a0"))).alias("zip_code"),
        F.when(key % 47 == 0, "2018").otherwise(F.date_format("o_orderdate", "MMM-yyyy")).alias("issue_d"), F.date_format(F.add_months(F.col("o_orderdate").cast("date"), (20 - cust % 300).cast("int")), "MMM-yyyy").alias("earliest_cr_line"),
        F.col("o_orderpriority").alias("purpose"), s(key % 9000).alias("total_pymnt"),
    )


RAW_ACCEPTED_SQL = """
raw_accepted AS (SELECT
  CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey AS VARCHAR) || '.0' ELSE CAST(o_orderkey AS VARCHAR) END AS id,
  CASE WHEN o_orderstatus = 'F' THEN 'Fully Paid' || chr(9) WHEN o_orderstatus = 'O' THEN ' Charged Off' WHEN o_orderkey % 7 = 0 THEN 'Default' ELSE 'Current' END AS loan_status,
  CAST(o_orderkey % 40000 AS VARCHAR) AS loan_amnt, CASE WHEN o_custkey % 19 = 0 THEN 'NULL' ELSE CAST((o_custkey * 37) % 90000 AS VARCHAR) END AS annual_inc,
  CASE WHEN o_orderkey % 31 = 0 THEN '12d' WHEN o_orderkey % 37 = 0 THEN 'inf' ELSE CAST((o_orderkey % 450) // 10 AS VARCHAR) || '.' || CAST(o_orderkey % 10 AS VARCHAR) END AS dti,
  CASE WHEN o_orderkey % 3 = 0 THEN ' 60 months' WHEN o_orderkey % 41 = 0 THEN 'months' ELSE ' 36 months' END AS term,
  CASE WHEN o_orderkey % 43 = 0 THEN 'bad%' ELSE CAST(o_orderkey % 30 AS VARCHAR) || '.' || CAST(o_orderkey % 10 AS VARCHAR) || '%' END AS int_rate,
  CASE WHEN o_custkey % 13 = 0 THEN '< 1 year' WHEN o_custkey % 13 = 10 THEN '10+ years' WHEN o_custkey % 13 = 11 THEN 'n/a' WHEN o_custkey % 13 = 12 THEN NULL ELSE CAST(o_custkey % 13 AS VARCHAR) || ' years' END AS emp_length,
  CASE WHEN o_custkey % 50 = 0 THEN 'bad' ELSE lower(chr(65 + c_nationkey % 26) || chr(65 + (c_nationkey * 7) % 26)) END AS addr_state,
  CASE WHEN o_custkey % 29 = 0 THEN '9' ELSE lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || 'XX' || chr(9) || chr(160) END AS zip_code,
  CASE WHEN o_orderkey % 47 = 0 THEN '2018' ELSE strftime(o_orderdate, '%b-%Y') END AS issue_d,
  strftime(CAST(o_orderdate AS DATE) + to_months(CAST(20 - (o_custkey % 300) AS INTEGER)), '%b-%Y') AS earliest_cr_line,
  o_orderpriority AS purpose, CAST(o_orderkey % 9000 AS VARCHAR) AS total_pymnt
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def raw_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rejected file before cleaning: its nine columns by their own names."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    s = lambda x: F.col(x).cast("string")
    return l.select(
        F.when(F.col("l_orderkey") % 53 == 0, "n/a").otherwise((F.col("l_partkey") * 3).cast("string")).alias("Amount Requested"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("Application Date"), F.concat(F.lit(" "), F.col("l_returnflag")).alias("Loan Title"),
        ((F.col("l_orderkey") % 300) + 500).cast("string").alias("Risk_Score"), F.concat((F.col("l_orderkey") % 60).cast("string"), F.lit(".5%")).alias("Debt-To-Income Ratio"), F.concat(F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0"), F.lit("xx")).alias("Zip Code"),
        F.lower(_states(F.col("l_suppkey"))).alias("State"), F.when(F.col("l_linenumber") == 1, "< 1 year").otherwise(F.concat(s("l_linenumber"), F.lit(" years"))).alias("Employment Length"), F.lit("0").alias("Policy Code"),
    )


RAW_REJECTED_SQL = """
raw_rejected AS (SELECT CASE WHEN l_orderkey % 53 = 0 THEN 'n/a' ELSE CAST(l_partkey * 3 AS VARCHAR) END AS amount, strftime(l_shipdate, '%Y-%m-%d') AS adate, ' ' || l_returnflag AS title,
  CAST((l_orderkey % 300) + 500 AS VARCHAR) AS score, CAST(l_orderkey % 60 AS VARCHAR) || '.5%' AS ratio, lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') || 'xx' AS zip,
  lower(chr(CAST(65 + l_suppkey % 26 AS INTEGER)) || chr(CAST(65 + (l_suppkey * 7) % 26 AS INTEGER))) AS state,
  CASE WHEN l_linenumber = 1 THEN '< 1 year' ELSE CAST(l_linenumber AS VARCHAR) || ' years' END AS emp, '0' AS policy FROM lineitem)"""
