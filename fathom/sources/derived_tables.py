"""Loan tables derived from the driver's order and customer tables.

The texts are accepted unchanged by Spark SQL and DuckDB; the oracles use them too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LOAN_APPLICATIONS = """
WITH b AS (
  SELECT o_orderkey, o_custkey,
    CAST(20 + (o_custkey * 7) % 56 AS INT) AS person_age,
    CAST(4000 + floor((c_acctbal + 1000e0) * 15e0) AS INT) AS person_income,
    CASE WHEN o_custkey % 20 < 10 THEN 'RENT' WHEN o_custkey % 20 < 17 THEN 'MORTGAGE'
         WHEN o_custkey % 20 < 19 THEN 'OWN' ELSE 'OTHER' END AS person_home_ownership,
    CAST(o_custkey % 41 AS DOUBLE) AS person_emp_length,
    CASE WHEN o_orderkey % 21 < 6 THEN 'EDUCATION' WHEN o_orderkey % 21 < 11 THEN 'MEDICAL'
         WHEN o_orderkey % 21 < 15 THEN 'PERSONAL' WHEN o_orderkey % 21 < 18 THEN 'VENTURE'
         WHEN o_orderkey % 21 < 20 THEN 'DEBTCONSOLIDATION' ELSE 'HOMEIMPROVEMENT' END AS loan_intent,
    CAST(500 + floor(o_totalprice * 69e-3) AS INT) AS loan_amnt,
    CAST(542 + (o_orderkey * 37 + o_custkey * 11) % 1780 AS DOUBLE) / 100e0 AS loan_int_rate,
    CASE WHEN o_custkey % 6 = 0 THEN 'Y' ELSE 'N' END AS cb_person_default_on_file,
    CAST(o_custkey % 31 AS INT) AS cb_person_cred_hist_length
  FROM orders JOIN customer ON o_custkey = c_custkey),
p AS (SELECT *, floor(CAST(loan_amnt AS DOUBLE) * 100e0 / CAST(person_income AS DOUBLE)) / 100e0
        AS loan_percent_income FROM b)
SELECT o_orderkey AS id, person_age, person_income, person_home_ownership, person_emp_length, loan_intent,
  CASE WHEN loan_int_rate < 8e0 THEN 'A' WHEN loan_int_rate < 11e0 THEN 'B'
       WHEN loan_int_rate < 135e-1 THEN 'C' WHEN loan_int_rate < 155e-1 THEN 'D'
       WHEN loan_int_rate < 175e-1 THEN 'E' WHEN loan_int_rate < 20e0 THEN 'F' ELSE 'G' END AS loan_grade,
  loan_amnt, loan_int_rate, loan_percent_income, cb_person_default_on_file, cb_person_cred_hist_length,
  CAST(CASE WHEN loan_percent_income >= 5e-1
              OR (loan_int_rate >= 20e0 AND cb_person_default_on_file = 'Y')
              OR o_orderkey % 29 = 0 THEN 1 ELSE 0 END AS INT) AS loan_status
FROM p
"""

LOAN_DIRTY = """
SELECT id,
  CASE WHEN id % 53 = 0 THEN NULL ELSE person_age END AS person_age,
  CASE WHEN id % 59 = 0 THEN NULL ELSE person_income END AS person_income,
  CASE WHEN id % 61 = 0 THEN NULL ELSE person_home_ownership END AS person_home_ownership,
  CASE WHEN id % 33 = 0 THEN NULL ELSE person_emp_length END AS person_emp_length,
  CASE WHEN id % 67 = 0 THEN NULL ELSE loan_intent END AS loan_intent,
  loan_amnt,
  CASE WHEN id % 47 = 0 THEN NULL ELSE loan_int_rate END AS loan_int_rate,
  loan_percent_income, cb_person_default_on_file,
  CASE WHEN id % 71 = 0 THEN NULL ELSE cb_person_cred_hist_length END AS cb_person_cred_hist_length,
  loan_status
FROM loan_applications
"""

LOAN_SCORED = """
SELECT id, concat('u', id % 50) AS username, loan_intent AS intent,
  CAST(loan_amnt AS DOUBLE) AS amount_requested, loan_int_rate AS interest_rate,
  CASE WHEN id % 10 = 0 THEN '-' WHEN loan_status = 1 THEN 'ACCEPTED' ELSE 'REJECTED' END AS status,
  CASE WHEN id % 10 = 0 THEN '-' ELSE loan_grade END AS loan_grade,
  loan_status AS label,
  CAST(loan_status * 30 + (id * 31) % 70 AS DOUBLE) / 100e0 AS score,
  CAST(CASE WHEN loan_status * 30 + (id * 31) % 70 >= 50 THEN 1 ELSE 0 END AS DOUBLE) AS prediction,
  CAST(CASE loan_grade WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'C' THEN 2 WHEN 'D' THEN 3
       WHEN 'E' THEN 4 WHEN 'F' THEN 5 ELSE 6 END AS DOUBLE) AS grade_label,
  CAST((CASE loan_grade WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'C' THEN 2 WHEN 'D' THEN 3
        WHEN 'E' THEN 4 WHEN 'F' THEN 5 ELSE 6 END
        + CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END) % 7 AS DOUBLE) AS grade_prediction
FROM loan_applications
"""

# Submitted forms as text, a share of them broken in known ways.
LOAN_FORMS = """
SELECT id, concat('u', id % 50) AS username,
  CASE WHEN id % 37 = 0 THEN 'forty' WHEN id % 101 = 0 THEN '41.5'
       ELSE concat('', person_age) END AS personAge,
  CASE WHEN id % 103 = 0 THEN '99999999999' ELSE concat('', person_income) END AS personIncome,
  CASE WHEN id % 41 = 0 THEN '  ' ELSE person_home_ownership END AS ownershipType,
  concat('', CAST(person_emp_length AS INT)) AS employmentLength,
  CASE WHEN id % 43 = 0 THEN NULL ELSE loan_intent END AS intent,
  CASE WHEN id % 107 = 0 THEN '12k' ELSE concat(loan_amnt, '.50') END AS amountRequested,
  CASE WHEN id % 109 = 0 THEN '' ELSE concat('', CAST(floor(loan_int_rate) AS INT)) END AS interestRate,
  CASE WHEN id % 113 = 0 THEN 'maybe' WHEN id % 7 = 0 THEN NULL
       WHEN cb_person_default_on_file = 'Y' THEN 'true' ELSE 'false' END AS priorDefault,
  concat('', cb_person_cred_hist_length) AS creditHistory
FROM loan_applications
"""

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _run(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """Run a shared SQL text over the given frames."""
    for name in tables:
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
    return spark.sql(text, **tables)


def applications_from(spark: SparkSession, orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Loan table over given frames; ``orders`` may be a stream."""
    return _run(spark, LOAN_APPLICATIONS, orders=orders, customer=customer)


def loan_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return applications_from(
        spark, driver_table(spark, sf_dir, "orders"), driver_table(spark, sf_dir, "customer")
    )


def loan_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, LOAN_DIRTY, loan_applications=loan_applications(spark, sf_dir))


def scored_from(spark: SparkSession, applications: DataFrame) -> DataFrame:
    return _run(spark, LOAN_SCORED, loan_applications=applications)


def loan_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_from(spark, loan_applications(spark, sf_dir))


def forms_from(spark: SparkSession, applications: DataFrame) -> DataFrame:
    return _run(spark, LOAN_FORMS, loan_applications=applications)


def loan_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms_from(spark, loan_applications(spark, sf_dir))
