"""Loan domain: table schemas, category lists, code tables and feature layouts."""

from __future__ import annotations

from pyspark.sql import types as T

# --- table schemas ---------------------------------------------------------
# Column names and types of the input tables and forms.

LOAN_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("person_age", T.IntegerType()),
        T.StructField("person_income", T.IntegerType()),
        T.StructField("person_home_ownership", T.StringType()),
        T.StructField("person_emp_length", T.DoubleType()),
        T.StructField("loan_intent", T.StringType()),
        T.StructField("loan_grade", T.StringType()),
        T.StructField("loan_amnt", T.IntegerType()),
        T.StructField("loan_int_rate", T.DoubleType()),
        T.StructField("loan_percent_income", T.DoubleType()),
        T.StructField("cb_person_default_on_file", T.StringType()),
        T.StructField("cb_person_cred_hist_length", T.IntegerType()),
        T.StructField("loan_status", T.IntegerType()),
    ]
)

# A submitted form arrives as text; validation gives it types.
FORM_FIELDS = {
    "personAge": "whole",
    "personIncome": "whole",
    "ownershipType": "text",
    "employmentLength": "whole",
    "intent": "text",
    "amountRequested": "decimal",
    "interestRate": "decimal",
    "priorDefault": "flag",
    "creditHistory": "whole",
}

APPLICATION_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("username", T.StringType()),
        T.StructField("submitted_at", T.TimestampType()),
        T.StructField("person_age", T.IntegerType()),
        T.StructField("person_income", T.IntegerType()),
        T.StructField("person_home_ownership", T.StringType()),
        T.StructField("person_emp_length", T.IntegerType()),
        T.StructField("loan_intent", T.StringType()),
        T.StructField("amount_requested", T.DoubleType()),
        T.StructField("interest_rate", T.DoubleType()),
        T.StructField("prior_default", T.BooleanType()),
        T.StructField("cb_person_cred_hist_length", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("loan_grade", T.StringType()),
        T.StructField("status_probability", T.DoubleType()),
        T.StructField("grade_probability", T.DoubleType()),
        T.StructField(
            "feature_importances",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("feature", T.StringType()),
                        T.StructField("importance", T.DoubleType()),
                    ]
                )
            ),
        ),
    ]
)

# --- fixed values: categories, codes, buckets -------------------------------
# These must stay as they are for results to agree with existing models and reports.

OWNERSHIP_ONEHOT = ["RENT", "MORTGAGE", "OWN"]  # OTHER is all zero
INTENT_ONEHOT = [  # HOMEIMPROVEMENT is all zero
    "EDUCATION",
    "MEDICAL",
    "PERSONAL",
    "VENTURE",
    "DEBTCONSOLIDATION",
]

OWNERSHIP_CODES = {"RENT": 0, "MORTGAGE": 1, "OWN": 2}
OWNERSHIP_OTHER_CODE = 3
INTENT_CODES = {
    "PERSONAL": 0,
    "EDUCATION": 1,
    "MEDICAL": 2,
    "VENTURE": 3,
    "HOMEIMPROVEMENT": 4,
}
INTENT_OTHER_CODE = 5

GRADES = ["A", "B", "C", "D", "E", "F", "G"]
PENDING, ACCEPTED, REJECTED = "-", "ACCEPTED", "REJECTED"

AGE_EDGES = [25, 35, 45, 55, 65]
AGE_LABELS = ["Under 25", "25-34", "35-44", "45-54", "55-64", "65+"]
INCOME_EDGES = [30000, 50000, 70000, 100000, 150000]
INCOME_LABELS = ["Under 30k", "30k-49k", "50k-69k", "70k-99k", "100k-149k", "150k+"]
INCOME_CODES = [1, 2, 3, 4, 5, 6]

# --- fixed values: feature layouts -------------------------------------------

STATUS_NUMERIC = [
    "person_age",
    "person_emp_length",
    "loan_amnt",
    "loan_int_rate",
    "loan_percent_income",
    "cb_person_cred_hist_length",
    "cb_person_default_on_file_binary",
    "remaining_income_to_receive",
    "remaining_employment_length",
    "age_to_history_length_ratio",
    "income_bracket",
    "credit_risk",
]
GRADE_NUMERIC = [
    "person_age",
    "person_income",
    "person_emp_length",
    "loan_amnt",
    "loan_int_rate",
    "loan_percent_income",
    "cb_person_cred_hist_length",
]
GRADE_DERIVED = ["age_minus_history", "actual_loan_interest", "employment_stability"]
GRADE_ORDINAL = ["home_ownership_num", "loan_intent_num", "default_on_file_num"]

# --- built from the lists above ----------------------------------------------

OWNERSHIP_SLOTS = [f"person_home_ownership_onehot_{i}" for i in range(len(OWNERSHIP_ONEHOT))]
INTENT_SLOTS = [f"loan_intent_onehot_{i}" for i in range(len(INTENT_ONEHOT))]

STATUS_LAYOUT = STATUS_NUMERIC + OWNERSHIP_SLOTS + INTENT_SLOTS
GRADE_LAYOUT = OWNERSHIP_SLOTS + INTENT_SLOTS + ["no_default_on_file"] + GRADE_NUMERIC + GRADE_DERIVED
GRADE_ORDINAL_LAYOUT = GRADE_NUMERIC + GRADE_ORDINAL + GRADE_DERIVED

# Readable names for slots that are numbered in the layout.
SLOT_NAMES = {
    **{s: f"person_home_ownership_{v}" for s, v in zip(OWNERSHIP_SLOTS, OWNERSHIP_ONEHOT)},
    **{s: f"loan_intent_{v}" for s, v in zip(INTENT_SLOTS, INTENT_ONEHOT)},
}

# Columns a model needs from the loan table; everything else is derived from them.
RAW_FEATURES = [
    "person_age",
    "person_income",
    "person_home_ownership",
    "person_emp_length",
    "loan_intent",
    "loan_amnt",
    "loan_int_rate",
    "loan_percent_income",
    "cb_person_default_on_file",
    "cb_person_cred_hist_length",
]
KNOWN_CATEGORIES = {
    "person_home_ownership": [*OWNERSHIP_ONEHOT, "OTHER"],
    "loan_intent": [*INTENT_ONEHOT, "HOMEIMPROVEMENT"],
    "cb_person_default_on_file": ["Y", "N"],
}
RAW_CATEGORICAL = ["person_home_ownership", "loan_intent", "cb_person_default_on_file"]
