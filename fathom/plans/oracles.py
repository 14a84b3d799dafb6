"""The same results in SQL that DuckDB runs on the driver's tables, written independently of the
Spark expressions; only the derived input tables are shared."""

from __future__ import annotations

import math
from itertools import combinations

from fathom import domain
from fathom.plans.rules import APPROVAL_RULES, RESPONSE_GRID
from fathom.sources.derived_tables import LOAN_APPLICATIONS, LOAN_DIRTY, LOAN_FORMS, LOAN_SCORED

_INPUTS = {"loan_dirty": LOAN_DIRTY, "loan_scored": LOAN_SCORED, "loan_forms": LOAN_FORMS}

_PROFILED = [
    "person_age",
    "person_income",
    "person_emp_length",
    "loan_amnt",
    "loan_int_rate",
    "loan_percent_income",
    "cb_person_cred_hist_length",
    "loan_status",
]


def _with(body: str, *inputs: str, **steps: str) -> str:
    """The loan table, the further inputs and the steps as common tables before the body."""
    parts = [f"loan_applications AS ({LOAN_APPLICATIONS})"]
    parts += [f"{name} AS ({_INPUTS[name]})" for name in inputs]
    parts += [f"{name} AS ({text})" for name, text in steps.items()]
    return f"WITH {', '.join(parts)} {body}"


def _union(selects: list[str]) -> str:
    return " UNION ALL ".join(selects)


def _pairs(columns: list[str]) -> list[tuple[str, str]]:
    names = sorted(columns)
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]


def _correlations(source: str, columns: list[str]) -> str:
    return _union(
        [
            f"SELECT '{a}' AS column1, '{b}' AS column2, round(corr({a}, {b}), 6) AS correlation FROM {source}"
            for a, b in _pairs(columns)
        ]
    )


def _quartiles(source: str, columns: list[str]) -> str:
    q = "CAST(quantile_disc({c}, {p}) AS DOUBLE)"
    return _union(
        [
            f"SELECT '{c}' AS column_name, {q.format(c=c, p=0.25)} AS q1, {q.format(c=c, p=0.5)} AS q2, "
            f"{q.format(c=c, p=0.75)} AS q3 FROM {source}"
            for c in columns
        ]
    )


_BOUNDS = (
    "SELECT column_name, q1 - 15e-1 * (q3 - q1) AS lower_bound, q3 + 15e-1 * (q3 - q1) AS upper_bound "
    "FROM quartile"
)


def _outside(column: str) -> str:
    fence = f"(SELECT {{}}_bound FROM bounds WHERE column_name = '{column}')"
    return (
        f"coalesce({column} < {fence.format('lower')} OR {column} > {fence.format('upper')}, false)"
    )


_AGE_BUCKET = (
    "CASE WHEN person_age IS NULL THEN NULL WHEN person_age < 25 THEN 'Under 25' "
    "WHEN person_age < 35 THEN '25-34' WHEN person_age < 45 THEN '35-44' "
    "WHEN person_age < 55 THEN '45-54' WHEN person_age < 65 THEN '55-64' ELSE '65+' END"
)
_INCOME_BUCKET = (
    "CASE WHEN person_income IS NULL THEN NULL WHEN person_income < 30000 THEN 'Under 30k' "
    "WHEN person_income < 50000 THEN '30k-49k' WHEN person_income < 70000 THEN '50k-69k' "
    "WHEN person_income < 100000 THEN '70k-99k' WHEN person_income < 150000 THEN '100k-149k' "
    "ELSE '150k+' END"
)
_INCOME_CODE = (
    "CAST(CASE WHEN person_income IS NULL THEN NULL WHEN person_income < 30000 THEN 1 "
    "WHEN person_income < 50000 THEN 2 WHEN person_income < 70000 THEN 3 "
    "WHEN person_income < 100000 THEN 4 WHEN person_income < 150000 THEN 5 ELSE 6 END AS INT)"
)


def _percent(part: str, whole: str) -> str:
    return f"CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 100e0"


def _share(source: str, keys: str, target: str, where: str = "true") -> str:
    return (
        f'SELECT {keys}, {target}, "count", total_count, {_percent(chr(34) + "count" + chr(34), "total_count")} '
        f"AS percentage FROM (SELECT {keys}, {target}, n AS \"count\", "
        f"CAST(sum(n) OVER (PARTITION BY {keys}) AS BIGINT) AS total_count FROM "
        f"(SELECT {keys}, {target}, count({target}) AS n FROM {source} WHERE {where} GROUP BY {keys}, {target}))"
    )


def _fixed(value: str, digits: int) -> str:
    """Decimal text rounded half up on the printed digits of the double."""
    return f"CAST(CAST(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38,18)) AS DECIMAL(38,{digits})) AS VARCHAR)"


def _flag(condition: str, name: str) -> str:
    return f"CAST(CASE WHEN {condition} THEN 1 ELSE 0 END AS INT) AS {name}"


def _letter(code: str) -> str:
    arms = " ".join(f"WHEN {i} THEN '{g}'" for i, g in enumerate("ABCDEFG"))
    return f"CASE {code} {arms} END"


def _decision(prediction: str) -> str:
    return f"CASE WHEN {prediction} = 0 THEN 'REJECTED' ELSE 'ACCEPTED' END"


def _onehot(column: str, width: int) -> str:
    slots = ", ".join(_flag(f"place = {i + 1}", f"{column}_onehot_{i}") for i in range(width))
    return _with(
        f"SELECT id, {slots} FROM loan_applications JOIN places USING ({column})",
        places=f"SELECT {column}, row_number() OVER (ORDER BY n DESC, {column}) AS place FROM "
        f"(SELECT {column}, count(*) AS n FROM loan_applications GROUP BY {column})",
    )


def _over_history(numerator: str, empty: str) -> str:
    h = "cb_person_cred_hist_length"
    return f"CASE WHEN {h} = 0 THEN {empty} ELSE {numerator} / {h} END"


def _histogram(column: str) -> str:
    place = "least(floor((v - lo) / width), 9)"
    return (
        f"SELECT '{column}' AS column_name, CAST(b AS INT) AS bin, coalesce(n, 0) AS n "
        f"FROM (SELECT unnest(range(10)) AS b) LEFT JOIN (SELECT CAST({place} AS INT) AS bin, count(*) AS n "
        f"FROM (SELECT CAST({column} AS DOUBLE) AS v, lo, (hi - lo) / 10 AS width FROM loan_applications, "
        f"(SELECT CAST(min({column}) AS DOUBLE) AS lo, CAST(max({column}) AS DOUBLE) AS hi FROM loan_applications)) "
        f"GROUP BY 1) ON b = bin"
    )


def _roc(score: str) -> dict[str, str]:
    return {
        "per_score": f"SELECT {score} AS s, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg "
        "FROM loan_scored GROUP BY 1",
        "points": "SELECT s, pos, neg, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, "
        "sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM per_score",
    }


_ROC_CURVE = (
    "SELECT s AS threshold, CAST(fp AS DOUBLE) / CAST(n AS DOUBLE) AS fpr, "
    "CAST(tp AS DOUBLE) / CAST(p AS DOUBLE) AS tpr FROM points "
    "UNION ALL SELECT CAST(NULL AS DOUBLE), 0e0, 0e0"
)

_WHOLE = "regexp_matches({f}, '^[+-]?[0-9]+$')"
_NUMBER = "regexp_matches({f}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')"


def _whole(field: str) -> str:
    return f"CASE WHEN {_WHOLE.format(f=field)} THEN TRY_CAST({field} AS INT) END"


def _number(field: str) -> str:
    return f"CASE WHEN {_NUMBER.format(f=field)} THEN TRY_CAST({field} AS DOUBLE) END"


def _empty(field: str) -> str:
    return f"({field} IS NULL OR trim({field}) = '')"


_TYPED = f"""
SELECT id, username, {_whole('personAge')} AS person_age, {_whole('personIncome')} AS person_income,
  ownershipType AS person_home_ownership, {_whole('employmentLength')} AS person_emp_length,
  intent AS loan_intent, {_number('amountRequested')} AS amount_requested,
  {_number('interestRate')} AS interest_rate,
  CASE coalesce(priorDefault, 'false') WHEN 'true' THEN true WHEN 'false' THEN false END AS prior_default,
  {_whole('creditHistory')} AS cb_person_cred_hist_length
FROM loan_forms
"""

_ERRORS = """
concat_ws('; ',
  CASE WHEN person_age IS NULL THEN 'personAge: must be a whole number' END,
  CASE WHEN person_income IS NULL THEN 'personIncome: must be a whole number' END,
  CASE WHEN coalesce(trim(person_home_ownership), '') = '' THEN 'ownershipType: must not be empty' END,
  CASE WHEN person_emp_length IS NULL THEN 'employmentLength: must be a whole number' END,
  CASE WHEN coalesce(trim(loan_intent), '') = '' THEN 'intent: must not be empty' END,
  CASE WHEN amount_requested IS NULL THEN 'amountRequested: must be a number' END,
  CASE WHEN interest_rate IS NULL THEN 'interestRate: must be a number' END,
  CASE WHEN prior_default IS NULL THEN 'priorDefault: must be true or false' END,
  CASE WHEN cb_person_cred_hist_length IS NULL THEN 'creditHistory: must be a whole number' END) AS errors
"""


def _accepted(extra: str = "") -> str:
    return _with(
        "SELECT CAST(id AS VARCHAR) AS id, * EXCLUDE (id, errors), '-' AS status, '-' AS loan_grade, "
        f"0e0 AS status_probability, 0e0 AS grade_probability{extra} FROM checked WHERE errors = ''",
        "loan_forms",
        typed=_TYPED,
        checked=f"SELECT *, {_ERRORS} FROM typed",
    )


_RATES = _with(
    "SELECT *, "
    f"{_fixed('acceptance_rate', 1)} || '%' AS acceptance_text, "
    f"{_fixed('rejection_rate', 1)} || '%' AS rejection_text "
    f"FROM (SELECT *, {_percent('n_accepted', 'n_loans')} AS acceptance_rate, "
    f"{_percent('n_rejected', 'n_loans')} AS rejection_rate FROM counts)",
    "loan_scored",
    counts="SELECT username, count(*) AS n_loans, count(*) FILTER (status = 'ACCEPTED') AS n_accepted, "
    "count(*) FILTER (status = 'REJECTED') AS n_rejected FROM loan_scored GROUP BY username",
)


def _top_purpose(status: str) -> str:
    return (
        "SELECT username, intent FROM (SELECT username, intent, row_number() OVER "
        "(PARTITION BY username ORDER BY count(*) DESC, intent) AS place "
        f"FROM loan_scored WHERE status = '{status}' GROUP BY username, intent) WHERE place = 1"
    )


def _decided_share(target: str) -> str:
    return _share("loan_scored", "username, status", target, "status IN ('ACCEPTED', 'REJECTED')")


_LOAN_TYPES = [
    ("id", "bigint"),
    ("person_age", "int"),
    ("person_income", "int"),
    ("person_home_ownership", "string"),
    ("person_emp_length", "double"),
    ("loan_intent", "string"),
    ("loan_grade", "string"),
    ("loan_amnt", "int"),
    ("loan_int_rate", "double"),
    ("loan_percent_income", "double"),
    ("cb_person_default_on_file", "string"),
    ("cb_person_cred_hist_length", "int"),
    ("loan_status", "int"),
]

_OUTLIERS = ["person_income", "loan_amnt", "loan_percent_income"]
_IMPUTED = {"person_income": "INT", "loan_int_rate": "DOUBLE", "loan_percent_income": "DOUBLE"}
_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_DIRTY_COLUMNS = [c for c, _ in _LOAN_TYPES if c != "loan_grade"]
_INTEREST = "loan_amnt * loan_int_rate AS actual_loan_interest"
_SHORT_JOB = _flag("person_emp_length < 2", "employment_stability")

_ONEHOT_LISTS = ", ".join(
    [
        *(
            _flag(f"person_home_ownership = '{v}'", f"person_home_ownership_onehot_{i}")
            for i, v in enumerate(domain.OWNERSHIP_ONEHOT)
        ),
        *(_flag(f"loan_intent = '{v}'", f"loan_intent_onehot_{i}") for i, v in enumerate(domain.INTENT_ONEHOT)),
    ]
)
_NO_DEFAULT = _flag("cb_person_default_on_file = 'N'", "no_default_on_file")
_GRADE_COLUMNS = (
    "person_age, person_income, person_emp_length, loan_amnt, loan_int_rate, "
    "loan_percent_income, cb_person_cred_hist_length, "
    "round(CASE WHEN person_age - cb_person_cred_hist_length > -1 "
    "THEN ln(1 + person_age - cb_person_cred_hist_length) END, 9) AS age_minus_history, "
    f"{_INTEREST}, {_SHORT_JOB}"
)


def _status_columns(empty_history: str) -> str:
    return (
        "person_age, person_emp_length, loan_amnt, loan_int_rate, loan_percent_income, "
        "cb_person_cred_hist_length, "
        + _flag("cb_person_default_on_file = 'Y'", "cb_person_default_on_file_binary")
        + ", CAST(person_income AS BIGINT) * (80 - person_age) AS remaining_income_to_receive, "
        "65 - person_age AS remaining_employment_length, "
        f"{_over_history('person_age', empty_history)} AS age_to_history_length_ratio, "
        f"{_INCOME_CODE} AS income_bracket, "
        f"{_over_history('(loan_amnt * loan_int_rate)', empty_history)} AS credit_risk"
    )


def _described() -> str:
    return _union(
        [
            f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, "
            f"round(stddev_samp({c}), 6) AS stddev, CAST(min({c}) AS DOUBLE) AS min, "
            f"CAST(max({c}) AS DOUBLE) AS max FROM loan_applications"
            for c in _PROFILED
        ]
    )


_UNSCORABLE = """
SELECT id, 'missing: ' || CASE WHEN inputs <> '' THEN inputs ELSE made END AS error FROM (
  SELECT id, concat_ws(', ',
    CASE WHEN person_age IS NULL THEN 'person_age' END,
    CASE WHEN person_income IS NULL THEN 'person_income' END,
    CASE WHEN person_home_ownership IS NULL THEN 'person_home_ownership' END,
    CASE WHEN person_emp_length IS NULL THEN 'person_emp_length' END,
    CASE WHEN loan_intent IS NULL THEN 'loan_intent' END,
    CASE WHEN loan_int_rate IS NULL THEN 'loan_int_rate' END,
    CASE WHEN coalesce(person_income, 0) = 0 THEN 'loan_percent_income' END,
    CASE WHEN cb_person_cred_hist_length IS NULL THEN 'cb_person_cred_hist_length' END) AS inputs,
    CASE WHEN person_age - cb_person_cred_hist_length <= -1 THEN 'age_minus_history' ELSE '' END AS made
  FROM loan_dirty) WHERE inputs <> '' OR made <> ''
"""


ORACLES: dict[str, str] = {
    "scan_loans": _with("SELECT * FROM loan_applications"),
    "table_shape": _with(
        "SELECT column_name, data_type, n_rows, CAST(13 AS INT) AS n_columns FROM (VALUES "
        + ", ".join(f"('{n}', '{t}')" for n, t in _LOAN_TYPES)
        + ") AS t(column_name, data_type), (SELECT count(*) AS n_rows FROM loan_applications)"
    ),
    "describe_numeric_json": _with(
        "SELECT concat('{\"column_name\":\"', column_name, '\",\"n\":', n, ',\"mean\":', mean, ',\"stddev\":', "
        f"stddev, ',\"min\":', min, ',\"max\":', max, '}}') AS json FROM ({_described()})"
    ),
    "grade_distribution_json": _with(
        "SELECT concat('{\"loan_grade\":\"', loan_grade, '\",\"count\":', count(*), '}') AS json "
        "FROM loan_applications GROUP BY loan_grade"
    ),
    "class_balance": _with(
        "SELECT count(*) AS n_rows, count(*) FILTER (loan_status = 0) AS n_rejected, "
        "count(*) FILTER (loan_status = 1) AS n_approved, "
        "count(*) FILTER (loan_status = 1) / count(*) AS approved_share FROM loan_applications"
    ),
    "null_profile": _with(
        _union(
            [
                f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_missing FROM loan_dirty"
                for c in _DIRTY_COLUMNS
            ]
        ),
        "loan_dirty",
    ),
    "approval_by_age_bucket": _with(
        f"SELECT {_AGE_BUCKET} AS age_bucket, avg(loan_status) AS average_loan_status_rate "
        "FROM loan_applications GROUP BY 1"
    ),
    "approval_by_income_bucket": _with(
        f"SELECT {_INCOME_BUCKET} AS income_bucket, avg(loan_status) AS average_loan_status_rate "
        "FROM loan_applications GROUP BY 1"
    ),
    "pct_by_ownership": _with(_share("loan_applications", "person_home_ownership", "loan_status")),
    "pct_by_ownership_join": _with(
        _share("loan_dirty", "person_home_ownership", "loan_status", "person_home_ownership IS NOT NULL"),
        "loan_dirty",
    ),
    "pct_by_intent": _with(_share("loan_dirty", "loan_intent", "loan_status"), "loan_dirty"),
    "corr_matrix": _with(
        "SELECT * FROM pairs WHERE abs(correlation) < 1", pairs=_correlations("loan_applications", _PROFILED)
    ),
    "corr_matrix_dirty": _with(
        "SELECT * FROM pairs WHERE abs(correlation) < 1",
        "loan_dirty",
        pairs=_correlations("loan_dirty", _PROFILED),
    ),
    "corr_top_k": _with(
        "SELECT * FROM pairs WHERE abs(correlation) < 1 ORDER BY abs(correlation) DESC, column1, column2 LIMIT 10",
        pairs=_correlations("loan_applications", _PROFILED),
    ),
    "corr_with_target": _with(
        _union(
            [
                f"SELECT '{c}' AS column_name, round(corr({c}, loan_status), 6) AS correlation FROM loan_applications"
                for c in _PROFILED[:-1]
            ]
        )
    ),
    "corr_lineitem": f"SELECT * FROM ({_correlations('lineitem', _LINE)}) WHERE abs(correlation) < 1",
    "quartiles": _with(_quartiles("loan_applications", _PROFILED)),
    "quartiles_lineitem": _quartiles("lineitem", _LINE),
    "iqr_bounds": _with(_BOUNDS, quartile=_quartiles("loan_applications", _OUTLIERS)),
    "iqr_outlier_flags": _with(
        "SELECT id, "
        + ", ".join(f"{c}, {_outside(c)} AS {c}_outlier" for c in _OUTLIERS)
        + " FROM loan_applications",
        quartile=_quartiles("loan_applications", _OUTLIERS),
        bounds=_BOUNDS,
    ),
    "iqr_outlier_counts": _with(
        _union(
            [
                f"SELECT '{c}' AS column_name, count(*) FILTER ({_outside(c)}) AS n_outliers FROM loan_applications"
                for c in _OUTLIERS
            ]
        ),
        quartile=_quartiles("loan_applications", _OUTLIERS),
        bounds=_BOUNDS,
    ),
    "iqr_outlier_counts_events": (
        f"WITH quartile AS ({_quartiles('events', ['value'])}), bounds AS ({_BOUNDS}) "
        f"SELECT 'value' AS column_name, count(*) FILTER ({_outside('value')}) AS n_outliers FROM events"
    ),
    "impute_group_median": _with(
        "SELECT id, person_age, age_bucket, "
        + ", ".join(
            f"CASE WHEN {c} IS NULL OR {_outside(c)} THEN coalesce(CAST(m_{c} AS {t}), {c}) ELSE {c} END AS {c}"
            for c, t in _IMPUTED.items()
        )
        + " FROM grouped LEFT JOIN medians ON age_bucket IS NOT DISTINCT FROM bucket",
        "loan_dirty",
        grouped=f"SELECT *, {_AGE_BUCKET} AS age_bucket FROM loan_dirty",
        medians="SELECT age_bucket AS bucket, "
        + ", ".join(f"quantile_disc({c}, 0.5) AS m_{c}" for c in _IMPUTED)
        + " FROM grouped GROUP BY 1",
        quartile=_quartiles("loan_dirty", list(_IMPUTED)),
        bounds=_BOUNDS,
    ),
    "describe_numeric": _with(_described()),
    "grade_distribution": _with(
        f"SELECT loan_grade, n, {_percent('n', '(SELECT count(*) FROM loan_applications)')} AS percentage "
        "FROM (SELECT loan_grade, count(*) AS n FROM loan_applications GROUP BY 1)"
    ),
    "feature_histogram": _with(
        _union([_histogram(c) for c in ("loan_amnt", "loan_int_rate", "person_age")])
    ),
    "share_of_order_priority": _share("orders", "o_orderstatus", "o_orderpriority"),
    "age_bucket": _with(f"SELECT id, person_age, {_AGE_BUCKET} AS age_bucket FROM loan_dirty", "loan_dirty"),
    "income_bucket": _with(
        f"SELECT id, person_income, {_INCOME_BUCKET} AS income_bucket FROM loan_dirty", "loan_dirty"
    ),
    "status_features": _with(f"SELECT id, {_status_columns('0e0')} FROM loan_dirty", "loan_dirty"),
    "status_layout": _with(
        f"SELECT id, {_status_columns('NULL')}, {_ONEHOT_LISTS} FROM loan_dirty", "loan_dirty"
    ),
    "grade_layout": _with(
        f"SELECT id, {_ONEHOT_LISTS}, {_NO_DEFAULT}, {_GRADE_COLUMNS} FROM loan_applications"
    ),
    "status_features_null_history": _with(
        f"SELECT id, {_over_history('person_age', 'NULL')} AS age_to_history_length_ratio, "
        f"{_over_history('(loan_amnt * loan_int_rate)', 'NULL')} AS credit_risk FROM loan_applications"
    ),
    "grade_features": _with(f"SELECT id, {_GRADE_COLUMNS} FROM loan_applications"),
    "grade_features_ordinal": _with(
        "SELECT id, CAST(CASE person_home_ownership WHEN 'RENT' THEN 0 WHEN 'MORTGAGE' THEN 1 "
        "WHEN 'OWN' THEN 2 ELSE 3 END AS INT) AS home_ownership_num, "
        "CAST(CASE loan_intent WHEN 'PERSONAL' THEN 0 WHEN 'EDUCATION' THEN 1 WHEN 'MEDICAL' THEN 2 "
        "WHEN 'VENTURE' THEN 3 WHEN 'HOMEIMPROVEMENT' THEN 4 ELSE 5 END AS INT) AS loan_intent_num, "
        + _flag("cb_person_default_on_file <> 'N'", "default_on_file_num")
        + f", {_INTEREST}, {_SHORT_JOB} FROM loan_applications"
    ),
    "index_ownership": _with(
        "SELECT person_home_ownership, n, CAST(row_number() OVER (ORDER BY n DESC, person_home_ownership) - 1 "
        'AS DOUBLE) AS "index" FROM (SELECT person_home_ownership, count(*) AS n FROM loan_applications GROUP BY 1)'
    ),
    "index_grade": _with(
        'SELECT loan_grade, n, CAST(dense_rank() OVER (ORDER BY loan_grade) - 1 AS DOUBLE) AS "index" '
        "FROM (SELECT loan_grade, count(*) AS n FROM loan_applications GROUP BY 1)"
    ),
    "onehot_ownership": _onehot("person_home_ownership", 3),
    "onehot_intent": _onehot("loan_intent", 5),
    "onehot_fixed": _with(
        f"SELECT id, {_ONEHOT_LISTS}, CAST(0 AS INT) AS loan_intent_onehot FROM loan_dirty", "loan_dirty"
    ),
    "assemble_skip_count": _with(
        "SELECT count(*) AS n_rows, count(*) FILTER (whole) AS n_kept, count(*) FILTER (NOT whole) AS n_dropped "
        "FROM (SELECT coalesce(cb_person_cred_hist_length, 0) <> 0 AND person_age IS NOT NULL "
        "AND person_income IS NOT NULL AND person_emp_length IS NOT NULL AND loan_int_rate IS NOT NULL AS whole "
        "FROM loan_dirty)",
        "loan_dirty",
    ),
    "split_counts": _with(
        "SELECT CASE WHEN id % 5 < 4 THEN 'train' ELSE 'validation' END AS side, count(*) AS n, "
        "CAST(sum(count(*)) OVER () AS BIGINT) AS n_all, CAST(0 AS BIGINT) AS n_neither, CAST(0 AS BIGINT) AS n_twice, "
        "true AS is_four_fifths FROM loan_applications GROUP BY 1"
    ),
    "accuracy": _with(
        "SELECT n, accuracy, 1e0 - accuracy AS test_error FROM (SELECT count(*) AS n, "
        "avg(CASE WHEN grade_label = grade_prediction THEN 1e0 ELSE 0e0 END) AS accuracy FROM loan_scored)",
        "loan_scored",
    ),
    "precision_recall": _with(
        'SELECT tp, fp, fn, tn, tp / nullif(tp + fp, 0) AS "precision", tp / nullif(tp + fn, 0) AS recall, '
        "2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM cells",
        "loan_scored",
        cells="SELECT count(*) FILTER (label = 1 AND prediction = 1) AS tp, "
        "count(*) FILTER (label = 0 AND prediction = 1) AS fp, "
        "count(*) FILTER (label = 1 AND prediction = 0) AS fn, "
        "count(*) FILTER (label = 0 AND prediction = 0) AS tn FROM loan_scored",
    ),
    "confusion_long": _with(
        f"SELECT {_letter('grade_label')} AS actual, {_letter('grade_prediction')} AS predicted, count(*) AS n "
        "FROM loan_scored GROUP BY 1, 2",
        "loan_scored",
    ),
    "confusion_dense": _with(
        "SELECT actual, "
        + ", ".join(f"count(*) FILTER (predicted = '{g}') AS predicted_{g}" for g in "ABCDEFG")
        + ", count(*) FILTER (actual IS NOT NULL AND seen AND predicted IS NULL) AS predicted_other"
        + " FROM (SELECT unnest(['A','B','C','D','E','F','G','other']) AS actual) LEFT JOIN letters USING (actual) GROUP BY 1",
        "loan_scored",
        letters=f"SELECT coalesce({_letter('grade_label')}, 'other') AS actual, "
        f"{_letter('grade_prediction')} AS predicted, true AS seen FROM loan_scored",
    ),
    "roc_curve": _with(_ROC_CURVE, "loan_scored", **_roc("score")),
    "roc_curve_hard_class": _with(_ROC_CURVE, "loan_scored", **_roc("prediction")),
    "roc_auc": _with(
        "SELECT round(CAST(sum(neg * (tp - pos / 2e0)) AS DOUBLE) / CAST(max(p) * max(n) AS DOUBLE), 9) AS auc "
        "FROM points",
        "loan_scored",
        **_roc("score"),
    ),
    "decode_predictions": _with(
        f"SELECT id, {_letter('grade_prediction')} AS grade, {_decision('prediction')} AS decision FROM loan_scored",
        "loan_scored",
    ),
    "validate_applications": _with(f"SELECT *, {_ERRORS} FROM typed", "loan_forms", typed=_TYPED),
    "rejected_forms": _with(
        f"SELECT id, username, errors FROM (SELECT *, {_ERRORS} FROM typed) WHERE errors <> ''",
        "loan_forms",
        typed=_TYPED,
    ),
    "accepted_applications": _accepted(
        ", amount_requested / nullif(CAST(person_income AS DOUBLE), 0) AS loan_percent_income"
    ),
    "unscorable_applications": _with(_UNSCORABLE, "loan_dirty"),
    "pending_loans": _with(
        "SELECT id, username, intent, amount_requested FROM loan_scored WHERE status = '-'", "loan_scored"
    ),
    "next_pending": _with(
        "SELECT username, CAST(id AS VARCHAR) AS id, intent, amount_requested FROM (SELECT *, row_number() OVER "
        "(PARTITION BY username ORDER BY (id * 7919) % 1000, CAST(id AS VARCHAR)) AS place "
        "FROM loan_scored WHERE status = '-') WHERE place = 1",
        "loan_scored",
    ),
    "merge_scores": _with(
        f"SELECT id, username, CASE WHEN status = '-' THEN {_decision('prediction')} ELSE status END AS status, "
        f"CASE WHEN status = '-' THEN {_letter('grade_prediction')} ELSE loan_grade END AS loan_grade "
        "FROM loan_scored",
        "loan_scored",
    ),
    "dashboard_rates": _RATES,
    "dashboard_avg_amount": _with(
        f"SELECT *, {_fixed('avg_accepted_amount', 2)} AS accepted_text, "
        f"{_fixed('avg_rejected_amount', 2)} AS rejected_text FROM means",
        "loan_scored",
        means="SELECT username, coalesce(avg(amount_requested) FILTER (status = 'ACCEPTED'), 0e0) "
        "AS avg_accepted_amount, coalesce(avg(amount_requested) FILTER (status = 'REJECTED'), 0e0) "
        "AS avg_rejected_amount FROM loan_scored GROUP BY username",
    ),
    "dashboard_top_purpose": _with(
        "SELECT username, coalesce(a.intent, 'N/A') AS accepted_purpose, coalesce(r.intent, 'N/A') AS rejected_purpose "
        "FROM (SELECT DISTINCT username FROM loan_scored) LEFT JOIN a USING (username) LEFT JOIN r USING (username)",
        "loan_scored",
        a=_top_purpose("ACCEPTED"),
        r=_top_purpose("REJECTED"),
    ),
    "dashboard_grade_dist": _with(
        'SELECT username, status, loan_grade, "count" AS n, CAST(floor(percentage + 5e-1) AS BIGINT) AS percent '
        f"FROM ({_decided_share('loan_grade')})",
        "loan_scored",
    ),
    "dashboard_purpose_dist": _with(
        f'SELECT username, status, intent, "count" AS n, percentage FROM ({_decided_share("intent")})',
        "loan_scored",
    ),
    "loan_list": _with(
        "SELECT id, username, intent, status, loan_grade, "
        f"'$' || {_fixed('amount_requested', 2)} AS amount_text, {_fixed('interest_rate', 1)} || '%' AS rate_text "
        "FROM loan_scored",
        "loan_scored",
    ),
    "stream_accepted_forms": _accepted(),
    "stream_dashboard_rates": _RATES,
}

# --- what must hold of fitted models ------------------------------------------------------

# A status vector needs its numbers; a grade vector also an age not below the credit history.
_COMPLETE = " AND ".join(
    f"{c} IS NOT NULL" for c in domain.RAW_FEATURES if c not in domain.RAW_CATEGORICAL
)
_OLD_ENOUGH = "person_age - cb_person_cred_hist_length > -1"
_ACCEPTED_IDS = f"SELECT id, username, coalesce(person_income <> 0 AND {_OLD_ENOUGH}, false) AS scored FROM (SELECT *, {_ERRORS} FROM typed) WHERE errors = ''"


def _typical(column: str) -> str:
    if column in domain.RAW_CATEGORICAL:
        value = f"(SELECT {column} FROM loan_applications GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
    else:
        value = f"(SELECT quantile_disc({column}, 0.5) FROM loan_applications)"
    usual = f"count(*) FILTER ({column} = {value})"
    return (
        f"SELECT '{column}' AS feature, count(*) AS n, {usual} AS n_usual, {usual} AS n_usual_unchanged "
        "FROM loan_applications"
    )


ORACLES |= {
    "score_status_lr": _with("SELECT id, true AS is_class, true AS is_sigmoid FROM loan_applications"),
    "score_status_dirty": _with(
        f"SELECT id, {_COMPLETE} AS is_scored, NOT ({_COMPLETE}) AS has_error FROM loan_dirty", "loan_dirty"
    ),
    "status_model_quality": "SELECT model, true AS precise, true AS complete FROM (VALUES ('forest'), ('logistic')) v(model)",
    "grade_test_error": _with(
        "SELECT count(*) AS n, true AS is_a_fifth, true AS is_accurate FROM loan_applications"
    ),
    "cv_status": "SELECT CAST(fold AS INT) AS fold, true AS is_good FROM range(5) f(fold)",
    "cv_grade": """SELECT '{"layers": ' || l || ', "maxIter": ' || m || '}' AS setting, CAST(fold AS INT) AS fold, """
    "true AS is_good FROM (VALUES (50), (100)) v(m), (VALUES ('[19, 15, 15, 7]'), ('[19, 24, 7]')) w(l), range(3) f(fold)",
    "occlusion_attribution": _with(_union([_typical(c) for c in domain.RAW_FEATURES])),
    "score_pending": _with(
        "SELECT CAST(id AS VARCHAR) AS id, username, "
        + ", ".join(f"scored AS {c}" for c in ("is_decided", "is_graded", "is_explained", "is_scored"))
        + f" FROM ({_ACCEPTED_IDS})",
        "loan_forms",
        typed=_TYPED,
    ),
    "stream_score_counts": _with(
        f"SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_different FROM ({_ACCEPTED_IDS})",
        "loan_forms",
        typed=_TYPED,
    ),
}


# --- trees of rules and calibration ---------------------------------------------------------


def _rule_nodes(rule: dict | None, reach: str, nodes: list[dict]) -> int:
    """Nodes with the condition under which a row comes to them."""
    number = len(nodes)
    nodes.append({"reach": reach, "rule": rule})
    if rule is not None:
        test = f"{rule['column']} <= {rule['up_to']}"
        nodes[number]["low"] = _rule_nodes(rule["low"], f"{reach} AND {test}", nodes)
        nodes[number]["high"] = _rule_nodes(rule["high"], f"{reach} AND NOT {test}", nodes)
    return number


_RULE_NODES: list[dict] = []
_rule_nodes(APPROVAL_RULES, "true", _RULE_NODES)
_RULE_COLUMNS = list(dict.fromkeys(n["rule"]["column"] for n in _RULE_NODES if n["rule"]))
_RULE_FACTS = (
    "SELECT "
    + ", ".join(
        f"CAST(count(*) FILTER ({n['reach']}) AS DOUBLE) AS n{i}, avg(loan_status) FILTER ({n['reach']}) AS v{i}"
        for i, n in enumerate(_RULE_NODES)
    )
    + " FROM loan_applications"
)


def _known(columns: frozenset, at: int = 0) -> str:
    """The tree's answer when only some columns are known; others are averaged by the rows' counts."""
    node = _RULE_NODES[at]
    if node["rule"] is None:
        return f"v{at}"
    low, high = (_known(columns, node[side]) for side in ("low", "high"))
    if node["rule"]["column"] in columns:
        return f"CASE WHEN {node['rule']['column']} <= {node['rule']['up_to']} THEN {low} ELSE {high} END"
    return f"((n{node['low']} * {low} + n{node['high']} * {high}) / (n{node['low']} + n{node['high']}))"


def _subset_sum(column: str) -> str:
    """The Shapley value by its definition: a weighted sum over all sets of other columns."""
    others = [c for c in _RULE_COLUMNS if c != column]
    terms = []
    for size in range(len(others) + 1):
        weight = math.factorial(size) * math.factorial(len(others) - size) / math.factorial(len(others) + 1)
        for some in combinations(others, size):
            more = _known(frozenset({*some, column}))
            terms.append(f"{weight!r} * ({more} - {_known(frozenset(some))})")
    return " + ".join(terms)


ORACLES |= {
    "tree_shapley_sums": _with("SELECT id, true AS adds_up FROM loan_applications"),
    "rule_tree_shapley": _with(
        _union(
            [
                f"SELECT id, '{c}' AS feature, round({_known(frozenset())}, 9) AS base, "
                f"round({_subset_sum(c)}, 9) AS value FROM loan_applications, facts"
                for c in _RULE_COLUMNS
            ]
        ),
        facts=_RULE_FACTS,
    ),
    "rule_tree_response": _with(
        "SELECT loan_percent_income AS grid_value, "
        f"round({_known(frozenset({'loan_percent_income'}))}, 9) AS probability "
        f"FROM (SELECT unnest([{', '.join(f'{v}e0' for v in RESPONSE_GRID)}]) AS loan_percent_income), facts",
        facts=_RULE_FACTS,
    ),
    # The fit at a score: over starts at or below it the highest of the lowest means up to it or beyond.
    "calibrated_confidence": _with(
        "SELECT id, score, round(confidence, 9) AS confidence FROM loan_scored JOIN fit USING (score)",
        "loan_scored",
        points="SELECT score, sum(count(*)) OVER (ORDER BY score) AS n, sum(sum(label)) OVER (ORDER BY score) AS s, "
        "count(*) AS own_n, sum(label) AS own_s FROM loan_scored GROUP BY score",
        lowest="SELECT p.score, a.score AS start, "
        "min((b.s - a.s + a.own_s) / CAST(b.n - a.n + a.own_n AS DOUBLE)) AS mean "
        "FROM points p JOIN points a ON a.score <= p.score JOIN points b ON b.score >= p.score GROUP BY 1, 2",
        fit="SELECT score, max(mean) AS confidence FROM lowest GROUP BY score",
    ),
    "calibration_error": _with(
        "SELECT bin, n, round(c, 9) AS mean_confidence, round(o, 9) AS observed_rate, round(abs(c - o), 9) AS gap "
        "FROM (SELECT CAST(least(floor(score * 10), 9) AS INT) AS bin, count(*) AS n, avg(score) AS c, "
        "avg(label) AS o FROM loan_scored GROUP BY 1)",
        "loan_scored",
    ),
}

ORACLES["merge_scores_bucketed"] = ORACLES["merge_scores"]
ORACLES["stream_merge_scores"] = ORACLES["merge_scores"]
ORACLES["stream_top_purpose"] = ORACLES["dashboard_top_purpose"]
ORACLES["refreshed_correlations"] = ORACLES["corr_matrix_dirty"]


def _gap(column: str) -> str:
    """Cumulative shares by windows over the column's values."""
    return (
        f"SELECT '{column}' AS feature, max(total_r) AS n_reference, max(total_c) AS n_current, "
        "round(max(gap), 9) AS distance, round(min_by(v, [-gap, v]), 9) AS at_value, "
        "max(gap) > 1.95e0 * sqrt((max(total_r) + max(total_c)) / (CAST(max(total_r) AS DOUBLE) * max(total_c))) AS drifted "
        "FROM (SELECT v, total_r, total_c, abs(so_far_r / CAST(total_r AS DOUBLE) - so_far_c / CAST(total_c AS DOUBLE)) AS gap "
        "FROM (SELECT v, CAST(sum(r) OVER (ORDER BY v) AS BIGINT) AS so_far_r, CAST(sum(c) OVER (ORDER BY v) AS BIGINT) AS so_far_c, "
        "CAST(sum(r) OVER () AS BIGINT) AS total_r, CAST(sum(c) OVER () AS BIGINT) AS total_c "
        f"FROM (SELECT CAST({column} AS DOUBLE) AS v, count(*) FILTER (id % 10 <> 0) AS r, count(*) FILTER (id % 10 = 0) AS c "
        "FROM loan_applications GROUP BY 1)))"
    )


def _moved(column: str) -> str:
    return (
        f"SELECT '{column}' AS feature, CAST(sum(r) AS BIGINT) AS n_reference, CAST(sum(c) AS BIGINT) AS n_current, "
        "round(sum(abs(r / CAST(total_r AS DOUBLE) - c / CAST(total_c AS DOUBLE))) / 2, 9) AS distance, "
        "CAST(sum(CASE WHEN r = 0 THEN c ELSE 0 END) AS BIGINT) AS n_unseen "
        "FROM (SELECT *, sum(r) OVER () AS total_r, sum(c) OVER () AS total_c "
        f"FROM (SELECT {column}, count(*) FILTER (id % 10 <> 0) AS r, count(*) FILTER (id % 10 = 0) AS c "
        "FROM loan_applications GROUP BY 1))"
    )


def _frequent(table: str, column: str) -> str:
    return (
        "SELECT CAST(row_number() OVER (ORDER BY n DESC, value) AS INT) AS place, value, n FROM "
        f"(SELECT CAST({column} AS VARCHAR) AS value, count(*) AS n FROM {table} WHERE {column} IS NOT NULL "
        "GROUP BY 1 ORDER BY n DESC, value LIMIT 20)"
    )


def _described(column: str) -> str:
    return (
        f"SELECT '{column}' AS column_name, count({column}) AS n, count(*) - count({column}) AS n_missing, "
        f"round(avg({column}), 6) AS mean, round(stddev_samp({column}), 6) AS stddev, "
        f"CAST(min({column}) AS DOUBLE) AS min_value, CAST(max({column}) AS DOUBLE) AS max_value FROM loan_dirty"
    )


ORACLES |= {
    "numeric_drift": _with(_union([_gap(c) for c in ("person_income", "loan_amnt", "loan_int_rate", "person_age")])),
    "text_drift": _with(_union([_moved(c) for c in domain.RAW_CATEGORICAL])),
    "frequent_users": _frequent("events", "user_id"),
    "frequent_order_keys": _frequent("lineitem", "l_orderkey"),
    "refreshed_profile": _with(_union([_described(c) for c in _PROFILED]), "loan_dirty"),
}
