"""Summaries of scored loans per user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom import domain
from fathom.functions.numeric import fixed, round_half_up, share_percent
from fathom.operators.profiling import share_within

DECIDED = [domain.ACCEPTED, domain.REJECTED]


def _decided(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status").isin(DECIDED))


def _of(status: str):
    return F.col("status") == status


def rates(df: DataFrame) -> DataFrame:
    """Acceptance and rejection rate of each user over all loans, pending ones included."""
    counts = df.groupBy("username").agg(
        F.count(F.lit(1)).alias("n_loans"),
        F.count(F.when(_of(domain.ACCEPTED), 1)).alias("n_accepted"),
        F.count(F.when(_of(domain.REJECTED), 1)).alias("n_rejected"),
    )
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    total = F.col("n_loans").cast("double")
    measured = counts.withColumns(
        {
            "acceptance_rate": F.col("n_accepted").cast("double") / total * F.lit(100.0),
            "rejection_rate": F.col("n_rejected").cast("double") / total * F.lit(100.0),
        }
    )
    return measured.withColumns(
        {
            "acceptance_text": fixed(F.col("acceptance_rate"), 1, "%%"),
            "rejection_text": fixed(F.col("rejection_rate"), 1, "%%"),
        }
    )


def average_amount(df: DataFrame) -> DataFrame:
    """Average amount of accepted and of rejected loans per user, 0 without any."""
    amount = F.col("amount_requested")
    means = df.groupBy("username").agg(
        *(
            F.coalesce(F.avg(F.when(_of(s), amount)), F.lit(0.0)).alias(f"avg_{s.lower()}_amount")
            for s in DECIDED
        )
    )
    return means.withColumns(
        {f"{s.lower()}_text": fixed(F.col(f"avg_{s.lower()}_amount"), 2) for s in DECIDED}
    )


def top_purpose(df: DataFrame) -> DataFrame:
    """Most common purpose of accepted and of rejected loans per user; ties by name; N/A without any."""
    counts = df.groupBy("username", "status", "intent").agg(F.count(F.lit(1)).alias("n"))
    # Most rows first, then the smaller name: the least (-n, intent).
    key = F.struct((-F.col("n")).alias("rank"), F.col("intent"))
    return counts.groupBy("username").agg(
        *(
            F.coalesce(F.min(F.when(_of(s), key))["intent"], F.lit("N/A")).alias(f"{s.lower()}_purpose")
            for s in DECIDED
        )
    )


def grade_distribution(df: DataFrame) -> DataFrame:
    """Whole percent of each grade within a user's accepted and rejected loans."""
    shares = share_within(_decided(df), ["username", "status"], "loan_grade", ordered=False)
    return shares.withColumn("percent", round_half_up(F.col("percentage")).cast("long")).select(
        "username", "status", "loan_grade", F.col("count").alias("n"), "percent"
    )


def purpose_distribution(df: DataFrame) -> DataFrame:
    """Share of each purpose within a user's accepted and rejected loans."""
    # The purpose is free text, so a user may have very many.
    shares = share_within(_decided(df), ["username", "status"], "intent", method="join", ordered=False)
    return shares.select("username", "status", "intent", F.col("count").alias("n"), "percentage")


def loan_list(df: DataFrame) -> DataFrame:
    """Loans as shown to a user: amount, rate and confidences as text."""
    columns = {
        "amount_text": F.concat(F.lit("$"), fixed(F.col("amount_requested"), 2)),
        "rate_text": fixed(F.col("interest_rate"), 1, "%%"),
    }
    for name in ("grade", "status"):
        if f"{name}_probability" in df.columns:
            columns[f"{name}_confidence"] = fixed(F.col(f"{name}_probability") * F.lit(100.0), 1, "%%")
    return df.select(
        "id",
        "username",
        "intent" if "intent" in df.columns else F.col("loan_intent").alias("intent"),
        "status",
        "loan_grade",
        *(text.alias(name) for name, text in columns.items()),
    )


def explained_loans(df: DataFrame, top: int = 10) -> DataFrame:
    """The strongest features shown with each decided loan, one row per loan and feature."""
    shown = _decided(df).select(
        "id", F.posexplode(F.slice("feature_importances", 1, top)).alias("place", "entry")
    )
    importance = F.col("entry.importance")
    return shown.select(
        "id",
        (F.col("place") + 1).alias("place"),
        F.col("entry.feature").alias("feature"),
        importance.alias("importance"),
        fixed(importance * F.lit(100.0), 1, "%%").alias("importance_text"),
    )
