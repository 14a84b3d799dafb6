"""Loan analytics as composable Spark DataFrame operators."""
