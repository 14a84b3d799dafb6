"""Column expressions. No Python UDF: everything stays inside generated code."""
