"""Table scans and schema introspection."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom import domain


def read_loans(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    schema: T.StructType | None = None,
    header: bool = True,
    sep: str = ",",
    infer: bool = False,
) -> DataFrame:
    """Scan a loan table.

    The declared schema is the default; ``infer`` costs an extra pass over a CSV file.
    A CSV with fewer columns (no grade, no status) is matched to the schema by its header. Every
    file must have that header: one with other or swapped columns is an error. Values that are not
    of a column's type are null here; ``rejected_records`` gives the lines they stand in.
    """
    reader = spark.read.option("header", header).option("sep", sep)
    try:
        if fmt != "csv":
            return (reader.schema(schema) if schema else reader).format(fmt).load(path)
        if infer:
            return reader.option("inferSchema", True).csv(path)
        if schema is None:
            schema = domain.LOAN_SCHEMA
            if header:
                names = reader.csv(path).columns
                types = {f.name: f for f in schema.fields}
                schema = T.StructType([types.get(n, T.StructField(n, T.StringType())) for n in names])
        return reader.schema(schema).option("enforceSchema", not header).csv(path)
    except AnalysisException as problem:
        raise ValueError(f"Error reading loans from {path!r}: {problem}") from problem


def rejected_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """The lines of a CSV loan table with a value that is not of its column's type, as ``record``."""
    schema = read_loans(spark, path, sep=sep).schema.add("record", T.StringType())
    reader = spark.read.option("header", True).option("sep", sep).option("enforceSchema", False)
    rows = reader.schema(schema).option("columnNameOfCorruptRecord", "record").csv(path)
    return rows.filter(F.col("record").isNotNull())


def loans_from_rows(spark: SparkSession, rows: Iterable, schema: T.StructType | None = None) -> DataFrame:
    """Literal rows as a table, for single requests and tests."""
    return spark.createDataFrame(list(rows), schema or domain.LOAN_SCHEMA)


def schema_frame(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, nullability."""
    rows = [
        (i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(
        rows, "position int, column_name string, data_type string, nullable boolean"
    )


def table_shape(df: DataFrame) -> DataFrame:
    """Column names and types with the row and column count of the table."""
    fields = [
        F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"))
        for f in df.schema.fields
    ]
    return (
        df.agg(F.count(F.lit(1)).alias("n_rows"))
        .select("n_rows", F.lit(len(fields)).alias("n_columns"), F.explode(F.array(*fields)).alias("f"))
        .select("f.column_name", "f.data_type", "n_rows", "n_columns")
    )


def preview(df: DataFrame, n: int = 20, *order) -> DataFrame:
    """First ``n`` rows in a given order."""
    return (df.orderBy(*order) if order else df).limit(n)
