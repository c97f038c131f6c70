"""Cleaning: null tokens, column drops, duplicate rows, type coercion, filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.functions.scalars import col, try_number


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def feature_roles(df: DataFrame, target: str | None = None) -> tuple[list[str], list[str]]:
    """Numeric and categorical feature names by type; other types belong to neither."""
    numeric, categorical = [], []
    for f in df.schema.fields:
        if f.name == target:
            continue
        if isinstance(f.dataType, T.NumericType):
            numeric.append(f.name)
        elif isinstance(f.dataType, (T.StringType, T.BooleanType)):
            categorical.append(f.name)
    return numeric, categorical


def null_tokens(df: DataFrame, tokens: Sequence[str] = ("?",)) -> DataFrame:
    """Cells of string columns equal to a token (spaces aside) become null."""
    text = set(string_columns(df))
    return df.select(
        *[
            F.when(F.trim(col(c)).isin(list(tokens)), F.lit(None)).otherwise(col(c)).alias(c) if c in text else col(c)
            for c in df.columns
        ]
    )


def drop_columns(df: DataFrame, cols: Sequence[str], missing_ok: bool = True) -> DataFrame:
    absent = [c for c in cols if c not in df.columns]
    if absent and not missing_ok:
        raise ValueError(f"columns not in the table: {absent}")
    return df.drop(*cols)


def dedup(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row per distinct value; nulls compare equal.  Copies merge map-side first."""
    return df.dropDuplicates(list(cols)) if cols else df.dropDuplicates()


def column_fill(df: DataFrame) -> DataFrame:
    """Non-null count per column in long form: ``column``, ``non_null``, ``n_rows``."""
    counted = df.agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]
    )
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("non_null")) for i, c in enumerate(df.columns)]
    )
    return counted.select("n_rows", F.explode(pairs).alias("p")).select("p.column", "p.non_null", "n_rows")


def sparse_columns(df: DataFrame, min_fill: float = 0.5) -> DataFrame:
    """Fill report with ``kept``: at least ``min_fill`` of the cells are present."""
    return column_fill(df).withColumn("kept", F.col("non_null") >= F.col("n_rows") * F.lit(min_fill))


def drop_sparse_columns(df: DataFrame, min_fill: float = 0.5) -> DataFrame:
    gone = [r["column"] for r in sparse_columns(df, min_fill).filter(~F.col("kept")).collect()]
    return df.drop(*gone)


def numeric_columns_of_text(df: DataFrame) -> list[str]:
    """String columns whose every non-null cell parses as a number (one pass)."""
    text = string_columns(df)
    if not text:
        return []
    got = df.agg(
        *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(text)],
        *[F.count(try_number(c)).alias(f"p{i}") for i, c in enumerate(text)],
    ).first()
    return [c for i, c in enumerate(text) if got[f"c{i}"] == got[f"p{i}"]]


def coerce_numeric(df: DataFrame) -> DataFrame:
    """Turn string columns into double where every value is a number."""
    numbers = set(numeric_columns_of_text(df))
    return df.select(*[try_number(c).alias(c) if c in numbers else col(c) for c in df.columns])


def trim_all(df: DataFrame) -> DataFrame:
    """Trim column names and string cells."""
    text = set(string_columns(df))
    return df.select(*[(F.trim(col(c)) if c in text else col(c)).alias(c.strip()) for c in df.columns])


def drop_any_null(df: DataFrame) -> DataFrame:
    """Rows without a null or NaN, whatever the columns are called."""
    real = {c for c, t in df.dtypes if t in ("double", "float")}
    for c in df.columns:
        df = df.filter(col(c).isNotNull() & (~F.isnan(col(c)) if c in real else F.lit(True)))
    return df


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.filter(col(target).isNotNull())


def rename_last(df: DataFrame, name: str) -> DataFrame:
    return df.withColumnRenamed(df.columns[-1], name)


def arrest_window(df: DataFrame, days: str, recid: str, degree: str, keep: Sequence[str]) -> DataFrame:
    """Range and inequality filter then projection.

    A missing ``days`` fails the range; a missing value passes the inequalities.
    """
    return df.filter(
        col(days).between(-30, 30) & ~col(recid).eqNullSafe(F.lit(-1)) & ~col(degree).eqNullSafe(F.lit("O"))
    ).select(*[col(c) for c in keep])
