"""What kind of column is this? Decided by the declared type alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC, CATEGORICAL, DATETIME = "numeric", "categorical", "datetime"


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATETIME
    if isinstance(data_type, T.NumericType):
        return NUMERIC
    return CATEGORICAL


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def columns_of(df: DataFrame, kind: str) -> list[str]:
    return [name for name, k in kinds(df).items() if k == kind]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing; fold it into NULL on every floating column."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floats:
        return df
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def text_of(df: DataFrame, column: str):
    """The column as comparable text; nested values as JSON."""
    data_type = df.schema[column].dataType
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(F.col(column))
    return F.col(column).cast("string")
