"""Declared schemas. Operators check their input against these instead of inferring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TRANSLATION = T.StructType([T.StructField("src", T.StringType()), T.StructField("tgt", T.StringType())])

PAIRS = T.StructType([T.StructField("id", T.StringType()), T.StructField("translation", TRANSLATION)])

NUMBERED_PAIRS = T.StructType([T.StructField("row_idx", T.LongType()), *PAIRS.fields])


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Return ``df`` unchanged, or raise when a column is absent."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def require_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Return ``df`` unchanged, or raise when a declared field is absent or has another type."""
    for field in require(df, *schema.names).schema:
        if field.name in schema.names:
            wanted = schema[field.name].dataType.simpleString()
            if field.dataType.simpleString() != wanted:
                raise ValueError(f"column {field.name} is {field.dataType.simpleString()}, wanted {wanted}")
    return df
