"""Declared field types and how raw values become them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Declared type -> Spark type (fixed values).
DECLARED = {
    "STRING": T.StringType(),
    "BOOLEAN": T.BooleanType(),
    "BYTES": T.BinaryType(),
    "INT": T.IntegerType(),
    "LONG": T.LongType(),
    "FLOAT": T.FloatType(),
    "DOUBLE": T.DoubleType(),
}


def spark_type(declared: str) -> T.DataType:
    try:
        return DECLARED[declared.upper()]
    except KeyError:
        raise ValueError(f"unknown field type {declared!r}") from None


def cast(column: Column, declared: str, *, strict: bool = True) -> Column:
    """column as its declared type; BYTES are base64 text.  strict: bad text is an error, else null."""
    kind = spark_type(declared)
    if isinstance(kind, T.BinaryType):
        return F.unbase64(column.cast("string"))
    return column.cast(kind) if strict else column.try_cast(kind)
