"""Predicate trees as Spark columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .intervals import FLIPPED

_OPS = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def column(predicate: tuple | None) -> Column:
    """Names are given as the second part of a comparison (or the third, if the second is no string)."""
    if predicate is None:
        return F.lit(True)
    op, *args = predicate
    if op in ("and", "or"):
        return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), map(column, args))
    if op == "not":
        return ~column(args[0])
    if op == "is null":
        return F.col(args[0]).isNull()
    if op == "is not null":
        return F.col(args[0]).isNotNull()
    if op == "like":
        return F.col(args[0]).like(args[1])
    if not isinstance(args[0], str):
        op, args = FLIPPED[op], args[::-1]
    return _OPS[op](F.col(args[0]), F.lit(args[1]))
