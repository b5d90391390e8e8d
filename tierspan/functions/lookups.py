"""Lookups of the query builder: (column, value) -> boolean column, with built-in functions only.

Equality is null-safe (None equals None); a value of another type than the column never equals it. Ordering lookups drop rows whose
value is null. `regex` and `iregex` use Java's dialect, unanchored. String lookups are false for other types.
"""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def comparable(kind: T.DataType, value: Any) -> bool:
    """Whether a value can equal a column of this type; decided when the query is built, so no cast fails at run time."""
    if value is None:
        return True
    if isinstance(kind, T.StringType):
        return isinstance(value, str)
    if isinstance(kind, T.BooleanType):
        return isinstance(value, (bool, int))
    if isinstance(kind, _NUMBERS):
        return isinstance(value, (int, float, decimal.Decimal))
    if isinstance(kind, T.BinaryType):
        return isinstance(value, (bytes, bytearray))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return isinstance(value, (datetime.date, datetime.datetime))
    return True


def equals(c: Column, value: Any, kind: T.DataType) -> Column:
    return c.eqNullSafe(F.lit(value)) if comparable(kind, value) else F.lit(False)


def _ordered(test: Callable[[Column, Any], Column]):
    def lookup(c: Column, value: Any, kind: T.DataType) -> Column:
        if value is None or not comparable(kind, value):
            raise TypeError(f"{value!r} can't be ordered against {kind.simpleString()}")
        return test(c, value)

    return lookup


def _range(c: Column, value: Any, kind: T.DataType) -> Column:
    low, high = value
    return _ordered(lambda x, _: x.between(low, high))(c, low, kind)


def _in(c: Column, value: Any, kind: T.DataType) -> Column:
    if isinstance(value, str):  # the column's text is a part of the value
        return F.coalesce(F.contains(F.lit(value), c), F.lit(False)) if isinstance(kind, T.StringType) else F.lit(False)
    values = list(value)
    fit = [v for v in values if v is not None and comparable(kind, v)]
    found = c.isin(fit) if fit else F.lit(False)
    return found | c.isNull() if None in values else F.coalesce(found, F.lit(False))


def _text(test: Callable[[Column, str], Column]):
    def lookup(c: Column, value: Any, kind: T.DataType) -> Column:
        if not isinstance(kind, T.StringType) or not isinstance(value, str):
            return F.lit(False)
        return F.coalesce(test(c, value), F.lit(False))

    return lookup


def _length(test: Callable[[Column, int], Column]):
    def lookup(c: Column, value: Any, kind: T.DataType) -> Column:
        if isinstance(kind, T.ArrayType):
            return test(F.size(c), value)
        if not isinstance(kind, (T.StringType, T.BinaryType)):
            raise TypeError(f"{kind.simpleString()} has no length")
        return test(F.length(c), value)

    return lookup


def _no_len(c: Column, value: Any, kind: T.DataType) -> Column:
    raise TypeError("len needs a comparison: use len_eq, len_gt or len_lt")


LOOKUPS: dict[str, Callable[[Column, Any, T.DataType], Column]] = {
    "eq": equals,
    "exact": equals,
    "gt": _ordered(lambda c, v: c > v),
    "gte": _ordered(lambda c, v: c >= v),
    "lt": _ordered(lambda c, v: c < v),
    "lte": _ordered(lambda c, v: c <= v),
    "range": _range,
    "in": _in,
    "contains": _text(lambda c, v: F.contains(c, F.lit(v))),
    "icontains": _text(lambda c, v: F.contains(F.lower(c), F.lit(v.lower()))),
    "startswith": _text(lambda c, v: F.startswith(c, F.lit(v))),
    "istartswith": _text(lambda c, v: F.startswith(F.lower(c), F.lit(v.lower()))),
    "endswith": _text(lambda c, v: F.endswith(c, F.lit(v))),
    "iendswith": _text(lambda c, v: F.endswith(F.lower(c), F.lit(v.lower()))),
    "iexact": _text(lambda c, v: F.lower(c) == v.lower()),
    "regex": _text(lambda c, v: c.rlike(v)),
    "iregex": _text(lambda c, v: c.rlike(f"(?iu){v}")),
    "len": _no_len,
    "len_eq": _length(lambda c, v: c == v),
    "len_gt": _length(lambda c, v: c > v),
    "len_lt": _length(lambda c, v: c < v),
}
CARDINALITY = {"len_eq": lambda c, v: c == v, "len_gt": lambda c, v: c > v, "len_lt": lambda c, v: c < v}
ORDERED = {"gt", "gte", "lt", "lte", "range"}
