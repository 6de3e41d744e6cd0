"""Value semantics that differ from Spark's own and that every operator and expression shares."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SemanticError(ValueError):
    """A statement that cannot be given a meaning: unknown names, wrong kinds, wrong arity."""


@dataclass(frozen=True)
class Typed:
    """A column with the kind of its values, as far as it is known; ``literal`` holds a constant's value."""

    col: Column
    kind: str = "any"
    element: str = "any"
    literal: object = None
    is_literal: bool = False
    #: compile-time facts about graph values: alias, edge types, tag names
    info: object = None


def kind_of(t: T.DataType) -> tuple[str, str]:
    """Kind and element kind of a Spark type."""
    if isinstance(t, T.ArrayType):
        return "list", kind_of(t.elementType)[0]
    if isinstance(t, T.MapType):
        return "map", kind_of(t.valueType)[0]
    if isinstance(t, T.StructType):
        names = set(t.fieldNames())
        if {"_nodes", "_rels"} <= names:
            return "path", "any"
        if {"_type", "_src", "_dst", "_rank"} <= names:
            return "edge", "any"
        if {"_vid"} <= names:
            return "vertex", "any"
        if {"months", "seconds", "micros"} == names:
            return "duration", "any"
        return "map", "any"
    for cls, kind in (
        (T.BooleanType, "bool"), (T.IntegralType, "int"), (T.FractionalType, "float"), (T.StringType, "string"), (T.DateType, "date"),
        (T.TimestampNTZType, "datetime"), (T.TimestampType, "datetime"), (T.NullType, "null"),
    ):
        if isinstance(t, cls):
            return kind, "any"
    if type(t).__name__ == "TimeType":
        return "time", "any"
    return "any", "any"


def lit(value: object) -> Typed:
    """A constant."""
    if value is None:
        return Typed(F.lit(None), "null", literal=None, is_literal=True)
    if isinstance(value, bool):
        return Typed(F.lit(value), "bool", literal=value, is_literal=True)
    if isinstance(value, int):
        if not -(1 << 63) <= value < 1 << 63:
            raise SemanticError(f"integer out of range: {value}")
        return Typed(F.lit(value).cast("long"), "int", literal=value, is_literal=True)
    if isinstance(value, float):
        return Typed(F.lit(value), "float", literal=value, is_literal=True)
    if isinstance(value, str):
        return Typed(F.lit(value), "string", literal=value, is_literal=True)
    if isinstance(value, (list, tuple, set)):
        items = [lit(v) for v in value]
        return Typed(F.array(*(i.col for i in items)) if items else F.array().cast("array<string>"), "list", items[0].kind if items else "any", literal=value, is_literal=True)
    if isinstance(value, dict):
        pairs = [c for k, v in value.items() for c in (F.lit(k), lit(v).col)]
        return Typed(F.create_map(*pairs), "map", literal=value, is_literal=True)
    return Typed(F.lit(value), kind_of_value(value), literal=value, is_literal=True)


def kind_of_value(value: object) -> str:
    """Kind of a Python constant."""
    import datetime

    if isinstance(value, datetime.datetime):
        return "datetime"
    if isinstance(value, datetime.date):
        return "date"
    if isinstance(value, datetime.time):
        return "time"
    return "any"


def text_of(x: Typed) -> Column:
    """Text of a scalar; floats always show a decimal point or exponent, times nine digits of a second."""
    if x.kind == "float":
        s = x.col.cast("double").cast("string")
        return s
    if x.kind == "list":
        return F.concat(F.lit("["), F.array_join(x.col.cast("array<string>"), ", "), F.lit("]"))
    if x.kind == "time":
        s = x.col.cast("string")
        return F.rpad(F.when(F.instr(s, ".") > 0, s).otherwise(F.concat(s, F.lit("."))), 18, "0")
    if x.kind == "datetime":
        return F.date_format(x.col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'000'")
    return x.col.cast("string")


def null_safe(keys: list[tuple[Column, Column]]) -> Column:
    """Equality of all key pairs in which null equals null."""
    out = None
    for a, b in keys:
        c = a.eqNullSafe(b)
        out = c if out is None else out & c
    return out if out is not None else F.lit(True)


def ordering(col: Column, descending: bool = False) -> Column:
    """Total order: null is the largest value."""
    return col.desc_nulls_first() if descending else col.asc_nulls_last()


def is_true(col: Column) -> Column:
    """Filters keep a row only if the condition is true."""
    return F.coalesce(col.cast("boolean"), F.lit(False))


def same_names(a: DataFrame, b: DataFrame) -> None:
    """Set operations need the same names in the same order."""
    if len(a.columns) != len(b.columns):
        raise SemanticError("both sides of a set operation need the same number of columns")
    if a.columns != b.columns:
        raise SemanticError(f"both sides of a set operation need the same column names: {a.columns} and {b.columns}")


# -- arithmetic ----------------------------------------------------------------
def _numeric(a: Typed, b: Typed) -> str:
    return "float" if "float" in (a.kind, b.kind) else "int" if a.kind == b.kind == "int" else "any"


def divide(a: Typed, b: Typed) -> Typed:
    """Integers truncate towards zero and give null over zero; floats give infinities or NaN."""
    if a.kind == b.kind == "int":
        x, y = a.col.cast("long"), b.col.cast("long")
        overflow = (x == F.lit(-(1 << 63)).cast("long")) & (y == -1)
        q = F.when((y == 0) | overflow, F.lit(None)).otherwise(F.call_function("div", x, F.when(y == 0, F.lit(1).cast("long")).otherwise(y)))
        return Typed(q.cast("long"), "int")
    x, y = a.col.cast("double"), b.col.cast("double")
    inf = F.lit(float("inf"))
    special = F.when(F.isnan(x) | (x == 0), F.lit(float("nan"))).when(x > 0, inf).otherwise(-inf)
    return Typed(F.when(y == 0, special).otherwise(F.try_divide(x, F.when(y == 0, F.lit(1.0)).otherwise(y))), "float")


def remainder(a: Typed, b: Typed) -> Typed:
    """Remainder with the sign of the dividend; null over integer zero."""
    if a.kind == b.kind == "int":
        y = b.col.cast("long")
        return Typed(F.when(y != 0, a.col.cast("long") % F.when(y == 0, F.lit(1).cast("long")).otherwise(y)), "int")
    y = b.col.cast("double")
    return Typed(F.when(y == 0, F.lit(float("nan"))).otherwise(a.col.cast("double") % F.when(y == 0, F.lit(1.0)).otherwise(y)), "float")


def add(a: Typed, b: Typed) -> Typed:
    """Numbers add (null on overflow), text concatenates, lists append, dates and times move by durations."""
    kinds = {a.kind, b.kind}
    if "duration" in kinds and kinds & {"date", "datetime", "time"}:
        when, by = (a, b) if b.kind == "duration" else (b, a)
        return shift(when, by, 1)
    if a.kind == b.kind == "duration":
        return Typed(F.struct(*((a.col[k] + b.col[k]).alias(k) for k in ("months", "seconds", "micros"))), "duration")
    if a.kind == "date" and b.kind == "int":
        return Typed(F.date_add(a.col, b.col.cast("int")), "date")
    if "list" in kinds:
        if a.kind == b.kind == "list":
            return Typed(F.concat(a.col, b.col), "list", a.element if a.element != "any" else b.element)
        if a.kind == "list":
            return Typed(F.when(a.col.isNotNull(), F.concat(a.col, F.array(b.col))), "list", a.element)
        return Typed(F.when(b.col.isNotNull(), F.concat(F.array(a.col), b.col)), "list", b.element)
    if "string" in kinds:
        return Typed(F.concat(text_of(a), text_of(b)), "string")
    return Typed(F.try_add(*_wide(a, b)), _numeric(a, b))


def subtract(a: Typed, b: Typed) -> Typed:
    """Numbers subtract (null on overflow); dates and times move back by durations."""
    if b.kind == "duration" and a.kind in ("date", "datetime", "time"):
        return shift(a, b, -1)
    if a.kind == b.kind == "date":
        return Typed(F.datediff(a.col, b.col).cast("long"), "int")
    if a.kind == "date" and b.kind == "int":
        return Typed(F.date_sub(a.col, b.col.cast("int")), "date")
    return Typed(F.try_subtract(*_wide(a, b)), _numeric(a, b))


def multiply(a: Typed, b: Typed) -> Typed:
    """Product, null on overflow."""
    return Typed(F.try_multiply(*_wide(a, b)), _numeric(a, b))


def _wide(a: Typed, b: Typed) -> tuple[Column, Column]:
    to = {"int": "long", "float": "double"}.get(_numeric(a, b))
    return (a.col.cast(to), b.col.cast(to)) if to else (a.col, b.col)


def shift(when: Typed, by: Typed, sign: int) -> Typed:
    """A date or time moved by a duration."""
    months, seconds, micros = (by.col[k] * sign for k in ("months", "seconds", "micros"))
    if when.kind == "date":
        return Typed(F.date_add(F.add_months(when.col, months.cast("int")), F.floor(seconds / 86400).cast("int")), "date")
    if when.kind == "datetime":
        step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (seconds + micros / 1e6).cast("decimal(18,6)"))
        return Typed(when.col + F.make_ym_interval(F.lit(0), months.cast("int")) + step, "datetime")
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.pmod(seconds, F.lit(86400)) + micros / 1e6).cast("decimal(18,6)"))
    return Typed(when.col + step, "time")
