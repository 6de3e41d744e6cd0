"""Scalar functions by name, built from Spark's own functions.

A null argument gives null and a value of the wrong kind gives null, unless a function says otherwise. Names are looked up
without regard to case.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.values import SemanticError, Typed, text_of


@dataclass(frozen=True)
class Function:
    """A function with its arity (``None``: any number of arguments) and the builder of its column."""

    name: str
    least: int
    most: int | None
    build: Callable[[list[Typed]], Typed]
    pure: bool = True


REGISTRY: dict[str, Function] = {}
ALIASES = {"tolower": "lower", "toupper": "upper", "substring": "substr", "labels": "tags"}


def define(name: str, least: int, most: int | None = -1, pure: bool = True):
    """Register a builder; ``most`` left out means exactly ``least`` arguments."""

    def wrap(build):
        REGISTRY[name] = Function(name, least, least if most == -1 else most, build, pure)
        return build

    return wrap


def call(name: str, args: list[Typed]) -> Typed:
    """Apply a function by name."""
    key = ALIASES.get(name.lower(), name.lower())
    f = REGISTRY.get(key)
    if f is None:
        raise SemanticError(f"unknown function: {name}")
    if len(args) < f.least or (f.most is not None and len(args) > f.most):
        raise SemanticError(f"wrong number of arguments for {name}: {len(args)}")
    return f.build(args)


def _null(kind: str = "null") -> Typed:
    return Typed(F.lit(None).cast({"int": "long", "float": "double", "string": "string", "bool": "boolean"}.get(kind, "void")), kind)


def _num(f: Callable[[Column], Column], kind: str = "float"):
    def build(a: list[Typed]) -> Typed:
        if a[0].kind not in ("int", "float", "any", "null"):
            return _null(kind)
        return Typed(f(a[0].col.cast("double")), kind)

    return build


def _simple() -> None:
    number = {
        "floor": lambda x: F.floor(x).cast("double"), "ceil": lambda x: F.ceil(x).cast("double"), "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)), "cbrt": F.cbrt,
        "exp": F.exp, "exp2": lambda x: F.pow(F.lit(2.0), x), "log": lambda x: F.when(x > 0, F.ln(x)), "log2": lambda x: F.when(x > 0, F.log2(x)), "log10": lambda x: F.when(x > 0, F.log10(x)),
        "radians": F.radians, "sin": F.sin, "asin": lambda x: F.when(F.abs(x) <= 1, F.asin(x)), "cos": F.cos, "acos": lambda x: F.when(F.abs(x) <= 1, F.acos(x)), "tan": F.tan, "atan": F.atan,
    }
    for name, f in number.items():
        define(name, 1)(_num(f))
    define("sign", 1)(_num(lambda x: F.signum(x).cast("long"), "int"))
    for name, op in (("bit_and", Column.bitwiseAND), ("bit_or", Column.bitwiseOR), ("bit_xor", Column.bitwiseXOR)):
        define(name, 2)(lambda a, op=op: Typed(op(a[0].col.cast("long"), a[1].col.cast("long")), "int") if a[0].kind in ("int", "any", "null") and a[1].kind in ("int", "any", "null") else _null("int"))
    for name, f in (("pow", F.pow), ("hypot", F.hypot)):
        define(name, 2)(lambda a, f=f, name=name: Typed(f(a[0].col.cast("double"), a[1].col.cast("double")).cast("long" if name == "pow" and a[0].kind == a[1].kind == "int" else "double"), "int" if name == "pow" and a[0].kind == a[1].kind == "int" else "float"))
    define("e", 0)(lambda a: Typed(F.e(), "float"))
    define("pi", 0)(lambda a: Typed(F.pi(), "float"))
    define("rand", 0, pure=False)(lambda a: Typed(F.rand(), "float"))
    define("now", 0, pure=False)(lambda a: Typed(F.unix_timestamp(), "int"))
    for name, f in (("lower", F.lower), ("upper", F.upper), ("trim", F.trim), ("ltrim", F.ltrim), ("rtrim", F.rtrim)):
        define(name, 1)(lambda a, f=f: Typed(f(a[0].col), "string") if a[0].kind in ("string", "any", "null") else _null("string"))
    define("md5", 1)(lambda a: Typed(F.md5(a[0].col.cast("binary")), "string"))
    define("hash", 1)(lambda a: Typed(F.xxhash64(a[0].col), "int"))
    define("score", 0)(lambda a: Typed(F.col("score"), "float"))
    define("uuid", 0, pure=False)(lambda a: Typed(F.uuid(), "string"))


_simple()


@define("abs", 1)
def _abs(a):
    if a[0].kind == "int":
        return Typed(F.when(a[0].col >= 0, a[0].col.cast("long")).otherwise(F.try_subtract(F.lit(0).cast("long"), a[0].col.cast("long"))), "int")
    return Typed(F.abs(a[0].col.cast("double")), "float") if a[0].kind in ("float", "any", "null") else _null("float")


@define("round", 1, 3)
def _round(a):
    x, digits = a[0].col.cast("double"), a[1].col if len(a) > 1 else F.lit(0)
    mode = (a[2].literal if len(a) > 2 else "half_up") or ""
    if len(a) > 2 and not a[2].is_literal:
        raise SemanticError("the rounding mode must be a constant")
    mode = str(mode).lower()
    # decimal text keeps 1.25 what it was written as; scaling in binary would not
    d = x.cast("decimal(38,18)")
    scale = F.pow(F.lit(10.0), digits.cast("double")).cast("decimal(38,18)")
    n = int(a[1].literal) if len(a) > 1 and a[1].is_literal and a[1].literal is not None else 0 if len(a) < 2 else None
    y = F.abs(d) * F.lit(10**n).cast("decimal(20,0)") if n is not None and n >= 0 else (F.abs(d) * scale)
    y = y.cast("decimal(38,12)")
    low, sign = F.floor(y).cast("decimal(38,12)"), F.signum(x)
    rest = y - low
    up = rest > 0
    half = F.lit("0.5").cast("decimal(38,12)")
    rules = {
        "up": up, "down": F.lit(False), "ceiling": up & (sign > 0), "floor": up & (sign < 0), "half_up": rest >= half, "half_down": rest > half,
        "half_even": (rest > half) | ((rest == half) & (low.cast("long") % 2 == 1)),
    }
    if mode not in rules:
        return _null("float")
    whole = low.cast("double") + rules[mode].cast("double")
    return Typed(sign * whole / F.pow(F.lit(10.0), digits.cast("double")), "float")


def _random(bits: int):
    top = float(2**bits)

    def build(a):
        if not a:
            return Typed(F.floor(F.rand() * top - (top / 2 if bits == 64 else 0)).cast("long"), "int")
        low, high = (F.lit(0).cast("long"), a[0].col) if len(a) == 1 else (a[0].col, a[1].col)
        return Typed(F.when(high > low, low + F.floor(F.rand() * (high - low))).cast("long"), "int")

    return build


define("rand32", 0, 2, pure=False)(_random(32))
define("rand64", 0, 2, pure=False)(_random(64))


@define("strcasecmp", 2)
def _strcasecmp(a):
    x, y = F.lower(a[0].col), F.lower(a[1].col)
    return Typed(F.when(x == y, 0).when(x < y, -1).when(x > y, 1).cast("long"), "int")


@define("length", 1)
def _length(a):
    if a[0].kind == "path":
        return Typed(F.size(a[0].col["_rels"]).cast("long"), "int")
    return Typed(F.octet_length(a[0].col).cast("long"), "int") if a[0].kind in ("string", "any", "null") else _null("int")


@define("size", 1)
def _size(a):
    x = a[0]
    if x.kind in ("string", "any"):
        return Typed(F.octet_length(x.col).cast("long"), "int")
    if x.kind in ("list", "map"):
        return Typed(F.when(x.col.isNotNull(), F.size(x.col)).cast("long"), "int")
    return _null("int")


@define("left", 2)
def _left(a):
    return Typed(F.when(a[1].col >= 0, F.substring(a[0].col, F.lit(1), a[1].col.cast("int"))), "string")


@define("right", 2)
def _right(a):
    n = F.least(a[1].col.cast("int"), F.length(a[0].col))
    return Typed(F.when((a[1].col >= 0) & a[0].col.isNotNull(), F.when(n == 0, F.lit("")).otherwise(F.substring(a[0].col, F.length(a[0].col) - n + 1, n))), "string")


@define("substr", 2, 3)
def _substr(a):
    s, start = a[0].col, a[1].col.cast("int")
    size = a[2].col.cast("int") if len(a) > 2 else F.length(s)
    return Typed(F.when((start >= 0) & (size >= 0), F.when(start >= F.length(s), F.lit("")).otherwise(F.substring(s, start + 1, size))), "string")


@define("replace", 3)
def _replace(a):
    if a[0].kind == "list":
        return Typed(F.transform(a[0].col, lambda x: F.when(x.eqNullSafe(a[1].col), a[2].col).otherwise(x)), "list", a[0].element)
    return Typed(F.replace(a[0].col, a[1].col, a[2].col), "string")


define("erase", 2)(lambda a: Typed(F.array_remove(a[0].col, a[1].col), "list", a[0].element))
define("setadd", 2)(lambda a: Typed(F.array_union(a[0].col, F.array(a[1].col)), "list", a[0].element))
define("reverse", 1)(lambda a: Typed(F.reverse(a[0].col), a[0].kind if a[0].kind == "list" else "string", a[0].element))
define("toset", 1)(lambda a: Typed(F.array_distinct(a[0].col), "list", a[0].element))


@define("split", 2)
def _split(a):
    if a[1].is_literal and isinstance(a[1].literal, str):
        return Typed(F.split(a[0].col, re.escape(a[1].literal)), "list", "string")
    return Typed(F.split(a[0].col, F.concat(F.lit("\\Q"), a[1].col, F.lit("\\E"))), "list", "string")


define("tostring", 1)(lambda a: Typed(text_of(a[0]), "string") if a[0].kind not in ("map", "vertex", "edge", "path") else _null("string"))


@define("toboolean", 1)
def _toboolean(a):
    if a[0].kind == "bool":
        return a[0]
    s = F.lower(a[0].col.cast("string"))
    return Typed(F.when(s == "true", True).when(s == "false", False), "bool") if a[0].kind in ("string", "any") else _null("bool")


define("tofloat", 1)(lambda a: Typed(a[0].col.cast("double") if a[0].kind in ("int", "float") else a[0].col.try_cast("double"), "float") if a[0].kind in ("int", "float", "string", "any") else _null("float"))


@define("tointeger", 1)
def _tointeger(a):
    if a[0].kind == "int":
        return a[0]
    if a[0].kind not in ("float", "string", "any"):
        return _null("int")
    d = a[0].col.try_cast("double")
    big = F.when(d >= 9.2e18, F.lit((1 << 63) - 1)).when(d <= -9.2e18, F.lit(-(1 << 63)).cast("long")).otherwise(d.try_cast("long"))
    return Typed(big.cast("long") if a[0].kind == "float" else F.coalesce(a[0].col.try_cast("long"), big.cast("long")), "int")


def _pad(f, left: bool):
    def build(a):
        n = a[1].col.cast("int")
        return Typed(F.when(n <= 0, F.when(a[0].col.isNotNull() & a[2].col.isNotNull(), F.lit(""))).otherwise(F.call_function(f, a[0].col, n, a[2].col)), "string")

    return build


define("lpad", 3)(_pad("lpad", True))
define("rpad", 3)(_pad("rpad", False))


@define("udf_is_in", 2, None)
def _is_in(a):
    return Typed(a[0].col.isin(*(x.col for x in a[1:])), "bool")


@define("cos_similarity", 2, None)
def _cosine(a):
    if len(a) % 2:
        return Typed(F.lit(-2.0), "float")
    half = len(a) // 2
    xs, ys = [x.col.cast("double") for x in a[:half]], [y.col.cast("double") for y in a[half:]]
    dot = sum((x * y for x, y in zip(xs, ys, strict=True)), F.lit(0.0))
    xx, yy = sum((x * x for x in xs), F.lit(0.0)), sum((y * y for y in ys), F.lit(0.0))
    return Typed(F.when((xx == 0) | (yy == 0), F.lit(-2.0)).otherwise(dot / (F.sqrt(xx) * F.sqrt(yy))), "float")


def cosine_of_arrays(x: Column, y: Column) -> Column:
    """Cosine of two array columns of equal length, -2 where one of them is zero; runs inside generated code."""
    def dot(p, q):
        return F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)

    xx, yy = dot(x, x), dot(y, y)
    return F.when((xx == 0) | (yy == 0), F.lit(-2.0)).otherwise(dot(x, y) / (F.sqrt(xx) * F.sqrt(yy)))


@define("range", 2, 3)
def _range(a):
    low, high = a[0].col.cast("long"), a[1].col.cast("long")
    step = a[2].col.cast("long") if len(a) > 2 else F.lit(1).cast("long")
    ok = ((step > 0) & (low <= high)) | ((step < 0) & (low >= high))
    got = F.when(ok, F.sequence(F.when(ok, low).otherwise(F.lit(0).cast("long")), F.when(ok, high).otherwise(F.lit(0).cast("long")), F.when(ok, step).otherwise(F.lit(1).cast("long"))))
    return Typed(F.when(step != 0, F.coalesce(got, F.array().cast("array<bigint>"))), "list", "int")


define("head", 1)(lambda a: Typed(F.get(a[0].col, F.lit(0)), a[0].element))
define("last", 1)(lambda a: Typed(F.try_element_at(a[0].col, F.lit(-1)), a[0].element))
define("tail", 1)(lambda a: Typed(F.when(F.size(a[0].col) > 1, F.slice(a[0].col, F.lit(2), F.greatest(F.size(a[0].col) - 1, F.lit(0)))).when(a[0].col.isNotNull(), F.slice(a[0].col, 1, 0)), "list", a[0].element))
define("coalesce", 1, None)(lambda a: Typed(F.coalesce(*(x.col for x in a)), next((x.kind for x in a if x.kind not in ("null", "any")), "any")))
define("_any", 1, None)(lambda a: REGISTRY["coalesce"].build(a))
define("extract", 2)(lambda a: Typed(F.regexp_extract_all(a[0].col, a[1].col, F.lit(0)), "list", "string"))
define("concat", 1, None)(lambda a: Typed(F.concat(*(text_of(x) for x in a)), "string"))
define("concat_ws", 2, None)(lambda a: Typed(F.when(a[0].col.isNotNull(), F.call_function("concat_ws", a[0].col, *(text_of(x) for x in a[1:]))), "string"))
define("json_extract", 1)(lambda a: Typed(F.when(F.trim(a[0].col).startswith("{"), F.from_json(a[0].col, "map<string,string>")), "map", "string"))


# -- dates and times -----------------------------------------------------------
def _parts(x: Typed, names: tuple[str, ...], defaults: tuple[int, ...]) -> list[Column]:
    if not isinstance(x.literal, dict):
        raise SemanticError("parts of a date or time must be a constant map")
    unknown = set(x.literal) - set(names) - {"millisecond", "microsecond"}
    if unknown:
        raise SemanticError(f"unknown parts: {sorted(unknown)}")
    return [F.lit(x.literal.get(n, d)) for n, d in zip(names, defaults, strict=True)]


def _second(x: Typed) -> Column:
    m = x.literal
    return F.lit(m.get("second", 0) + m.get("millisecond", 0) / 1e3 + m.get("microsecond", 0) / 1e6).cast("decimal(16,6)")


@define("date", 0, 1, pure=False)
def _date(a):
    if not a:
        return Typed(F.current_date(), "date")
    if a[0].kind == "map":
        return Typed(F.make_date(*_parts(a[0], ("year", "month", "day"), (1970, 1, 1))), "date")
    return Typed(a[0].col.try_cast("date"), "date")


@define("time", 0, 1, pure=False)
def _time(a):
    if not a:
        return Typed(F.current_timestamp().cast("timestamp_ntz").cast("string").substr(12, 15).try_cast("time(6)"), "time")
    if a[0].kind == "map":
        h, m = _parts(a[0], ("hour", "minute"), (0, 0)) if set(a[0].literal) <= {"hour", "minute"} else [F.lit(a[0].literal.get(k, 0)) for k in ("hour", "minute")]
        return Typed(F.make_time(h, m, _second(a[0])), "time")
    return Typed(a[0].col.try_cast("time(6)"), "time")


@define("datetime", 0, 1, pure=False)
def _datetime(a):
    if not a:
        return Typed(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz"), "datetime")
    if a[0].kind == "map":
        m = a[0].literal
        part = [F.lit(m.get(k, d)) for k, d in (("year", 1970), ("month", 1), ("day", 1), ("hour", 0), ("minute", 0))]
        return Typed(F.make_timestamp_ntz(*part, _second(a[0])), "datetime")
    if a[0].kind == "int":
        return Typed(F.timestamp_seconds(a[0].col).cast("timestamp_ntz"), "datetime")
    return Typed(a[0].col.try_cast("timestamp_ntz"), "datetime")


@define("timestamp", 0, 1, pure=False)
def _timestamp(a):
    if not a:
        return Typed(F.unix_timestamp(), "int")
    if a[0].kind == "int":
        return Typed(F.when(a[0].col >= 0, a[0].col), "int")
    return Typed(F.unix_timestamp(a[0].col.try_cast("timestamp_ntz").cast("timestamp")), "int")


@define("duration", 1)
def _duration(a):
    m = a[0].literal
    if not isinstance(m, dict):
        raise SemanticError("a duration needs a constant map")
    months = m.get("years", 0) * 12 + m.get("quarters", 0) * 3 + m.get("months", 0)
    seconds = m.get("weeks", 0) * 604800 + m.get("days", 0) * 86400 + m.get("hours", 0) * 3600 + m.get("minutes", 0) * 60 + m.get("seconds", 0)
    micros = m.get("milliseconds", 0) * 1000 + m.get("microseconds", 0)
    known = {"years", "quarters", "months", "weeks", "days", "hours", "minutes", "seconds", "milliseconds", "microseconds"}
    if set(m) - known:
        raise SemanticError(f"unknown parts of a duration: {sorted(set(m) - known)}")
    return Typed(F.struct(F.lit(months).cast("long").alias("months"), F.lit(seconds).cast("long").alias("seconds"), F.lit(micros).cast("long").alias("micros")), "duration")


# -- graph values ----------------------------------------------------------------
def _edge(a: Typed, field: str, kind: str) -> Typed:
    if a.kind == "list" and a.element == "edge":
        return Typed(F.transform(a.col, lambda e: e[field]), "list", kind)
    return Typed(a.col[field], kind) if a.kind == "edge" else _null(kind)


define("id", 1)(lambda a: Typed(a[0].col["_vid"], "any") if a[0].kind == "vertex" else _null("string"))
define("_joinkey", 1)(lambda a: Typed(a[0].col["_vid"]) if a[0].kind == "vertex" else Typed(F.struct(*(a[0].col[k] for k in ("_type", "_src", "_dst", "_rank")))) if a[0].kind == "edge" else Typed(F.get(a[0].col, F.lit(0))) if a[0].kind == "list" else a[0])
define("tags", 1)(lambda a: Typed(F.map_keys(a[0].col["_tags"]), "list", "string"))
define("properties", 1)(lambda a: Typed(F.aggregate(F.map_values(a[0].col["_tags"]), F.create_map().cast("map<string,string>"), lambda s, m: F.map_concat(F.map_filter(s, lambda k, v: ~F.map_contains_key(m, k)), m)), "map", "string", info=a[0].info) if a[0].kind == "vertex" else Typed(a[0].col["_props"], "map", "string") if a[0].kind == "edge" else a[0])
define("type", 1)(lambda a: _edge(a[0], "_type", "string"))
define("typeid", 1)(lambda a: Typed(F.abs(F.crc32(a[0].col["_type"])), "int"))
define("src", 1)(lambda a: _edge(a[0], "_src", "any"))
define("dst", 1)(lambda a: _edge(a[0], "_dst", "any"))
define("rank", 1)(lambda a: _edge(a[0], "_rank", "int"))
define("none_direct_src", 1, 2)(lambda a: Typed(F.when(a[0].col["_dir"] > 0, a[0].col["_src"]).otherwise(a[0].col["_dst"])))
define("none_direct_dst", 1, 2)(lambda a: Typed(F.when(a[0].col["_dir"] > 0, a[0].col["_dst"]).otherwise(a[0].col["_src"])))
define("nodes", 1)(lambda a: Typed(a[0].col["_nodes"], "list", "vertex"))
define("relationships", 1)(lambda a: Typed(a[0].col["_rels"], "list", "edge"))
define("startnode", 1)(lambda a: Typed(F.get(a[0].col["_nodes"], F.lit(0)), "vertex") if a[0].kind == "path" else Typed(F.struct(a[0].col["_src"].alias("_vid")), "vertex"))
define("endnode", 1)(lambda a: Typed(F.element_at(a[0].col["_nodes"], -1), "vertex") if a[0].kind == "path" else Typed(F.struct(a[0].col["_dst"].alias("_vid")), "vertex"))
define("hassameedgeinpath", 1)(lambda a: Typed(F.size(F.array_distinct(F.transform(a[0].col["_rels"], lambda e: F.struct(e["_type"], e["_src"], e["_dst"], e["_rank"])))) < F.size(a[0].col["_rels"]), "bool"))
define("hassamevertexinpath", 1)(lambda a: Typed(F.size(F.array_distinct(F.transform(a[0].col["_nodes"], lambda v: v["_vid"]))) < F.size(a[0].col["_nodes"]), "bool"))
define("reversepath", 1)(lambda a: Typed(F.struct(F.reverse(a[0].col["_nodes"]).alias("_nodes"), F.reverse(a[0].col["_rels"]).alias("_rels")), "path"))
define("_nodeid", 2)(lambda a: Typed(F.get(a[0].col["_nodes"], a[1].col.cast("int"))["_vid"]))
define("_edge", 2)(lambda a: Typed(F.get(a[0].col["_rels"], a[1].col.cast("int")), "edge"))
define("is_edge", 1)(lambda a: Typed(F.lit(a[0].kind == "edge"), "bool"))
define("datasetrowcol", 3)(lambda a: Typed(F.get(a[0].col, a[1].col.cast("int"))[a[2].literal]))


@define("keys", 1)
def _keys(a):
    x = a[0]
    if x.kind == "vertex":
        return Typed(F.sort_array(F.array_distinct(F.flatten(F.transform(F.map_values(x.col["_tags"]), F.map_keys)))), "list", "string")
    if x.kind == "edge":
        return Typed(F.sort_array(F.map_keys(x.col["_props"])), "list", "string")
    return Typed(F.sort_array(F.map_keys(x.col)), "list", "string")
