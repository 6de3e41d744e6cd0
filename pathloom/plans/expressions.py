"""Compile expression trees to Spark columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom import values as V
from pathloom import functions as _functions  # noqa: F401  registers all functions
from pathloom.functions.scalar import call
from pathloom.operators.aggregate import AGGREGATES, aggregate_column
from pathloom.plans.ast import Expr
from pathloom.values import SemanticError, Typed

_PARTS = {"year": F.year, "month": F.month, "day": F.day, "hour": F.hour, "minute": F.minute, "second": F.second}


@dataclass
class Scope:
    """What names mean: columns in reach, special forms of a statement, parameters."""

    names: dict[str, Typed] = field(default_factory=dict)
    special: Callable[[Expr], Typed | None] = lambda e: None
    parameters: dict[str, object] = field(default_factory=dict)

    def inner(self, **more: Typed) -> Scope:
        return Scope({**self.names, **more}, self.special, self.parameters)


def is_aggregate(e: Expr) -> bool:
    """Whether an aggregate is called anywhere in an expression."""
    return any(_aggregates(x) for x in e.walk())


def _aggregates(e: Expr) -> bool:
    # bit_and and the like are aggregates of one argument and plain functions of two
    return e.op == "call" and e.args[0].lower() in AGGREGATES and len(e.args[1]) == 1


def constant(e: Expr, parameters: dict[str, object] | None = None) -> object:
    """The value of an expression of constants and parameters."""
    if e.op == "lit":
        return e.args[0]
    if e.op == "parameter":
        if e.args[0] not in (parameters or {}):
            raise SemanticError(f"parameter ${e.args[0]} is not given")
        return parameters[e.args[0]]
    if e.op in ("list", "setof"):
        return [constant(x, parameters) for x in e.args]
    if e.op == "map":
        return {k: constant(x, parameters) for k, x in e.args}
    if e.op == "neg":
        return -constant(e.args[0], parameters)
    if e.op in ("+", "-", "*", "/", "%"):
        a, b = (constant(x, parameters) for x in e.args)
        if e.op in ("/", "%") and isinstance(a, int) and isinstance(b, int):
            if b == 0:
                return None
            q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
            return q if e.op == "/" else a - q * b
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b}[e.op]()
    raise SemanticError("a constant is needed here")


def compile_expr(e: Expr, scope: Scope) -> Typed:
    """The typed column of an expression."""
    got = scope.special(e)
    if got is not None:
        return got
    rule = globals().get(f"_c_{e.op}")
    if rule is not None:
        return rule(e, scope)
    if e.op in _BINARY:
        a, b = (compile_expr(x, scope) for x in e.args)
        return _BINARY[e.op](a, b)
    raise SemanticError(f"this has no meaning here: {e.op}")


def _c_lit(e, s):
    return V.lit(e.args[0])


def _c_parameter(e, s):
    return V.lit(constant(e, s.parameters))


def _c_name(e, s):
    name = e.args[0]
    if name in s.names:
        return s.names[name]
    raise SemanticError(f"unknown name: {name}")


def _c_neg(e, s):
    a = compile_expr(e.args[0], s)
    return Typed(F.try_subtract(F.lit(0).cast("long"), a.col.cast("long")) if a.kind == "int" else -a.col, a.kind)


def _c_not(e, s):
    return Typed(~compile_expr(e.args[0], s).col.cast("boolean"), "bool")


def _c_is_null(e, s):
    return Typed(compile_expr(e.args[0], s).col.isNull(), "bool")


def _bool(x: Typed) -> Column:
    return F.size(x.col) > 0 if x.kind == "list" else x.col.cast("boolean")


def _c_and(e, s):
    a, b = (compile_expr(x, s) for x in e.args)
    return Typed(_bool(a) & _bool(b), "bool")


def _c_or(e, s):
    a, b = (compile_expr(x, s) for x in e.args)
    return Typed(_bool(a) | _bool(b), "bool")


def _c_xor(e, s):
    a, b = (compile_expr(x, s) for x in e.args)
    return Typed(_bool(a) != _bool(b), "bool")


_COMPARABLE = ({"int", "float"}, {"string"}, {"bool"}, {"date"}, {"time"}, {"datetime"}, {"list"}, {"map"}, {"vertex"}, {"edge"}, {"path"}, {"duration"})


def _alike(a: Typed, b: Typed) -> bool:
    return "any" in (a.kind, b.kind) or "null" in (a.kind, b.kind) or any(a.kind in g and b.kind in g for g in _COMPARABLE)


def _key(x: Typed) -> Column:
    if x.kind == "vertex":
        return x.col["_vid"]
    if x.kind == "edge":
        return F.struct(*(x.col[k].alias(k) for k in ("_type", "_src", "_dst", "_rank")))
    return x.col


def _equal(a: Typed, b: Typed) -> Typed:
    if not _alike(a, b):
        return Typed(F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False)), "bool")
    if "float" in (a.kind, b.kind):
        x, y = a.col.cast("double"), b.col.cast("double")
        return Typed((x == y) | (F.abs(x - y) < 1e-8), "bool")
    return Typed(_key(a) == _key(b), "bool")


def _compare(op):
    def build(a: Typed, b: Typed) -> Typed:
        if not _alike(a, b) or "duration" in (a.kind, b.kind):
            return Typed(F.lit(None).cast("boolean"), "bool")
        return Typed(op(a.col, b.col), "bool")

    return build


def _in(a: Typed, b: Typed) -> Typed:
    if b.kind == "map":
        return Typed(F.map_contains_key(b.col, a.col), "bool")
    if b.kind not in ("list", "any"):
        raise SemanticError("IN needs a list")
    if isinstance(b.literal, (list, tuple)) and len(b.literal) == 0:
        return Typed(F.when(a.col.isNotNull(), F.lit(False)), "bool")
    if isinstance(b.literal, (list, tuple)) and None not in b.literal and a.kind == b.element and a.kind in ("int", "string"):
        return Typed(a.col.isin(*b.literal), "bool")  # a form that scans understand
    return Typed(F.exists(b.col, lambda x: _equal(a, Typed(x, b.element)).col), "bool")


def _text(f):
    def build(a: Typed, b: Typed) -> Typed:
        ok = {"string", "any"}
        return Typed(f(a.col, b.col) if a.kind in ok and b.kind in ok else F.lit(None).cast("boolean"), "bool")

    return build


_BINARY = {
    "+": V.add, "-": V.subtract, "*": V.multiply, "/": V.divide, "%": V.remainder, "==": _equal, "!=": lambda a, b: Typed(~_equal(a, b).col, "bool"),
    "<": _compare(Column.__lt__), "<=": _compare(Column.__le__), ">": _compare(Column.__gt__), ">=": _compare(Column.__ge__), "in": _in,
    "contains": _text(lambda a, b: F.contains(a, b)), "starts": _text(lambda a, b: F.startswith(a, b)), "ends": _text(lambda a, b: F.endswith(a, b)),
    "=~": _text(lambda a, b: F.regexp_like(a, F.concat(F.lit("^(?:"), b, F.lit(")$")))),
}


def _c_cast(e, s):
    return call({"int": "tointeger", "float": "tofloat", "double": "tofloat", "string": "tostring", "bool": "toboolean"}[e.args[0]], [compile_expr(e.args[1], s)])


def _c_list(e, s):
    items = [compile_expr(x, s) for x in e.args]
    if not items:
        return V.lit([])
    kinds = {x.kind for x in items} - {"null"}
    if len(kinds) > 1 and kinds != {"int", "float"}:
        return Typed(F.array(*(V.text_of(x) for x in items)), "list", "string")
    out = F.array(*(x.col for x in items))
    kind = "float" if kinds == {"int", "float"} else next(iter(kinds), "any")
    if all(x.is_literal for x in items):
        return Typed(out, "list", kind, [x.literal for x in items], True)
    return Typed(out, "list", kind)


def _c_setof(e, s):
    x = _c_list(e, s)
    return Typed(F.array_distinct(x.col), "list", x.element)


def _c_map(e, s):
    items = [(k, compile_expr(x, s)) for k, x in e.args]
    kinds = {x.kind for _, x in items}
    one = len(kinds) == 1
    literal = {k: x.literal for k, x in items} if all(x.is_literal for _, x in items) else None
    if one:
        col = F.create_map(*(c for k, x in items for c in (F.lit(k), x.col)))
        return Typed(col, "map", next(iter(kinds)), literal, literal is not None)
    if not items:
        return Typed(F.create_map().cast("map<string,string>"), "map", "string", {}, True)
    return Typed(F.struct(*(x.col.alias(k) for k, x in items)), "map", "any", literal, literal is not None, info={k: x for k, x in items})


def _c_attr(e, s):
    base, name = e.args
    x = compile_expr(base, s)
    if x.kind in ("date", "time", "datetime") and name in (*_PARTS, "millisecond", "microsecond"):
        if name in _PARTS:
            return Typed(_PARTS[name](x.col).cast("long"), "int")
        micro = F.unix_micros(x.col.cast("timestamp")) % 1_000_000
        return Typed((micro if name == "microsecond" else (micro / 1000).cast("long")).cast("long"), "int")
    if isinstance(x.info, dict) and isinstance(x.info.get(name), Typed):
        return Typed(x.col[name], x.info[name].kind, x.info[name].element)
    if x.kind in ("map", "vertex") and isinstance(x.info, dict) and isinstance(x.info.get(name), T.DataType):
        # properties travel as text; one that has the same type under every tag is read as that type
        text = x.col[name] if x.kind == "map" else call("properties", [x]).col[name]
        return Typed(text.cast(x.info[name]), *V.kind_of(x.info[name]))
    if x.kind == "map" and isinstance(x.info, dict) and any(isinstance(t, T.DataType) for t in x.info.values()):
        return Typed(x.col[name], x.element)
    if x.kind == "map":
        return Typed(x.col[name], x.element) if not isinstance(x.info, dict) else Typed(F.lit(None), "null")
    if x.kind == "edge":
        return Typed(x.col[name], (x.info or {}).get(name, "any") if isinstance(x.info, dict) else "any")
    if x.kind == "vertex":
        return Typed(call("properties", [x]).col[name], "string")
    return Typed(x.col[name])


def _c_item(e, s):
    x, i = (compile_expr(a, s) for a in e.args)
    if x.kind in ("map", "vertex", "edge"):
        return _c_attr(Expr("attr", (e.args[0], constant(e.args[1], s.parameters))), s)
    n = i.col.cast("int")
    return Typed(F.get(x.col, F.when(n < 0, F.size(x.col) + n).otherwise(n)), x.element, info=x.info)


def _c_slice(e, s):
    x = compile_expr(e.args[0], s)
    size = F.size(x.col)

    def place(arg, default):
        if arg is None:
            return default
        n = compile_expr(arg, s).col.cast("int")
        return F.least(F.greatest(F.when(n < 0, size + n).otherwise(n), F.lit(0)), size)

    low, high = place(e.args[1], F.lit(0)), place(e.args[2], size)
    return Typed(F.when(low.isNull() | high.isNull(), F.lit(None)).otherwise(F.slice(x.col, low + 1, F.greatest(high - low, F.lit(0)))), "list", x.element)


def _c_case(e, s):
    base, arms, other = e.args
    out, kind = None, "null"
    b = compile_expr(base, s) if base is not None else None
    for c, v in arms:
        x, val = compile_expr(c, s), compile_expr(v, s)
        test = V.is_true(x.col) if b is None else (b.col.eqNullSafe(x.col) if _alike(b, x) else F.lit(False))
        out = F.when(test, val.col) if out is None else out.when(test, val.col)
        kind = val.kind if kind == "null" else kind if val.kind in (kind, "null") else "float" if {kind, val.kind} == {"int", "float"} else "any"
    if other is not None:
        val = compile_expr(other, s)
        out = out.otherwise(val.col)
        kind = val.kind if kind == "null" else kind if val.kind in (kind, "null") else "float" if {kind, val.kind} == {"int", "float"} else "any"
    return Typed(out, kind)


def _c_predicate(e, s):
    kind, var, source, cond = e.args
    x = compile_expr(source, s)

    def test(v):
        return compile_expr(cond, s.inner(**{var: Typed(v, x.element, info=x.info)})).col

    if kind == "all":
        return Typed(F.forall(x.col, test), "bool")
    if kind == "single":
        return Typed(F.size(F.filter(x.col, test)) == 1, "bool")
    found = F.exists(x.col, test)
    return Typed(found if kind == "any" else ~found, "bool")


def _c_comprehension(e, s):
    var, source, cond, out = e.args
    x = compile_expr(source, s)
    col, kind = x.col, x.element
    if cond is not None:
        col = F.filter(col, lambda v: V.is_true(compile_expr(cond, s.inner(**{var: Typed(v, x.element, info=x.info)})).col))
    if out is not None:
        seen = []

        def build(v):
            t = compile_expr(out, s.inner(**{var: Typed(v, x.element, info=x.info)}))
            seen.append(t.kind)
            return t.col

        col = F.transform(col, build)
        kind = seen[0] if seen else "any"
    return Typed(col, "list", kind)


def _c_reduce(e, s):
    acc, start, var, source, step = e.args
    first, x = compile_expr(start, s), compile_expr(source, s)
    kind = "float" if "float" in (first.kind, x.element) and first.kind in ("int", "float") else first.kind
    initial = first.col.cast("double") if kind == "float" else first.col
    cast = {"int": "long", "float": "double", "string": "string"}.get(kind)

    def build(a, v):
        c = compile_expr(step, s.inner(**{acc: Typed(a, kind), var: Typed(v, x.element, info=x.info)})).col
        return c.cast(cast) if cast else c

    return Typed(F.aggregate(x.col, initial, build), kind)


def _c_call(e, s):
    name, args, distinct = e.args
    if _aggregates(e):
        if args[0].op == "star":
            return Typed(F.count(F.lit(1)), "int")
        return aggregate_column(name, compile_expr(args[0], s), distinct)
    return call(name, [compile_expr(a, s) for a in args])
