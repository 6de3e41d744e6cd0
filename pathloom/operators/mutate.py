"""Mutations: each gives a new space; the tables of the old one are untouched."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom import values as V
from pathloom.plans.ast import Expr
from pathloom.plans.expressions import Scope, compile_expr
from pathloom.sources.space import Schema, Space
from pathloom.values import SemanticError, Typed


def _last_wins(old: DataFrame, new: DataFrame, keys: list[str], keep_old: bool) -> DataFrame:
    """Old and new rows with one row for each key."""
    if keep_old:
        return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def _defaults(schema: Schema, given: list[str], df: DataFrame) -> dict[str, object]:
    out = {}
    for p in schema.properties:
        if p.name in given:
            continue
        if p.has_default:
            out[p.name] = F.lit(p.default)
        elif p.nullable:
            out[p.name] = F.lit(None)
        else:
            raise SemanticError(f"property {p.name} needs a value")
    return {k: v.cast(df.schema[k].dataType) for k, v in out.items()}


def _rows(session, heads_props: list[str], keys: list[str], rows: list[tuple], target: DataFrame, schema: Schema) -> DataFrame:
    scope = Scope(parameters=session.parameters)
    seen: dict[tuple, list] = {}
    for n, (key, vals) in enumerate(rows):
        if len(vals) != len(heads_props):
            raise SemanticError("the number of values differs from that of the properties")
        seen[tuple(repr(k) for k in key)] = [key, vals]  # a later row of the same key wins
    one, out = session.spark.range(1), None
    fill = _defaults(schema, heads_props, target)
    required = {p.name for p in schema.properties if not p.nullable}
    for key, vals in seen.values():
        cols = [compile_expr(k, scope).col.cast(target.schema[c].dataType).alias(c) for k, c in zip(key, keys, strict=True)]
        for name, v in zip(heads_props, vals, strict=True):
            x = compile_expr(v, scope)
            if name in required and x.is_literal and x.literal is None:
                raise SemanticError(f"property {name} must not be null")
            cols.append(x.col.cast(target.schema[name].dataType).alias(name))
        part = one.select(*cols, *(c.alias(n) for n, c in fill.items()))
        out = part if out is None else out.unionByName(part)
    return out.select(*target.columns)


def insert_vertices(session, s) -> Space:
    """INSERT VERTEX: an existing row of the tag is overwritten, or kept with IF NOT EXISTS."""
    space, at = session.space, 0
    for tag, props in s["heads"]:
        if tag not in space.tags:
            raise SemanticError(f"no tag named {tag}")
        schema = space.schemas[("tag", tag)]
        props = schema.names() if props is None else props
        for p in props:
            if p not in schema.names():
                raise SemanticError(f"tag {tag} has no property {p}")
        width = sum(len(space.schemas[("tag", t)].names() if q is None else q) for t, q in s["heads"])
        for _, vals in s["rows"]:
            if len(vals) != width:
                raise SemanticError("the number of values differs from that of the properties")
        rows = [(k, v[at : at + len(props)]) for k, v in s["rows"]]
        at += len(props)
        old = space.tags[tag]
        new = _rows(session, props, ["_vid"], rows, old, schema)
        space = replace(space, tags={**space.tags, tag: _last_wins(old, new, ["_vid"], s["keep"])})
    return space


def insert_edges(session, s) -> Space:
    """INSERT EDGE: the key is source, destination and rank."""
    space = session.space
    ((name, props),) = s["heads"]
    if name not in space.edges:
        raise SemanticError(f"no edge type named {name}")
    schema = space.schemas[("edge", name)]
    props = schema.names() if props is None else props
    old = space.edges[name]
    new = _rows(session, props, ["_src", "_dst", "_rank"], s["rows"], old, schema)
    return replace(space, edges={**space.edges, name: _last_wins(old, new, ["_src", "_dst", "_rank"], s["keep"])})


def update(session, s) -> tuple[Space, DataFrame | None]:
    """UPDATE and UPSERT: a row is changed if it exists and the condition holds; UPSERT makes a missing one from defaults."""
    space, name = session.space, s["on"]
    tables = space.tags if s["vertex"] else space.edges
    if name not in tables:
        raise SemanticError(f"no {'tag' if s['vertex'] else 'edge type'} named {name}")
    old, schema = tables[name], space.schemas[("tag" if s["vertex"] else "edge", name)]
    keys = ["_vid"] if s["vertex"] else ["_src", "_dst", "_rank"]
    plain = Scope(parameters=session.parameters)
    wanted = [compile_expr(k, plain).col.cast(old.schema[c].dataType) for k, c in zip(s["key"], keys, strict=True)]
    match = None
    for k, w in zip(keys, wanted, strict=True):
        match = (F.col(k) == w) if match is None else match & (F.col(k) == w)
    kinds = {f.name: V.kind_of(f.dataType) for f in old.schema}

    def special(e: Expr) -> Typed | None:
        if e.op == "attr" and e.args[0] == Expr("name", (name,)):
            return Typed(F.col(e.args[1]), *kinds[e.args[1]])
        return None

    scope = Scope({c: Typed(F.col(c), *kinds[c]) for c in schema.names()}, special, session.parameters)
    base = old
    if s["upsert"]:
        one = session.spark.range(1).select(*(w.alias(k) for k, w in zip(keys, wanted, strict=True)))
        fill = _defaults(schema, list(s["set"]), old)
        for c in s["set"]:
            fill[c] = F.lit(next((p.default for p in schema.properties if p.name == c and p.has_default), None)).cast(old.schema[c].dataType)
        missing = one.join(old.where(match).select(*keys), keys, "left_anti")
        base = old.unionByName(missing.select(*keys, *(v.alias(k) for k, v in fill.items())).select(*old.columns))
    for c in s["set"]:
        if c not in schema.names():
            raise SemanticError(f"{name} has no property {c}")
    cond = match if s["when"] is None else match & V.is_true(compile_expr(s["when"], scope).col)
    cols = [F.when(cond, compile_expr(s["set"][c], scope).col.cast(old.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in s["set"] else F.col(c) for c in old.columns]
    new = base.select(*cols)
    changed = {**tables, name: new}
    space = replace(space, tags=changed) if s["vertex"] else replace(space, edges=changed)
    out = None
    if s["yield"]:
        out = session.finish(new.where(match), s["yield"]["columns"], scope)
    return space, out


def delete_vertices(space: Space, ids: DataFrame, with_edges: bool = False) -> Space:
    """Remove vertices from all tags, and the edges at them on request; null ids are passed over."""
    ids = ids.where("_vid is not null").distinct()
    tags = {n: t.join(ids, "_vid", "left_anti") for n, t in space.tags.items()}
    edges = space.edges
    if with_edges:
        edges = {}
        for n, e in space.edges.items():
            for c in ("_src", "_dst"):
                e = e.join(ids.select(F.col("_vid").alias(c)), c, "left_anti")
            edges[n] = e.select(*space.edges[n].columns)
    return replace(space, tags=tags, edges=edges)


def delete_tags(space: Space, names: list[str], ids: DataFrame) -> Space:
    """Remove the given tags from vertices."""
    for n in names:
        if n not in space.tags:
            raise SemanticError(f"no tag named {n}")
    ids = ids.where("_vid is not null").distinct()
    return replace(space, tags={n: t.join(ids, "_vid", "left_anti") if n in names else t for n, t in space.tags.items()})


def delete_edges(space: Space, name: str, keys: DataFrame) -> Space:
    """Remove edges by key."""
    if name not in space.edges:
        raise SemanticError(f"no edge type named {name}")
    e = space.edges[name]
    return replace(space, edges={**space.edges, name: e.join(keys, ["_src", "_dst", "_rank"], "left_anti").select(*e.columns)})
