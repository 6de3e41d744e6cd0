"""Catalog statements: spaces, tags, edge types, indexes and what is shown of them.

Indexes are declarations only: scans push predicates into the files, so there is nothing to build.
"""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.plans.expressions import Scope, compile_expr, constant
from pathloom.sources.space import Property, Schema, Space
from pathloom.values import SemanticError

_TYPES = {
    "bool": "boolean", "int8": "byte", "int16": "short", "int32": "int", "int64": "long", "int": "long", "float": "float", "double": "double", "string": "string",
    "date": "date", "time": "time(6)", "datetime": "timestamp_ntz", "timestamp": "long", "duration": "struct<months:bigint,seconds:bigint,micros:bigint>", "geography": "string",
}


def spark_type(declared: str) -> str:
    """Spark type of a declared property type."""
    base = declared.lower()
    m = re.fullmatch(r"(list|set)<(\w+)>", base)
    if m:
        return f"array<{spark_type(m[2])}>"
    if base.startswith(("fixed_string", "geography")):
        return "string"
    if base not in _TYPES:
        raise SemanticError(f"unknown type: {declared}")
    return _TYPES[base]


def run(session, s) -> DataFrame | None:
    """Run a catalog statement."""
    rule = globals().get(f"_{s.kind}")
    if rule is None:
        raise SemanticError(f"cannot run {s.kind}")
    return rule(session, s)


def _frame(session, names: list[str], rows: list[tuple]) -> DataFrame:
    return session.spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows], ", ".join(f"`{n}` string" for n in names))


def _use(session, s):
    if s["name"] not in session.spaces:
        raise SemanticError(f"no space named {s['name']}")
    session.current = s["name"]


def _create_space(session, s):
    if s["name"] in session.spaces:
        if s["keep"]:
            return
        raise SemanticError(f"space {s['name']} exists")
    if s["as"]:
        like = session.spaces.get(s["as"])
        if like is None:
            raise SemanticError(f"no space named {s['as']}")
        session.spaces[s["name"]] = _cleared(replace(like, name=s["name"]))
        return
    options = dict(s["options"])
    vid = options.get("vid_type", "fixed_string(8)")
    session.spaces[s["name"]] = Space(session.spark, s["name"], "int64" if vid.startswith("int") else "string", options={"vid_type": vid} | options)


def _alter_space(session, s):
    """Change a space's options; the type of its ids is fixed."""
    space = session.spaces.get(s["name"])
    if space is None:
        raise SemanticError(f"no space named {s['name']}")
    if "vid_type" in s["options"]:
        raise SemanticError("the type of vertex ids cannot be changed")
    session.spaces[s["name"]] = replace(space, options={**space.options, **s["options"]})


def _cleared(space: Space) -> Space:
    return replace(space, tags={n: t.limit(0) for n, t in space.tags.items()}, edges={n: t.limit(0) for n, t in space.edges.items()})


def _clear_space(session, s):
    if s["name"] not in session.spaces:
        if s["keep"]:
            return
        raise SemanticError(f"no space named {s['name']}")
    session.spaces[s["name"]] = _cleared(session.spaces[s["name"]])


def _declared(session, p: dict) -> Property:
    has = "default" in p
    value = None
    if has:
        try:
            value = constant(p["default"], session.parameters)
        except SemanticError:
            value = session.spark.range(1).select(compile_expr(p["default"], Scope()).col).head()[0]
    return Property(p["name"], p["type"], p["nullable"], value, has, p.get("comment", ""))


def _empty(session, kind: str, schema: Schema, space: Space) -> DataFrame:
    vid = "long" if space.vid_type.startswith("int") else "string"
    head = f"_vid {vid}" if kind == "tag" else f"_src {vid}, _dst {vid}, _rank long"
    return session.spark.createDataFrame([], ", ".join([head, *(f"`{p.name}` {spark_type(p.type)}" for p in schema.properties)]))


def _create_schema(session, s):
    space, kind, name = session.space, s["kind"], s["name"]
    tables = space.tags if kind == "tag" else space.edges
    if name in space.tags or name in space.edges:
        if s["keep"] and name in tables:
            return
        raise SemanticError(f"{name} exists")
    schema = Schema(name, tuple(_declared(session, p) for p in s["props"]), s["ttl"].get("ttl_col"), int(s["ttl"].get("ttl_duration", 0)), comment=str(s["ttl"].get("comment", "")))
    if schema.ttl_column and schema.ttl_column not in schema.names():
        raise SemanticError("the TTL column must be a property")
    df = _empty(session, kind, schema, space)
    session.replace_space(space.with_tag(name, df, schema=schema) if kind == "tag" else space.with_edge(name, df, schema=schema))


def _alter_schema(session, s):
    space, kind, name = session.space, s["kind"], s["name"]
    tables = dict(space.tags if kind == "tag" else space.edges)
    schema = space.schemas.get((kind, name))
    if schema is None:
        raise SemanticError(f"no {kind} named {name}")
    df, props = tables[name], list(schema.properties)
    for what, items in s["changes"]:
        for item in items:
            pname = item if what == "drop" else item["name"]
            at = next((k for k, p in enumerate(props) if p.name == pname), None)
            if what == "add":
                if at is not None:
                    raise SemanticError(f"property {pname} exists")
                p = _declared(session, item)
                df = df.withColumn(pname, F.lit(p.default).cast(spark_type(p.type)))
                props.append(p)
            elif at is None:
                raise SemanticError(f"no property {pname}")
            elif what == "drop":
                df = df.drop(pname)
                del props[at]
            else:
                p = _declared(session, item)
                df = df.withColumn(pname, F.col(pname).try_cast(spark_type(p.type)))
                props[at] = p
    ttl = s["ttl"]
    schema = replace(schema, properties=tuple(props), version=schema.version + 1, ttl_column=ttl.get("ttl_col", schema.ttl_column) or None, ttl_seconds=int(ttl.get("ttl_duration", schema.ttl_seconds)))
    tables[name] = df
    space = replace(space, schemas={**space.schemas, (kind, name): schema})
    session.replace_space(replace(space, tags=tables) if kind == "tag" else replace(space, edges=tables))


def _drop(session, s):
    kind, name = s["kind"], s["name"]
    if kind == "space":
        found = session.spaces.pop(name, None)
        if found is not None and session.current == name:
            session.current = None
    elif kind == "index":
        found = session.space.indexes.get(name)
        session.replace_space(replace(session.space, indexes={k: v for k, v in session.space.indexes.items() if k != name}))
    else:
        space = session.space
        found = space.schemas.get((kind, name))
        tables = {k: v for k, v in (space.tags if kind == "tag" else space.edges).items() if k != name}
        space = replace(space, schemas={k: v for k, v in space.schemas.items() if k != (kind, name)})
        session.replace_space(replace(space, tags=tables) if kind == "tag" else replace(space, edges=tables))
    if found is None and not s["keep"]:
        raise SemanticError(f"no {kind} named {name}")


def _create_index(session, s):
    space = session.space
    if s["name"] in space.indexes:
        if s["keep"]:
            return
        raise SemanticError(f"index {s['name']} exists")
    schema = space.schemas.get((s["kind"], s["on"]))
    if schema is None:
        raise SemanticError(f"no {s['kind']} named {s['on']}")
    for f in s["fields"]:
        if f.split("(")[0] not in schema.names():
            raise SemanticError(f"{s['on']} has no property {f}")
    entry = {"kind": s["kind"], "on": s["on"], "fields": s["fields"], "fulltext": s["fulltext"]}
    session.replace_space(replace(space, indexes={**space.indexes, s["name"]: entry}))


def _describe(session, s):
    kind, name = s["kind"], s["name"]
    if kind == "space":
        sp = session.spaces.get(name)
        if sp is None:
            raise SemanticError(f"no space named {name}")
        return _frame(session, ["Name", "Vid Type", "Tags", "Edges"], [(name, sp.vid_type, len(sp.tags), len(sp.edges))])
    if kind == "index":
        index = session.space.indexes.get(name)
        if index is None:
            raise SemanticError(f"no index named {name}")
        schema = session.space.schemas[(index["kind"], index["on"])]
        types = {p.name: p.type for p in schema.properties}
        return _frame(session, ["Field", "Type"], [(f, types[f.split("(")[0]]) for f in index["fields"]])
    schema = session.space.schemas.get((kind, name))
    if schema is None:
        raise SemanticError(f"no {kind} named {name}")
    return _frame(session, ["Field", "Type", "Null", "Default", "Comment"], [(p.name, p.type, "YES" if p.nullable else "NO", p.default if p.has_default else None, p.comment or None) for p in schema.properties])


def _show(session, s):
    what = s["what"]
    if what == "spaces":
        return _frame(session, ["Name"], [(n,) for n in sorted(session.spaces)])
    if what in ("tags", "edges"):
        return _frame(session, ["Name"], [(n,) for n in sorted(session.space.tags if what == "tags" else session.space.edges)])
    if what in ("tag indexes", "edge indexes", "fulltext indexes"):
        rows = [(n, i["on"], ", ".join(i["fields"])) for n, i in sorted(session.space.indexes.items()) if i["fulltext"] == (what == "fulltext indexes") and (i["fulltext"] or i["kind"] == what.split()[0])]
        return _frame(session, ["Index Name", "By", "Columns"], rows)
    if what in ("tag index status", "edge index status"):
        return _frame(session, ["Name", "Index Status"], [(n, "FINISHED") for n, i in sorted(session.space.indexes.items()) if i["kind"] == what.split()[0]])
    if what == "stats":
        return stats(session.space)
    if what == "charset":
        return _frame(session, ["Charset", "Description", "Default collation", "Maxlen"], [("utf8", "UTF-8 Unicode", "utf8_bin", 4)])
    if what == "collation":
        return _frame(session, ["Collation", "Charset"], [("utf8_bin", "utf8")])
    raise SemanticError(f"cannot show {what}")


def stats(space: Space) -> DataFrame:
    """Rows of each tag and edge type, and all vertices and edges: ``Type, Name, Count``."""
    parts = []
    for kind, tables in (("Tag", space.tags), ("Edge", space.edges)):
        for n in sorted(tables):
            live = space.tag(n) if kind == "Tag" else space.edge(n)
            parts.append(live.agg(F.count(F.lit(1)).alias("Count")).select(F.lit(kind).alias("Type"), F.lit(n).alias("Name"), "Count"))
    if not parts:
        return space.spark.createDataFrame([], "Type string, Name string, Count long")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    vertices = space.vertices().agg(F.count(F.lit(1)).alias("Count")).select(F.lit("Space").alias("Type"), F.lit("vertices").alias("Name"), "Count")
    edges = out.where("Type = 'Edge'").agg(F.coalesce(F.sum("Count"), F.lit(0)).cast("long").alias("Count")).select(F.lit("Space").alias("Type"), F.lit("edges").alias("Name"), "Count")
    return out.union(vertices).union(edges)


def _submit_job(session, s):
    if s["what"] != "stats":
        raise SemanticError("only the stats job exists")
    return stats(session.space)


def _show_create(session, s):
    kind, name = s["kind"], s["name"]
    if kind == "space":
        sp = session.spaces[name]
        more = "".join(f", {k} = {v}" for k, v in sorted(sp.options.items()) if k not in ("vid_type", "closed"))
        text = f"CREATE SPACE `{name}` (vid_type = {sp.options.get('vid_type', sp.vid_type).upper()}{more})"
    elif kind == "index":
        i = session.space.indexes[name]
        text = f"CREATE {i['kind'].upper()} INDEX `{name}` ON `{i['on']}` ({', '.join(i['fields'])})"
    else:
        schema = session.space.schemas.get((kind, name))
        if schema is None:
            raise SemanticError(f"no {kind} named {name}")
        props = ",\n".join(f" `{p.name}` {p.type} {'NULL' if p.nullable else 'NOT NULL'}" + (f" DEFAULT {p.default!r}" if p.has_default else "") for p in schema.properties)
        text = f"CREATE {kind.upper()} `{name}` (\n{props}\n) ttl_duration = {schema.ttl_seconds}, ttl_col = \"{schema.ttl_column or ''}\""
    return _frame(session, [kind.capitalize(), f"Create {kind.capitalize()}"], [(name, text)])


def declared_type(t: T.DataType) -> str:
    """Declared type that a Spark type stands for."""
    return {"bigint": "int64", "int": "int32", "smallint": "int16", "tinyint": "int8", "boolean": "bool", "timestamp_ntz": "datetime"}.get(t.simpleString(), t.simpleString())
