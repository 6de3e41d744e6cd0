"""Run statements against a catalog of spaces."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom import values as V
from pathloom.operators import joins, mutate, paths, relational, setops, subgraph, traverse
from pathloom.operators.aggregate import aggregate
from pathloom.plans import catalog_statements, patterns
from pathloom.plans.ast import Column, Expr, Statement
from pathloom.plans.expressions import Scope, compile_expr, constant, is_aggregate
from pathloom.plans.parser import parse
from pathloom.sources.space import Space
from pathloom.values import SemanticError, Typed

_GRAPH_FIELDS = {"_src": "_from", "_dst": "_to", "_rank": "_rank", "_type": "_type"}


class Session:
    """A connection: spaces by name, the one in use, and variables that hold results."""

    def __init__(self, spark: SparkSession, space: Space | None = None, parameters: dict[str, object] | None = None):
        self.spark = spark
        self.spaces: dict[str, Space] = {space.name: space} if space else {}
        self.current = space.name if space else None
        self.variables: dict[str, DataFrame] = {}
        self.parameters = dict(parameters or {})
        # values of the type time need it
        self.spark.conf.set("spark.sql.timeType.enabled", "true")

    @property
    def space(self) -> Space:
        if self.current is None:
            raise SemanticError("no space is in use")
        return self.spaces[self.current]

    def replace_space(self, space: Space) -> None:
        """Put a changed space in place of the one of its name; what it declared of its edges' ends may no longer hold."""
        options = {k: v for k, v in space.options.items() if k != "closed"}
        self.spaces[space.name] = replace(space, options=options)

    def execute(self, text: str) -> DataFrame | None:
        """Run all statements of a text; the result of the last one."""
        out = None
        for s in parse(text):
            out = self.run(s)
        return out

    # -- dispatch -------------------------------------------------------------------
    def run(self, s: Statement, piped: DataFrame | None = None) -> DataFrame | None:
        """Run one statement; ``piped`` holds the rows that ``$-`` names."""
        method = getattr(self, f"r_{s.kind}", None)
        if method is None:
            return catalog_statements.run(self, s)
        return method(s, piped)

    def r_pipe(self, s, piped):
        return self.run(s["right"], self.run(s["left"], piped))

    def r_assign(self, s, piped):
        self.variables[s["name"]] = self.run(s["of"], piped)
        return self.variables[s["name"]]

    def r_set(self, s, piped):
        return getattr(setops, s["op"])(self.run(s["left"], piped), self.run(s["right"], piped))

    def r_explain(self, s, piped):
        from pathloom.plans.explain import describe

        return describe(self.spark, s["of"], self.run(s["of"], piped), s["format"], s["profile"])

    # -- rows and names ----------------------------------------------------------------
    def input_scope(self, df: DataFrame | None, special=None) -> Scope:
        """``$-.x`` and ``$v.x`` name columns of ``df``."""
        kinds = {f.name: Typed(F.col(f"`{f.name}`"), *V.kind_of(f.dataType)) for f in df.schema} if df is not None else {}

        def resolve(e: Expr) -> Typed | None:
            if special:
                got = special(e)
                if got is not None:
                    return got
            if e.op in ("input", "variable"):
                name = e.args[0] if e.op == "input" else e.args[1]
                if name not in kinds:
                    raise SemanticError(f"no input column named {name}")
                return kinds[name]
            return None

        return Scope(dict(kinds), resolve, self.parameters)

    def source(self, e: list[Expr], piped: DataFrame | None) -> tuple[DataFrame, str, DataFrame | None]:
        """Start ids of a clause: a one-column frame, its column, and the input rows they come from."""
        if len(e) == 1 and e[0].op in ("input", "variable"):
            rows = piped if e[0].op == "input" else self.variables.get(e[0].args[0])
            if rows is None:
                raise SemanticError("there is no input to take ids from")
            name = e[0].args[-1]
            if name not in rows.columns:
                raise SemanticError(f"no input column named {name}")
            return rows.select(F.col(f"`{name}`").alias("_vid")), "_vid", rows
        cols = [compile_expr(x, Scope(parameters=self.parameters)) for x in e]
        kind = "long" if self.space.vid_type.startswith("int") else "string"
        ids = self.spark.range(1).select(F.explode(F.array_distinct(F.array(*(c.col.cast(kind) for c in cols)))).alias("_vid"))
        known = [c.literal for c in cols] if all(c.is_literal and c.literal is not None for c in cols) else None
        return traverse.given(ids, [int(x) if kind == "long" else str(x) for x in known] if known else None), "_vid", None

    def finish(self, df: DataFrame, columns: list[Column], scope: Scope, distinct: bool = False, allow_star: DataFrame | None = None) -> DataFrame:
        """Project the yielded columns, grouping by those without aggregates if any has one."""
        wide: list[Column] = []
        for c in columns:
            if c.expr.op == "star" and allow_star is not None:
                wide += [Column(Expr("input", (n,)), n) for n in allow_star.columns]
            else:
                wide.append(c)
        names = [c.alias for c in wide]
        if len(set(names)) < len(names):
            raise SemanticError(f"duplicate column names: {names}")
        compiled = {c.alias: compile_expr(c.expr, scope).col for c in wide}
        if any(is_aggregate(c.expr) for c in wide):
            keys = {c.alias: compiled[c.alias] for c in wide if not is_aggregate(c.expr)}
            out = aggregate(df, keys, {c.alias: compiled[c.alias] for c in wide if is_aggregate(c.expr)}).select(*(F.col(f"`{n}`") for n in names))
        else:
            out = relational.project(df, compiled)
        return out.distinct() if distinct else out

    # -- relational statements -----------------------------------------------------------
    def r_yield(self, s, piped):
        uses = [x for c in s["columns"] for x in c.expr.walk()] + (list(s["where"].walk()) if s["where"] else [])
        variables = {x.args[0] for x in uses if x.op == "variable"}
        if len(variables) > 1:
            raise SemanticError("only one variable can be yielded from")
        df = self.variables.get(next(iter(variables))) if variables else piped if any(x.op in ("input", "star") for x in uses) and piped is not None else self.spark.range(1).select(F.lit(1).alias("__one")) if piped is None else piped
        if df is None:
            raise SemanticError("unknown variable")
        scope = self.input_scope(df)
        if s["where"]:
            df = relational.where(df, compile_expr(s["where"], scope).col)
        return self.finish(df, s["columns"], scope, s["distinct"], allow_star=df)

    def r_yield_join(self, s, piped):
        a, b = self.variables.get(s["left"]), self.variables.get(s["right"])
        if a is None or b is None:
            raise SemanticError("unknown variable in a join")
        if s["left"] == s["right"]:
            raise SemanticError("a variable cannot be joined with itself")
        on = s["on"]
        if on.op != "==" or any(x.op != "variable" for x in on.args):
            raise SemanticError("a join needs an equality of two variables' columns")
        keys = {x.args[0]: x.args[1] for x in on.args}
        left = a.select(*(F.col(f"`{c}`").alias(f"{s['left']}.{c}") for c in a.columns))
        right = b.select(*(F.col(f"`{c}`").alias(f"{s['right']}.{c}") for c in b.columns))
        cond = F.col(f"`{s['left']}.{keys[s['left']]}`").eqNullSafe(F.col(f"`{s['right']}.{keys[s['right']]}`"))
        df = left.join(right, cond, s["how"])
        kinds = {f.name: Typed(F.col(f"`{f.name}`"), *V.kind_of(f.dataType)) for f in df.schema}
        scope = Scope({}, lambda e: kinds.get(f"{e.args[0]}.{e.args[1]}") if e.op == "variable" else None, self.parameters)
        return self.finish(df, s["columns"], scope, s["distinct"])

    def r_group(self, s, piped):
        if piped is None:
            raise SemanticError("GROUP BY needs an input")
        scope = self.input_scope(piped)
        keys = [compile_expr(k, scope).col for k in s["keys"]]
        names = [f"__k{n}" for n in range(len(keys))]
        items, firsts = {}, {}
        for c in s["yield"]["columns"]:
            if is_aggregate(c.expr):
                items[c.alias] = compile_expr(c.expr, scope).col
            elif c.expr in s["keys"]:
                firsts[c.alias] = F.col(names[s["keys"].index(c.expr)])
            else:
                # neither key nor aggregate: some row's value
                items[c.alias] = F.last(compile_expr(c.expr, scope).col)
        out = piped.groupBy(*(k.alias(n) for k, n in zip(keys, names, strict=True))).agg(*(v.alias(n) for n, v in items.items()), F.count(F.lit(1)).alias("__n"))
        out = out.select(*(firsts[c.alias].alias(c.alias) if c.alias in firsts else F.col(f"`{c.alias}`") for c in s["yield"]["columns"]))
        return out.distinct() if s["yield"]["distinct"] else out

    def r_order(self, s, piped):
        if piped is None:
            raise SemanticError("ORDER BY needs an input")
        scope = self.input_scope(piped)
        return piped.orderBy(*(V.ordering(compile_expr(e, scope).col, d) for e, d in s["factors"]))

    def r_limit(self, s, piped):
        if piped is None:
            raise SemanticError("LIMIT needs an input")
        return piped.offset(s["offset"]) if s["count"] is None else relational.limit(piped, s["count"], s["offset"])

    def r_sample(self, s, piped):
        return relational.sample(piped, s["count"])

    def r_unwind(self, s, piped):
        df = piped if piped is not None else self.spark.range(1).select(F.lit(1).alias("__one"))
        x = compile_expr(s["expr"], self.input_scope(df))
        return relational.unwind(df, x.col, s["alias"], x.kind == "list", keep=False)

    # -- traversal statements ------------------------------------------------------------
    def r_go(self, s, piped):
        space, over = self.space, s["over"]
        start, vid, rows = self.source(s["from"], piped)
        types = space.edge_types(over["types"])
        first, last = s["first"], s["last"]
        columns = s["yield"]["columns"] if s["yield"] else [Column(Expr("attr", (Expr("name", (types[0],)), "_dst")), f"{types[0]}._dst")]
        uses = [x for c in columns for x in c.expr.walk()] + (list(s["where"].walk()) if s["where"] else [])
        whole = any(x == Expr("name", ("edge",)) for x in uses)
        props = list(dict.fromkeys(x.args[1] for x in uses if x.op == "attr" and x.args[0].op == "name" and x.args[0].args[0] in types and not x.args[1].startswith("_")))
        if any(x.op == "call" and x.args[0].lower() == "properties" for x in uses):
            props = None
        view = space.edge_view(types, over["direction"], props)
        needs_input = rows is not None and any(x.op in ("input", "variable") for x in uses)
        df = traverse.expand_all(view, start, first, last, vid, origin=needs_input, step_limits=s["limits"], step_samples=s["samples"])
        if last == 0:
            df = df.limit(0)
        if needs_input:
            name = s["from"][0].args[-1]
            keyed = rows.select(*(F.col(f"`{c}`").alias(f"__in_{c}") for c in rows.columns))
            df = df.join(keyed, df["_origin"].eqNullSafe(F.col(f"`__in_{name}`")))
        for op, at in (("source", "_from"), ("target", "_to")):
            wanted: dict[str, dict[str, str]] = {}
            for x in uses:
                if x.op == op:
                    wanted.setdefault(x.args[0], {})[x.args[1]] = f"__{op}_{x.args[0]}_{x.args[1]}"
            for tag, cols in wanted.items():
                df = space.with_tag_columns(df, at, tag, cols)
        for op, at in (("source_vertex", "_from"), ("target_vertex", "_to")):
            if any(x.op == op and not self._only_ids(columns, s["where"], op) for x in uses):
                df = space.vertex_values(df, at, f"__{op}")
        kinds = {f.name: V.kind_of(f.dataType) for f in df.schema}
        edge_kinds = {p: kinds[p][0] for p in view.columns if p in kinds}

        def col(name: str) -> Typed:
            return Typed(F.col(f"`{name}`"), *kinds[name])

        def special(e: Expr) -> Typed | None:
            if e.op == "attr" and e.args[0].op == "name" and e.args[0].args[0] in types:
                kind, name = e.args[0].args[0], e.args[1]
                if name in _GRAPH_FIELDS:
                    c = col(_GRAPH_FIELDS[name])
                else:
                    if name not in space.edges[kind].columns:
                        raise SemanticError(f"edge type {kind} has no property {name}")
                    c = col(name)
                return c if len(types) == 1 else Typed(F.when(F.col("_type") == kind, c.col), c.kind)
            if e == Expr("name", ("edge",)):
                extra = [c for c in view.columns if not c.startswith("_")]
                pairs = [x for p in extra for x in (F.lit(p), F.col(f"`{p}`").cast("string"))]
                bag = F.map_filter(F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>"), lambda k, v: v.isNotNull())
                return Typed(F.struct("_type", "_src", "_dst", "_rank", "_dir", *extra, bag.alias("_props")), "edge", info=edge_kinds)
            if e.op in ("source", "target"):
                return col(f"__{e.op}_{e.args[0]}_{e.args[1]}")
            if e.op in ("source_vertex", "target_vertex"):
                at = "_from" if e.op == "source_vertex" else "_to"
                return Typed(F.col(f"__{e.op}") if f"__{e.op}" in kinds else F.struct(F.col(at).alias("_vid")), "vertex", info=space.property_types())
            if e.op in ("input", "variable"):
                name = f"__in_{e.args[-1]}"
                if name not in kinds:
                    raise SemanticError(f"no input column named {e.args[-1]}")
                return col(name)
            return None

        scope = Scope({}, special, self.parameters)
        if s["where"]:
            df = relational.where(df, compile_expr(s["where"], scope).col)
        return self.finish(df, columns, scope, bool(s["yield"] and s["yield"]["distinct"]))

    @staticmethod
    def _only_ids(columns, where, op) -> bool:
        """Whether vertices are used for their ids alone, so that no tag needs to be read."""
        roots = [c.expr for c in columns] + ([where] if where else [])
        total = sum(x.op == op for r in roots for x in r.walk())
        ids = sum(x.op == "call" and x.args[0].lower() == "id" and x.args[1] and x.args[1][0].op == op for r in roots for x in r.walk())
        return total == ids

    def r_lookup(self, s, piped):
        space, name = self.space, s["on"]
        if name in space.tags:
            df, graph = space.tag(name), {"id": "_vid"}
        elif name in space.edges:
            df, graph = space.edge(name), {"_src": "_src", "_dst": "_dst", "_rank": "_rank"}
        else:
            raise SemanticError(f"no tag or edge type named {name}")
        is_tag = name in space.tags
        score = any(x.op == "call" and x.args[0].lower() == "es_query" for x in (s["where"].walk() if s["where"] else []))
        if score:
            from pathloom.sources.fulltext import es_query

            index, query = (s["where"].args[1][0].args[0], constant(s["where"].args[1][1], self.parameters))
            df = es_query(self, space, name, index, query)
        scope = self._row_scope(df, name, is_tag)
        if s["where"] and not score:
            df = relational.where(df, compile_expr(s["where"], scope).col)
        if not s["yield"]:
            return df.select(*(F.col(c).alias(k) for k, c in graph.items()))
        return self.finish(df, s["yield"]["columns"], scope, s["yield"]["distinct"])

    def _row_scope(self, df: DataFrame, name: str, is_tag: bool, bare: bool = False) -> Scope:
        kinds = {f.name: V.kind_of(f.dataType) for f in df.schema}
        props = [c for c in df.columns if not c.startswith("_") and c != "score"]
        pairs = [x for p in props for x in (F.lit(p), F.col(f"`{p}`").cast("string"))]
        bag = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")

        def special(e: Expr) -> Typed | None:
            if e.op == "attr" and e.args[0] == Expr("name", (name,)):
                if e.args[1] not in kinds:
                    raise SemanticError(f"{name} has no property {e.args[1]}")
                return Typed(F.col(f"`{e.args[1]}`"), *kinds[e.args[1]])
            if is_tag and e == Expr("name", ("vertex",)):
                return Typed(F.struct(F.col("_vid").alias("_vid"), F.create_map(F.lit(name), bag).alias("_tags")), "vertex", info=self.space.property_types())
            if not is_tag and e == Expr("name", ("edge",)):
                return Typed(F.struct(F.lit(name).alias("_type"), "_src", "_dst", "_rank", F.lit(1).alias("_dir"), *props, bag.alias("_props")), "edge", info={p: kinds[p][0] for p in props})
            return None

        names = {f.name: Typed(F.col(f"`{f.name}`"), *V.kind_of(f.dataType)) for f in df.schema} if bare else {}
        return Scope(names, special, self.parameters)

    def r_fetch_vertices(self, s, piped):
        space = self.space
        start, vid, _ = self.source(s["from"], piped)
        ids = start.where("_vid is not null").distinct()
        known = getattr(start, "_given_ids", None)
        if known is not None:
            # listed ids become a filter on the scans
            space = replace(space, tags={n: t.where(F.col("_vid").isin(known)) for n, t in space.tags.items()})
        tags = list(space.tags) if s["on"] == ["*"] else s["on"]
        uses = [x for c in (s["yield"]["columns"] if s["yield"] else []) for x in c.expr.walk()]
        if s["yield"] and len(tags) == 1 and not any(x == Expr("name", ("vertex",)) for x in uses):
            df = space.tag(tags[0]) if known is not None else space.tag(tags[0]).join(ids, "_vid", "left_semi")
            return self.finish(df, s["yield"]["columns"], self._row_scope(df, tags[0], True), s["yield"]["distinct"])
        for t in tags:
            space.tag(t)
        narrow = replace(space, tags={t: space.tags[t] for t in tags})
        df = ids.join(narrow.vertices(), "_vid", "left_semi")
        df = narrow.vertex_values(df, "_vid", "__vertex")
        for t in tags:
            cols = {x.args[1]: f"__{t}_{x.args[1]}" for x in uses if x.op == "attr" and x.args[0] == Expr("name", (t,))}
            if cols:
                df = space.with_tag_columns(df, "_vid", t, cols)
        kinds = {f.name: V.kind_of(f.dataType) for f in df.schema}

        def special(e: Expr) -> Typed | None:
            if e.op == "attr" and e.args[0].op == "name" and e.args[0].args[0] in tags:
                n = f"__{e.args[0].args[0]}_{e.args[1]}"
                return Typed(F.col(f"`{n}`"), *kinds[n])
            return Typed(F.col("__vertex"), "vertex", info=space.property_types()) if e == Expr("name", ("vertex",)) else None

        columns = s["yield"]["columns"] if s["yield"] else [Column(Expr("name", ("vertex",)), "vertices_")]
        return self.finish(df, columns, Scope({}, special, self.parameters), bool(s["yield"] and s["yield"]["distinct"]))

    def edge_keys(self, keys: list[tuple], piped: DataFrame | None) -> DataFrame:
        """Edge keys as ``_src, _dst, _rank`` rows, from constants or input columns."""
        kind = "long" if self.space.vid_type.startswith("int") else "string"
        out = None
        for key in keys:
            refs = [k for k in key if k.op in ("input", "variable")]
            df = self.spark.range(1) if not refs else piped if refs[0].op == "input" else self.variables[refs[0].args[0]]
            scope = self.input_scope(df)
            src, dst, rank = (compile_expr(k, scope).col for k in key)
            one = df.select(src.cast(kind).alias("_src"), dst.cast(kind).alias("_dst"), rank.cast("long").alias("_rank"))
            out = one if out is None else out.union(one)
        return out.distinct()

    def r_fetch_edges(self, s, piped):
        if len(s["on"]) != 1:
            raise SemanticError("edges of one type are fetched at a time")
        name = s["on"][0]
        table = self.space.edge(name)
        if all(k[0].op not in ("input", "variable") for k in s["keys"]):
            from_ids = [compile_expr(k[0], self.input_scope(None)) for k in s["keys"]]
            if all(c.is_literal and c.literal is not None for c in from_ids):
                table = table.where(F.col("_src").isin([c.literal for c in from_ids]))
        df = table.join(self.edge_keys(s["keys"], piped), ["_src", "_dst", "_rank"], "left_semi")
        columns = s["yield"]["columns"] if s["yield"] else [Column(Expr("name", ("edge",)), "edges_")]
        return self.finish(df, columns, self._row_scope(df, name, False), bool(s["yield"] and s["yield"]["distinct"]))

    def _edge_filter(self, view: DataFrame, where: Expr | None, types: list[str]):
        if where is None:
            return None
        kinds = {f.name: V.kind_of(f.dataType) for f in view.schema}

        def special(e: Expr) -> Typed | None:
            if e.op == "attr" and e.args[0].op == "name" and e.args[0].args[0] in types:
                n = _GRAPH_FIELDS.get(e.args[1], e.args[1])
                if n not in kinds:
                    raise SemanticError(f"no edge property {e.args[1]}")
                c = Typed(F.col(f"`{n}`"), *kinds[n])
                # a filter on one type leaves the others alone only if it is true for them
                return c if len(types) == 1 else Typed(F.when(F.col("_type") == e.args[0].args[0], c.col), c.kind)
            return None

        return compile_expr(where, Scope({}, special, self.parameters)).col

    def r_find_path(self, s, piped):
        space, over = self.space, s["over"]
        types = space.edge_types(over["types"])
        src, a, _ = self.source(s["from"], piped)
        dst, b, _ = self.source(s["to"], piped)
        uses = list(s["where"].walk()) if s["where"] else []
        props = None if s["props"] else [x.args[1] for x in uses if x.op == "attr" and not x.args[1].startswith("_")]
        view = space.edge_view(types, over["direction"], props)
        keep = [c for c in view.columns if not c.startswith("_")] if s["props"] else []
        cond = self._edge_filter(view, s["where"], types)
        view = view.where(cond) if cond is not None else view
        if s["kind"] == "shortest":
            df = paths.shortest_paths(view, src, dst, s["steps"], a, b, single=s["single"], props=keep)
        else:
            df = paths.all_paths(view, src, dst, s["steps"], a, b, no_loop=s["kind"] == "noloop", props=keep)
        if s["props"]:
            df = space.path_values(df)
            value = F.struct("_nodes", "_rels")
        else:
            value = F.struct(F.transform("_nodes", lambda v: F.struct(v.alias("_vid"))).alias("_nodes"), F.col("_rels"))
        scope = Scope({"path": Typed(value, "path")}, lambda e: None, self.parameters)
        columns = s["yield"]["columns"] if s["yield"] else [Column(Expr("name", ("path",)), "path")]
        return self.finish(df, columns, scope)

    def r_subgraph(self, s, piped):
        space = self.space
        start, vid, _ = self.source(s["from"], piped)
        given = {k: s[k] for k in ("in", "out", "both")}
        if not any(given.values()):
            given["both"] = list(space.edges)
        ways: dict[str, set[str]] = {}
        for k, names in given.items():
            for n in space.edge_types(names) if names else []:
                ways.setdefault(n, set()).update(("in", "out") if k == "both" else (k,))
        uses = list(s["where"].walk()) if s["where"] else []
        props = None if s["props"] else list(dict.fromkeys(x.args[1] for x in uses if x.op == "attr" and not x.args[1].startswith("_")))
        view = None
        for n, w in ways.items():
            one = space.edge_view([n], "both" if len(w) == 2 else next(iter(w)), [p for p in props if p in space.edges[n].columns] if props is not None else None)
            view = one if view is None else view.unionByName(one, allowMissingColumns=True)
        cond = self._edge_filter(view, s["where"], list(ways))
        nodes, edges = subgraph.subgraph(view, start, s["steps"], vid, [n for n, w in ways.items() if len(w) == 2], cond)
        extra = [c for c in view.columns if not c.startswith("_")]
        nodes = space.vertex_values(nodes, "_vid", "__v") if s["props"] else nodes.withColumn("__v", F.struct(F.col("_vid").alias("_vid")))
        vs = nodes.groupBy("_step").agg(F.collect_list("__v").alias("__vs"))
        es = edges.groupBy("_step").agg(F.collect_list(F.struct("_type", "_src", "_dst", "_rank", "_dir", *extra)).alias("__es"))
        kind = F.array().cast(es.schema["__es"].dataType)
        df = vs.join(es, "_step", "left").select("_step", "__vs", F.coalesce("__es", kind).alias("__es")).orderBy("_step")
        scope = Scope({"VERTICES": Typed(F.col("__vs"), "list", "vertex"), "EDGES": Typed(F.col("__es"), "list", "edge"), "vertices": Typed(F.col("__vs"), "list", "vertex"), "edges": Typed(F.col("__es"), "list", "edge")}, parameters=self.parameters)
        columns = s["yield"]["columns"] if s["yield"] else [Column(Expr("name", ("vertices",)), "nodes"), Column(Expr("name", ("edges",)), "relationships")]
        return self.finish(df, columns, scope)

    # -- pattern statements ---------------------------------------------------------------
    def r_cypher(self, s, piped):
        return patterns.run(self, s["clauses"])

    # -- mutation ---------------------------------------------------------------------------
    def r_insert_vertex(self, s, piped):
        self.replace_space(mutate.insert_vertices(self, s))

    def r_insert_edge(self, s, piped):
        self.replace_space(mutate.insert_edges(self, s))

    def r_update(self, s, piped):
        space, out = mutate.update(self, s)
        self.replace_space(space)
        return out

    def r_delete_vertex(self, s, piped):
        ids, _, _ = self.source(s["from"], piped)
        self.replace_space(mutate.delete_vertices(self.space, ids, s["with_edge"]))

    def r_delete_tag(self, s, piped):
        ids, _, _ = self.source(s["from"], piped)
        self.replace_space(mutate.delete_tags(self.space, list(self.space.tags) if s["on"] == ["*"] else s["on"], ids))

    def r_delete_edge(self, s, piped):
        self.replace_space(mutate.delete_edges(self.space, s["on"], self.edge_keys(s["keys"], piped)))

    def r_yield_rows(self, s, piped):
        return joins.natural(self.run(s["left"], piped), self.run(s["right"], piped))
